"""Packets, reports and contexts as files. Every writer is a plain DataFrame write, so a task that runs again leaves no double."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.functions.text import redacted
from buildlens.operators import gates, packet


def write_packets(packets: DataFrame, path: str) -> None:
    """``json``: a packet in each line, keys in order; ``markdown``: log_id and text, redacted."""
    packets.select(gates.canonical_json(F.to_json(F.struct(*packets.columns))).alias("value")).write.text(f"{path}/json")
    packets.select("log_id", packet.markdown().alias("text")).write.parquet(f"{path}/markdown")


def write_json(rows: DataFrame, path: str) -> None:
    """A row in each line, keys in order."""
    rows.select(gates.canonical_json(F.to_json(F.struct(*rows.columns))).alias("value")).write.text(path)


def append_status(rows: DataFrame, path: str) -> DataFrame:
    """Append status rows (unit, status, reason, arch, at) that may be; returns the others with the reason."""
    checked = rows.withColumn("refused", gates.status_refused(F.col("status"), F.col("reason"), F.col("arch")))
    checked.filter("refused is null").drop("refused").write.mode("append").parquet(path)
    return checked.filter("refused is not null")


def append_events(events: DataFrame, path: str) -> DataFrame:
    """Append gate events (event_id, unit, event_type, payload) with the columns of their payload; returns those that have
    writers of their own."""
    result = F.get_json_object("payload", "$.result")
    checked = events.withColumn("refused", gates.append_refused(F.col("event_type"), result))
    rows = gates.gate_rows(events).join(checked.filter("refused is null").select("event_id", "unit", "event_type"), "event_id")
    rows.write.mode("append").parquet(path)
    return checked.filter("refused is not null")


def run_report(runs: DataFrame) -> DataFrame:
    """unit, report of finished runs (unit, state, verdict, error, packet, context): sections in order, empty ones left out."""
    part = lambda title, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"## {title}\n"), F.col(c)))
    return runs.select("unit", redacted(F.concat_ws("\n\n", F.concat(F.lit("# Run "), F.col("unit").cast("string")), part("State", "state"), part("Verdict", "verdict"), part("Error", "error"), part("Packet", "packet"), part("Context", "context"))).alias("report"))


def token_stats(files: DataFrame) -> DataFrame:
    """kind, files, tokens of files written (kind, text), and all together as kind ``total``."""
    from buildlens.functions.text import token_estimate

    n = files.select("kind", token_estimate(F.col("text")).alias("tokens"))
    return n.groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.sum("tokens").alias("tokens")).unionByName(n.agg(F.lit("total").alias("kind"), F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")))
