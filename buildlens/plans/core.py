"""Queries of the scanner and the ranking over the synthetic log relation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.functions.scratch import written
from buildlens.functions.stages import Stages
from buildlens.operators import rank, scan
from buildlens.plans.sql import chain
from buildlens.plans.synthetic import logl
from buildlens.streaming import scanner


def classified(spark, d) -> DataFrame:
    """Lines with what each says by itself, written: the lines and their parts' carries both read it."""
    return written(scan.classify(scan.normalise(logl(spark, d))), "classified")


def annotated(spark, d) -> DataFrame:
    return scan.annotate(classified(spark, d))


def linked(lines: DataFrame) -> DataFrame:
    """Events with parents and failed phase. The facts are written, as parents read them many times and would scan the log for each;
    so are the events, for the plans that do. Parents and phases are written first: few rows, whose size is then known before the
    join is planned, so that no event is shuffled for them while they are small."""
    facts = written(scan.events(lines), "facts")
    parents, phases = written(scan.parents_of(facts), "parents"), written(scan.failed_phases(facts), "phases")
    return written(scan.with_failed_phase(scan.with_parents(facts, parents), phases), "events")


def events(spark, d) -> DataFrame:
    """No text is written for these plans: what the events need of a line is in its fact."""
    said = scan.classify(scan.normalise(logl(spark, d))).drop("raw_text", "text", "gbs_seconds")
    return linked(scan.annotate(written(said, "classified")))


def scored_of(ev: DataFrame) -> DataFrame:
    return rank.scored(rank.classified(rank.warning_block(ev)))


def scored(spark, d) -> DataFrame:
    return scored_of(events(spark, d))


def scan_once(spark, d, stages: Stages) -> tuple[DataFrame, DataFrame]:
    """Annotated lines and scored events, written: for plans that read them many times."""
    lines = stages.run("lines", annotated(spark, d))
    return lines, stages.run("events", scored_of(linked(lines)))


def top_of(ev: DataFrame, k: int = 3) -> DataFrame:
    return rank.top_causes(scored_of(ev), k)


def top(spark, d, k: int = 3) -> DataFrame:
    return top_of(events(spark, d), k)


QUERIES = {
    "log_normalised": lambda s, d: scan.normalise(logl(s, d)).select("log_id", "line_no", "text", "gbs_seconds"),
    "log_offsets": lambda s, d: scan.with_offsets(logl(s, d)).select("log_id", "line_no", "raw_offset"),
    "log_phases": lambda s, d: scan.phases(annotated(s, d)),
    "log_commands": lambda s, d: scan.commands(annotated(s, d)).select("log_id", "id", "line_no", "phase", "n_lines", "argv_short", "tool"),
    "log_continuations": lambda s, d: annotated(s, d).filter("is_continuation").select("log_id", "line_no", "text"),
    "log_events": lambda s, d: scan.events(annotated(s, d)).drop("patch_total", "patch_line", "patch_file"),
    "log_events_replayed": lambda s, d: scanner.replayed(logl(s, d)),
    "events_by_kind": lambda s, d: scan.events(annotated(s, d)).groupBy("kind", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("log_id").alias("logs")),
    "failed_phase": lambda s, d: events(s, d).select("log_id", "failed_phase").distinct(),
    "event_command_join": lambda s, d: scan.events(annotated(s, d)).select("log_id", "id", "command_id").join(scan.commands(annotated(s, d)).select("log_id", F.col("id").alias("command_id"), "argv_short", F.col("tool").alias("command_tool")), ["log_id", "command_id"], "left").select("log_id", "id", "command_id", "argv_short", "command_tool"),
    "rpm_patch_parent": lambda s, d: events(s, d).filter("kind = 'rpm_phase'").select("log_id", "id", "exit_phase", "parent"),
    "cascade_parent": lambda s, d: scan.cascade_parents(scan.events(annotated(s, d))),
    "cascade_summary": lambda s, d: scan.cascade_summary(events(s, d)),
    "warning_block": lambda s, d: rank.warning_block(events(s, d)).select("log_id", "id", "in_warning_block"),
    "semantic_class": lambda s, d: rank.classified(events(s, d)).select("log_id", "id", "semantic_class", "context_satisfied", "base", "cascade"),
    "cause_score": lambda s, d: scored(s, d).select("log_id", "id", "score", "bucket", "band"),
    "confidence_band": lambda s, d: scored(s, d).groupBy("band").agg(F.count(F.lit(1)).alias("n")),
    "top3_causes": lambda s, d: top(s, d).select("log_id", "rank", "id", "kind", "semantic_class", "score", "band", "is_terminal", "summary"),
    "top_cause": lambda s, d: top(s, d, 1).select("log_id", "id", "kind", "semantic_class", F.round("score", 4).alias("confidence"), "band", "summary"),
}

SUMMARY = "kind || ' ' || semantic_class || CASE WHEN coalesce(file, '') <> '' AND coalesce(line, 0) <> 0 THEN ' at ' || file || ':' || line ELSE '' END || ' - ' || trim(message) AS summary"
COMMANDS = r"""cmd AS (
  SELECT log_id, command_no, min(line_no) AS line_no, max(CASE WHEN is_command THEN phase END) AS phase, count(*)::INTEGER AS n_lines, string_agg(nullif(part, ''), ' ' ORDER BY line_no) AS argv
  FROM (SELECT *, trim(regexp_replace(CASE WHEN is_command THEN regexp_extract(text, '^\+\s+(.+)', 1) ELSE text END, '\\\s*$', '')) AS part FROM annotated WHERE is_command OR is_continuation) GROUP BY ALL
), commands AS (
  SELECT *, 'C' || lpad(command_no::VARCHAR, greatest(3, length(command_no::VARCHAR))::INTEGER, '0') AS id, trim(regexp_replace(argv, '\s+', ' ', 'g')) AS argv_short,
  regexp_replace(regexp_extract(argv, '^\s*(\S+)', 1), '^.*/', '') AS tool FROM cmd
)"""
WITH_COMMANDS = lambda select: chain("events0", "").rstrip() + ", " + COMMANDS + " " + select
ORACLES = {
    "log_normalised": chain("plain", "SELECT log_id, line_no, text, gbs_seconds FROM plain"),
    "log_offsets": chain("logl", "SELECT log_id, line_no, coalesce(sum(strlen(raw_text) + 1) OVER (PARTITION BY log_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS raw_offset FROM logl"),
    "log_phases": chain("annotated", "SELECT log_id, marker AS phase, line_no FROM annotated WHERE marker IS NOT NULL"),
    "log_commands": WITH_COMMANDS("SELECT log_id, id, line_no, phase, n_lines, argv_short, tool FROM commands"),
    "log_continuations": chain("annotated", "SELECT log_id, line_no, text FROM annotated WHERE is_continuation"),
    "log_events": chain("events0", "SELECT * FROM events0"),
    "log_events_replayed": chain("ev", "SELECT log_id::VARCHAR AS log_id, id, kind, severity, message, line_no, phase, command_id, file, line, parent FROM ev"),
    "events_by_kind": chain("events0", "SELECT kind, severity, count(*) AS n, count(DISTINCT log_id) AS logs FROM events0 GROUP BY ALL"),
    "failed_phase": chain("ev", "SELECT DISTINCT log_id, failed_phase FROM ev"),
    "event_command_join": WITH_COMMANDS("SELECT e.log_id, e.id, e.command_id, c.argv_short, c.tool AS command_tool FROM events0 e LEFT JOIN commands c ON c.log_id = e.log_id AND c.id = e.command_id"),
    "rpm_patch_parent": chain("ev", "SELECT log_id, id, exit_phase, parent FROM ev WHERE kind = 'rpm_phase'"),
    "cascade_parent": chain("cascades", "SELECT log_id, id, cascade_parent FROM cascades"),
    "cascade_summary": chain("ev", "SELECT log_id, 'make cascade: ' || string_agg(coalesce(target, '<unknown>') || ' -> ' || coalesce(parent, 'unlinked'), '; ' ORDER BY seq) AS summary FROM ev WHERE kind = 'make_cascade' GROUP BY log_id"),
    "warning_block": chain("blocked", "SELECT log_id, id, in_warning_block FROM blocked"),
    "semantic_class": chain("based", "SELECT log_id, id, semantic_class, context_satisfied, base, cascade FROM based"),
    "cause_score": chain("scored", "SELECT log_id, id, score, bucket, band FROM scored"),
    "confidence_band": chain("scored", "SELECT band, count(*) AS n FROM scored GROUP BY band"),
    "top3_causes": chain("top", f"SELECT log_id, rank, id, kind, semantic_class, score, band, parent IS NULL AS is_terminal, {SUMMARY} FROM top"),
    "top_cause": chain("top", f"SELECT log_id, id, kind, semantic_class, round(score, 4) AS confidence, band, {SUMMARY} FROM top WHERE rank = 1"),
}
