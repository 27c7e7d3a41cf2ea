"""Repeated diagnostics of one warning option."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from buildlens.functions import patterns as P


def warning_option(kind: Column, message: Column) -> Column:
    """The first ``-W`` token in any brackets of a source diagnostic's message that is not -Werror itself."""
    blocks = F.regexp_extract_all(message, F.lit(r"\[([^\]]+)\]"), F.lit(1))
    tokens = F.flatten(F.transform(blocks, lambda b: F.transform(F.split(b, ","), lambda t: F.trim(t))))
    return F.when(kind.isin(*P.SOURCE_KINDS), F.try_element_at(F.filter(tokens, lambda t: t.startswith("-W") & (t != "-Werror")), F.lit(1)))


def with_option(ev: DataFrame) -> DataFrame:
    return ev.withColumn("option", warning_option(F.col("kind"), F.col("message")))


def truncation_signals(ev: DataFrame, most: int = 5) -> DataFrame:
    """log_id, line_no, message: the first five messages that tell of output cut short."""
    first = Window.partitionBy("log_id").orderBy("line_no")
    return ev.filter(F.lower("message").contains(P.TRUNCATED)).withColumn("n", F.row_number().over(first)).filter(F.col("n") <= most).select("log_id", "line_no", "message")


def error_clusters(ev: DataFrame) -> DataFrame:
    """Options with three events or more in a log; ids by first appearance. Files in order of first appearance, 20 shown.

    Grouping runs twice over the option's rows: by file, then by option, so a frequent option is summed up before it is listed.
    """
    rows = with_option(ev).filter("option is not null")
    by_file = rows.groupBy("log_id", "option", "file").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"), F.collect_set("kind").alias("kinds"))
    named = (F.col("file") != "") & F.col("file").isNotNull()
    files = F.transform(F.array_sort(F.collect_list(F.when(named, F.struct("first", "file")))), lambda x: x["file"])
    df = by_file.groupBy("log_id", "option").agg(F.min("first").alias("first"), F.sum("n").cast("int").alias("count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("diagnostic_kinds"), files.alias("every_file"))
    df = df.filter(F.col("count") >= 3).withColumn("no", F.row_number().over(Window.partitionBy("log_id").orderBy("first")))
    n_files = F.size("every_file")
    return df.select("log_id", F.format_string("CL%03d", "no").alias("id"), "option", "diagnostic_kinds", "count", n_files.alias("file_count"), F.slice("every_file", 1, 20).alias("files"), (F.col("count") > F.least(F.col("count"), F.lit(10))).alias("locations_truncated"), ((F.col("count") >= 10) | (n_files >= 3)).alias("large_scale"))


def cluster_sample(ev: DataFrame, most: int = 10) -> DataFrame:
    """Up to ten locations of each cluster: the first of each file, then others in order."""
    rows = with_option(ev).filter("option is not null")
    by_file = F.row_number().over(Window.partitionBy("log_id", "option", "file").orderBy("seq"))
    of = Window.partitionBy("log_id", "option")
    df = rows.withColumn("new_file", (by_file == 1) & F.col("file").isNotNull() & (F.col("file") != "")).withColumn("n", F.count(F.lit(1)).over(of))
    df = df.filter(F.col("n") >= 3).withColumn("place", F.row_number().over(of.orderBy(F.desc("new_file"), "seq"))).filter(F.col("place") <= most)
    return df.select("log_id", "option", "place", F.col("id").alias("event_id"), "file", "line", "column")
