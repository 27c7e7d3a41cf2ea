"""Logs, source trees, specs and sidecars as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """log_id (the file), line_no, raw_offset, raw_text of logs, plain or gzip.

    A plain log of any size is read in blocks. Lines are numbered within their block; how many lines and bytes stand before a
    block is a sum over the blocks, of which there are few. A gzip log is one block, and its offsets are of its text. Lines end
    at a line feed alone, a carriage return before it goes; bytes that are no UTF-8 become U+FFFD. An empty file has no lines.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
    block = [F.col("_metadata.file_path").alias("log_id"), F.col("_metadata.file_block_start").alias("block")]
    lines = lines.select(*block, F.monotonically_increasing_id().alias("place"), "value")
    n_bytes = F.octet_length("value") + 1
    blocks = lines.groupBy("log_id", "block").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"), F.sum(n_bytes).alias("size"))
    ahead = Window.partitionBy("log_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("log_id", "block", "first", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("lines_before"), F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("bytes_before"))
    before = Window.partitionBy("log_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    df = lines.join(blocks, ["log_id", "block"])
    offset = F.col("bytes_before") + F.coalesce(F.sum(n_bytes).over(before), F.lit(0))
    text = F.regexp_replace(F.make_valid_utf8("value"), r"\r+$", "")
    return df.select("log_id", (F.col("place") - F.col("first") + F.col("lines_before") + 1).cast("int").alias("line_no"), offset.cast("long").alias("raw_offset"), text.alias("raw_text"))


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """path below the root of every file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("path"))
    return files.select(F.regexp_extract("path", "^.*?" + root.rstrip("/").split("/")[-1] + "/(.*)$", 1).alias("path"))


def spec_lines(spark: SparkSession, path: str) -> DataFrame:
    """spec, line_no, text of spec files, lines that end in a backslash joined with the next."""
    logs = read_logs(spark, path).select(F.col("log_id").alias("spec"), "line_no", F.col("raw_text").alias("text"))
    w = Window.partitionBy("spec").orderBy("line_no")
    start = F.when(F.coalesce(F.lag("text").over(w).endswith("\\"), F.lit(False)), 0).otherwise(1)
    df = logs.withColumn("start", start).withColumn("no", F.sum("start").over(w))
    parts = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return df.groupBy("spec", "no").agg(F.min("line_no").alias("line_no"), F.array_join(F.transform(parts, lambda x: F.regexp_replace(x["text"], r"\\$", "")), " ").alias("text")).drop("no")


def packets(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Evidence packets in JSON, one object for each file."""
    return spark.read.schema(schema).json(path, multiLine=True)


def bound_evidence(files: DataFrame, digests: DataFrame) -> DataFrame:
    """Files (path, content) whose bytes have the stored SHA-256 (path, sha256); all else counts as missing."""
    return files.withColumn("sha256", F.sha2("content", 256)).join(digests, ["path", "sha256"], "left_semi")
