"""Files beside the logs, as DataFrames: candidate and cluster sidecars, review queries, run states, edit specs, rule libraries.

A file that is not what it should be gives no data and a reason, never an error that ends the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.operators.rules import SCHEMA as RULES

LOCATION = "file string, line int, column int, event_id string, message string"
CANDIDATES = f"schema_version string, candidates array<struct<{LOCATION.replace(' ', ':').replace(',:', ',')}>>"
CLUSTERS = f"schema_version string, clusters array<struct<id:string,locations:array<struct<{LOCATION.replace(' ', ':').replace(',:', ',')}>>>>"
EDITS = "edits array<struct<file:string,old:string,new:string,line:int>>"
STATE = "map<string,struct<state:string,retries:int,updated_at:string>>"
#: Versions that sidecars state.
CANDIDATE_VERSION, CLUSTER_VERSION = "source_candidates/v1", "error_clusters_locations/v1"


def texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole small files; an empty file gives no row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def _sidecar(files: DataFrame, schema: str, version: str, rows: str) -> DataFrame:
    """path, data, reason: the sidecar's content, or why it cannot be used."""
    df = files.withColumn("data", F.from_json("text", schema))
    whole = F.try_parse_json("text").isNotNull()
    reason = F.when(~whole, "unreadable").when(~F.coalesce(F.col("data.schema_version") == version, F.lit(False)), "schema_mismatch").when(F.col(f"data.{rows}").isNull(), f"no_{rows}")
    return df.select("path", F.when(reason.isNull(), F.col("data")).alias("data"), reason.alias("reason"))


def candidate_sidecars(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates (path, file, line, column, event_id, message) of usable sidecars, and the others with their reasons."""
    df = _sidecar(files, CANDIDATES, CANDIDATE_VERSION, "candidates")
    return df.filter("reason is null").select("path", F.inline("data.candidates")), df.filter("reason is not null").select("path", "reason")


def cluster_sidecars(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clusters (path, id, locations) of usable sidecars, and the others with their reasons."""
    df = _sidecar(files, CLUSTERS, CLUSTER_VERSION, "clusters")
    return df.filter("reason is null").select("path", F.inline("data.clusters")), df.filter("reason is not null").select("path", "reason")


def review_changes(spark: SparkSession, path: str) -> DataFrame:
    """number, subject, patchSets of a code-review query's JSON lines; its statistics line is left out."""
    return spark.read.schema("type string, number long, subject string, patchSets array<struct<number:int,revision:string>>").json(path).filter("type is null or type <> 'stats'").filter("number is not null").drop("type")


def run_states(files: DataFrame) -> DataFrame:
    """path, unit, state, retries, updated_at of state files: an object by unit, or the older list of units that are done."""
    by_unit = files.select("path", F.explode(F.from_json("text", STATE)).alias("unit", "s")).select("path", "unit", "s.state", "s.retries", "s.updated_at")
    done = files.filter(F.ltrim("text").startswith("[")).select("path", F.explode(F.from_json("text", "array<string>")).alias("unit"))
    return by_unit.filter("state is not null").unionByName(done.select("path", "unit", F.lit("DONE").alias("state"), F.lit(0).alias("retries"), F.lit(None).cast("string").alias("updated_at")))


def edit_specs(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edits (path, place, file, old, new, line), and files that are no edit specs with their reasons."""
    df = files.withColumn("data", F.from_json("text", EDITS))
    whole = F.try_parse_json("text").isNotNull()
    bad = F.exists("data.edits", lambda e: e["file"].isNull() | e["old"].isNull() | e["new"].isNull())
    reason = F.when(~whole, "EDIT_SPEC_UNREADABLE").when(F.col("data.edits").isNull(), "EDIT_SPEC_NO_EDITS").when(F.size("data.edits") == 0, "EDIT_SPEC_EMPTY").when(bad, "EDIT_SPEC_FIELD_MISSING")
    df = df.withColumn("reason", reason)
    return df.filter("reason is null").select("path", F.posexplode("data.edits").alias("place", "e")).select("path", "place", "e.*"), df.filter("reason is not null").select("path", "reason")


def touched_files(files: DataFrame) -> DataFrame:
    """path, touched of files that hold a JSON list of names."""
    return files.select("path", F.from_json("text", "array<string>").alias("touched")).filter("touched is not null")


def rule_library(spark: SparkSession, path: str) -> DataFrame:
    """A rule library in JSON lines, with the columns of ``rules.rule_frame``: a row for each rule, kind and pattern."""
    return spark.read.schema(RULES).json(path).withColumn("regex", _any_case(F.col("regex"))).withColumn("negative", _any_case(F.col("negative")))


def _any_case(pattern: Column) -> Column:
    return F.when(pattern.startswith("(?i)"), pattern).otherwise(F.concat(F.lit("(?i)"), pattern))
