"""Edits of specs as data: lines to insert, merged into numbered lines, and unified diffs made of runs of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Patterns of messages and specs.
MISSING_DEPENDENCY = r"(?i)\bnothing provides\s+(.+?)(?:\s+needed by\b|$)"
MISSING_LIBRARY = [r"cannot find\s+-l([A-Za-z0-9_+.-]+)", r"cannot find\s+(lib[A-Za-z0-9_+-]+)(?:\.so)?", r"library not found for\s+-l([A-Za-z0-9_+.-]+)"]
REQUIRES, SECTION = r"^\s*BuildRequires\s*:", r"^\s*%[A-Za-z]"
CONTEXT = 3


def missing_dependency(message: Column) -> Column:
    return F.nullif(F.regexp_replace(F.trim(F.regexp_extract(message, MISSING_DEPENDENCY, 1)), "[.,;]+$", ""), F.lit(""))


def devel_candidate(message: Column) -> Column:
    """A guess of the package that has the library which the linker misses."""
    library = F.coalesce(*[F.nullif(F.regexp_extract(message, p, 1), F.lit("")) for p in MISSING_LIBRARY])
    return F.concat(F.lit("lib"), F.regexp_replace(F.regexp_replace(library, "^lib", ""), r"\.so$", ""), F.lit("-devel"))


def _plain(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, r"\s+", ""))


def insertion_points(lines: DataFrame) -> DataFrame:
    """spec, after: the last line of a spec's first block of BuildRequires, with lines that go on by white space; without one, the line
    before the first section, or the last line."""
    text = F.col("text")
    first = Window.partitionBy("spec")
    df = lines.withColumn("own", text.rlike(REQUIRES)).withColumn("from", F.min(F.when(F.col("own"), F.col("line_no"))).over(first))
    stops = (F.col("line_no") > F.col("from")) & ~F.col("own") & ~text.rlike(r"^[ \t]")
    of = df.groupBy("spec").agg(F.max("from").alias("from"), F.min(F.when(stops, F.col("line_no"))).alias("stop"), F.min(F.when(text.rlike(SECTION), F.col("line_no"))).alias("section"), F.max("line_no").alias("last"))
    after = F.when(F.col("from").isNotNull(), F.coalesce(F.col("stop") - 1, "last")).otherwise(F.coalesce(F.col("section") - 1, "last"))
    return of.select("spec", after.cast("int").alias("after"))


def requirement_edits(causes: DataFrame, lines: DataFrame) -> DataFrame:
    """log_id, spec, suggester, requirement, confidence, after, text for causes (log_id, spec, kind, message) of a missing
    dependency or library: a BuildRequires line to insert.

    A dependency that the spec declares already is advice alone (``advisory``), and so is a cause whose name is not told or whose
    spec is not there (``manual``): these have no text.
    """
    depsolve = F.col("kind") == "depsolve"
    df = causes.filter("kind in ('depsolve', 'linker_missing')")
    df = df.withColumn("requirement", F.when(depsolve, missing_dependency(F.col("message"))).otherwise(devel_candidate(F.col("message"))))
    declared = lines.filter(F.col("text").rlike("(?i)" + REQUIRES)).select("spec", _plain(F.regexp_replace("text", "^[^:]*:", "")).alias("plain"), F.lit(True).alias("declared")).distinct()
    df = df.withColumn("plain", _plain(F.col("requirement"))).join(insertion_points(lines), "spec", "left").join(declared, ["spec", "plain"], "left")
    confidence = F.when(F.col("requirement").isNull() | F.col("after").isNull(), "manual").when(depsolve & F.coalesce("declared", F.lit(False)), "advisory").when(depsolve, "medium").otherwise("low")
    text = F.when(confidence.isin("medium", "low"), F.concat(F.lit("BuildRequires:  "), F.col("requirement")))
    return df.select("log_id", "spec", F.col("kind").alias("suggester"), "requirement", confidence.alias("confidence"), F.when(text.isNotNull(), F.col("after")).alias("after"), text.alias("text"))


def merged(lines: DataFrame, edits: DataFrame) -> DataFrame:
    """edit, new_no, old_no, after, text: the lines of each edited spec with what is inserted, numbered anew. edits: edit, spec, after
    (0: before the first line), place (the order of those at one line), text."""
    wanted = edits.select("edit", "spec").distinct()
    old = wanted.join(lines, "spec").select("edit", F.col("line_no").alias("at"), F.lit(-1).alias("place"), F.col("line_no").alias("old_no"), F.lit(None).cast("int").alias("after"), "text")
    new = edits.select("edit", F.col("after").alias("at"), "place", F.lit(None).cast("int").alias("old_no"), F.col("after").cast("int").alias("after"), "text")
    order = Window.partitionBy("edit").orderBy("at", "place")
    return old.unionByName(new).withColumn("new_no", F.row_number().over(order)).select("edit", "new_no", "old_no", "after", "text")


def _range(first: Column, n: Column) -> Column:
    return F.when(n == 1, first.cast("string")).otherwise(F.concat_ws(",", F.when(n == 0, first - 1).otherwise(first), n))


def unified_diffs(lines: DataFrame, edits: DataFrame) -> DataFrame:
    """edit, diff: a unified diff with three lines about each insertion; runs of lines that overlap or touch are one hunk."""
    order = Window.partitionBy("edit").orderBy("new_no")
    df = merged(lines, edits)
    df = df.withColumn("back", F.last("after", True).over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("ahead", F.first("after", True).over(order.rowsBetween(1, Window.unboundedFollowing)))
    near = (F.col("old_no") - F.col("back") <= CONTEXT) | (F.col("ahead") - F.col("old_no") < CONTEXT)
    df = df.filter(F.col("old_no").isNull() | F.coalesce(near, F.lit(False)))
    begins = F.coalesce((F.col("new_no") - F.lag("new_no").over(order) > 1).cast("int"), F.lit(1))
    df = df.withColumn("begins", begins).withColumn("hunk", F.sum("begins").over(order))
    mark = F.when(F.col("old_no").isNull(), "+").otherwise(" ")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("new_no", F.concat(mark, "text").alias("line")))), lambda x: x["line"]), "\n")
    hunks = df.groupBy("edit", "hunk").agg(F.coalesce(F.min("old_no"), F.min("after") + 1).alias("old_from"), F.count("old_no").alias("old_n"), F.min("new_no").alias("new_from"), F.count(F.lit(1)).alias("new_n"), body.alias("body"))
    head = F.concat(F.lit("@@ -"), _range(F.col("old_from"), F.col("old_n")), F.lit(" +"), _range(F.col("new_from"), F.col("new_n")), F.lit(" @@\n"))
    return hunks.groupBy("edit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hunk", F.concat(head, "body").alias("h")))), lambda x: x["h"]), "\n").alias("diff"))


def git_headed(diff: Column, path: Column) -> Column:
    return F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n"), diff, F.lit("\n"))


def spec_diffs(causes: DataFrame, lines: DataFrame, path: Column) -> DataFrame:
    """Suggested edits of the causes' specs with their diffs; ``path`` is of a spec's file, by its columns. Without text: no diff."""
    edits = requirement_edits(causes, lines)
    made = edits.filter("text is not null").select(F.struct("log_id", "spec", "suggester").alias("edit"), "spec", "after", F.lit(0).alias("place"), "text").distinct()
    diffs = unified_diffs(lines, made).select("edit.*", "diff")
    return edits.join(diffs, ["log_id", "spec", "suggester"], "left").withColumn("diff", git_headed(F.col("diff"), path)).drop("text")
