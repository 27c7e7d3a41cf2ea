"""Source diagnostics that a patch could meet: gates with reasons, ownership, keys, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from buildlens.functions import patterns as P
from buildlens.functions.text import fingerprint, normal_path
from buildlens.operators.clusters import warning_option
from buildlens.operators.ends import longest_ends


def fatality() -> Column:
    """How a diagnostic is known to be fatal; null: it is not."""
    return F.when(F.lower(F.trim("severity")) == "error", "severity").when(F.col("kind") == "werror", "kind").when(F.col("message").contains("-Werror"), "werror_message_fallback")


def gated(ev: DataFrame) -> DataFrame:
    """Fatal source diagnostics with exclusion_reason; null: a candidate."""
    df = ev.filter(F.col("kind").isin(*P.SOURCE_KINDS)).withColumn("fatal_detection_source", fatality()).filter("fatal_detection_source is not null")
    no_file, no_line = F.coalesce("file", F.lit("")) == "", F.coalesce("line", F.lit(0)) <= 0
    reason = F.when(no_file & no_line, "missing_file_and_line").when(no_file, "missing_file").when(no_line, "missing_line").when(F.col("parent").isNotNull(), "explicit_parent")
    return df.withColumn("exclusion_reason", reason)


def source_tree(files: DataFrame) -> DataFrame:
    """Files (root, path) outside the directories that are never searched."""
    dirs = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    return files.filter(~F.exists(dirs, lambda p: p.isin(*P.SKIPPED_DIRS) | p.startswith("GBS-ROOT") | p.startswith(".gbs_")))


def mapped_paths(paths: DataFrame, files: DataFrame) -> DataFrame:
    """root, file, mapped, matches: the files of its own tree for each path (root, file): the longest end of an absolute path that
    any file of that root has, the whole of a relative one. mapped is null unless just one file fits."""
    wanted = paths.select("root", "file").distinct().withColumn("asked", F.regexp_replace("file", "^/+", "")).withColumn("whole", ~F.col("file").startswith("/"))
    found = longest_ends(wanted, source_tree(files))
    return wanted.join(found, ["root", "asked", "whole"]).select("root", "file", "matches", F.when(F.col("matches") == 1, F.col("path")).alias("mapped"))


def owned(df: DataFrame, mapped: DataFrame | None = None) -> DataFrame:
    """normalized_file, reachability and ownership of each file (of its root, if ``mapped`` is given); without a tree nothing is mapped."""
    df = df.withColumn("raw_path", normal_path(F.col("file")))
    df = df.join(mapped.select("root", "file", "mapped"), ["root", "file"], "left") if mapped is not None else df.withColumn("mapped", F.lit(None).cast("string"))
    system = F.exists(F.array(*map(F.lit, P.SYSTEM_PREFIXES)), lambda p: (F.col("raw_path") == p) | F.col("raw_path").startswith(F.concat(p, F.lit("/"))))
    suspect = lambda c: F.arrays_overlap(F.split(F.lower(c), "/"), F.array(*map(F.lit, P.SUSPECT_PARTS)))
    missing = F.lit("source_root_unavailable" if mapped is None else "source_mapping_unavailable")
    use = F.col("mapped").isNotNull() & ~system
    path = F.when(use, F.col("mapped")).otherwise(F.col("raw_path"))
    status = F.when(system, "system_or_toolchain_path").when(suspect(path), "generated_or_vendor").when(use, "project_owned").otherwise("unknown")
    return df.select("*", path.alias("normalized_file"), use.alias("source_reachable"), F.when(use, "mapped_to_source_root").otherwise(missing).alias("source_resolution_status"), status.alias("source_ownership_status"), (status == "project_owned").alias("source_owned")).drop("raw_path", "mapped")


def fixability(option: Column, message: Column) -> tuple[Column, Column]:
    low = F.lower(message)
    unused = (low.contains("unused") & low.contains("field")) | (low.contains("private field") & low.contains("not used"))
    listed = F.coalesce(option.isin(*P.FIXABLE_OPTIONS), F.lit(False))
    kind = F.when(listed | unused, "probably_fixable").otherwise("unknown")
    return kind, F.when(listed, F.concat(F.lit("whitelisted_warning_option:"), option)).when(unused, "unused_field_message_rule").otherwise("no_matching_fixability_rule")


def candidates(classified: DataFrame, mapped: DataFrame | None = None) -> DataFrame:
    """Candidates with option, fixability, ownership and the key that tells repeats."""
    df = owned(gated(classified).filter("exclusion_reason is null"), mapped).withColumn("option", warning_option(F.col("kind"), F.col("message")))
    kind, why = fixability(F.col("option"), F.col("message"))
    key = F.concat_ws(
        "|",
        F.concat(F.lit("file="), "normalized_file"),
        F.concat(F.lit("line="), F.col("line").cast("string")),
        F.concat(F.lit("column="), F.coalesce(F.col("column").cast("string"), F.lit("<unknown>"))),
        F.concat(F.lit("warning_option="), F.coalesce("option", F.lit("<none>"))),
        F.concat(F.lit("semantic_class="), "semantic_class"),
        F.concat(F.lit("message="), fingerprint(F.col("message"))),
        F.concat(F.lit("command_id="), F.coalesce("command_id", F.lit("<unknown>"))),
        F.concat(F.lit("kind="), "kind"),
    )
    degraded = F.col("column").isNull() | F.col("option").isNull() | F.col("command_id").isNull()
    df = df.withColumn("type_fixability", kind).withColumn("type_fixability_reason", why).withColumn("dedupe_key", key).withColumn("degraded_key", degraded)
    return df.withColumn("patch_ready", (F.col("type_fixability") == "probably_fixable") & F.col("source_reachable") & F.col("source_owned"))


def not_ready_reason() -> Column:
    return F.when(F.col("type_fixability") != "probably_fixable", F.concat(F.lit("type_fixability="), "type_fixability")).when(~F.col("source_reachable"), F.concat(F.lit("source_resolution_status="), "source_resolution_status")).when(~F.col("source_owned"), F.concat(F.lit("source_ownership_status="), "source_ownership_status"))


def candidate_counts(cand: DataFrame) -> DataFrame:
    return cand.groupBy("log_id").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("type_fixability") == "probably_fixable").alias("type_probably_fixable"), F.count_if(F.col("type_fixability") == "unknown").alias("type_unknown"), F.count_if("source_reachable").alias("source_reachable"), F.count_if("source_owned").alias("source_owned"), F.count_if("patch_ready").alias("patch_ready"))


def exclusion_counts(ev: DataFrame) -> DataFrame:
    reason = F.col("exclusion_reason")
    return gated(ev).groupBy("log_id").agg(F.count_if(reason.isin("missing_file", "missing_file_and_line")).alias("missing_file_count"), F.count_if(reason.isin("missing_line", "missing_file_and_line")).alias("missing_line_count"), F.count_if(reason == "explicit_parent").alias("explicit_parent_count"))


def first_of_key(cand: DataFrame) -> DataFrame:
    """Candidates without repeats of their key in a log; the first stays."""
    return cand.withColumn("n", F.row_number().over(Window.partitionBy("log_id", "dedupe_key").orderBy("seq"))).filter("n = 1").drop("n")


def coverage(old: DataFrame, new: DataFrame) -> DataFrame:
    """Ids that one of two candidate lists (log_id, id) has and the other lacks."""
    missed = new.join(old, ["log_id", "id"], "left_anti").withColumn("side", F.lit("missed_by_old"))
    return missed.unionByName(old.join(new, ["log_id", "id"], "left_anti").withColumn("side", F.lit("extra_in_old")))


def scanner_gap(raw: DataFrame, cand: DataFrame) -> DataFrame:
    """Raw diagnostics with no structured one of equal file, line, column and option; null equals null."""
    keys = ["file", "line", "column", "option"]
    other = cand.select(F.col("log_id").alias("l"), *[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = F.col("log_id") == F.col("l")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return raw.join(other, same, "left_anti")
