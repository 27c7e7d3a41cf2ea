"""Which diagnostics a patch context is made of: coverage branches, skip reasons, identities, raw diagnostics, files of a context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from buildlens.functions.text import fingerprint, slug
from buildlens.operators.clusters import warning_option
from buildlens.operators.gates import first_of

#: A diagnostic-like line by the broad heuristic, and the kinds that stand for sources.
RAW = r"((?:/[^:\n]+|[A-Za-z0-9_./+-][^:\n]*?)):(\d+):(?:(\d+):)?\s*(fatal error|error|warning):\s*(.*)"
SECONDS = r"^\[\s*\d+s\]\s*"
SOURCE_KINDS = ["compiler", "werror"]
TRUNCATED = "too many errors emitted"


def skip_reason() -> Column:
    """Why a cause is no candidate of a context with several; null: it is. Needs parent, kind, file, line, message."""
    f = F.col
    return first_of(
        (f("parent").isNotNull(), "not_terminal_cascade"),
        (~F.coalesce(f("kind").isin(*SOURCE_KINDS), F.lit(False)), "not_source_diagnostic"),
        (F.coalesce(f("file"), F.lit("")) == "", "missing_file"),
        (F.coalesce(f("line"), F.lit(0)) <= 0, "missing_line"),
        (F.coalesce(f("message"), F.lit("")) == "", "missing_message"),
    )


def multi_candidates(top: DataFrame) -> DataFrame:
    """log_id, candidate, id of causes that a context with several is made of; a log with one only has none."""
    ok = top.withColumn("skip", skip_reason()).filter("skip is null")
    of = Window.partitionBy("log_id")
    df = ok.withColumn("n", F.count(F.lit(1)).over(of)).filter("n >= 2").withColumn("place", F.row_number().over(of.orderBy("rank")))
    return df.select("log_id", F.concat(F.format_string("C%03d", "place"), F.lit("_"), "id").alias("candidate"), "id")


def identity() -> Column:
    """What tells a diagnostic: its event, else its key, else a key made of what is known."""
    f = F.col
    part = lambda name, c, none="<unknown>": F.concat(F.lit(f"{name}="), F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(none)))
    made = F.concat_ws("|", part("file", f("file")), part("line", f("line")), part("column", f("column")), part("warning_option", warning_option(f("kind"), f("message")), "<none>"), part("semantic_class", f("semantic_class")), part("message", fingerprint(F.coalesce(f("message"), F.lit("")))), part("command_id", f("command_id")), part("kind", f("kind")))
    return F.coalesce(F.concat(F.lit("event_id:"), F.nullif(f("id"), F.lit(""))), F.concat(F.lit("dedupe:"), F.nullif(f("dedupe_key"), F.lit(""))), F.concat(F.lit("fallback:"), made))


def is_large_source_cluster() -> Column:
    """Needs large_scale and diagnostic_kinds (array): all kinds must be of sources."""
    return F.col("large_scale") & (F.size("diagnostic_kinds") > 0) & (F.size(F.array_except("diagnostic_kinds", F.array(*map(F.lit, SOURCE_KINDS)))) == 0)


def coverage_branch(logs: DataFrame, clusters: DataFrame, locations: DataFrame, top: DataFrame) -> DataFrame:
    """log_id, branch, and why each branch before it was not taken: cluster (a large cluster of sources with readable
    locations), multi (two causes or more), single (a primary error), none.

    logs: log_id, sidecar (whether its locations can be read); clusters: log_id, id, large_scale, diagnostic_kinds; locations:
    log_id, cluster (an id that repeats counts once), file, line.
    """
    c = clusters.withColumn("good", is_large_source_cluster()).groupBy("log_id").agg(F.count_if("good").alias("good"), F.count_if(~F.col("large_scale")).alias("small"))
    usable = locations.filter("file is not null and line is not null").join(clusters.filter(is_large_source_cluster()).select("log_id", F.col("id").alias("cluster")), ["log_id", "cluster"], "left_semi").groupBy("log_id").agg(F.count(F.lit(1)).alias("usable"))
    t = top.groupBy("log_id").agg(F.count_if(skip_reason().isNull()).alias("eligible"), F.count(F.lit(1)).alias("causes"))
    df = logs.join(c, "log_id", "left").join(usable, "log_id", "left").join(t, "log_id", "left")
    f = F.col
    no_cluster = first_of((f("good").isNull(), "no_clusters"), ((f("good") == 0) & (f("small") > 0), "large_scale_false"), (f("good") == 0, "no_large_scale_source_cluster"), (~f("sidecar"), "sidecar_unreadable"), (F.coalesce("usable", F.lit(0)) == 0, "sidecar_no_usable_locations"))
    no_multi = first_of((f("causes").isNull(), "no_root_cause_candidates"), (f("eligible") < 2, "candidates_lt_2"))
    no_single = first_of((f("causes").isNull(), "no_primary_error"))
    df = df.withColumn("a", no_cluster).withColumn("b", no_multi).withColumn("c", no_single)
    branch = F.when(f("a").isNull(), "cluster").when(f("b").isNull(), "multi").when(f("c").isNull(), "single").otherwise("none")
    return df.select("log_id", branch.alias("branch"), f("a").alias("no_cluster"), F.when(f("a").isNotNull(), f("b")).alias("no_multi"), F.when(f("a").isNotNull() & f("b").isNotNull(), f("c")).alias("no_single"))


def cluster_locations(clusters: DataFrame, sidecar: DataFrame) -> DataFrame:
    """log_id, id, option, file, line, column: the sidecar's locations (log_id, id, locations: array) of each summarised cluster."""
    df = clusters.select("log_id", "id", "option").join(sidecar.select("log_id", "id", "locations"), ["log_id", "id"])
    return df.select("log_id", "id", "option", F.explode("locations").alias("l")).select("log_id", "id", "option", "l.file", "l.line", "l.column").filter("file is not null and line is not null")


def raw_diagnostics(lines: DataFrame) -> DataFrame:
    """log_id, line_no, file, line, column, severity, message, option of lines (log_id, line_no, raw_text) that look like source
    diagnostics; warnings only if they are promoted to errors."""
    text = F.regexp_replace("raw_text", SECONDS, "")
    get = lambda i: F.regexp_extract(F.col("t"), RAW, i)
    df = lines.withColumn("t", text).filter(F.col("t").rlike(RAW)).withColumn("message", F.trim(get(5))).withColumn("level", get(4))
    df = df.filter((F.col("level") != "warning") | F.col("message").contains("-Werror"))
    return df.select("log_id", "line_no", get(1).alias("file"), get(2).cast("int").alias("line"), F.nullif(get(3), F.lit("")).cast("int").alias("column"), F.when(F.col("level") == "warning", "warning").otherwise("error").alias("severity"), "message", warning_option(F.lit("compiler"), F.col("message")).alias("option"))


def gap_categories(unmatched: DataFrame) -> DataFrame:
    """log_id, category, n of raw diagnostics that no structured one matches; a message cut short counts twice."""
    promoted = F.when(F.col("message").contains("-Werror"), "werror_promoted").otherwise("source_error")
    kinds = F.array_compact(F.array(promoted, F.when(F.lower("message").contains(TRUNCATED), "truncation_signal")))
    return unmatched.select("log_id", F.explode(kinds).alias("category")).groupBy("log_id", "category").agg(F.count(F.lit(1)).alias("n"))


def distinct_options(ev: DataFrame) -> DataFrame:
    """log_id, options: warning options that the compiler does not know, in order of first appearance."""
    first = ev.filter("warning_option is not null").groupBy("log_id", "warning_option").agg(F.min("seq").alias("seq"))
    return first.groupBy("log_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "warning_option"))), lambda x: x["warning_option"]), ",").alias("options"))


def skeleton_groups(rows: DataFrame) -> DataFrame:
    """key, line, reason: lines with any suppressed diagnostic (key, line, reason); a structural reason wins."""
    reason = F.when(F.bool_or(F.col("reason") == "structural"), "structural").otherwise(F.min("reason"))
    return rows.groupBy("key", "line").agg(reason.alias("reason")).filter("reason is not null")


def first_diagnostics(top: DataFrame) -> DataFrame:
    """log_id, id, kind, semantic_class, file, line, message: the primary error with the class of the first cause of that event."""
    return top.filter("rank = 1").select("log_id", "id", "kind", F.coalesce("semantic_class", F.lit("unknown")).alias("semantic_class"), "file", "line", "message")


def edit_violations(edits: DataFrame, files: DataFrame) -> DataFrame:
    """edit, violation of edits (edit, file, old, new) against files (file, text): empty or equal texts, paths out of the root,
    files that are not there, old text that stands nowhere or more than once."""
    df = edits.join(files, "file", "left")
    found = F.when(F.coalesce("old", F.lit("")) != "", (F.length("text") - F.length(F.replace("text", F.col("old"), F.lit("")))) / F.length("old"))
    parts = F.split("file", "/")
    checks = [
        F.when(F.coalesce("old", F.lit("")) == "", "empty_old"),
        F.when(F.col("old") == F.col("new"), "no_change"),
        F.when(F.col("file").startswith("/") | F.exists(parts, lambda p: p == ".."), "path_outside_root"),
        F.when(F.col("text").isNull(), "file_missing"),
        F.when(found == 0, "old_not_found"),
        F.when(found > 1, "old_not_unique"),
    ]
    return df.select("edit", F.explode(F.array_compact(F.array(*checks))).alias("violation"))


def context_files(groups: DataFrame) -> DataFrame:
    """log_id, place, name, content of the files of a fix-all context: one for each group (log_id, normalized_file, ids, n)."""
    place = F.row_number().over(Window.partitionBy("log_id").orderBy("normalized_file"))
    df = groups.withColumn("place", place)
    name = F.concat(F.format_string("%03d_", "place"), slug(F.col("normalized_file"), 80, "_"), F.lit(".md"))
    content = F.concat_ws("\n", F.concat(F.lit("# "), "normalized_file"), F.concat(F.lit("Diagnostics: "), F.col("n").cast("string")), F.concat(F.lit("Events: "), "ids"))
    return df.select("log_id", "place", name.alias("name"), content.alias("content"))


def fix_all_counts(cand: DataFrame) -> DataFrame:
    """log_id, candidates, patch_ready, file_groups, visible_not_ready of a fix-all context; not-ready rows that can be reached show."""
    ready = F.col("patch_ready")
    return cand.groupBy("log_id").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(ready).alias("patch_ready"), F.count_distinct(F.when(ready, F.col("normalized_file"))).alias("file_groups"), F.count_if(~ready & F.col("source_reachable")).alias("visible_not_ready"))
