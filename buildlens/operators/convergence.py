"""Whether a repair goes on: fingerprints of the primary error, cluster differences, failure classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens.functions.text import normal_message, stable_hash


def diagnostic_code(option: Column, semantic: Column, message: Column) -> Column:
    tokens = F.filter(F.regexp_extract_all(message, F.lit(r"-W[A-Za-z0-9_+=-]+"), F.lit(0)), lambda t: t != "-Werror")
    return F.coalesce(F.nullif(option, F.lit("")), F.nullif(semantic, F.lit("")), F.try_element_at(tokens, F.lit(1)), F.lit("<none>"))


def anchor(symbol: Column, message: Column) -> Column:
    """The symbol, else the first quoted identifier, else the first identifier that is no common word, else a hash."""
    quoted = F.nullif(F.regexp_extract(message, "[`']([A-Za-z_][A-Za-z0-9_]*)[`']", 1), F.lit(""))
    names = F.filter(F.regexp_extract_all(message, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)), lambda t: ~F.lower(t).isin("error", "warning", "werror", "deprecated"))
    return F.coalesce(F.nullif(symbol, F.lit("")), quoted, F.try_element_at(names, F.lit(1)), stable_hash(normal_message(message)))


def fingerprints(primary: DataFrame) -> DataFrame:
    """identity (file, code, anchor) and attributes (kind, message) of a primary error."""
    identity = F.struct(F.coalesce("file", F.lit("")).alias("file"), diagnostic_code(F.col("option"), F.col("semantic_class"), F.col("message")).alias("code"), anchor(F.col("symbol"), F.col("message")).alias("anchor"))
    return primary.withColumn("identity", identity).withColumn("attributes", F.struct("kind", normal_message(F.col("message")).alias("message")))


def error_counts(clusters: DataFrame, primary: DataFrame) -> DataFrame:
    """unit, errors: the sum of clusters of errors, else one for a primary error, else none."""
    n = clusters.groupBy("unit").agg(F.sum("count").alias("n"))
    return primary.join(n, "unit", "left").select("unit", F.coalesce(F.nullif("n", F.lit(0)), F.when(F.col("kind").isNotNull(), 1).otherwise(0)).cast("long").alias("errors"))


def regression_files(previous: DataFrame, current: DataFrame, touched: DataFrame) -> DataFrame:
    """unit, type_key, reason, files: clusters (unit, type_key, files) that are new, or have new files, among the files touched (unit, touched)."""
    old = previous.groupBy("unit", "type_key").agg(F.array_distinct(F.flatten(F.collect_list("files"))).alias("old"))
    df = current.join(touched, "unit").join(old, ["unit", "type_key"], "left")
    files = F.array_sort(F.array_intersect(F.array_except("files", F.coalesce("old", F.array().cast("array<string>"))), "touched"))
    return df.select("unit", "type_key", F.when(F.col("old").isNull(), "new_source_cluster_in_touched").otherwise("expanded_source_cluster_in_touched").alias("reason"), files.alias("files")).filter(F.size("files") > 0)


def regression_suspected(errors: Column, before: Column, hit: Column) -> Column:
    return (errors >= 2 * before) & (errors - before >= 20) & hit


def convergence(pairs: DataFrame) -> DataFrame:
    """verdict, confidence, reason. pairs: identity, attributes, errors and the previous ones (null: none), regression, suspected, touched."""
    same = F.col("identity").eqNullSafe(F.col("previous_identity")) & F.col("attributes").eqNullSafe(F.col("previous_attributes")) & (F.col("errors") == F.col("previous_errors")) & F.col("identity").isNotNull()
    none = F.col("previous_errors").isNull()
    notes = F.concat(F.lit("fingerprint_changed_or_error_count_changed"), F.when(F.col("touched"), "").otherwise(";touched_files_unavailable_no_regression_check"), F.when(F.col("suspected"), ";regression_suspected_not_decisive").otherwise(""))
    return pairs.withColumn("verdict", F.when(none, "advance").when(F.col("regression").isNotNull(), "regressed").when(same, "stalled").otherwise("advance")).withColumn("confidence", F.when(none, "low").when(F.col("verdict") == "advance", "medium").otherwise("high")).withColumn("reason", F.when(none, "previous_missing_one_round_advance").when(F.col("regression").isNotNull(), F.col("regression")).when(same, "fingerprint_unchanged_error_count_unchanged").otherwise(notes))


#: Fixed values, in order: rule, class and pattern of phrases that no repair of sources can mend.
DENIED = [
    ("toolchain_flag_enable_ml_inliner", "toolchain", r"-enable-ml-inliner(?:=|\b)"),
    ("toolchain_unknown_argument", "toolchain", r"\b(?:unknown|unsupported)\s+(?:argument|option)\b"),
    ("toolchain_unrecognized_option", "toolchain", r"\bunrecognized\b.*\boption\b"),
    ("toolchain_unknown_warning_option", "toolchain", r"\bunknown warning option\b"),
    ("missing_link_library", "dependency", r"\bcannot find -l[^\s:]+"),
    ("missing_library_path", "dependency", r"(?:-l|-L)[^\n]*\bNo such file or directory\b"),
    ("no_space_left", "build_env", r"\bNo space left on device\b"),
    ("read_only_filesystem", "build_env", r"\bRead-only file system\b"),
    ("out_of_memory", "build_env", r"\b(?:out of memory|oom-killer|killed process)\b"),
    ("depsolve_failure", "dependency", r"\b(?:nothing provides|depsolve|cannot install|conflicting requests)\b"),
]
#: Stages that are no build and are their own class.
NO_BUILD = ["apply_failed", "analyzer_failed", "infrastructure_failed", "build_mutated_source"]


def denied_rule(text: Column) -> Column:
    """The first rule of the list that is found in the text."""
    out = None
    for name, _, pattern in DENIED:
        out = (F if out is None else out).when(text.rlike("(?i)" + pattern), name)
    return out


def failure_classes(primary: DataFrame) -> DataFrame:
    """failure_class, repair, confidence, matched_rule of primary errors.

    Needs stage, log_text, kind, message, file, line, source_reachable, source_owned, type_fixability. A stage that is no
    build decides first, then the list of phrases in message and log, then what is known of the source. Denied below 0.8
    is uncertain, unless the source is out of reach.
    """
    f = F.col
    source, located = f("kind").isin("compiler", "werror"), (F.coalesce("file", F.lit("")) != "") & (F.coalesce("line", F.lit(0)) > 0)
    symbol = f("kind").startswith("link") & f("message").rlike("[A-Za-z_]")
    of = lambda name, sure, rule, repair="denied": F.struct(F.lit(name).alias("name"), F.lit(sure).alias("sure"), F.lit(rule).alias("rule"), F.lit(repair).alias("repair"))
    known = (
        F.when(source & ~located, of("source_unreachable", 0.4, "missing_source_location"))
        .when(source & ~f("source_reachable"), of("source_unreachable", 0.55, "source_unreachable"))
        .when(source & ~f("source_owned"), of("source_unreachable", 0.55, "source_not_owned"))
        .when(source & (f("type_fixability") != "probably_fixable"), of("source_repairable_unverified_type", 0.65, "type_unknown", "needs_confirmation"))
        .when(source, of("source_repairable", 0.95, "source_werror_or_compile_error", "auto"))
        .when(symbol, of("uncertain", 0.7, "link_symbol"))
        .otherwise(of("uncertain", 0.2, "unsupported_kind"))
    )
    classes = F.create_map(*[F.lit(x) for name, cls, _ in DENIED for x in (name, cls)])
    df = primary.withColumn("denied", denied_rule(F.concat_ws("\n", "message", "log_text"))).withColumn("known", known)
    no_build, raw = f("stage").isin(*NO_BUILD), f("kind").isin("raw_error", "raw_unparsed")
    pick = lambda stage, listed, unparsed, rest: F.when(no_build, stage).when(f("denied").isNotNull(), listed).when(raw, unparsed).otherwise(rest)
    return df.select(
        *primary.columns,
        pick(f("stage"), classes[f("denied")], F.lit("raw_unparsed"), f("known.name")).alias("failure_class"),
        pick(F.lit("denied"), F.lit("denied"), F.lit("denied"), f("known.repair")).alias("repair"),
        pick(F.lit(1.0), F.lit(1.0), F.lit(1.0), f("known.sure")).alias("confidence"),
        pick(F.concat(F.lit("failure_stage:"), f("stage")), F.concat(F.lit("denylist:"), f("denied")), F.lit("denylist:raw_unparsed"), F.concat(F.lit("heuristic:"), f("known.rule"))).alias("matched_rule"),
    )
