"""Queries of clusters, candidates and coverage over the synthetic log relation."""

from __future__ import annotations

from pyspark.sql import functions as F

from buildlens.functions import patterns as P
from buildlens.functions import text as T
from buildlens.operators import candidates as C
from buildlens.operators import clusters, rank
from buildlens.plans.core import events, scored_of
from buildlens.plans.sql import chain, q




def tree(s, d):
    """A source tree with a file that fits, one that fits twice, and one in a vendor directory."""
    k = F.col("id").cast("string")
    at = s.range(7)
    paths = at.select(F.lit("root").alias("root"), F.concat(F.lit("src/f"), k, F.lit(".c")).alias("path")).union(at.filter("id = 3").select(F.lit("root"), F.concat(F.lit("old/src/f"), k, F.lit(".c")))).union(at.filter("id = 5").select(F.lit("root"), F.concat(F.lit("build/src/f"), k, F.lit(".c"))))
    return paths


def two_trees(s, d):
    """Trees of two packages that share names of files."""
    return s.range(14).selectExpr("concat('pkg', cast(id % 2 as string)) as root", "concat('src/f', cast(id div 2 as string), '.c') as path")


def cand_of(s, d, ev):
    rows = rank.classified(ev).withColumn("root", F.lit("root"))
    return C.candidates(rows, C.mapped_paths(rows.filter("file is not null"), tree(s, d)))


def cand(s, d):
    return cand_of(s, d, events(s, d))


def raw(e):
    """What a broader heuristic sees: every line with a place."""
    return clusters.with_option(e).filter("file is not null").select("log_id", "id", "file", "line", "column", "option", "severity")


def coverage_diff(s, d):
    e = events(s, d)
    return C.coverage(scored_of(e).filter("score >= 0.7").select("log_id", "id"), cand_of(s, d, e).select("log_id", "id"))


def scanner_gap(s, d):
    e = events(s, d)
    return C.scanner_gap(raw(e), cand_of(s, d, e)).select("log_id", "id", "file", "line")


QUERIES = {
    "error_clusters": lambda s, d: clusters.error_clusters(events(s, d)).withColumn("files", F.array_join("files", ",")).withColumn("diagnostic_kinds", F.array_join("diagnostic_kinds", ",")),
    "cluster_sample": lambda s, d: clusters.cluster_sample(events(s, d)),
    "truncation_signals": lambda s, d: clusters.truncation_signals(events(s, d).withColumn("message", F.when(F.col("kind") == "raw_error", F.concat("message", F.lit(", too many errors emitted"))).otherwise(F.col("message")))),
    "source_candidates": lambda s, d: cand(s, d).select("log_id", "id", "normalized_file", "line", "option", "semantic_class", "fatal_detection_source", "type_fixability", "type_fixability_reason", "source_reachable", "source_resolution_status", "source_owned", "source_ownership_status", "patch_ready"),
    "excluded_by_reason": lambda s, d: C.gated(events(s, d)).filter("exclusion_reason is not null").groupBy("exclusion_reason").agg(F.count(F.lit(1)).alias("n")),
    "exclusion_counts": lambda s, d: C.exclusion_counts(events(s, d)),
    "fixability": lambda s, d: cand(s, d).groupBy("type_fixability", "type_fixability_reason").agg(F.count(F.lit(1)).alias("n")),
    "path_ownership": lambda s, d: cand(s, d).groupBy("file", "normalized_file", "source_ownership_status").agg(F.count(F.lit(1)).alias("n")),
    "path_suffix_match": lambda s, d: C.mapped_paths(events(s, d).filter("file is not null").withColumn("file", F.concat(F.lit("/home/abuild/rpmbuild/BUILD/app-1.0/"), "file")).withColumn("root", F.lit("root")), tree(s, d)).drop("root"),
    "path_suffix_roots": lambda s, d: C.mapped_paths(events(s, d).filter("file is not null").select(F.concat(F.lit("pkg"), (F.col("log_id") % 3).cast("string")).alias("root"), "file"), two_trees(s, d)),
    "candidate_counts": lambda s, d: C.candidate_counts(cand(s, d)),
    "dedupe_key": lambda s, d: cand(s, d).select("log_id", "id", "dedupe_key", "degraded_key"),
    "first_of_key": lambda s, d: C.first_of_key(cand(s, d)).select("log_id", "id", "dedupe_key"),
    "message_fingerprint": lambda s, d: events(s, d).select("log_id", "id", T.fingerprint(F.col("message")).alias("fingerprint")),
    "unknown_by_reason": lambda s, d: cand(s, d).filter("not patch_ready").groupBy(F.coalesce(C.not_ready_reason(), F.lit("<unknown>")).alias("reason")).agg(F.count(F.lit(1)).alias("n")),
    "coverage_diff": coverage_diff,
    "scanner_gap": scanner_gap,
    "fix_all_groups": lambda s, d: cand(s, d).filter("patch_ready").groupBy("log_id", "normalized_file").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "id"))), lambda x: x["id"]), ",").alias("ids")),
}

OPTION = r"list_filter(flatten(list_transform(regexp_extract_all(message, '\[([^\]]+)\]', 1), lambda b: list_transform(string_split(b, ','), lambda t: trim(t)))), lambda t: starts_with(t, '-W') AND t <> '-Werror')[1]"
OPTIONS = f"opt AS (SELECT *, CASE WHEN kind IN ('compiler', 'werror') THEN {OPTION} END AS option FROM based)"
TREE = "tree AS (SELECT 'src/f' || i || '.c' AS path FROM range(7) t(i) UNION ALL SELECT 'old/src/f3.c')"
FATAL = "CASE WHEN lower(trim(severity)) = 'error' THEN 'severity' WHEN kind = 'werror' THEN 'kind' WHEN contains(message, '-Werror') THEN 'werror_message_fallback' END"
NO_FILE, NO_LINE = "coalesce(file, '') = ''", "coalesce(line, 0) <= 0"
GATED = f"gated AS (SELECT *, {FATAL} AS fatal_detection_source, CASE WHEN {NO_FILE} AND {NO_LINE} THEN 'missing_file_and_line' WHEN {NO_FILE} THEN 'missing_file' WHEN {NO_LINE} THEN 'missing_line' WHEN parent IS NOT NULL THEN 'explicit_parent' END AS exclusion_reason FROM opt WHERE kind IN ('compiler', 'werror') AND {FATAL} IS NOT NULL)"
LISTED = f"coalesce(option IN ({', '.join(q(o) for o in P.FIXABLE_OPTIONS)}), false)"
UNUSED = "((contains(lower(message), 'unused') AND contains(lower(message), 'field')) OR (contains(lower(message), 'private field') AND contains(lower(message), 'not used')))"
FINGERPRINT = r"substring(sha1(trim(regexp_replace(lower(message), '\s+', ' ', 'g'))), 1, 12)"
CAND = f"""found AS (SELECT file, count(*) AS matches, CASE WHEN count(*) = 1 THEN min(path) END AS mapped FROM (SELECT DISTINCT file FROM gated), tree WHERE path = file OR ends_with(path, '/' || file) GROUP BY file),
cand0 AS (SELECT g.*, coalesce(mapped, file) AS normalized_file, mapped IS NOT NULL AS source_reachable, CASE WHEN mapped IS NOT NULL THEN 'mapped_to_source_root' ELSE 'source_mapping_unavailable' END AS source_resolution_status,
  CASE WHEN mapped IS NOT NULL THEN 'project_owned' ELSE 'unknown' END AS source_ownership_status, mapped IS NOT NULL AS source_owned,
  CASE WHEN {LISTED} OR {UNUSED} THEN 'probably_fixable' ELSE 'unknown' END AS type_fixability,
  CASE WHEN {LISTED} THEN 'whitelisted_warning_option:' || option WHEN {UNUSED} THEN 'unused_field_message_rule' ELSE 'no_matching_fixability_rule' END AS type_fixability_reason
  FROM gated g LEFT JOIN found USING (file) WHERE exclusion_reason IS NULL),
cand AS (SELECT *, type_fixability = 'probably_fixable' AND source_reachable AND source_owned AS patch_ready,
  'file=' || normalized_file || '|line=' || line || '|column=' || coalesce("column"::VARCHAR, '<unknown>') || '|warning_option=' || coalesce(option, '<none>') || '|semantic_class=' || semantic_class
  || '|message=' || {FINGERPRINT} || '|command_id=' || coalesce(command_id, '<unknown>') || '|kind=' || kind AS dedupe_key, "column" IS NULL OR option IS NULL OR command_id IS NULL AS degraded_key FROM cand0)"""


def sql(select: str, upto: str = "scored", more: str = ", ".join((OPTIONS, TREE, GATED, CAND))) -> str:
    return chain(upto, "").rstrip() + ", " + more + " " + select


ORACLES = {
    "error_clusters": sql("""SELECT log_id, 'CL' || lpad(row_number() OVER (PARTITION BY log_id ORDER BY first)::VARCHAR, 3, '0') AS id, option, diagnostic_kinds, count, len(f)::INTEGER AS file_count, array_to_string(f[1:20], ',') AS files, count > 10 AS locations_truncated, count >= 10 OR len(f) >= 3 AS large_scale
      FROM (SELECT log_id, option, min(seq) AS first, count(*)::INTEGER AS count, string_agg(DISTINCT kind, ',' ORDER BY kind) AS diagnostic_kinds FROM opt WHERE option IS NOT NULL GROUP BY ALL)
      JOIN (SELECT log_id, option, coalesce(list(file ORDER BY first) FILTER (file IS NOT NULL), []) AS f FROM (SELECT log_id, option, file, min(seq) AS first FROM opt WHERE option IS NOT NULL GROUP BY ALL) GROUP BY ALL) USING (log_id, option) WHERE count >= 3"""),
    "cluster_sample": sql("""SELECT log_id, option, place, id AS event_id, file, line, "column" FROM (SELECT *, row_number() OVER (PARTITION BY log_id, option ORDER BY new_file DESC, seq)::INTEGER AS place FROM (
      SELECT *, file IS NOT NULL AND row_number() OVER (PARTITION BY log_id, option, file ORDER BY seq) = 1 AS new_file, count(*) OVER (PARTITION BY log_id, option) AS n FROM opt WHERE option IS NOT NULL) WHERE n >= 3) WHERE place <= 10"""),
    "truncation_signals": chain("ev", "SELECT log_id, line_no, message || ', too many errors emitted' AS message FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY line_no) AS n FROM ev WHERE kind = 'raw_error') WHERE n <= 5"),
    "source_candidates": sql("SELECT log_id, id, normalized_file, line, option, semantic_class, fatal_detection_source, type_fixability, type_fixability_reason, source_reachable, source_resolution_status, source_owned, source_ownership_status, patch_ready FROM cand"),
    "excluded_by_reason": sql("SELECT exclusion_reason, count(*) AS n FROM gated WHERE exclusion_reason IS NOT NULL GROUP BY ALL"),
    "exclusion_counts": sql("SELECT log_id, count(*) FILTER (exclusion_reason IN ('missing_file', 'missing_file_and_line')) AS missing_file_count, count(*) FILTER (exclusion_reason IN ('missing_line', 'missing_file_and_line')) AS missing_line_count, count(*) FILTER (exclusion_reason = 'explicit_parent') AS explicit_parent_count FROM gated GROUP BY ALL"),
    "fixability": sql("SELECT type_fixability, type_fixability_reason, count(*) AS n FROM cand GROUP BY ALL"),
    "path_ownership": sql("SELECT file, normalized_file, source_ownership_status, count(*) AS n FROM cand GROUP BY ALL"),
    "path_suffix_match": sql("SELECT '/home/abuild/rpmbuild/BUILD/app-1.0/' || e.file AS file, count(*) AS matches, CASE WHEN count(*) = 1 THEN min(path) END AS mapped FROM (SELECT DISTINCT file FROM based WHERE file IS NOT NULL) e, tree WHERE path = e.file OR ends_with(path, '/' || e.file) GROUP BY e.file"),
    "path_suffix_roots": sql("SELECT DISTINCT 'pkg' || (log_id % 3) AS root, file, 1::BIGINT AS matches, file AS mapped FROM based WHERE file LIKE 'src/f%' AND log_id % 3 < 2"),
    "candidate_counts": sql("SELECT log_id, count(*) AS candidates, count(*) FILTER (type_fixability = 'probably_fixable') AS type_probably_fixable, count(*) FILTER (type_fixability = 'unknown') AS type_unknown, count(*) FILTER (source_reachable) AS source_reachable, count(*) FILTER (source_owned) AS source_owned, count(*) FILTER (patch_ready) AS patch_ready FROM cand GROUP BY log_id"),
    "dedupe_key": sql("SELECT log_id, id, dedupe_key, degraded_key FROM cand"),
    "first_of_key": sql("SELECT log_id, id, dedupe_key FROM (SELECT *, row_number() OVER (PARTITION BY log_id, dedupe_key ORDER BY seq) AS n FROM cand) WHERE n = 1"),
    "message_fingerprint": chain("ev", f"SELECT log_id, id, {FINGERPRINT} AS fingerprint FROM ev"),
    "unknown_by_reason": sql("SELECT CASE WHEN type_fixability <> 'probably_fixable' THEN 'type_fixability=' || type_fixability WHEN NOT source_reachable THEN 'source_resolution_status=' || source_resolution_status ELSE 'source_ownership_status=' || source_ownership_status END AS reason, count(*) AS n FROM cand WHERE NOT patch_ready GROUP BY ALL"),
    "coverage_diff": sql("SELECT log_id, id, 'missed_by_old' AS side FROM (SELECT log_id, id FROM cand EXCEPT SELECT log_id, id FROM scored WHERE score >= 0.7::DOUBLE) UNION ALL SELECT log_id, id, 'extra_in_old' FROM (SELECT log_id, id FROM scored WHERE score >= 0.7::DOUBLE EXCEPT SELECT log_id, id FROM cand)"),
    "scanner_gap": sql("""SELECT log_id, id, file, line FROM opt o WHERE file IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cand c WHERE c.log_id = o.log_id AND c.file IS NOT DISTINCT FROM o.file AND c.line IS NOT DISTINCT FROM o.line AND c."column" IS NOT DISTINCT FROM o."column" AND c.option IS NOT DISTINCT FROM o.option)"""),
    "fix_all_groups": sql("SELECT log_id, normalized_file, count(*) AS n, string_agg(id, ',' ORDER BY seq) AS ids FROM cand WHERE patch_ready GROUP BY ALL"),
}
