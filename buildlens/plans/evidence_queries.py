"""Queries of evidence: sources and specs are small relations made by one expression, valid in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from buildlens.functions.scratch import written
from buildlens.operators import evidence as V
from buildlens.operators import packet, spec_edits
from buildlens.plans.core import annotated, events, scored, top
from buildlens.plans.sql import chain, ex, has, q

FILES, LINES = 8, 90
#: path and text of line n of file f: functions of ten lines each, every third file a header, the last one without braces.
PATH = "case when f % 3 = 2 then concat('inc/f', cast(f as string), '.h') else concat('src/f', cast(f as string), '.c') end"
TEXT = "case when f = 7 then concat('plain line ', cast(n as string)) when n % 10 = 1 then concat('static int fn', cast(f as string), '_', cast(n as string), '(int a) {') when n % 10 = 4 then concat('  if (v', cast((f + n) % 7 as string), ' > s', cast((f * n) % 7 as string), ') {') when n % 10 = 6 then '  }' when n % 10 = 8 then '}' else concat('  v', cast(n % 7 as string), '(w', cast(f as string), ');') end"
#: Text of line n of spec k.
SPEC = """case n when 1 then 'Name: app' when 2 then concat('BuildRequires: cmake, pkgconfig(x', cast(k as string), ') # build') when 3 then 'Patch0: a.patch' when 4 then 'Source1: app.tar.gz'
when 5 then concat('BuildRequires: z', cast(k % 3 as string)) when 6 then case when k % 4 = 0 then '%package devel' else '# %package' end when 7 then case when k % 5 = 0 then '%if 1' else '' end when 8 then case when k % 5 = 0 then '%endif' else '' end
when 9 then '%description' when 10 then case when k % 7 = 0 then 'for %{name}' else 'text' end when 11 then '%prep' when 12 then 'setup -q' when 13 then case when k % 10 = 9 then '%check' else '%build' end
when 14 then case when k % 6 = 5 then 'echo none' else concat('export CFLAGS="-O2 -Wno-x', cast(k % 2 as string), '"') end when 15 then case when k % 8 = 3 then '%if %{toolchain_is clang}' when k % 9 = 4 then 'make pre' else 'echo a' end
when 16 then 'echo b' when 17 then case when k % 16 = 3 then '%endif' else 'echo c' end when 18 then case when k % 9 = 4 then 'export CFLAGS+=" -Wno-x0"' else 'true' end when 19 then case when k % 11 = 10 then 'true' else '%cmake .' end when 20 then '%install' when 21 then 'make install' when 22 then '%files' else '/usr/bin/app' end"""
AS_SQL = lambda text: text.replace("as string", "as varchar")
SRC_SQL = f"SELECT 'root' AS root, {AS_SQL(PATH)} AS path, n::INTEGER AS line_no, {AS_SQL(TEXT)} AS text FROM range({FILES}) a(f), range(1, {LINES + 1}) b(n)"
SPEC_SQL = f"SELECT k AS spec, n::INTEGER AS line_no, {AS_SQL(SPEC)} AS text FROM (SELECT s_suppkey AS k FROM supplier), range(1, 24) b(n)"
#: Each supplier has a tree of these files, with more functions in some: one inside another, braces on the next line, on one line.
TREE_TEXT = f"case when (f + k) % 5 = 0 and n % 10 = 2 then concat('int in', cast(n as string), '(int b)') when (f + k) % 5 = 0 and n % 10 = 3 then '{{ {{' when (f + k) % 5 = 0 and n % 10 = 5 then '}} }} }}' when (f + k) % 7 = 0 and n % 10 = 9 then concat('void one', cast(n as string), '() {{ }}') else {TEXT} end"
TREE_SQL = f"SELECT k AS root, {AS_SQL(PATH)} AS path, n::INTEGER AS line_no, {AS_SQL(TREE_TEXT)} AS text FROM (SELECT s_suppkey AS k FROM supplier), range({FILES}) a(f), range(1, {LINES + 1}) b(n)"


def sources(s, d):
    return s.range(FILES * LINES).selectExpr(f"cast(id div {LINES} as int) as f", f"cast(id % {LINES} + 1 as int) as n").selectExpr("'root' as root", f"{PATH} as path", "n as line_no", f"{TEXT} as text")


def trees(s, d):
    lines = s.read.parquet(f"{d}/supplier.parquet").selectExpr("s_suppkey as k", f"explode(sequence(0, {FILES * LINES - 1})) as id")
    return lines.selectExpr("k", f"cast(id div {LINES} as int) as f", f"cast(id % {LINES} + 1 as int) as n").selectExpr("k as root", f"{PATH} as path", "n as line_no", f"{TREE_TEXT} as text")


def tree_asks(s, d):
    """Located source events of each log, in the tree of the log's number."""
    return asks(s, d).withColumn("root", F.col("log_id"))


def specs(s, d):
    lines = s.read.parquet(f"{d}/supplier.parquet").selectExpr("s_suppkey as k", "explode(sequence(1, 23)) as n")
    return lines.selectExpr("k as spec", "n as line_no", f"{SPEC} as text")


def asks(s, d):
    """Located source events, asking for their line and the name that the message quotes."""
    e = events(s, d).filter("kind in ('compiler', 'werror') and line is not null")
    return e.select("log_id", "id", F.lit("root").alias("root"), F.col("file").alias("path"), "line", V.group(F.col("message"), V.QUOTED, 1).alias("symbol"))


def symbol_asks(s, d):
    return events(s, d).filter("kind = 'linker_undef'").select("log_id", "id", F.lit("root").alias("root"), "symbol")


def spec_tree(s, d):
    k = F.col("s_suppkey")
    return s.read.parquet(f"{d}/supplier.parquet").select((k % 40).alias("root"), F.concat(F.lit("packaging/p"), (k % 3).cast("string"), F.lit(".spec")).alias("path")).filter("root % 5 <> 0").distinct()


def spec_asks(s, d):
    return s.range(41).selectExpr("id as root").crossJoin(s.createDataFrame([("p1",), ("p9",)], "package string"))


def granted(top):
    return top.withColumn("granted", V.granted(F.col("semantic_class"), F.lit(650) + F.col("log_id") % 400))


def collected_of(s, d, top):
    """What the collectors hold of each of these causes."""
    cand = granted(top)
    own = cand.select("log_id", "id", F.lit("root").alias("root"), F.col("file").alias("path"), "line", V.group(F.col("message"), V.QUOTED, 1).alias("quoted"), "symbol")
    c, src = own.drop("symbol").withColumnRenamed("quoted", "symbol"), sources(s, d)
    spec = specs(s, d).select(F.col("spec").alias("log_id"), "spec").distinct()
    return V.collected(cand, V.source_contexts(c, src), V.header_declarations(c, src), V.symbol_contexts(own, src), spec)


def all_collected(s, d):
    return collected_of(s, d, written(top(s, d), "top"))


def dependencies(s, d):
    a, b = V.missing_dependency(F.col("message"))
    return events(s, d).filter("kind in ('depsolve', 'raw_error')").select("log_id", "id", a.alias("dependency"), b.alias("needed_by"))


def spec_causes(s, d):
    """The three causes of each log, with the spec of the log's number; one of a kind, the first."""
    t = top(s, d).filter("kind in ('depsolve', 'linker_missing')")
    return t.groupBy("log_id", "kind").agg(F.min_by("message", "rank").alias("message")).withColumn("spec", F.col("log_id"))


QUERIES = {
    "spec_diff": lambda s, d: spec_edits.spec_diffs(spec_causes(s, d), specs(s, d), F.concat(F.lit("packaging/p"), F.col("spec").cast("string"), F.lit(".spec"))),
    "source_functions": lambda s, d: V.functions_of(trees(s, d)),
    "tree_context": lambda s, d: V.source_contexts(tree_asks(s, d), trees(s, d)),
    "source_context": lambda s, d: V.source_contexts(asks(s, d), sources(s, d)),
    "header_declarations": lambda s, d: V.header_declarations(asks(s, d), sources(s, d)),
    "symbol_context": lambda s, d: V.symbol_contexts(symbol_asks(s, d), sources(s, d)),
    "spec_locator": lambda s, d: V.located_spec(spec_asks(s, d), spec_tree(s, d)),
    "spec_tags": lambda s, d: V.spec_tags(specs(s, d)),
    "spec_section": lambda s, d: V.spec_section(specs(s, d), "%build"),
    "spec_warnings": lambda s, d: V.spec_warnings(specs(s, d)),
    "toolchain_flags": lambda s, d: V.toolchain_flag_point(specs(s, d), ["-Wno-x0"]),
    "last_command": lambda s, d: V.last_commands(annotated(s, d).select("log_id", "line_no", "text"), annotated(s, d).select("log_id").distinct().withColumn("phase", F.when(F.col("log_id") % 2 == 0, "%build").when(F.col("log_id") % 4 == 1, "%prep").otherwise("%install"))),
    "missing_dependency": dependencies,
    "evidence": lambda s, d: all_collected(s, d).withColumn("contains", F.array_join(F.array_sort("contains"), ",")).withColumn("warnings", F.array_join("warnings", ",")),
    "evidence_level": lambda s, d: granted(top(s, d)).select("log_id", "id", "granted", packet.level(F.col("granted")).alias("level")),
}

BODY = f"src AS ({SRC_SQL})"
FUNCS = f"""fn AS (SELECT s.root, s.path, {ex(V.FUNCTION, 1, 's.text')} AS name, s.line_no AS start_line, (SELECT min(e.line_no) FROM src e WHERE e.path = s.path AND e.line_no >= s.line_no
  AND (SELECT sum(length(b.text) - length(replace(b.text, '{{', '')) - length(b.text) + length(replace(b.text, '}}', ''))) FROM src b WHERE b.path = s.path AND b.line_no BETWEEN s.line_no AND e.line_no) <= 0
  AND (SELECT bool_or(contains(b.text, '{{')) FROM src b WHERE b.path = s.path AND b.line_no BETWEEN s.line_no AND e.line_no)) AS end_line FROM src s WHERE {has(V.FUNCTION, 's.text')})"""
TREE_FUNCS = f"""fn AS (SELECT root, path, name, start_line, min(line_no)::INTEGER AS end_line FROM (
    SELECT h.root, h.path, h.name, h.start_line, e.line_no, sum(e.net) OVER w AS depth, bool_or(contains(e.text, '{{')) OVER w AS opened
    FROM (SELECT root, path, line_no AS start_line, {ex(V.FUNCTION, 1)} AS name FROM tree WHERE {has(V.FUNCTION)}) h
    JOIN (SELECT *, length(replace(text, '}}', '')) - length(replace(text, '{{', '')) AS net FROM tree) e ON e.root = h.root AND e.path = h.path AND e.line_no >= h.start_line
    WINDOW w AS (PARTITION BY h.root, h.path, h.start_line ORDER BY e.line_no)) WHERE depth <= 0 AND opened GROUP BY ALL)"""
ASKS = f"asks AS (SELECT log_id, id, file AS path, line, {ex(V.QUOTED, 1, 'message')} AS symbol FROM ev WHERE kind IN ('compiler', 'werror') AND line IS NOT NULL)"
CONTEXT = """ctx AS (SELECT a.log_id, a.id, a.path, coalesce(f[1], greatest(1, line - 30))::INTEGER AS start_line, coalesce(f[2], least(90, line + 30))::INTEGER AS end_line, CASE WHEN f IS NULL THEN 'line_window' ELSE 'regex_brace' END AS method, f IS NULL AS degraded
  FROM (SELECT a.*, (SELECT min([start_line, end_line]) FROM fn WHERE fn.path = a.path AND end_line IS NOT NULL AND (fn.name = a.symbol OR a.line BETWEEN start_line AND end_line)) AS f FROM asks a WHERE a.path IN (SELECT path FROM src)) a)"""
HEADERS = r"""hdr AS (SELECT log_id, id, path, line FROM (SELECT a.log_id, a.id, h.path, h.line, row_number() OVER (PARTITION BY a.log_id, a.id ORDER BY h.path) AS n
  FROM asks a JOIN (SELECT path, w, min(line_no) AS line FROM (SELECT path, line_no, unnest(regexp_extract_all(text, '\w+')) AS w FROM src WHERE path LIKE '%.h') GROUP BY ALL) h ON h.w = a.symbol) WHERE n <= 5)"""


def sql(select: str, *ctes: str, upto: str = "ev") -> str:
    return chain(upto, "").rstrip() + "".join(", " + c for c in ctes) + " " + select


def spec(select: str) -> str:
    return f"WITH spec AS ({SPEC_SQL}) {select}"


GRANT = "least(CASE WHEN semantic_class = 'undefined_reference' THEN 900 ELSE 600 END, 650 + log_id % 400)::BIGINT"
LEVEL = f"CASE WHEN {GRANT} >= 900 THEN 3 WHEN {GRANT} >= 600 THEN 2 ELSE 1 END"
TOP_ASKS = ASKS.replace("FROM ev WHERE kind IN ('compiler', 'werror') AND line IS NOT NULL", "FROM top")
TOP_CONTEXT = CONTEXT.replace("greatest(1, line - 30)", "greatest(1, coalesce(line, 1) - 30)").replace("least(90, line + 30)", "least(90, coalesce(line, 1) + 30)")
EVIDENCE_SELECT = f"""SELECT log_id, id, collector, CASE WHEN collector IS NOT NULL THEN level END AS level, array_to_string(list_sort(list_filter([CASE WHEN collector IS NOT NULL THEN 'primary_error' END, CASE WHEN collector = 'compile' THEN 'command_summary' END, CASE WHEN collector = 'compile' AND m IS NOT NULL THEN 'source_snippet' END,
      CASE WHEN collector = 'link' THEN 'link_command' END, CASE WHEN collector IN ('link', 'deps') AND log_id IN (SELECT s_suppkey FROM supplier) THEN 'spec_buildrequires' END, CASE WHEN collector = 'link' AND level = 3 AND sym THEN 'symbol_context' END, CASE WHEN collector = 'spec' AND log_id IN (SELECT s_suppkey FROM supplier) THEN 'spec_section_text' END,
      CASE WHEN collector = 'spec' AND log_id IN (SELECT s_suppkey FROM supplier) THEN 'spec_parse_status' END, CASE WHEN collector = 'spec' AND log_id IN (SELECT s_suppkey FROM supplier) THEN 'failure_context' END, CASE WHEN collector = 'deps' THEN 'missing_dependency' END], lambda x: x IS NOT NULL)), ',') AS contains,
      warnings <> '' OR (collector = 'compile' AND coalesce(dg, false)) AS degraded, warnings, CASE WHEN collector = 'compile' THEN m END AS method, n_headers
      FROM (SELECT t.*, c.method AS m, c.degraded AS dg, coalesce(h.n, 0) AS n_headers, t.symbol IS NOT NULL AND EXISTS (SELECT 1 FROM src WHERE contains(src.text, t.symbol)) AS sym,
        concat_ws(',', CASE WHEN collector = 'compile' AND c.method IS NULL THEN 'source_file_unavailable' END, CASE WHEN collector = 'link' AND level = 3 AND t.symbol IS NOT NULL AND NOT EXISTS (SELECT 1 FROM src WHERE contains(src.text, t.symbol)) THEN 'symbol_context_unavailable' END, CASE WHEN collector IN ('spec', 'deps') AND log_id NOT IN (SELECT s_suppkey FROM supplier) THEN 'spec_file_unavailable' END) AS warnings
        FROM (SELECT *, {LEVEL}::INTEGER AS level, CASE WHEN kind IN ('compiler', 'werror') THEN 'compile' WHEN kind IN ('linker_missing', 'linker_undef') THEN 'link' WHEN kind IN ('spec_script', 'rpm_phase') THEN 'spec' WHEN kind = 'depsolve' THEN 'deps' END AS collector FROM top) t
        LEFT JOIN ctx c USING (log_id, id) LEFT JOIN (SELECT log_id, id, count(*) AS n FROM hdr GROUP BY ALL) h USING (log_id, id))"""
ORACLES = {
    "spec_diff": sql("""SELECT log_id, log_id AS spec, kind AS suggester, requirement, confidence, CASE WHEN confidence IN ('low', 'medium') THEN "after" END AS "after", CASE WHEN confidence IN ('low', 'medium') THEN
        'diff --git a/' || path || ' b/' || path || chr(10) || '--- a/' || path || chr(10) || '+++ b/' || path || chr(10) || '@@ -' || lo || ',' || (hi - lo + 1) || ' +' || lo || ',' || (hi - lo + 2) || ' @@' || chr(10)
        || (SELECT string_agg(' ' || text || CASE WHEN line_no = "after" THEN chr(10) || '+BuildRequires:  ' || requirement ELSE '' END, chr(10) ORDER BY line_no) FROM spec WHERE spec.spec = log_id AND line_no BETWEEN lo AND hi) || chr(10) END AS diff
      FROM (SELECT *, greatest(1, "after" - 2) AS lo, least(23, "after" + 3) AS hi, 'packaging/p' || log_id || '.spec' AS path,
          CASE WHEN "after" IS NULL THEN 'manual' WHEN kind = 'linker_missing' THEN 'low' WHEN EXISTS (SELECT 1 FROM spec WHERE spec.spec = log_id AND regexp_matches(text, '^BuildRequires:') AND lower(replace(text[15:], ' ', '')) = lower(replace(requirement, ' ', ''))) THEN 'advisory' ELSE 'medium' END AS confidence
        FROM (SELECT c.*, (SELECT min(x.line_no) - 1 FROM spec x WHERE x.spec = c.log_id AND NOT starts_with(x.text, 'BuildRequires') AND x.line_no > 2)::INTEGER AS "after",
            CASE WHEN kind = 'depsolve' THEN regexp_extract(message, 'nothing provides (.+?) needed by', 1) ELSE 'lib' || regexp_extract(message, '-l(\\w+)', 1) || '-devel' END AS requirement
          FROM (SELECT log_id, kind, arg_min(message, rank) AS message FROM top WHERE kind IN ('depsolve', 'linker_missing') GROUP BY ALL) c))""", f"spec AS ({SPEC_SQL})", upto="top"),
    "source_functions": f"WITH tree AS ({TREE_SQL}), {TREE_FUNCS} SELECT * FROM fn",
    "tree_context": sql("""SELECT a.log_id, a.id, a.path, coalesce(f[1], greatest(1, line - 30))::INTEGER AS start_line, coalesce(f[2], least(90, line + 30))::INTEGER AS end_line, CASE WHEN f IS NULL THEN 'line_window' ELSE 'regex_brace' END AS method, f IS NULL AS degraded
      FROM (SELECT a.log_id, a.id, a.path, a.line, min(CASE WHEN fn.name = a.symbol OR a.line BETWEEN fn.start_line AND fn.end_line THEN [fn.start_line, fn.end_line] END) AS f
        FROM asks a LEFT JOIN fn ON fn.root = a.log_id AND fn.path = a.path WHERE (a.log_id, a.path) IN (SELECT root, path FROM tree) GROUP BY ALL) a""", f"tree AS ({TREE_SQL})", TREE_FUNCS, ASKS),
    "source_context": sql("SELECT * FROM ctx", BODY, FUNCS, ASKS, CONTEXT),
    "header_declarations": sql("SELECT * FROM hdr", BODY, ASKS, HEADERS),
    "symbol_context": sql("SELECT e.log_id, e.id, min(s.path) AS path FROM ev e JOIN src s ON contains(s.text, e.symbol) WHERE e.kind = 'linker_undef' GROUP BY ALL", BODY),
    "spec_locator": """WITH t AS (SELECT DISTINCT s_suppkey % 40 AS root, 'packaging/p' || (s_suppkey % 3) || '.spec' AS path FROM supplier WHERE (s_suppkey % 40) % 5 <> 0),
      c AS (SELECT a.root, p.package, count(t.path) AS n, count(*) FILTER (ends_with(t.path, '/' || p.package || '.spec')) AS e, min(t.path) AS first FROM range(41) a(root) CROSS JOIN (VALUES ('p1'), ('p9')) p(package) LEFT JOIN t ON t.root = a.root GROUP BY ALL)
      SELECT root, package, CASE WHEN e = 1 THEN 'packaging/' || package || '.spec' WHEN e = 0 AND n = 1 THEN first END AS spec, CASE WHEN e = 1 THEN 'exact' WHEN e > 1 THEN 'ambiguous' WHEN n = 1 THEN 'only' WHEN n = 0 THEN 'missing' ELSE 'ambiguous' END AS status FROM c""",
    "spec_tags": f"SELECT k AS spec, v.place, v.tag, v.number, CASE v.place WHEN 1 THEN 'pkgconfig(x' || k || ')' WHEN 4 THEN 'z' || (k % 3) ELSE v.value END AS value FROM (SELECT s_suppkey AS k FROM supplier), (VALUES (0, 'BuildRequires', NULL::INTEGER, 'cmake'), (1, 'BuildRequires', NULL, ''), (2, 'Patch', 0, 'a.patch'), (3, 'Source', 1, 'app.tar.gz'), (4, 'BuildRequires', NULL, '')) v(place, tag, number, value)",
    "spec_section": spec("SELECT spec, 14 AS start_line, 19 AS end_line, string_agg(text, chr(10) ORDER BY line_no) AS body FROM spec WHERE line_no BETWEEN 14 AND 19 AND spec % 10 <> 9 GROUP BY spec"),
    "spec_warnings": f"SELECT k AS spec, concat_ws(',', CASE WHEN k % 7 = 0 OR k % 8 = 3 THEN 'macros_present_not_expanded' END, CASE WHEN k % 5 = 0 OR k % 8 = 3 THEN 'conditionals_present_not_evaluated' END, CASE WHEN k % 4 = 0 THEN 'subpackages_present_not_resolved' END) AS warnings FROM (SELECT s_suppkey AS k FROM supplier)",
    "toolchain_flags": f"""SELECT k AS spec, CASE WHEN advisory IS NULL THEN CASE WHEN guard AND k % 16 = 3 THEN 16 ELSE flags END END::INTEGER AS insert_after, advisory FROM (SELECT *, CASE WHEN k % 10 = 9 THEN 'no_build_section' WHEN flags IS NULL THEN 'options_not_found' WHEN consumer IS NULL THEN 'no_consumer' WHEN flags >= consumer THEN 'flags_after_consumer' WHEN guard AND k % 16 <> 3 THEN 'unsafe_block' END AS advisory
      FROM (SELECT *, k % 8 = 3 AND flags < 15 AND consumer > 15 AS guard FROM (SELECT k, CASE WHEN k % 9 = 4 THEN 18 WHEN k % 6 <> 5 AND k % 2 = 0 THEN 14 END AS flags, CASE WHEN k % 8 <> 3 AND k % 9 = 4 THEN 15 WHEN k % 11 <> 10 THEN 19 END AS consumer FROM (SELECT s_suppkey AS k FROM supplier))))""",
    "last_command": chain("annotated", "").rstrip() + rf""", ph AS (SELECT log_id, own, s, (SELECT min(m.line_no) FROM annotated m WHERE m.log_id = y.log_id AND {has(V.PHASE, 'm.text')} AND m.line_no > y.s) AS t FROM (
        SELECT log_id, CASE WHEN log_id % 2 = 0 THEN '%build' WHEN log_id % 4 = 1 THEN '%prep' ELSE '%install' END AS own, min(line_no) FILTER ({ex(V.PHASE, 1)} = CASE WHEN log_id % 2 = 0 THEN 'build' WHEN log_id % 4 = 1 THEN 'prep' ELSE 'install' END) AS s FROM annotated GROUP BY log_id) y),
      w AS (SELECT x.*, p.own, CASE WHEN NOT {has(V.PHASE, 'x.text')} THEN {ex(V.SHELL, 1, 'x.text')} END AS cmd, {has(V.SHELL, 'x.text')} AS shell FROM annotated x JOIN ph p ON p.log_id = x.log_id WHERE p.s IS NULL OR (x.line_no > p.s AND (p.t IS NULL OR x.line_no < p.t))),
      l AS (SELECT log_id, own, max(line_no) AS e, max(line_no) FILTER (cmd IS NOT NULL) AS a, arg_max(cmd, line_no) FILTER (cmd IS NOT NULL) AS last_command FROM w GROUP BY ALL)
      SELECT l.log_id, l.own AS phase, l.last_command, (coalesce((SELECT min(w.line_no) FROM w WHERE w.log_id = l.log_id AND w.shell AND w.line_no > l.a) - 1, l.e) - l.a)::INTEGER AS output_lines FROM l WHERE a IS NOT NULL""",
    "missing_dependency": chain("ev", rf"SELECT log_id, id, coalesce({ex(V.DEPENDENCY, 1, 'message')}, trim(message)) AS dependency, {ex(V.DEPENDENCY, 2, 'message')} AS needed_by FROM ev WHERE kind IN ('depsolve', 'raw_error')"),
    "evidence_level": chain("top", f"SELECT log_id, id, {GRANT} AS granted, {LEVEL}::INTEGER AS level FROM top"),
    "evidence": sql(EVIDENCE_SELECT, BODY, FUNCS, TOP_ASKS, TOP_CONTEXT, HEADERS, upto="top"),
}
