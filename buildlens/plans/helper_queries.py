"""Queries of what other queries do not reach: reasons of scores, options, context levels, response files, new failures, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from buildlens.functions import text as T
from buildlens.functions.scratch import new_folder, written
from buildlens.operators import contexts as X
from buildlens.operators import patch, rank, reports, rule_index, rules, scan, state, triage
from buildlens.plans.core import WITH_COMMANDS, annotated, events, scored
from buildlens.plans.sql import chain
from buildlens.sinks.standing import Latest, Seen
from buildlens.sinks.store import Store

#: Text of response file i of log k, if it is there; valid in Spark and in DuckDB.
RSP = "concat('-lfoo', cast(i as string), ' -L/usr/lib/', cast(k % 5 as string), ' a', cast(i as string), '.o -Iinc b.a -shared')"
AS_SQL = lambda text: text.replace("as string", "as varchar")
CATEGORIES = ["depsolve_failure", "patch_failed", "linker_missing_lib", "install_file_missing", "compile_error"]
ARCHES = ["armv7hl", " ARM64 ", "x86_64", "sparc", "amd64"]
CLASSES = ["row failed", "row successful", "unfailed", "a failed successful", "x"]


def part(s, d):
    return s.read.parquet(f"{d}/part.parquet")


def orders(s, d):
    return s.read.parquet(f"{d}/orders.parquet")


def response_files(s, d):
    """Each supplier's number is a log with three response files of the five that commands name."""
    k = s.read.parquet(f"{d}/supplier.parquet").selectExpr("s_suppkey as k", "explode(array(0, 2, 5)) as i")
    return k.selectExpr("k as log_id", "concat('objs', i, '.rsp') as rsp", f"{RSP} as text")


def part_rules(s, d):
    """A rule of each part: some break what first-tier rules must keep."""
    k = F.col("p_partkey")
    text = F.concat(F.when(k % 3 == 0, "It may be ").otherwise("It is "), F.repeat("p_name", F.when(k % 7 == 0, 30).otherwise(1)), F.when(k % 4 == 0, "; run expand").otherwise("."))
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), (k % 5 + 1).cast("int"))
    return part(s, d).select(k.cast("string").alias("rule"), category.alias("category"), F.when(k % 6 == 0, "tier2").otherwise("tier1").alias("tier"), (F.lit(0.9) + F.col("p_size") / 500).alias("confidence"), text.alias("tier1_template"))


#: A pattern of each part, most of them found nowhere; valid in Spark and in DuckDB.
_P = "cast(p_partkey % 97 as string)"
PART_KIND = "case p_partkey % 6 when 0 then 'depsolve' when 1 then 'linker_missing' when 2 then 'linker_undef' when 3 then 'patch' else 'compiler' end"
PART_PATTERN = f"""concat('(?i)', case p_partkey % 6
when 0 then concat('nothing  ?provides|nothing provides PKG', {_P}, chr(92), 'b')
when 1 then concat('cannot find -l(x', {_P}, '|', p_name, ')$')
when 2 then concat('undefined (?:reference|symbol)s? to .(?:s', {_P}, '|', p_brand, ').$')
when 3 then concat('hunk', chr(92), 's*#?', {_P}, chr(92), 's+failed( at ', chr(92), 'd+)?')
when 4 then concat('(?:undeclared|unknown) identifier .v', {_P}, '.|', p_name)
else concat('^', case when p_partkey % 30 = 5 then '[a-z] ag?a*i+n$' else p_name end) end)"""
PART_NEGATIVE = "case when p_partkey % 7 = 0 then '(?i)pkg3|V2' end"


def part_library(s, d):
    """A rule of each part, as a library of thousands."""
    return part(s, d).select(F.col("p_partkey").cast("int").alias("rule_ord"), F.lit(0).alias("regex_ord"), F.expr(PART_KIND).alias("kind"), F.expr(PART_PATTERN).alias("regex"), F.expr(PART_NEGATIVE).alias("negative"))


def library_hits(s, d):
    """How many rules of the library each event meets, and the first of them; messages that repeat are tried once, on a number of
    tasks of its own, and so are rules that differ by their numbers alone."""
    ev = written(events(s, d).select("log_id", "id", "kind", "message"), "events")
    told = ev.select("kind", "message").distinct().repartition(int(s.conf.get("spark.sql.shuffle.partitions")))
    library = part_library(s, d).groupBy("kind", "regex", "negative").agg(F.min("rule_ord").alias("rule_ord"), F.min("regex_ord").alias("regex_ord"), F.count(F.lit(1)).alias("rules"))
    met = rule_index.hits(told, written(library, "library")).groupBy("kind", "message").agg(F.sum("rules").alias("n"), F.min("rule_ord").alias("first_rule"))
    return ev.join(met, ["kind", "message"]).select("log_id", "id", "n", "first_rule")


def reconciled(s, d):
    """Units by customer with three rounds each, of which every thirteenth has two of one edit; orders are passes, links and free invocations."""
    c, k, i = F.col("c_custkey"), F.col("o_orderkey"), F.col("i")
    customers = s.read.parquet(f"{d}/customer.parquet").select("c_custkey")
    rounds = customers.select(c.alias("unit"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("i")).select("unit", i.alias("round"), F.when((F.col("unit") % 13 == 0) & (i == 2), 1).otherwise(i).alias("edit"))
    current = rounds.filter(F.col("round") == F.col("unit") % 3 + 1)
    o = orders(s, d).select(F.col("o_custkey").alias("unit"), "o_orderkey", (k % 37).cast("int").alias("edit"))
    links = o.filter(k % 4 == 0).select("unit", "edit", F.when(k % 72 != 0, k).alias("event_id"))
    passes = state.attributed(o.filter(k % 4 != 0).select("unit", k.alias("verification_id"), "edit"), rounds)
    free = o.filter(k % 11 == 0).groupBy("unit", (k % 3 + 1).cast("int").alias("round")).agg(F.count(F.lit(1)).alias("n"))
    return state.reconciled(current, links, passes, free)


def builds(s, d):
    k = F.col("o_orderkey")
    text = F.when(k % 11 == 0, "not a date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return orders(s, d).select(k.alias("build"), text.alias("begin_date"), F.when(k % 3 == 0, "failed").otherwise("successful").alias("status"))


def listed(values):
    return F.array(*map(F.lit, values))


def named(s, d):
    k = F.col("p_partkey")
    pick = lambda values: F.element_at(listed(values), (k % len(values) + 1).cast("int"))
    return part(s, d).select(
        k.alias("k"),
        T.normal_arch(pick(ARCHES)).alias("arch"),
        T.devel_package(F.concat(F.when(k % 2 == 0, "lib").otherwise(""), F.lit("x"), (k % 9).cast("string"), F.when(k % 3 == 0, ".so.1").otherwise(""))).alias("devel"),
        reports.status_of_classes(pick(CLASSES)).alias("status"),
        reports.snapshot_name(F.concat(F.when(k % 2 == 0, " Snapshot: ").otherwise("build "), "p_name", F.lit("  x "))).alias("snapshot"),
    )


def why(s, d):
    """Each factor of each event's score."""
    df = scored(s, d).select("log_id", "id", F.posexplode(rank.reasons()).alias("place", "r"))
    return df.select("log_id", "id", "place", "r.factor", F.round("r.delta", 6).alias("delta"))


def thirds(s, d):
    """Orders as status rows in three parts, as they would come one after another."""
    rows = orders(s, d).select(F.col("o_orderkey").alias("unit"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("record"))
    return [rows.filter(F.col("unit") % 3 == i) for i in range(3)]


def as_of_two(s, d):
    """Status rows and their records, committed in pairs, as of the second of three commits."""
    store = Store(s, new_folder(s, "store"))
    for rows in thirds(s, d):
        store.commit({"status": rows.select("unit", "status"), "records": rows.select("unit", "record")})
    return store.read("status", 2).join(store.read("records", 2), "unit")


def inserted_again(s, d):
    """Keys inserted twice, the second time with new ones among them."""
    store, (one, two, three) = Store(s, new_folder(s, "store")), thirds(s, d)
    store.insert_or_compare("keys", one.unionByName(two), ["unit"])
    store.insert_or_compare("keys", two.unionByName(three), ["unit"])
    return store.read("keys")


def changes(s, d):
    """A base and three deltas of orders by customer."""
    rows = orders(s, d).select(F.col("o_custkey").alias("unit"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("event"), F.col("o_orderstatus").alias("status"))
    return [rows.filter(F.col("event") % 4 == i) for i in range(4)]


def standing_latest(s, d):
    held = Latest(Store(s, new_folder(s, "standing")), "latest", ["unit"], ["at", "event"])
    for i, rows in enumerate(changes(s, d)):
        held.add(rows)
        if i == 2:
            held.compact()
    return held.read()


def standing_new(s, d):
    """Units that each delta brings for the first time."""
    held, out = Seen(Store(s, new_folder(s, "seen")), "units", ["unit"]), None
    for i, rows in enumerate(changes(s, d)):
        new = held.add(rows.select("unit")).select("unit", F.lit(i).alias("delta"))
        out = new if out is None else out.unionByName(new)
    return out


QUERIES = {
    "store_as_of": as_of_two,
    "store_inserts": inserted_again,
    "standing_latest": standing_latest,
    "standing_new_units": standing_new,
    "cause_reasons": why,
    "unknown_options": lambda s, d: X.distinct_options(events(s, d)),
    "context_level": lambda s, d: events(s, d).select("log_id", "id", patch.context_level(F.col("kind"), F.col("file").isNotNull(), F.col("line") % 3).alias("level")),
    "message_truncated": lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", T.truncated(F.col("text"), 80).alias("text")),
    "expanded_commands": lambda s, d: reports.expanded_commands(scan.commands(annotated(s, d)), response_files(s, d)).drop("defines"),
    "recent_failures": lambda s, d: triage.recent_failures(builds(s, d), F.lit("1996-01-01").cast("timestamp")).select("build", "begin_date"),
    "changed_identity": lambda s, d: state.changed_identity(orders(s, d).select(F.col("o_custkey").alias("unit"), "o_orderstatus", "o_orderpriority"), ["o_orderstatus", "o_orderpriority"]),
    "normal_names": named,
    "reconcile_branch": reconciled,
    "rule_library_hits": library_hits,
    "rule_violations": lambda s, d: rules.rule_violations(part_rules(s, d)),
}

_FACTORS = [
    ("semantic_class", "NOT linked", "base"),
    ("linker_undef_no_cascade_penalty", "NOT linked AND kind = 'linker_undef'", "0.0"),
    ("cascade_probability", "NOT linked AND kind <> 'linker_undef'", "-(cascade * 0.3)"),
    ("has_command", "NOT linked AND command_id IS NOT NULL", "0.05"),
    ("has_location", "NOT linked AND coalesce(file, '') <> '' AND coalesce(line, 0) <> 0", "0.05"),
    ("patch_failed_phase", "NOT linked AND kind = 'patch' AND phase IS NOT DISTINCT FROM failed_phase", "0.1"),
    ("warning_block", "NOT linked AND in_warning_block", "-0.3"),
    ("parent_cascade", "NOT linked AND parent IS NOT NULL", "-0.4"),
    ("make_cascade_parent", "linked", "0.1"),
]
_EACH = " UNION ALL ".join(f"SELECT log_id, id, {i} AS n, '{name}' AS factor, round(({delta})::DOUBLE, 6) AS delta FROM l WHERE {when}" for i, (name, when, delta) in enumerate(_FACTORS))
ORACLES = {
    "store_as_of": "SELECT o_orderkey AS unit, o_orderstatus AS status, o_orderpriority AS record FROM orders WHERE o_orderkey % 3 < 2",
    "store_inserts": "SELECT o_orderkey AS unit, o_orderstatus AS status, o_orderpriority AS record FROM orders",
    "standing_latest": 'SELECT o_custkey AS unit, max(o_orderdate) AS "at", arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS event, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY o_custkey',
    "standing_new_units": "SELECT o_custkey AS unit, min(o_orderkey % 4)::INTEGER AS delta FROM orders GROUP BY o_custkey",
    "cause_reasons": chain("scored", "").rstrip() + f", l AS (SELECT *, kind = 'make_cascade' AND parent IS NOT NULL AS linked FROM scored) SELECT log_id, id, (row_number() OVER (PARTITION BY log_id, id ORDER BY n) - 1)::INTEGER AS place, factor, delta FROM ({_EACH})",
    "unknown_options": chain("ev", "SELECT log_id, string_agg(warning_option, ',' ORDER BY seq) AS options FROM (SELECT log_id, warning_option, min(seq) AS seq FROM ev WHERE warning_option IS NOT NULL GROUP BY ALL) GROUP BY log_id"),
    "context_level": chain("ev", "SELECT log_id, id, CASE WHEN kind NOT IN ('compiler', 'werror') THEN 'n/a' WHEN file IS NULL THEN 'C' WHEN line % 3 = 1 THEN 'A' ELSE 'B' END AS level FROM ev"),
    "message_truncated": "SELECT doc_id, CASE WHEN length(text) > 80 THEN rtrim(substring(text, 1, 77), ' ') || '...' ELSE text END AS text FROM documents",
    "expanded_commands": WITH_COMMANDS(f"""SELECT log_id, id, rsp, text IS NOT NULL AS found, bool_or(text IS NULL) OVER (PARTITION BY log_id, id) AS degraded, CASE WHEN text IS NOT NULL THEN '-lfoo' || i END AS libraries, CASE WHEN text IS NOT NULL THEN '-L/usr/lib/' || (log_id % 5) END AS library_paths,
      CASE WHEN text IS NOT NULL THEN '-shared' END AS flags, CASE WHEN text IS NOT NULL THEN '-Iinc' END AS includes, CASE WHEN text IS NOT NULL THEN 'a' || i || '.o b.a' END AS objects
      FROM (SELECT log_id, id, unnest(regexp_extract_all(argv, '@([^\\s]+\\.rsp)', 1)) AS rsp FROM commands) c LEFT JOIN (SELECT s_suppkey AS log_id, i, 'objs' || i || '.rsp' AS rsp, 'x' AS text FROM supplier, (VALUES (0), (2), (5)) v(i)) f USING (log_id, rsp)"""),
    "recent_failures": "SELECT o_orderkey AS build, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS begin_date FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 3 = 0 AND o_orderdate >= TIMESTAMP '1996-01-01'",
    "changed_identity": "SELECT o_custkey AS unit, count(DISTINCT (o_orderstatus, o_orderpriority)) AS versions FROM orders GROUP BY o_custkey HAVING versions > 1",
    "normal_names": "SELECT p_partkey AS k, [" + ", ".join(f"'{v}'" if v else "NULL" for v in ("armv7l", "aarch64", "x86_64", "", "x86_64")) + "][p_partkey % 5 + 1] AS arch, 'libx' || (p_partkey % 9) || '-devel' AS devel, ['failed', 'successful', NULL, 'failed', NULL][p_partkey % 5 + 1] AS status, p_name || ' x' AS snapshot FROM part",
    "reconcile_branch": """WITH rounds AS (SELECT c_custkey AS unit, i AS round, CASE WHEN c_custkey % 13 = 0 AND i = 2 THEN 1 ELSE i END AS edit FROM customer, range(1, 4) t(i)),
      cur AS (SELECT * FROM rounds WHERE round = unit % 3 + 1),
      o AS (SELECT o_custkey AS unit, o_orderkey AS k, o_orderkey % 37 AS edit FROM orders),
      told AS (SELECT o.unit, o.k, count(r.round) AS n, min(r.round) AS round FROM o LEFT JOIN rounds r ON r.unit = o.unit AND r.edit = o.edit WHERE o.k % 4 <> 0 GROUP BY ALL),
      acts AS (SELECT unit, round, coalesce(p, 0) AS p, coalesce(f, 0) AS f FROM (SELECT unit, round, count(*) AS p FROM told WHERE n = 1 GROUP BY ALL) FULL JOIN (SELECT unit, k % 3 + 1 AS round, count(*) AS f FROM o WHERE k % 11 = 0 GROUP BY ALL) USING (unit, round)),
      facts AS (SELECT c.unit, EXISTS (SELECT 1 FROM o WHERE o.unit = c.unit AND k % 72 = 0) OR (SELECT count(*) FROM o WHERE o.unit = c.unit AND k % 4 = 0 AND o.edit = c.edit) > 1 OR EXISTS (SELECT 1 FROM told t WHERE t.unit = c.unit AND n > 1) AS bad,
        EXISTS (SELECT 1 FROM o WHERE o.unit = c.unit AND k % 4 = 0 AND o.edit = c.edit) AS linked, EXISTS (SELECT 1 FROM acts a WHERE a.unit = c.unit AND a.round = c.round AND p = 1 AND f = 1) AS anew,
        (SELECT count(*) FROM acts a WHERE a.unit = c.unit AND p > 0 AND NOT (p = 1 AND f = 1)) AS held, (SELECT count(*) FROM acts a WHERE a.unit = c.unit AND p = 1 AND f = 1) AS relinked, (SELECT count(*) FROM acts a WHERE a.unit = c.unit AND p = 0) AS filled FROM cur c)
      SELECT unit, CASE WHEN bad THEN 'state_inconsistent_held' WHEN held > 0 THEN 'orphan_pass_held' WHEN linked THEN 'linked_already' WHEN anew THEN 'relinked' ELSE 'proceed' END AS branch,
        CASE WHEN bad THEN 0 ELSE held END AS held, CASE WHEN bad THEN 0 ELSE relinked END AS relinked, CASE WHEN bad THEN 0 ELSE filled END AS filled FROM facts""",
    "rule_library_hits": chain("blocked", "").rstrip() + AS_SQL(f""", lib AS (SELECT p_partkey AS rule_ord, {PART_KIND} AS kind, {PART_PATTERN} AS regex, {PART_NEGATIVE} AS negative FROM part),
      told AS (SELECT DISTINCT kind, message FROM blocked),
      met AS (SELECT kind, message, count(*) AS n, min(rule_ord)::INTEGER AS first_rule FROM told JOIN lib USING (kind) WHERE regexp_matches(message, regex) AND NOT coalesce(regexp_matches(message, negative), false) GROUP BY ALL)
      SELECT log_id, id, n, first_rule FROM blocked JOIN met USING (kind, message)"""),
    "rule_violations": """WITH r AS (SELECT p_partkey AS k, p_partkey::VARCHAR AS rule, p_partkey % 5 = 1 AS patch, 0.9 + p_size / 500 AS confidence, CASE WHEN p_partkey % 3 = 0 THEN 'It may be ' ELSE 'It is ' END || repeat(p_name, CASE WHEN p_partkey % 7 = 0 THEN 30 ELSE 1 END) || CASE WHEN p_partkey % 4 = 0 THEN '; run expand' ELSE '.' END AS t FROM part WHERE p_partkey % 6 <> 0)
      SELECT rule, 'category' AS violation FROM r WHERE k % 5 = 4 UNION ALL SELECT rule, 'confidence' FROM r WHERE confidence < 0.95 UNION ALL SELECT rule, 'template too long' FROM r WHERE length(t) > CASE WHEN patch THEN 150 ELSE 300 END
      UNION ALL SELECT rule, 'template not cautious' FROM r WHERE NOT regexp_matches(t, '\\b(may|usually|suggest)\\b') UNION ALL SELECT rule, 'template without expand' FROM r WHERE NOT contains(t, 'expand')""",
}
