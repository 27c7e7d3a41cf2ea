"""What copies of the driver's tables showed: rare logs, and steps that must not grow faster than their input."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from buildlens.operators import evidence, rule_index, scan, state
from buildlens.plans import core, helper_queries, registry


def tables(spark, folder, events):
    """events.parquet of rows (event_id, user_id), in order of their ids."""
    spark.createDataFrame(events, "event_id long, user_id long").selectExpr("*", "timestamp_seconds(event_id) as ts").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def both(spark, folder, name):
    """A query's rows and those of its SQL."""
    df = registry.QUERIES[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{folder}/events.parquet/*.parquet')")
    want = con.execute(f"select {', '.join(df.columns)} from ({registry.ORACLES[name]})").fetchall()
    key = lambda r: tuple(map(str, r))
    return sorted(map(tuple, df.collect()), key=key), sorted(want, key=key)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_first_cause_without_a_place_is_classed_as_in_the_sql(spark, tmp_path):
    got, want = both(spark, tables(spark, tmp_path, [(18, 1), (19, 1), (24 * 5 + 2, 2)]), "failure_class")
    assert got == want and (1, "E001", "source_unreachable", "denied", 0.55, "heuristic:source_unreachable") in got


def test_a_large_cluster_without_places_is_covered_as_in_the_sql(spark, tmp_path):
    got, want = both(spark, tables(spark, tmp_path, [(24 * i + 17, u) for u in (3, 5) for i in range(12)]), "coverage_branch")
    assert got == want and got[0][:2] == (3, "cluster")


def test_passes_meet_counts_of_rounds_and_no_pairs(spark):
    passes = spark.createDataFrame([(1, 10, 5), (1, 11, 6), (1, 12, 7), (2, 10, 5), (1, 10, 6), (1, 13, None)], "unit int, verification_id int, edit int")
    rounds = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (1, 3, 6), (2, 4, 5), (1, None, 7)], "unit int, round int, edit int")
    df = state.attributed(passes, rounds)
    got = {(r.unit, r.verification_id): (r.attribution, r.round) for r in df.collect()}
    assert got == {(1, 10): ("inconsistent", None), (1, 11): ("inconsistent", None), (1, 12): ("non_campaign", None), (2, 10): ("attributed", 4), (1, 13): ("non_campaign", None)}
    assert "Aggregate" in plan(df).split("Join", 1)[1]


def test_a_file_window_holds_places_and_not_asks(spark):
    lines = spark.createDataFrame([("r", "a.c", i, t) for i, t in enumerate(["int f(int a) {", "  x();", "}", "", "int g(void)", "{", "}"], 1)], "root string, path string, line_no int, text string")
    asks = spark.createDataFrame([(log, str(line), "r", path, line, symbol) for log in range(3) for path, line, symbol in [("a.c", 2, None), ("a.c", 4, "g"), ("a.c", 4, None), ("a.c", None, "f"), ("b.c", 1, None)]], "log_id int, id string, root string, path string, line int, symbol string")
    df = evidence.source_contexts(asks, lines)
    got = sorted(map(tuple, df.collect()))
    assert got == sorted(row for log in range(3) for row in [(log, "2", "a.c", 1, 3, "regex_brace", False), (log, "4", "a.c", 5, 7, "regex_brace", False), (log, "4", "a.c", 1, 7, "line_window", True), (log, "None", "a.c", 1, 3, "regex_brace", False)])
    below = plan(df).split("Window")[-1]
    assert all(c in below.split("Aggregate", 1)[1].split("]", 1)[0] for c in ("root#", "path#", "line#", "symbol#"))


def test_rules_that_repeat_are_tried_once(spark, tmp_path, monkeypatch):
    folder = tables(spark, tmp_path, [(8, 1), (32, 1)])
    spark.createDataFrame([(k + 20370 * i, "large ring", "Brand#7") for k in range(12) for i in range(5)], "p_partkey long, p_name string, p_brand string").write.parquet(f"{folder}/part.parquet")
    tried, hits = [], rule_index.hits
    monkeypatch.setattr(rule_index, "hits", lambda ev, rules: tried.append(rules.count()) or hits(ev, rules))
    assert sorted(map(tuple, helper_queries.library_hits(spark, folder).collect())) == [(1, "E001", 10, 0), (1, "E002", 10, 0)]
    assert tried == [12]


@pytest.mark.parametrize("name", ["events", "scored", "top"])
def test_plans_over_events_read_them_written(spark, tmp_path, name):
    folder = tables(spark, tmp_path, [(i, 1) for i in range(24)])
    assert not any(folder in f for f in getattr(core, name)(spark, folder).inputFiles())


def test_log_window_scans_the_log_once(spark, tmp_path, monkeypatch):
    folder = tables(spark, tmp_path, [(i, i % 3) for i in range(480)])
    tags, written = [], core.written
    monkeypatch.setattr(core, "written", lambda df, tag: tags.append(tag) or written(df, tag))
    got = sorted(map(tuple, registry.QUERIES["log_window"](spark, folder).select("log_id", "line_no", "at", "text").collect()))
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{folder}/events.parquet/*.parquet')")
    assert got == sorted(con.execute(f'select log_id, line_no, "at", text from ({registry.ORACLES["log_window"]})').fetchall())
    assert got and tags.count("classified") == 1


def test_carries_of_parts_shuffle_no_facts(spark, tmp_path):
    folder = tables(spark, tmp_path, [(i, 1) for i in range(48)])
    lines = core.classified(spark, folder)
    carry = plan(scan.annotate(lines)).split("Join", 1)[1].split("RepartitionByExpression")[2]
    assert "fact#" not in carry.split("Relation", 1)[0].replace("isnotnull(fact#", "")


def test_only_failed_preps_and_patches_are_windowed_for_parents(spark, tmp_path):
    folder = tables(spark, tmp_path, [(12, 1), (33, 1), (34, 1), (39, 1)])
    ev = scan.events(core.annotated(spark, folder))
    assert [tuple(r) for r in scan.patch_parents(ev).collect()] == [(1, "E002", "E001")]
    assert {r["id"]: r["parent"] for r in scan.with_parents(ev).collect()} == {"E001": None, "E002": "E001", "E003": None}


def test_no_step_of_classify_is_too_long_to_be_compiled(spark, tmp_path):
    """HotSpot leaves methods of more than 8,000 bytecodes to its interpreter."""
    folder = tables(spark, tmp_path, [(i, 1) for i in range(24)])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = scan.classify(scan.normalise(core.logl(spark, folder)))
        code = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package").codegenString(df._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) <= 8000


def test_no_event_is_shuffled_for_few_parents_and_phases(spark, tmp_path, monkeypatch):
    folder = tables(spark, tmp_path, [(i, 1) for i in (12, 33, 34, 39)] + [(i, 2) for i in (2, 3, 149)])
    plans, written = {}, core.written
    monkeypatch.setattr(core, "written", lambda df, tag: plans.update({tag: df._jdf.queryExecution().executedPlan().toString()}) or written(df, tag))
    got = {(r.log_id, r.id): r.parent for r in core.events(spark, folder).collect()}
    assert "hashpartitioning" not in plans["events"] and "hashpartitioning" in plans["parents"]
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{folder}/events.parquet/*.parquet')")
    want = con.execute(f"select log_id, id, parent from ({core.chain('ev', 'SELECT log_id, id, parent FROM ev')})").fetchall()
    assert got == {(log, i): p for log, i, p in want} and [p for p in got.values() if p] == ["E001", "E001"]


def test_numbers_have_three_digits_at_least(spark):
    df = spark.createDataFrame([(0,), (7,), (999,), (1000,), (12345,)], "n int")
    assert [r[0] for r in df.select(scan.numbered("E", F.col("n"))).collect()] == ["E000", "E007", "E999", "E1000", "E12345"]
