import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from buildlens.functions import text as T
from buildlens.operators import candidates, clusters, convergence, packet, patch, rank, rules, scan, state, triage
from buildlens.plans import registry
from buildlens.plans.synthetic import logl
from buildlens.sources import logs
from buildlens.streaming import scanner

SF = "/root/testdata/sf0.001"


def lines(spark, *texts, log="L"):
    return spark.createDataFrame([(log, i, t) for i, t in enumerate(texts, 1)], "log_id string, line_no int, raw_text string")


def scored(spark, *texts):
    ev = scan.with_failed_phase(scan.with_parents(scan.events(scan.scanned(lines(spark, *texts)))))
    return rank.scored(rank.classified(rank.warning_block(ev)))


CASCADE = ["+ %build", "+ gcc -c src/a.c", "src/a.c:4:10: error: use of undeclared identifier 'root'", "make: *** [a.o] Error 1"]


def test_cascade_sample(spark):
    rows = {r["id"]: r for r in scored(spark, *CASCADE).collect()}
    assert rows["E001"]["kind"] == "compiler" and rows["E002"]["parent"] == "E001" and rows["E001"]["failed_phase"] == "%build"
    assert round(rows["E001"]["score"], 4) == 0.76 and rows["E001"]["bucket"] == 15 and rows["E001"]["band"] == "medium_high"
    assert rows["E002"]["score"] == 0.1 and rows["E002"]["bucket"] == 2 and rows["E002"]["band"] == "low"


def test_warning_block_and_near_tie(spark):
    near = ["+ %build", "+ gcc -o app b.o", "b.c:1:1: warning: unused variable 'x' [-Wunused-variable]", "x", "ld: cannot find -lfoo"]
    sc = scored(spark, *near)
    assert [(r["id"], round(r["score"], 4)) for r in rank.top_causes(sc).orderBy("rank").collect()] == [("E002", 0.685), ("E001", 0.68)]
    assert rules.quick_match(sc, rules.rule_frame(spark)).count() == 0
    far = scored(spark, *near[:3], *["x"] * 5, near[4])
    assert [(r["id"], round(r["score"], 4)) for r in rank.top_causes(far).orderBy("rank").collect()] == [("E002", 0.985), ("E001", 0.38)]
    assert rules.quick_match(far, rules.rule_frame(spark)).first()["rule"] == "linker_missing_library"


def test_continuation(spark):
    a = scan.scanned(lines(spark, "+ gcc -c a.c \\", "-O2 \\", "-Wall", "x.c:1:1: error: e", "noise \\", "y.c:2: error: f"))
    c = scan.commands(a).collect()
    assert len(c) == 1 and c[0]["n_lines"] == 3 and c[0]["argv_short"] == "gcc -c a.c -O2 -Wall" and c[0]["tool"] == "gcc"
    assert [(r["line_no"], r["command_id"], r["column"]) for r in scan.events(a).orderBy("seq").collect()] == [(4, "C001", 1), (6, "C001", None)]


@pytest.mark.parametrize(
    "text, kind, message",
    [
        ("nothing provides a needed by b", "depsolve", None),
        ("Patch #3 (x.patch) failed", "patch", None),
        ("can't find file to patch at input line 5", "patch", "error: patch failed: can't find file to patch at input line 5"),
        ("2 out of 3 hunks ignored", "patch", "Hunk #2 FAILED: 2 out of 3 hunks ignored"),
        ("patch: **** malformed patch at line 9", "patch", None),
        ("error: patch failed: src/a.c:7", "patch", None),
        ("File not found: /x", "install_missing", None),
        ("Installed (but unpackaged) file(s) found:", "install_missing", None),
        ("error: unknown warning option '-Wfoo' [-Werror,-Wunknown-warning-option]", "werror", None),
        ("a.c:1:2: error: old [-Werror,-Wx]", "werror", "old [-Werror,-Wx]"),
        ("cc1: all warnings being treated as errors", "werror", None),
        ("cc1: error: bad [-Werror]", "werror", None),
        ("ld: cannot find -lz", "linker_missing", None),
        ("undefined reference to `f'", "linker_undef", None),
        ("A.S:3: fatal error: no", "compiler", "no"),
        ("error: Bad exit status from /t (%build)", "rpm_phase", None),
        ("make[1]: *** [x/y.o] Error 2", "make_cascade", None),
        ("spec file has an error", "spec_script", None),
        ("fatal: x", "raw_error", None),
        ("making patches", None, None),
    ],
)
def test_ladder(spark, text, kind, message):
    rows = scan.events(scan.scanned(lines(spark, "\x1b[31m[ 12s] " + text))).collect()
    assert ([r["kind"] for r in rows] or [None]) == [kind] and scanner.kind_of(text)[0] == kind
    if kind:
        assert rows[0]["message"] == (message or text)


POOL = ["+ %build", "+ %prep", "Executing(%install): x", "+ gcc -c a.c", "+ g++ \\", "-O2 \\", "plain", "a.c:1:1: error: e", "d/a.c:2: warning: w", "b.cc:3:4: error: z [-Werror,-Wq]", "make: *** [a.o] Error 1", "make: *** [o/b.cc.o] Error 1", "Hunk #1 FAILED", "error: Bad exit status from x (%prep)", "ld: cannot find -lx", "", "warning: \\"]


def test_windows_equal_the_sequential_scanner(spark):
    r = random.Random(4)
    rows = [(f"L{g}", i, r.choice(POOL)) for g in range(40) for i in range(1, 31)]
    want = []
    for g in range(40):
        held = scanner.fresh()
        want += [e for log, n, t in rows if log == f"L{g}" and (e := scanner.step(held, log, n, t))]
    ev = scan.with_parents(scan.events(scan.scanned(spark.createDataFrame(rows, "log_id string, line_no int, raw_text string"))))
    got = [tuple(x) for x in ev.select("log_id", "id", "kind", "severity", "message", "line_no", "phase", "command_id", "file", "line", "parent").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def streamed(spark, tmp_path, *batches):
    """Runs batches of (log_id, line_no, raw_text, minute) one after another; events and the number of logs held after each."""
    spark.conf.set(*scanner.STATE_STORE)
    (tmp_path / "in").mkdir()
    q = scanner.scan_stream(scanner.landed(spark, str(tmp_path / "in"), 1)).writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "c"))
    held, q = [], q.start()
    try:
        for k, rows in enumerate(batches):
            table = spark.createDataFrame(rows, "log_id string, line_no int, raw_text string, minute int").withColumn("at", F.timestamp_seconds(F.col("minute") * 60 + 1_000_000)).drop("minute")
            table.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
            q.processAllAvailable()
            held.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    finally:
        q.stop()
    return spark.table("streamed"), held


def test_stream_equals_batch(spark, tmp_path):
    df = logl(spark, SF).select(F.col("log_id").cast("string").alias("log_id"), "line_no", "raw_text", F.lit(1).alias("minute"))
    rows = [tuple(r) for r in df.collect()]
    got, _ = streamed(spark, tmp_path, [r for r in rows if r[1] <= 30], [r for r in rows if r[1] > 30])
    want = scan.with_parents(scan.events(scan.scanned(df))).select("log_id", "id", "kind", "line_no", "parent")
    assert sorted(map(tuple, got.select("log_id", "id", "kind", "line_no", "parent").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_stream_forgets_logs_by_timers(spark, tmp_path):
    error = "a.c:1:1: error: e"
    first = [("A", 1, "+ %build", 0), ("A", 2, error, 1), ("B", 1, error, 0), ("C", 1, error, 0), ("C", 2, None, 0)]
    got, held = streamed(spark, tmp_path, first, [("D", 1, "x", 600)], [("D", 2, "y", 601)], [("A", 3, error, 602), ("B", 2, error, 3)], [("A", 4, error, 603)])
    events = sorted((r["log_id"], r["line_no"], r["id"], r["phase"]) for r in got.collect())
    # A begins anew after six hours of silence; B's line of the third minute comes too late and is dropped
    assert events == [("A", 2, "E001", "%build"), ("A", 3, "E001", None), ("A", 4, "E002", None), ("B", 1, "E001", None), ("C", 1, "E001", None)]
    assert held[2] < held[0]


def test_parts_of_logs_equal_the_sequential_scanner(spark, monkeypatch):
    r = random.Random(9)
    pool = [*POOL, "x \x01 a.c:7: error: odd", "+ ld \\", "error: in a command \\"]
    rows = [(f"L{g}", i, r.choice(pool)) for g in range(6) for i in range(1, 300)]
    want = []
    for g in range(6):
        held = scanner.fresh()
        want += [e for log, n, t in rows if log == f"L{g}" and (e := scanner.step(held, log, n, t))]
    df = spark.createDataFrame(rows, "log_id string, line_no int, raw_text string")
    whole = sorted(map(str, scan.with_offsets(df).collect()))
    monkeypatch.setattr(scan, "PART_LINES", 7)
    ev = scan.with_parents(scan.events(scan.scanned(df)))
    got = [tuple(x) for x in ev.select("log_id", "id", "kind", "severity", "message", "line_no", "phase", "command_id", "file", "line", "parent").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sorted(map(str, scan.with_offsets(df).collect())) == whole


def test_one_log_is_many_tasks_and_its_carry_a_row_a_part(spark, monkeypatch):
    monkeypatch.setattr(scan, "PART_LINES", 1000)
    log = spark.range(1, 40_001).select(F.concat(F.lit("L"), F.col("id") % 1).alias("log_id"), F.col("id").cast("int").alias("line_no"), F.concat(F.lit("a.c:"), "id", F.lit(": error: e")).alias("raw_text"))
    ev = scan.events(scan.scanned(log))
    assert ev.select(F.spark_partition_id()).distinct().count() > 1
    assert ev.agg(F.count_if(F.expr('seq = line_no')), F.max("seq")).first() == (40_000, 40_000)
    plan = ev._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Python" not in plan and "REPARTITION_BY_NUM" in plan


def test_logs_are_read(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"+ %build\r\nx\xff\n\nlast")
    with gzip.open(tmp_path / "b.log.gz", "wb") as f:
        f.write(b"one\ntwo\n")
    rows = {(os.path.basename(r["log_id"]), r["line_no"]): (r["raw_offset"], r["raw_text"]) for r in logs.read_logs(spark, str(tmp_path)).collect()}
    assert rows[("a.log", 1)] == (0, "+ %build") and rows[("a.log", 4)][1] == "last" and rows[("a.log", 2)][1] == "x�"
    assert rows[("b.log.gz", 2)] == (4, "two") and len(rows) == 6


def test_clusters(spark):
    ev = scan.events(scan.scanned(lines(spark, *[f"f{i % 2}.c:{i}:1: warning: w [-Wx]" for i in range(1, 4)], *["g.c:1:1: warning: w [-Wy]"] * 2, *[f"h.c:{i}: error: e [-Werror,-Wz]" for i in range(1, 11)])))
    rows = {r["option"]: r for r in clusters.error_clusters(ev).collect()}
    assert set(rows) == {"-Wx", "-Wz"} and rows["-Wx"]["files"] == ["f1.c", "f0.c"] and not rows["-Wx"]["large_scale"] and rows["-Wz"]["large_scale"]
    assert [r["place"] for r in clusters.cluster_sample(ev).filter("option = '-Wz'").collect()] == list(range(1, 11))


def test_paths_and_ownership(spark):
    files = spark.createDataFrame([("r", p) for p in ("src/a.c", "lib/a.c", "src/b.c", "build/c.c", "vendor/d.c")], "root string, path string")
    asked = spark.createDataFrame([("r", p) for p in ("a.c", "src/a.c", "/x/y/src/b.c", "c.c", "d.c", "/usr/include/z.h")], "root string, file string")
    m = candidates.mapped_paths(asked, files)
    assert {r["file"]: r["mapped"] for r in m.collect()} == {"a.c": None, "src/a.c": "src/a.c", "/x/y/src/b.c": "src/b.c", "d.c": "vendor/d.c"}
    two = files.union(spark.createDataFrame([("q", "src/a.c")], "root string, path string"))
    asked_two = spark.createDataFrame([("r", "src/a.c"), ("q", "src/a.c"), ("q", "src/b.c")], "root string, file string")
    assert {(r["root"], r["file"], r["mapped"]) for r in candidates.mapped_paths(asked_two, two).collect()} == {("r", "src/a.c", "src/a.c"), ("q", "src/a.c", "src/a.c")}
    own = {r["file"]: r["source_ownership_status"] for r in candidates.owned(asked, m).collect()}
    assert own == {"a.c": "unknown", "src/a.c": "project_owned", "/x/y/src/b.c": "project_owned", "c.c": "unknown", "d.c": "generated_or_vendor", "/usr/include/z.h": "system_or_toolchain_path"}


def test_text_functions(spark):
    one = spark.range(1).select(
        T.normal_path(F.lit("/a/../../b/./c")).alias("p"),
        T.normal_path(F.lit("../x/..")).alias("r"),
        T.normal_message(F.lit("A.c:12:3  x 45")).alias("m"),
        T.token_estimate(F.lit("构建 a.c ok!")).alias("t"),
        T.slug(F.lit("--A b__c--")).alias("s"),
        T.filled(F.lit("{a} {b}"), F.create_map(F.lit("a"), F.lit("1"))).alias("f"),
        T.normal_arch(F.lit("ARM64")).alias("arch"),
        T.devel_package(F.lit("libz.so.1")).alias("d"),
        T.error_code(F.lit("NO_X: y"))[0].alias("e"),
        T.redacted(F.lit("/home/me/x in /w/1"), "/w/1").alias("red"),
    ).first()
    assert (one["p"], one["r"], one["m"], one["t"], one["s"], one["f"], one["arch"], one["d"], one["e"], one["red"]) == ("/b/c", "..", "a.c:# x #", 5, "a-b-c", "1 {b}", "aarch64", "libz-devel", "NO_X", "<USER>/x in <WORKSPACE>")


def test_budget_is_conserved(spark):
    rows = registry.QUERIES["packet_budget"](spark, SF).collect()
    assert rows and all(r["conservation_total"] == packet.TOTAL and r["within"] and r["reclaimed"] for r in rows)
    fits = lambda text, n: spark.range(1).select(packet.fit(F.lit(text), n)).first()[0]
    cut = fits("word " * 500, 60)
    assert cut.endswith("\n[truncated]") and len(cut.split()) <= 46 and fits("a b", 60) == "a b" and fits("a b", 0) == "" and fits(None, 5) is None
    big = {"log_id": 1, "primary_error": "{}", "causes": ['{"rank":1}', '{"rank":2}'], "cascade_summary": "make cascade: " + "a -> b; " * 200, "excerpt": "\n".join(f"line {i}" for i in range(200)), "prompt": "p " * 50, "snippets": ["s " * 300, "short"], "extra_window": "w\n" * 80}
    df = spark.createDataFrame([big], "log_id int, primary_error string, causes array<string>, cascade_summary string, excerpt string, prompt string, snippets array<string>, extra_window string")
    plan = packet.within_budget(df, 150)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and len(packet.LADDER) == 10
    small = packet.within_budget(df, 190).first()
    assert not small["over"] and small["used"] <= 190 and small["steps"] > 1 and small["cascade_summary"] == small["extra_window"] == "" and small["degraded_reasons"] == "packet_truncated_to_token_budget"
    kept = packet.within_budget(df, 700).first()
    assert kept["excerpt"].split("\n")[-2:] == ["line 199", "[truncated]"] and len(kept["causes"]) == 2
    same = packet.within_budget(df, 100_000).first()
    assert same["steps"] == 0 and same["excerpt"] == big["excerpt"] and same["degraded_reasons"] == ""
    assert packet.within_budget(df, 1).first()["over"]


def test_convergence_and_failures(spark):
    schema = "identity string, attributes string, errors long, previous_identity string, previous_attributes string, previous_errors long, regression string, suspected boolean, touched boolean"
    rows = [("a", "b", 3, "a", "b", 3, None, False, True), ("a", "b", 3, None, None, None, None, False, True), ("a", "b", 4, "a", "b", 3, None, True, False), ("a", "b", 3, "a", "b", 3, "new:x", False, True)]
    got = [(r["verdict"], r["confidence"]) for r in convergence.convergence(spark.createDataFrame(rows, schema)).collect()]
    assert got == [("stalled", "high"), ("advance", "low"), ("advance", "medium"), ("regressed", "high")]
    f = spark.createDataFrame([("gbs_build_failed", "No space left on device", "compiler", "e", "a.c", 1, True, True, "probably_fixable"), ("gbs_build_failed", "", "compiler", "e", "a.c", 1, True, True, "probably_fixable"), ("gbs_build_failed", "", "werror", "e", None, None, True, True, "unknown")], "stage string, log_text string, kind string, message string, file string, line int, source_reachable boolean, source_owned boolean, type_fixability string")
    assert [(r["failure_class"], r["repair"], r["confidence"]) for r in convergence.failure_classes(f).collect()] == [("build_env", "denied", 1.0), ("source_repairable", "auto", 0.95), ("source_unreachable", "denied", 0.4)]


def test_state_upsert_and_payloads(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    add, bad = state.upsert(old, spark.createDataFrame([(1, "a"), (2, "c"), (3, "d")], "k int, v string"), ["k"])
    assert [r["k"] for r in add.collect()] == [3] and [r["k"] for r in bad.collect()] == [2]
    g = spark.createDataFrame([(1, "PUSH", '{"ref":"r","ref_class":"x","pushed_sha":"s","result":"ok","at":"t"}'), (2, "KB", "{}"), (3, "NEW", "{}")], "event_id int, event_type string, payload string")
    got = {(r["event_id"], r["violation"]) for r in state.payload_violations(g).collect()}
    assert (1, "value:ref_class") in got and (2, "missing:kb_id") in got and (3, "unknown_type") in got


def test_triage_sources(spark):
    page = '<table class="builds"><tr><th>a</th></tr><tr><td><a href="/b/12">12</a></td><td>v</td><td>2024-01-02 03:04:05</td><td class="status failed">x</td></tr><tr><td>zz</td><td></td><td></td><td></td></tr></table>'
    cells = triage.table_cells(spark.createDataFrame([("p", page), ("q", None)], "id string, html string"), "id", "html")
    assert [(r["build_id"], r["status"], r["url"]) for r in triage.build_list(cells).collect()] == [("12", "failed", "/b/12")]
    text = "x\nbuild_pkg_list_dic: {'a/b': 'c1'}\nfail_pkg: p, spec_name: s, dest_file: d\nfail_pkg: p, spec_name: s\n"
    full = spark.createDataFrame([("1", text), ("2", "build_pkg_list_dic: {oops"), ("3", "")], "build string, text string")
    assert {(r["build"], r["project"], r["error"]) for r in triage.package_commits(full).collect()} == {("1", "a/b", None), ("2", None, "BUILD_PKG_LIST_UNREADABLE"), ("3", None, "BUILD_PKG_LIST_MISSING")}
    assert [tuple(r) for r in triage.failed_packages(full).collect()] == [("1", "p", "s", "d")]


def test_patches(spark):
    files = spark.createDataFrame([("a", "x\ny\nx\n"), ("b", "q\n"), ("c", "abc\n")], "file string, text string")
    edits = spark.createDataFrame([("a", "x", "z", 3), ("b", "nope", "z", None), ("c", "ab", "1", None), ("c", "bc", "2", None)], "file string, old string, new string, line int")
    rows = {r["file"]: r for r in patch.applied_edits(files, edits).collect()}
    assert rows["a"]["status"] == "applied" and "-x\n+z\n" in rows["a"]["diff"] and rows["b"]["status"] == "not_located" and rows["c"]["status"] == "overlap"
    spec = spark.createDataFrame([("s", 1, "BuildRequires: a, b # c"), ("s", 2, "%build"), ("s", 3, "make")], "spec string, line_no int, text string")
    assert [r["section"] for r in patch.spec_sections(spec).orderBy("line_no").collect()] == ["preamble", "build", "build"] and patch.build_requires(spec).count() == 2
    code = spark.createDataFrame([("k", 1, "f()"), ("k", 2, "{ if {"), ("k", 3, "} }"), ("k", 4, "}")], "key string, line_no int, text string")
    assert patch.brace_end(code).first()["end_line"] == 3


def test_rules_hold(spark):
    assert rules.rule_violations(rules.rule_frame(spark)).count() == 0
    bad = [("r", "compile_error", "tier1", ["compiler"], [("x", [])], None, False, ["y"], 0.5, None)]
    assert {r["violation"] for r in rules.rule_violations(rules.rule_frame(spark, bad, {"compile_error": ("z", None)})).collect()} == {"category", "confidence", "template not cautious", "template without expand"}


def test_every_sql_has_its_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 80
