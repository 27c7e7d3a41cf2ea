"""Readers of files beside the logs, and writers."""

import json

from buildlens.operators import reports, rules, triage
from buildlens.sinks import files as sinks
from buildlens.sources import sidecars


def written(spark, tmp_path, **texts):
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    return sidecars.texts(spark, str(tmp_path))


def names(rows):
    return {r["path"].rsplit("/", 1)[-1].split(".")[0]: r["reason"] for r in rows.collect()}


def test_candidate_sidecars(spark, tmp_path):
    good = json.dumps({"schema_version": sidecars.CANDIDATE_VERSION, "candidates": [{"file": "a.c", "line": 3, "column": None, "event_id": "E001", "message": "m"}]})
    rows, bad = sidecars.candidate_sidecars(written(spark, tmp_path, good=good, old='{"schema_version":"v0","candidates":[]}', none=json.dumps({"schema_version": sidecars.CANDIDATE_VERSION}), broken="{oops"))
    assert [(r["file"], r["line"], r["event_id"]) for r in rows.collect()] == [("a.c", 3, "E001")]
    assert names(bad) == {"old": "schema_mismatch", "none": "no_candidates", "broken": "unreadable"}


def test_cluster_sidecars(spark, tmp_path):
    good = json.dumps({"schema_version": sidecars.CLUSTER_VERSION, "clusters": [{"id": "CL001", "locations": [{"file": "a.c", "line": 1}]}]})
    rows, bad = sidecars.cluster_sidecars(written(spark, tmp_path, good=good, empty="", cut="{"))
    assert [(r["id"], len(r["locations"])) for r in rows.collect()] == [("CL001", 1)] and names(bad) == {"cut": "unreadable"}


def test_review_changes_and_states(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"number": 7, "subject": "s", "patchSets": [{"number": 1, "revision": "abc"}]}\n{"type": "stats", "rowCount": 1}\n')
    changes = sidecars.review_changes(spark, str(tmp_path / "q.jsonl"))
    assert [tuple(r) for r in triage.commit_patchsets(changes).collect()] == [("abc", 7, 1)]
    (tmp_path / "s").mkdir()
    states = sidecars.run_states(written(spark, tmp_path / "s", new='{"u1": {"state": "DONE", "retries": 2, "updated_at": "t"}}', legacy='["u2", "u3"]'))
    assert {(r["unit"], r["state"], r["retries"]) for r in states.collect()} == {("u1", "DONE", 2), ("u2", "DONE", 0), ("u3", "DONE", 0)}


def test_edit_specs_and_touched(spark, tmp_path):
    rows, bad = sidecars.edit_specs(written(spark, tmp_path, a='{"edits":[{"file":"a.c","old":"x","new":"y","line":2}]}', b='{"edits":[]}', c='{"edits":[{"file":"a.c"}]}', d="[]", e="nope"))
    assert [(r["file"], r["old"], r["new"], r["line"]) for r in rows.collect()] == [("a.c", "x", "y", 2)]
    assert names(bad) == {"b": "EDIT_SPEC_EMPTY", "c": "EDIT_SPEC_FIELD_MISSING", "d": "EDIT_SPEC_NO_EDITS", "e": "EDIT_SPEC_UNREADABLE"}
    assert [r["touched"] for r in sidecars.touched_files(spark.createDataFrame([("p", '["a","b"]'), ("q", "x")], "path string, text string")).collect()] == [["a", "b"]]


def test_rule_library(spark, tmp_path):
    rules.rule_frame(spark).write.json(str(tmp_path / "rules"))
    assert sorted(sidecars.rule_library(spark, str(tmp_path / "rules")).collect(), key=str) == sorted(rules.rule_frame(spark).collect(), key=str)
    broken = spark.createDataFrame([(0, 0, "r", "other", "tier1", "patch", "x", [], None, False, "y", 0.5, True, "surely", False, None, None)], rules.SCHEMA)
    assert {r["violation"] for r in rules.rule_violations(broken).collect()} == {"category", "confidence", "template not cautious", "template without expand"}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", None), (1, "a", 3.5)], "z int, a string, m double")
    sinks.write_json(rows, str(tmp_path / "j"))
    assert {r["value"] for r in spark.read.text(str(tmp_path / "j")).collect()} == {'{"a":"b","z":2}', '{"a":"a","m":3.5,"z":1}'}
    status = spark.createDataFrame([("u", "READY", None, None, 1), ("v", "", None, None, 2), ("w", "HELD_FOR_INVESTIGATION", "orphan_pass", None, 3)], "unit string, status string, reason string, arch string, at int")
    refused = sinks.append_status(status, str(tmp_path / "s"))
    assert {(r["unit"], r["refused"]) for r in refused.collect()} == {("v", "empty_status"), ("w", "held_reason_needs_arch")}
    assert [r["unit"] for r in spark.read.parquet(str(tmp_path / "s")).collect()] == ["u"]
    events = spark.createDataFrame([(1, "u", "POLICY", '{"round_index":2,"arch_norm":"aarch64"}'), (2, "u", "BUILD_INVOCATION", "{}")], "event_id long, unit string, event_type string, payload string")
    assert [r["event_id"] for r in sinks.append_events(events, str(tmp_path / "e")).collect()] == [2]
    assert [(r["event_id"], r["round"], r["arch"]) for r in spark.read.parquet(str(tmp_path / "e")).collect()] == [(1, 2, "aarch64")]
    stats = {r["kind"]: (r["files"], r["tokens"]) for r in sinks.token_stats(spark.createDataFrame([("md", "a b"), ("md", "c"), ("diff", "")], "kind string, text string")).collect()}
    assert stats["total"][0] == 3 and stats["md"][0] == 2 and stats["total"][1] == stats["md"][1] + stats["diff"][1]
    report = sinks.run_report(spark.createDataFrame([(1, "DONE", None, "", "p /home/x/y", None)], "unit int, state string, verdict string, error string, packet string, context string")).first()["report"]
    assert report == "# Run 1\n\n## State\nDONE\n\n## Packet\np <USER>/y"


def test_response_files_and_package_pages(spark):
    commands = spark.createDataFrame([("1", "C001", ["a.rsp", "b.rsp"]), ("1", "C002", ["a.rsp"])], "log_id string, id string, rsp_files array<string>")
    files = spark.createDataFrame([("1", "a.rsp", "-lz 'x y.o' -DA -shared")], "log_id string, rsp string, text string")
    got = {(r["id"], r["rsp"]): (r["found"], r["degraded"], r["libraries"], r["objects"]) for r in reports.expanded_commands(commands, files).collect()}
    assert got == {("C001", "a.rsp"): (True, True, "-lz", "x y.o"), ("C001", "b.rsp"): (False, True, None, None), ("C002", "a.rsp"): (True, False, "-lz", "x y.o")}
    page = '<table><tr><th>p</th><th>v</th><th>r</th></tr><tr><td>pkg</td><td>1</td><td><a href="log/x">Failed</a></td></tr><tr><td>ok</td><td>1</td><td>none</td></tr></table><iframe src="a?b=1&amp;c=2"></iframe>'
    pages = spark.createDataFrame([("1", page)], "id string, html string")
    assert [tuple(r) for r in reports.package_report(triage.table_cells(pages, "id", "html")).collect()] == [("1", "pkg", "failed", "log/x")]
    one = pages.select(reports.frame_source(pages["html"]).alias("src"), reports.snapshot_name(pages["id"]).alias("n"), reports.status_of_classes(pages["id"]).alias("c")).first()
    assert one["src"] == "a?b=1&c=2" and one["n"] == "1" and one["c"] is None


def test_logs_are_read_in_blocks(spark, tmp_path):
    import gzip

    from buildlens.sources.logs import read_logs

    lines = [f"line {i} " + "x" * (i % 50) + ("é" if i % 7 == 0 else "") + ("\r" if i % 5 == 0 else "") for i in range(3000)]
    data = "\n".join(lines).encode()
    (tmp_path / "a.log").write_bytes(data + b"\n")
    (tmp_path / "b.log.gz").write_bytes(gzip.compress(b"one\n\ntwo \xff"))
    (tmp_path / "c.log").write_bytes(b"")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        rows = read_logs(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    a = sorted((r["line_no"], r["raw_offset"], r["raw_text"]) for r in rows if r["log_id"].endswith("a.log"))
    want, at = [], 0
    for i, text in enumerate(lines, 1):
        want.append((i, at, text.rstrip("\r")))
        at += len(text.encode()) + 1
    assert a == want
    assert sorted((r["line_no"], r["raw_offset"], r["raw_text"]) for r in rows if r["log_id"].endswith(".gz")) == [(1, 0, "one"), (2, 4, ""), (3, 5, "two �")]
    assert len({r["log_id"] for r in rows}) == 2
