import pytest

from buildlens.sinks.store import Conflict, Store


def rows(spark, *values):
    return spark.createDataFrame(list(values), "unit long, status string")


def test_pairs_are_committed_together_and_read_as_of_a_version(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.version() == 0 and store.tables() == []
    one = store.commit({"status": rows(spark, (1, "PASS")), "records": rows(spark, (1, "r1"))})
    two = store.commit({"status": rows(spark, (2, "FAIL")), "records": rows(spark, (2, "r2"))})
    assert (one, two) == (1, 2) and store.tables() == ["records", "status"]
    assert sorted(map(tuple, store.read("status", 1).collect())) == [(1, "PASS")]
    assert sorted(map(tuple, store.read("records").collect())) == [(1, "r1"), (2, "r2")]
    with pytest.raises(KeyError):
        store.read("none")


def test_of_two_writers_one_is_refused(spark, tmp_path):
    store, other = Store(spark, f"file://{tmp_path}/s"), Store(spark, f"file://{tmp_path}/s")
    seen = other.version()
    store.commit({"status": rows(spark, (1, "A"))})
    with pytest.raises(Conflict):
        other.commit({"status": rows(spark, (1, "B")), "records": rows(spark, (1, "r"))}, on=seen)
    assert [tuple(r) for r in store.read("status").collect()] == [(1, "A")] and store.tables() == ["status"]
    assert other.commit({"status": rows(spark, (2, "B"))}) == 2


def test_a_failed_write_leaves_no_trace(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.commit({"status": rows(spark, (1, "A"))})
    broken = rows(spark, (2, "x")).selectExpr("unit", "raise_error('lost') as status")
    with pytest.raises(Exception, match="lost"):
        store.commit({"records": rows(spark, (2, "r")), "status": broken})
    assert store.version() == 1 and store.tables() == ["status"] and store.read("status").count() == 1


def test_insert_or_compare(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.insert_or_compare("keys", rows(spark, (1, "a"), (None, "n"), (1, "a")), ["unit"])
    store.insert_or_compare("keys", rows(spark, (1, "a"), (2, "b"), (None, "n")), ["unit"])
    assert sorted(map(tuple, store.read("keys").collect()), key=str) == [(1, "a"), (2, "b"), (None, "n")]
    for bad in ([(1, "z")], [(3, "c"), (3, "d")], [(2, None)]):
        with pytest.raises(Conflict):
            store.insert_or_compare("keys", rows(spark, *bad), ["unit"])
    assert store.read("keys").count() == 3


def test_standing_results_equal_the_whole_history(spark, tmp_path):
    from buildlens.sinks.standing import Latest, Seen

    held = Latest(Store(spark, f"file://{tmp_path}/s"), "latest", ["unit"], ["at"])
    make = lambda *v: spark.createDataFrame(list(v), "unit long, at int, status string")
    held.add(make((1, 1, "a"), (2, 5, "b"), (None, 1, "n")))
    held.add(make((1, 3, "c"), (2, 4, "late"), (None, 2, None)))
    want = [(1, 3, "c"), (2, 5, "b"), (None, 2, None)]
    assert sorted(map(tuple, held.read().collect()), key=str) == want
    held.compact()
    held.add(make((3, 1, "x"), (1, 2, "old")))
    assert sorted(map(tuple, held.read().collect()), key=str) == [*want[:2], (3, 1, "x"), want[2]]
    assert sorted(map(tuple, held.read(1).collect()), key=str) == [(1, 1, "a"), (2, 5, "b"), (None, 1, "n")]
    seen = Seen(Store(spark, f"file://{tmp_path}/u"), "units", ["unit"])
    assert [sorted(r["unit"] for r in seen.add(make(*[(u, 0, "") for u in us])).collect()) for us in ((1, 2, 2), (2, 3), (3, 1))] == [[1, 2], [3], []]


def test_stages_are_timed(spark):
    from buildlens.functions.stages import Stages

    stages = Stages(spark)
    assert stages.run("odd", stages.run("all", spark.range(10)).filter("id % 2 = 1")).count() == 5
    assert [(r["stage"], r["rows"]) for r in stages.table().orderBy("place").collect()] == [("all", 10), ("odd", 5)] and all(r["ms"] > 0 for r in stages.table().collect())
