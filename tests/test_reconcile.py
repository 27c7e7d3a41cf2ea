from buildlens.operators import state


def test_each_unit_has_one_of_five_results(spark):
    current = spark.createDataFrame([(u, 2, 20) for u in "abcdefgh"] + [(None, 2, 20)], "unit string, round int, edit int")
    links = spark.createDataFrame([("a", 10, None), ("b", 20, 1), ("b", 20, 2), ("d", 20, 3), ("e", 20, 4), ("h", 10, 5), ("z", 20, None)], "unit string, edit int, event_id long")
    passes = spark.createDataFrame([("a", 1, "attributed"), ("c", None, "inconsistent"), ("d", 1, "attributed"), ("f", 2, "attributed"), ("g", 1, "attributed"), ("h", None, "non_campaign")], "unit string, round int, attribution string")
    orphans = spark.createDataFrame([("a", 1, 1), ("e", 3, 2), ("f", 2, 1), ("f", 3, 1), ("g", 1, 1)], "unit string, round int, n long")
    got = {r.unit: tuple(r)[1:] for r in state.reconciled(current, links, passes, orphans).collect()}
    bad = ("state_inconsistent_held", 0, 0, 0)
    assert got == {"a": bad, "b": bad, "c": bad, "d": ("orphan_pass_held", 1, 0, 0), "e": ("linked_already", 0, 0, 1), "f": ("relinked", 0, 1, 1), "g": ("proceed", 0, 1, 0), "h": ("proceed", 0, 0, 0), None: ("proceed", 0, 0, 0)}
    assert state.reconciled(current.limit(0), links, passes, orphans).count() == 0
