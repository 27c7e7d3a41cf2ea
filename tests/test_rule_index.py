import random
import re

from buildlens.operators import rule_index, rules


def test_covers_are_what_every_match_holds():
    assert rule_index.covers("(?i)Hunk\\s*#?(\\d+)\\s*FAILED") == [["hunk"], ["failed"]]
    assert rule_index.covers("(?:has no member|no member named) x") == [["has no member", "no member named"]]
    assert rule_index.covers("(?<name>abcd)+efgh?") == [["abcd"]]
    assert rule_index.covers("abcd|x") == rule_index.covers("(abcd)?") == rule_index.covers("(?!abcd)") == rule_index.covers("") == []
    assert rule_index.covers("[a[bc]]defg") == rule_index.covers("(?iu)abcd") == rule_index.covers("(abcd") == rule_index.covers(None) == rule_index.covers("\\Qabcd\\E") == []


def test_an_index_finds_what_trying_all_rules_finds(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abAB") for _ in range(r.randint(1, 7)))
    pattern = lambda: r.choice([lambda: word(), lambda: f"{word()}|{word()}", lambda: f"({word()}|{word()}){word()}+", lambda: f"^{word()}.*{word()}?", lambda: f"(?:{word()}){{2}}"])()
    lib = [(i, i % 2, r.choice("kl"), "(?i)" + pattern(), word() if r.random() < 0.3 else None) for i in range(400)]
    lib += [(400, 0, "k", None, None), (401, 0, "none", "abab", None), (402, 0, "k", "", None)]
    ev = [(i, r.choice("klm"), " ".join(word() for _ in range(r.randint(0, 6))) + r.choice(["", "é", "😀abab"])) for i in range(150)]
    ev += [(150, "k", None), (151, "k", ""), (152, "k", "abab " * 50_000), (153, None, "abab"), (0, *ev[0][1:])]
    want = sorted((i, o, j) for i, kind, text in ev for o, j, k, regex, negative in lib if kind == k and text is not None and regex is not None and re.search(regex, text) and not (negative and re.search(negative, text)))
    frame = spark.createDataFrame(lib, "rule_ord int, regex_ord int, kind string, regex string, negative string")
    events = spark.createDataFrame(ev, "id int, kind string, message string")
    got = rule_index.hits(events, frame)
    assert got.columns == ["id", "kind", "message", "rule_ord", "regex_ord", "regex", "negative"]
    found = sorted(map(tuple, got.select("id", "rule_ord", "regex_ord").collect()))
    assert found == want and len(want) > 1000
    few = {(i, o) for i, o, _ in want if o < 50}
    shuffled = rule_index.AT_HAND
    try:
        rule_index.AT_HAND = 0
        assert {tuple(x) for x in rule_index.hits(events, frame.filter("rule_ord < 50")).select("id", "rule_ord").collect()} == few
    finally:
        rule_index.AT_HAND = shuffled
    assert rule_index.hits(events, frame.limit(0)).count() == rule_index.hits(events.limit(0), frame).count() == 0


def test_a_large_library_answers_as_its_few_rules_do(spark):
    more = [(f"none_{i}", "patch_failed", "tier1", ["patch"], [(f"never{i} seen", [])], None, False, ["warning:"], 0.96, None) for i in range(5000)]
    ev = spark.createDataFrame([("E1", "patch", "Hunk #3 FAILED at 7."), ("E2", "patch", "warning: Hunk #3 FAILED"), ("E3", "depsolve", "nothing provides x needed by y"), ("E4", "patch", "never4999 seen")], "id string, kind string, message string")
    few, all_ = rules._hits(ev, rules.rule_frame(spark)), rules._hits(ev, rules.rule_frame(spark, rules.RULES + more))
    named = {(x.id, x.rule) for x in all_.select("id", "rule").collect()}
    assert named == {(x.id, x.rule) for x in few.select("id", "rule").collect()} | {("E4", "none_4999")}
    assert sorted(few.columns) == sorted(all_.columns)
