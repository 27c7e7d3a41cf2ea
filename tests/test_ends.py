import random

from buildlens.operators import candidates, ends


def test_names_that_end_texts(spark):
    r = random.Random(2)
    word = lambda n: "".join(r.choice("abü") for _ in range(r.randint(1, n)))
    names, asks = {(g, word(4)) for g in range(3) for _ in range(40)}, [(g, i, word(9)) for g in range(3) for i in range(60)]
    want = sorted((g, i, n) for g, i, t in asks for h, n in names if g == h and t.endswith(n))
    got = ends.ending(spark.createDataFrame(list(names) * 2, "g int, name string"), spark.createDataFrame(asks, "g int, ask int, text string"), "g")
    assert sorted(map(tuple, got.collect())) == want and want


def by_hand(asked, files):
    plain = asked.lstrip("/")
    cuts = range(plain.count("/") + 1) if asked.startswith("/") else (0,)
    for cut in cuts:
        end = plain.split("/", cut)[-1] if cut else plain
        hits = [f for f in files if f == end or f.endswith("/" + end)]
        if hits:
            return len(hits), hits[0] if len(hits) == 1 else None
    return None


def test_paths_are_mapped_by_their_longest_end(spark):
    r = random.Random(7)
    path = lambda n: "/".join(r.choice(["a", "b", "ab", "a.c", "é"]) for _ in range(r.randint(1, n)))
    files = {root: {path(4) for _ in range(60)} for root in ("x", "y")}
    asks = {(root, ("/" if r.random() < 0.6 else "") + path(6)) for root in files for _ in range(150)} | {("none", "a"), ("x", "")}
    want = sorted((root, a, *hit) for root, a in asks if (hit := by_hand(a, files.get(root, ()))))
    tree = spark.createDataFrame([(root, f) for root, fs in files.items() for f in fs], "root string, path string")
    got = candidates.mapped_paths(spark.createDataFrame(list(asks), "root string, file string"), tree)
    assert sorted(map(tuple, got.select("root", "file", "matches", "mapped").collect()), key=str) == sorted(want, key=str)


def test_no_names(spark):
    none = spark.createDataFrame([], "g int, name string")
    assert ends.ending(none, spark.createDataFrame([(1, 2, "abc")], "g int, ask int, text string"), "g").count() == 0
