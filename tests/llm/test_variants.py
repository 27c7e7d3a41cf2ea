import random
import re
import zlib
from collections import Counter

import numpy as np

from buildlens.llm import variants

from .helpers import SCHEMA, documents

TABLE = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def counts_of(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(TABLE)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def edits(w, letters):
    out = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
    return (out | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}) - {w}


def brute(docs):
    n = counts_of(docs)
    letters, form, near = sorted({c for w in n for c in w}), {}, {}
    for w in n:
        near[w] = sorted((x for x in edits(w, letters) if x in n), key=lambda x: (-n[x], x))
        form[w] = near[w][0] if near[w] and n[near[w][0]] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def got(df):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def texts(n=60):
    r = random.Random(3)
    base = ["".join(r.choice("abÀÿéx") for _ in range(r.randint(3, 7))) for _ in range(150)]
    return [" ".join(r.choice(base) for _ in range(120)).upper() + ".ÀÀÀÀÀ7aaaaa_aaaab÷ïïïïïï" for _ in range(n)]


def test_variants_equal_brute_force(spark):
    chain = " ".join(["parasol"] * 90 + ["parasal"] * 30 + ["parasals"] * 9)
    docs = documents(spark, extra=[*texts(), chain])
    want = brute(rows_of(docs))
    assert got(variants.group_variants(docs)) == want and any(w[1] != w[2] and w[1] for w in want)


def test_large_groups_are_parted(spark, monkeypatch):
    monkeypatch.setattr(variants, "LARGE", 4)
    monkeypatch.setattr(variants, "SHARD_WORDS", 40)
    monkeypatch.setattr(variants, "TOGETHER", 7)
    docs = documents(spark, extra=texts())
    assert got(variants.group_variants(docs)) == brute(rows_of(docs))


def test_variants_of_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(variants.group_variants(docs)) == brute(rows_of(docs))


def test_no_words(spark):
    assert variants.group_variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert variants.group_variants(documents(spark).filter("doc_id < 3")).count() == 0


def test_very_long_runs_and_repeated_rows(spark):
    long = "q" * 20_000
    docs = spark.createDataFrame([(1, f"{long} {long} {long} {long}b {long}b {long}b")] * 2 + [(7, "hello " * 50_000)], "doc_id long, text string")
    want = brute_long(rows_of(docs))
    assert got(variants.group_variants(docs)) == want and any(w[4] for w in want)


def brute_long(docs):
    n = counts_of(docs)
    near = {w: sorted((x for x in n if x != w and abs(len(x) - len(w)) <= 1 and one_apart(x, w)), key=lambda x: (-n[x], x)) for w in n}
    form = {w: near[w][0] if near[w] and n[near[w][0]] >= 2 * n[w] else None for w in n}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def test_automaton_is_minimal_and_numbers_words():
    r = random.Random(5)
    words = sorted({bytes(r.choice(b"ab") for _ in range(r.randint(1, 6))) for _ in range(60)})
    m = variants.Automaton(words)
    rights = set()
    for w in words:
        state, number = m.start, 0
        for c in w:
            [arc] = m.step(np.array([state]), np.array([c]))
            state, number = m.to[arc], number + m.before[arc]
        assert words[number] == w and m.final[state]
    for w in words:
        for k in range(len(w) + 1):
            rights.add(tuple(x[k:] for x in words if x[:k] == w[:k]))
    assert len(m.final) == len(rights)  # a state for each set of ends, and no more
