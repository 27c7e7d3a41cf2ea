import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from buildlens.llm import resample, runs

from .helpers import SCHEMA, documents, words

TABLE = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(TABLE))


def features_of(text):
    w = words_of(text)
    return Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1))


def brute(docs, target, share=5):
    """(doc_id, n_features, weight, score, rank) row by row."""
    of = [features_of(t) for _, t in docs]
    s, t = sum(of, Counter()), sum((features_of(x) for x in target), Counter())
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in s}
    rows = []
    for (i, text), f in zip(docs, of):
        weight = sum(gain[b] * n for b, n in f.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text))])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: share * len(able) // 100]):
        r[4] = k + 1
    return sorted((r[:5] for r in rows), key=str)


def got(df):
    return sorted(([r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]] for r in df.collect()), key=str)


def test_resampling_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(resample, "CELL", 7)
    docs = documents(spark, extra=[" ".join(words(k, 25 + k)) + " Ünï-x9" for k in range(70)])
    target = [" ".join(words(3, 40)), None, "", "of the And"]
    table = spark.createDataFrame([(str(i), t) for i, t in enumerate(target)], "item_id string, text string")
    assert got(resample.resample(docs, table, share=20)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], target, 20)


def test_resampling_of_the_tables(spark):
    docs, target = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()])
    assert got(resample.resample(docs, target)) == want and sum(r[4] is not None for r in want) > 5


def test_repeated_rows_have_a_rank_each(spark):
    text = " ".join(words(5, 30))
    docs = spark.createDataFrame([(1, text)] * 40 + [(2, " ".join(words(6, 30)))] * 3, "doc_id long, text string").repartition(4)
    out = resample.resample(docs, docs.limit(1), share=50).collect()
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [text], 50)
    assert sorted([r["doc_id"], r["weight"], r["score"]] for r in out) == sorted([r[0], r[2], r[3]] for r in want)
    assert sorted(r["rank"] for r in out if r["rank"]) == list(range(1, 22))


def test_resampling_of_nothing(spark):
    none, target = spark.createDataFrame([], SCHEMA), spark.createDataFrame([("a", "some text")], "item_id string, text string")
    assert resample.resample(none, target).count() == 0
    docs = documents(spark)
    assert got(resample.resample(docs, target.limit(0))) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], [])


def test_long_text_is_counted_in_pieces():
    text = " ".join(words(9, 3000)) + " " + "y" * 5000 + " end. " + "é" * 300
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([b"k" * 16]), pa.array([text])], ["a", "b", "c"])
    was, resample.SLICE = resample.SLICE, 700
    try:
        [(_, _, n, total, buckets, counts)] = list(resample._counted(iter([batch])))
    finally:
        resample.SLICE = was
    assert (n, dict(zip(buckets.tolist(), counts.tolist()))) == (len(words_of(text)), dict(features_of(text))) and total == 3 * n - 3


def test_checksums_of_words_end_to_end():
    a, b = [b"", b"x", b"word" * 30, b"q" * 100_000], [b"", b"y" * 64, b"z" * 65, b"w" * 70_001]
    got = runs.shifted(runs.crcs(a), np.array([len(x) for x in b])) ^ runs.crcs(b)
    assert got.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b)]


def test_counts_of_more_than_a_byte_are_several_postings():
    lists = np.zeros(resample._WIDTH, np.int64)
    lists[3] = 2
    data = resample.pack(lists, np.array([5, 5]), np.array([255, 45]))
    got = resample.unpack(data, 4 * resample._WIDTH + 6)
    assert got[0].tolist() == lists.tolist() and got[1].tolist() == [5, 5] and got[2].tolist() == [255, 45]
