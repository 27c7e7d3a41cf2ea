import hashlib
import json
import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.fs as pafs
import pytest
from tokenizers import Tokenizer

from buildlens.llm import bpe, components, decontam, features, jaccard, langid, license, lm, quality, sharding, sstable, topk
from buildlens.llm.common import new_path

from .helpers import DE, SCHEMA, documents, labelled, words

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 1 language


def test_language_held_out_accuracy(spark):
    rows = langid.identify(labelled(spark)).collect()
    truth = {i: ("en", "de", "fr")[i % 3] for i in range(90)}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 90 and held
    assert {r["doc_id"] for r in held} == {i for i in range(90) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) >= 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_held_out_accuracy_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).filter("held_out").join(docs.select("doc_id", "lang", "text"), "doc_id").filter("lang is not null and length(text) > 40").collect()
    assert len(rows) > 100 and sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) >= 0.95


def test_language_edges(spark):
    got = {r["doc_id"]: r for r in langid.identify(documents(spark)).collect()}
    assert {got[i]["lang_pred"] for i in (0, 1, 2)} == {"und"} and got[5]["lang_pred"] == "en"
    assert langid.identify(documents(spark)).count() == documents(spark).count()
    assert langid.identify(empty(spark)).count() == 0
    assert {r["lang_pred"] for r in langid.predict(documents(spark).select("doc_id", "text"), None).collect()} == {"und"}


def test_language_families():
    assert langid.family_of("de") == "germanic" and langid.family_of("pt-BR") == "romance" and langid.family_of("xx") == "xx"
    x = np.eye(langid.DIMS, dtype=np.float32)[[0, 0, 1, 1, 2, 2] * 5]
    m = langid.fit(x, np.array(["en", "en", "de", "de", "fr", "fr"] * 5, object))
    assert list(m.families) == ["germanic", "romance"] and m.pairs == [("de", "en")]
    assert m.predict(x[:6])[0] == ["en", "en", "de", "de", "fr", "fr"]


def test_ngrams_of_a_long_text_are_counted_in_pieces(monkeypatch):
    text = "abc def " * 50
    whole = features.ngram_counts(text, 64, False)
    monkeypatch.setattr(features, "PIECE", 400)
    assert whole.sum() == 3 * len(text) - 3 and (features.ngram_counts(text, 64, False) == whole).all()


# 2 language model


def test_lm_base_score_and_gain(spark):
    docs = labelled(spark, 60).union(documents(spark).filter("doc_id is null or doc_id not in (8)"))
    rows = lm.score_documents(docs).collect()
    tokens = [((r["doc_id"]), (r["text"] or "").encode().lower().split() + [b""]) for r in docs.select("doc_id", "text").collect()]
    learned = [t for d, t in tokens if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2]
    c = Counter(w for t in learned for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), len(t), sum(c[w] > 0 for w in t), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for d, t in tokens)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in rows) == want
    assert {r["train_tokens"] for r in rows} == {n}
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_lm_is_a_distribution_and_carries_its_state():
    v = lm.Vocabulary({b"a": 5, b"b": 3, b"": 2}, {b"": 0, b"a": 1, b"b": 2}, {}, np.zeros(lm.RARE), np.zeros(lm.RARE), 10, 3)
    net = lm.start_network(v)
    lm.learn(net, [lm.whole(np.array([1, 2, 1, 2, 0]))] * 30, 0.01, 30)
    every = np.arange(lm.WORDS + lm.RARE)
    assert abs((10 ** net.log10_likelihood([np.array([i]) for i in every])).sum() - 1) < 1e-3
    alternating, other = net.log10_likelihood([np.array([1, 2] * 30 + [0]), np.array([1, 1] * 30 + [0])])
    assert alternating > other
    long = [np.array([1, 2] * 40), np.array([2])]
    assert np.allclose(net.log10_likelihood(long), [net.log10_likelihood([long[0]])[0], net.log10_likelihood([long[1]])[0]], atol=1e-4)


def test_lm_learns_from_every_token(spark):
    docs = documents(spark).repartition(3)
    v = lm.vocabulary(lm.count_tokens(docs))
    share = spark.sparkContext.broadcast
    assert sum(r["tokens"] for r in lm.one_pass(docs, share(v), share(lm.start_network(v).flat())).collect()) == v.total


def test_lm_carries_the_state_from_the_start_of_each_text(monkeypatch):
    monkeypatch.setattr(lm, "STREAMS", 3)
    monkeypatch.setattr(lm, "LEAST_STREAMS", 3)
    texts, seen, state = [np.arange(n) + 100 * n + 1 for n in (95, 7, 41, 20, 3)], {}, []

    class Recorder:
        def train_window(self, x, y, fresh, h, rate):
            for t, i in zip(*np.nonzero(y.T >= 0)):
                at = y[i, t]
                assert fresh[i, t] == (x[i, t] == 0) and (fresh[i, t] or seen[at - 1] == t)
                seen[at] = t
            assert not state or (h == state[-1][: len(h)]).all()
            state.append(h + 1)
            return h + 1

    assert lm.learn_whole(Recorder(), texts, 0.1) == len(seen) == sum(len(t) for t in texts)
    assert lm.learn_whole(Recorder(), [], 0.1) == 0


def test_lm_lays_out_many_windows_at_once(monkeypatch):
    looked, windows = [], []
    search = np.searchsorted
    monkeypatch.setattr(lm.np, "searchsorted", lambda *a, **k: looked.append(1) or search(*a, **k))

    class Recorder:
        def train_window(self, x, y, fresh, h, rate):
            windows.append(x.shape)
            return h

    assert lm.learn_whole(Recorder(), [np.ones(lm.WINDOW * 200, np.int16)] * 3, 0.1) == lm.WINDOW * 600
    assert len(windows) == 200 and len(looked) < len(windows)


def test_lm_gradients_agree_with_differences():
    v = lm.Vocabulary({}, {b"": 0, b"a": 1}, {}, np.ones(lm.RARE), np.ones(lm.RARE), 10, 3)
    net, x, y = lm.start_network(v), np.array([[0], [1], [0]]), np.array([[1], [0], [lm.WORDS]])
    fresh = np.array([[True], [False], [False]])
    got = {}
    net._adam = lambda g, rate: got.update(g)
    net.train_window(x, y, fresh, np.zeros((1, lm.STATE), np.float32), 0.1)
    net.p = {k: p.astype(np.float64) for k, p in net.p.items()}

    def loss():
        return -net.log10_likelihood([y[:, 0]])[0] * math.log(10) / 3

    for name, at in (("u", (3, 5)), ("wx", (2, 70)), ("wc", (4, 0)), ("e", (1, 3)), ("b", (40,))):
        was = net.p[name][at]
        net.p[name][at] = was + 1e-3
        up = loss()
        net.p[name][at] = was - 1e-3
        assert abs((up - loss()) / 2e-3 - got[name][at]) < 1e-3, name
        net.p[name][at] = was


def test_lm_empty(spark):
    assert lm.score_documents(empty(spark)).count() == 0


# 3 shards of token ids


def test_token_ids_round_trip(spark):
    docs = documents(spark, ["a  b   c", " x", "a\n b \n\nc ", "don't 's"])
    t = Tokenizer.from_file(BYTE)
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, start = [], 0
    for d, text in rows:
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in sstable.ids_of_documents(docs, BYTE).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    assert sstable.ids_of_documents(empty(spark), BYTE).count() == 0


def test_shards_find_documents_by_binary_search(spark):
    docs = spark.createDataFrame([(i * 3, " ".join(words(i, 30))) for i in range(2000)] + [(6, "again")], "doc_id long, text string")
    path = new_path(spark, "test-shards")
    manifest = sstable.write_shards(docs, path, BYTE, 2, shard_bytes=1)
    assert manifest.count() > 1
    t = Tokenizer.from_file(BYTE)
    found = sstable.lookup(spark, manifest, path, [0, 6, 7, 1197, 5000])
    assert found[0] == [[*t.encode(" ".join(words(0, 30))).ids, 2]] and len(found[6]) == 2 and found[7] == [] and found[5000] == []
    assert found[1197][0] == [*t.encode(" ".join(words(399, 30))).ids, 2]
    fs, root = pafs.FileSystem.from_uri(path)
    one = fs.open_input_file(f"{root}/{manifest.first()['shard']}")
    keys = [k for k, _ in sstable.Reader(one).scan()]
    assert keys == sorted(keys)
    with pytest.raises(ValueError):
        fs.open_output_stream(f"{root}/bad.sst").write(b"x" * 100)
        sstable.Reader(fs.open_input_file(f"{root}/bad.sst"))


def test_keys_sort_like_numbers():
    ids = [None, -(1 << 63), -5, 0, 7, 1 << 62]
    assert sorted(ids, key=sstable.key_of) == ids and [sstable.doc_of(sstable.key_of(i)) for i in ids] == ids


# 4 quality


def test_quality_separates_and_keeps(spark):
    docs = labelled(spark, 240)
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 0) for i in range(160)] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    new = range(160, 240)
    assert sum(rows[i]["keep"] == (i % 4 != 0) for i in new) / len(new) >= 0.9 and all(rows[i]["keep"] for i in new if i % 4)
    assert all(0 <= rows[i][c] <= 1 for i in new for c in ("p_text", "p_meta", "quality_score"))


def test_quality_on_labels_that_were_not_drawn(spark):
    """Accuracy of the combined views and of each alone on labelled rows left out of the draw, and what exchange needs: the
    metadata view never sees the text."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = labels.filter("quality is not null").dropDuplicates(["doc_id"])
    learn, rest = known.filter("doc_id % 3 <> 0"), known.filter("doc_id % 3 = 0")
    rows = quality.classify(docs, learn).join(rest.select("doc_id", "quality"), "doc_id").collect()
    good, bad = ([r["quality_score"] for r in rows if r["quality"] == k] for k in (1, 0))
    auc = sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))
    assert len(rows) > 30 and auc >= 0.8
    assert "text" not in quality.metadata.__code__.co_varnames
    x = np.eye(quality.DIMS, dtype=np.float32)[:8]
    own = quality.Exchange(quality.start(x, np.array([0, 1] * 4))[0], x, np.array([0, 1] * 4))
    own.model.predict = lambda rows: (np.full(len(rows), 0.99), np.full(len(rows), 0.5), None)
    own.add(x)
    assert not own.held[0] and len(own.held[1][0][1]) == 8  # the text view was sure, so the metadata view is told


def test_quality_without_labels_keeps_all(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.classify(documents(spark), none).collect()
    assert len(rows) == documents(spark).count() and all(r["keep"] and r["quality_score"] is None for r in rows)
    model = quality.train(labelled(spark, 80), spark.createDataFrame([(i, i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int"))
    assert quality.score(documents(spark), model).count() == documents(spark).count() and quality.score(empty(spark), model).count() == 0


# 5 decontamination


def brute_contamination(docs, items):
    import re

    az = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(az))
    out = []
    for d, text in docs:
        w, hit, ids = cut(text), set(), set()
        for item, t in items:
            v = cut(t)
            for k in range(max(1, len(v) - 9) if v else 0):
                win = v[k : k + 10]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        ids.add("" if item is None else str(item))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_decontamination_equals_brute_force(spark):
    a, b = words(11, 40), words(12, 25, DE)
    items = [(1, " ".join(a)), (2, " ".join(b)), (30, "Straße ΑΣ"), (4, None), (5, "!!"), (6, "the the the the the the the the the the the"), (1, " ".join(a)), (None, " ".join(words(13, 12))), (7, " ".join(a[5:20]))]
    texts = [" ".join(words(20, 30) + a[3:19] + words(21, 9)), " ".join(a), " ".join(a[:9]), "x STRASSE, y straße... ασ Straße-ΑΣ.", " ".join(["the"] * 30), " ".join(b[:12] + ["gap"] + b[12:]).upper(), " ".join(words(13, 12)), " ".join(a + a)]
    docs = documents(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in decontam.decontaminate(docs, bench).collect()), key=str)
    assert got == brute_contamination([(r["doc_id"], r["text"]) for r in docs.collect()], items)
    assert decontam.decontaminate(empty(spark), bench).count() == 0
    assert not any(r["contaminated"] for r in decontam.decontaminate(docs, bench.limit(0)).collect())


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x y beta"), (2, "beta a b c d e f alpha"), (3, "alpha beta alpha")], "doc_id long, text string")
    pairs = spark.createDataFrame([("alpha", "beta")], "term1 string, term2 string")
    got = decontam.proximity_matches(docs, pairs, 3).groupBy("key").count().collect()
    assert sorted(r["count"] for r in got) == [1, 2]


def test_decontamination_has_no_python(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    plan = decontam.decontaminate(documents(spark), bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# 6 BPE


def test_bpe_equals_the_library(spark):
    t = Tokenizer.from_file(WORD)
    t.no_truncation(), t.no_padding()
    r = random.Random(5)
    texts = ["".join(r.choice("abcdehilnorst éñ😀'0.,<|>") for _ in range(r.randint(0, 200))) for _ in range(300)] + ["\x1c a\x85b", "a" * 300, "<|startoftext|>a<|endoftext|>", "é ﬁ İ ΣΑΣ", "x" * 60 + " y"]
    enc = bpe.encoder(WORD)
    ids = enc.encode(texts)
    assert ids == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [enc.decode(i) for i in ids] == [t.decode(i, skip_special_tokens=False) for i in ids]
    docs = documents(spark)
    for row in bpe.digest_documents(docs, WORD).collect():
        text = next((x["text"] or "") for x in docs.collect() if x["doc_id"] == row["doc_id"])
        want = t.encode(text, add_special_tokens=False).ids
        assert row["n_tokens"] == len(want) and row["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(t.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(docs, WORD).count() == docs.count() and bpe.digest_documents(empty(spark), WORD).count() == 0


def test_automaton_accepts_just_the_encoding():
    vocab = {s: i for i, s in enumerate(["a", "b", "a</w>", "b</w>", "aa", "ab", "aab", "ab</w>"])}
    m = bpe.compile_automaton(vocab, [("a", "a"), ("a", "b"), ("aa", "b"), ("a", "b</w>")])
    e = bpe.Encoder(m, {})
    assert e.ids_of_words(["aaa", "aab", "ab", "aaaab"]) == [[vocab["aa"], vocab["a</w>"]], [vocab["aa"], vocab["b</w>"]], [vocab["ab</w>"]], [vocab["aa"], vocab["aa"], vocab["b</w>"]]]


def test_automaton_is_compiled_in_little_memory():
    with open(WORD, encoding="utf-8") as f:
        model = json.load(f)["model"]
    tracemalloc.start()
    try:
        m = bpe.compile_automaton(model["vocab"], [tuple(x) for x in model["merges"]], model["end_of_word_suffix"])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert m.arcs.shape == (11613, 1730) and peak < 130e6


# 7 search


def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in r.standard_normal(12)]) for i in range(230)]
    rows += [(300, rows[3][1]), (301, rows[3][1]), (302, None), (303, [float("nan")] * 12), (304, [None] * 12), (350, rows[3][1]), rows[7], (400, [1.0, 2.0]), (None, rows[0][1])]
    got = sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in topk.search_embeddings(spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")).collect())
    vecs = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for i in vecs:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(vecs[i], vecs[j])), j) for j in vecs if j != i and len(vecs[j]) == len(vecs[i]))[:5]
            want += [(i, k, j, -s) for k, (s, j) in enumerate(best, 1)]
    assert got == sorted(want)


def test_top_k_of_an_empty_table(spark):
    assert topk.search_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_segment_bounds_hold():
    r = np.random.default_rng(2)
    q, x = r.integers(-300, 300, (20, 33)).astype(float), r.integers(-300, 300, (50, 33)).astype(float)
    last = None
    for n in (1, 4, 16):
        bound = topk.segment_features(q, n) @ topk.segment_features(x, n).T
        assert (bound >= q @ x.T - 1e-6).all() and (last is None or (bound <= last + 1e-6).mean() > 0.9)
        last = bound
    out = topk.block_top_k(np.arange(20), q.astype(np.int64), np.arange(100, 150), x.astype(np.int64), 3)
    assert out[2][:3] == sorted((q @ x.T)[0].astype(int).tolist())[::-1][:3]


# 8 licences


def test_licenses(spark):
    docs = documents(spark, ["Released under the MIT License.\n" + " ".join(words(3, 50)), "ALL RIGHTS RESERVED", "this work is licensed under the gnu general public license version 3 or later"])
    rows = {r["doc_id"]: r for r in license.scan_licenses(docs).collect()}
    assert rows[11]["licenses"] == "mit" and rows[11]["best_dice"] == 1.0 and "all-rights-reserved" in rows[12]["licenses"] and rows[13]["best_license"] == "gpl-3.0"
    assert rows[0]["n_licenses"] == rows[5]["n_licenses"] == 0 and license.scan_licenses(docs).count() == docs.count()
    assert license.scan_licenses(empty(spark)).count() == 0


def test_licenses_equal_brute_force_and_are_found_wrapped_and_embedded(spark):
    """Every window of a template's length that begins with one of its bigrams; notices cut into comment lines or with some
    words changed, within long texts, are found."""
    r, texts, planted = random.Random(12), [], {}
    for name, text in sorted(license.TEMPLATES.items()):
        w = text.split()
        wrapped = "".join(" ".join(w[i : i + 9]) + "\n * " for i in range(0, len(w), 9))
        changed = [("zz" if r.random() < 0.04 else x) for x in w]
        for body in (wrapped, " ".join(changed) if len(w) > 30 else text):
            planted[len(texts)] = name
            texts.append(" ".join(words(len(texts), 80)) + "\n/* " + body + " */\n" + " ".join(words(len(texts) + 900, 80)))
    texts += [" ".join(words(700 + i, 60)) for i in range(10)] + ["", None, "All rights", "rights reserved all", license.TEMPLATES["mit"] * 3]
    docs = list(enumerate(texts)) + [(3, texts[3])]
    got = sorted((x["doc_id"], x["n_licenses"], x["licenses"], x["best_license"], x["best_dice"]) for x in license.scan_licenses(spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, dice int")).collect())
    want = []
    for d, text in docs:
        w = license.template_words(text or "")
        grams, best = [f"{a} {b}" for a, b in zip(w, w[1:])], {}
        for name, template in license.TEMPLATES.items():
            own, n = license.bigrams_of(template), len(license.template_words(template))
            scores = [2 * len(own & set(grams[i : i + n - 1])) / (len(own) + len(set(grams[i : i + n - 1]))) for i, g in enumerate(grams) if g in own]
            if scores and max(scores) >= license.LEAST_DICE:
                best[name] = max(scores)
        top = min(best, key=lambda k: (-best[k], k), default=None)
        want.append((d, len(best), ",".join(sorted(best)), top, best.get(top)))
    assert got == sorted(want)
    found = {d: names.split(",") for d, _, names, _, _ in got}
    assert sum(name in found[d] for d, name in planted.items()) / len(planted) >= 0.9
    assert all(n == 0 for d, n, *_ in got if d >= len(planted) and d < len(planted) + 10)


def test_license_scan_has_no_python(spark):
    plan = license.scan_licenses(documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# 9 sharding


def test_shards_are_even_and_gapless(spark):
    docs = spark.createDataFrame([(i, f"text {i}" if i % 9 else None, "x", 3) for i in range(1003)] + [(5, "text 5", "x", 3)] * 3, "doc_id long, text string, shard string, slot int")
    rows = sharding.shard_documents(docs, 10).collect()
    by = Counter(r["shard"] for r in rows)
    assert len(rows) == 1006 and max(by.values()) - min(by.values()) <= 1
    for s in by:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(by[s]))
    assert all(r["size"] == len((r_text(r["doc_id"])).encode()) + 16 for r in rows) and {r["law"] for r in rows} == {"rows"}
    assert sharding.shard_documents(empty(spark)).count() == 0 and sharding.shard_documents(documents(spark), 40).count() == documents(spark).count()


def r_text(i):
    return f"text {i}" if i % 9 else ""


def test_sharding_equals_a_walk_row_by_row(spark):
    """Every row goes to the owner of its cell while that has room, else on clockwise, the first to overflow first."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i % 900, f"text {i // 2}") for i in range(1500)], "doc_id long, text string")
    got = {(r["doc_id"], r["text_crc32"]): r["shard"] for r in sharding.shard_documents(docs, 7).collect()}
    text = F.col("text").cast("binary")
    h = F.pmod(F.xxhash64("doc_id", F.crc32(text), (F.octet_length(text) + 16).cast("long")), F.lit(1 << 32))
    rows = sorted((r["h"], r["doc_id"], r["c"]) for r in docs.select("doc_id", F.crc32(text).alias("c"), h.alias("h")).collect())
    owners, room, want, over = sharding.ring_owners(7), [1500 // 7 + (s < 1500 % 7) for s in range(7)], {}, {}
    for x, d, c in rows:
        if room[owners[x >> 16]]:
            room[owners[x >> 16]] -= 1
            want[d, c] = owners[x >> 16]
        else:
            over.setdefault(x >> 16, []).append((d, c))
    waiting = []
    for step in range(2 * sharding.CELLS):
        cell = step % sharding.CELLS
        waiting += over.pop(cell, [])
        while waiting and room[owners[cell]]:
            room[owners[cell]] -= 1
            want[waiting.pop(0)] = owners[cell]
    assert over == {} and not waiting and got == want


def test_sharding_of_odd_rows(spark):
    """Null and repeated ids, texts that are not ASCII, columns named like helpers and results."""
    rows = [(None, f"t{i}", 1, 2) for i in range(40)] + [(7, "ü中", 1, 2)] * 5 + [(8, None, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int, _ring_h int")
    got = sharding.shard_documents(docs, 4).collect()
    per = Counter(r["shard"] for r in got)
    assert len(got) == 46 and max(per.values()) - min(per.values()) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in per.items())
    assert {r["size"] for r in got if r["doc_id"] == 7} == {len("ü中".encode()) + 16} and {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] == 8} == {(16, 0)}
    kept = sharding.assign_shards(docs, 4, "doc_id", (docs["text"],))
    assert kept.count() == 46 and "_ring_h" in kept.columns and {r["_ring_h"] for r in kept.collect()} == {2}


def test_one_more_shard_moves_few():
    r = random.Random(3)
    counts = Counter(r.randrange(sharding.CELLS) for _ in range(20_000))

    def place(n):
        return {(c, k): s for c, a, z, s, _ in sharding.fill(counts, n) for k in range(a, z)}

    a, b = place(10), place(11)
    assert len(a) == len(b) == 20_000 and sum(a[k] != b[k] for k in a) < 0.5 * len(a)


# 10 join


def brute_components(docs):
    sets = {}
    for d, text in docs:
        w = (text or "").encode().lower().split()
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = list(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW", 3)
    r = random.Random(9)
    texts, passage = [], words(77, 60)
    for g in range(6):
        base = words(100 + g, r.choice([6, 12, 40, 90, 200]))
        for _ in range(14):
            v = base[:]
            for _ in range(r.randint(0, max(1, len(v) // 18))):
                v[r.randrange(len(v))] = r.choice(words(r.random(), 1))
            texts.append(" ".join(v))
    texts += [" ".join(words(500 + i, 40) + passage) for i in range(20)] + ["a b c d", "A  b c D", "a b c", "w x y z q"] + ["same same"] * 5
    docs = [*enumerate(texts, 1), (900, None), (901, ""), (902, " \n")]
    r.shuffle(docs)
    got = jaccard.near_duplicates(spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, n int, h int")).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == brute_components(docs)


def test_linked_sets_share_a_signature():
    r = np.random.default_rng(4)
    for n in [1, 2, 3, 4, 5, 7, 9, 13, 20, 50, 120, 700]:
        for _ in range(60):
            a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
            drop, add = (int(x) for x in r.integers(0, n // 3 + 1, 2))
            b = np.unique(np.r_[a[drop:], r.integers(0, 1 << 63, add).astype(np.uint64)])
            if len(b) and jaccard.linked(a, b):
                assert np.intersect1d(jaccard.signatures(a), jaccard.signatures(b)).size, (n, drop, add)
                x, y = jaccard.folded([jaccard.odd_sketch(a), jaccard.odd_sketch(b)])
                assert np.bitwise_count(x ^ y).sum() <= jaccard.most_difference(len(a) + len(b))


def test_join_edges(spark):
    docs = documents(spark)
    got = [(r["doc_id"], r["component_id"]) for r in jaccard.near_duplicates(docs).collect()]
    assert len(got) == docs.count() and (6, 5) in got and (7, 5) in got and (0, 0) in got and (None, None) in got
    assert jaccard.near_duplicates(empty(spark)).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9), (3, 1), (10, 11), (11, 12), (12, 13), (13, 14)], "a long, b long")
    assert {r["node"]: r["component"] for r in components.connected_components(links).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 10: 10, 11: 10, 12: 10, 13: 10, 14: 10}


def test_linked_sets_share_as_many_signatures_as_their_slack():
    r = np.random.default_rng(5)
    for n in [1, 2, 5, 9, 20, 50, 120, 700]:
        for _ in range(60):
            a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
            drop, add = (int(x) for x in r.integers(0, n // 4 + 1, 2))
            b = np.unique(np.r_[a[drop:], r.integers(0, 1 << 63, add).astype(np.uint64)])
            if len(b) and jaccard.linked(a, b):
                assert np.intersect1d(jaccard.signatures(a), jaccard.signatures(b)).size >= max(jaccard.slack_of(a), jaccard.slack_of(b))


def test_dense_blocks_are_compared_there(spark, monkeypatch):
    """Many near copies at the edge of the law, in groups of several blocks."""
    monkeypatch.setattr(jaccard, "FEW", 2)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "PART", 5)
    monkeypatch.setattr(jaccard, "PARTNERS", 1)
    monkeypatch.setattr(jaccard, "near_pairs", lambda *a, f=jaccard.near_pairs: None if len(f(*a[:-1], 1 << 40)) else f(*a[:-1], 1 << 40))
    r, base, docs = random.Random(3), words(31, 80), []
    for d in range(60):
        v = base[:]
        for at in r.sample(range(80), r.choice([1, 2, 3])):
            v[at] = f"x{d}{at}"
        docs.append((d, " ".join(v)))
    got = jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == brute_components(docs)


# draws


def test_a_row_that_repeats_is_drawn_once(spark, monkeypatch):
    docs = labelled(spark)
    hot = spark.range(20_000).selectExpr("3 as doc_id", "'der die und das in den von zu mit sich' as text", "'de' as lang", "'s' as source", "38 as n_chars", "0.5 as score", "7 as shard")
    every = docs.unionByName(hot.select(*docs.columns).selectExpr("cast(doc_id as long) doc_id", "text", "lang", "source", "cast(n_chars as long) n_chars", "cast(score as double) score", "cast(shard as int) shard"))
    seen = []
    monkeypatch.setattr(quality, "_collected", lambda df, f=quality._collected: seen.append(df.count()) or f(df))
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(90)], "doc_id long, quality int")
    quality.train(every, labels, rounds=0)
    assert seen == [90]
    model = langid.train(every.selectExpr("text", "lang", "doc_id as salt"), sample=100_000)
    assert model is not None and len({r["lang_pred"] for r in langid.predict(docs, model).collect()}) >= 3
