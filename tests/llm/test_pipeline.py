import random

import corpus_pipeline
from buildlens.llm import bpe, queries

from .helpers import DE, EN, FR, SCHEMA, labelled, words


def test_stages_in_order_and_their_effect(spark, tmp_path):
    docs = labelled(spark, 160)
    bench = [(1, " ".join(words(1000, 30)))]
    more = [(500, None), (501, "12 345 !!"), (502, docs.filter("doc_id = 1").first()["text"]), (503, " ".join(words(7, 10)) + " " + bench[0][1])]
    docs = docs.union(spark.createDataFrame([(i, t, "en", "s", 1, 0.0, 0) for i, t in more], docs.schema))
    docs.select("doc_id", "text", "lang", "source", "n_chars", "score").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_classifier", "jaccard_join", "decontamination", "bpe"]
    rows = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, str(tmp_path))
        assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"], name
        rows.write.parquet(str(tmp_path / name))
        rows = spark.read.parquet(str(tmp_path / name))
        kept.append({r["doc_id"] for r in rows.collect()})
    assert not kept[0] & {500, 501} and {1, 502, 503} <= kept[0]
    assert 4 not in kept[1] and {1, 2, 3} <= kept[1]
    assert 1 in kept[2] and 502 not in kept[2] and 503 in kept[2]
    assert 503 not in kept[3] and kept[3] == kept[2] - {503}
    got = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = {r["doc_id"]: r["ids_sha256"] for r in bpe.digest_documents(rows, corpus_pipeline.WORD_BPE).collect()}
    assert got == want and set(got) == kept[3]


def test_language_stage_drops_what_no_language_learned_explains(spark, tmp_path):
    def text(seed, base):  # words of the language's own syllables
        r = random.Random(seed)
        return " ".join("".join(r.choices(base, k=r.randint(1, 3))) for _ in range(40))

    docs = spark.createDataFrame([(i, text(i, base), lang, "s", 1, 0.0, 0) for i in range(160) for lang, base in [(("en", EN), ("de", DE), ("fr", FR))[i % 3]]], SCHEMA)
    junk = {600: "asdf qwer", 601: "zxcvbnm qwrtp sdfgh jklmn bvcxz", 602: "Это текст на русском языке о погоде", 603: "Ala ma kota a kot ma psa i bardzo lubi chodzić po lesie każdego dnia"}
    clean = {700: "the and that", 701: "und der mit", 702: "les dans pour", 703: "It was."}
    docs = docs.union(spark.createDataFrame([(i, t, None, "s", 1, 0.0, 0) for i, t in (junk | clean).items()], docs.schema))
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs, str(tmp_path)).collect()}
    assert not kept & set(junk) and kept >= set(clean) | set(range(160))


def test_one_of_each_goes_by_row_where_ids_repeat_or_are_null(spark, tmp_path):
    a, b, c, d = (words(seed, 80) for seed in (21, 22, 23, 24))
    near = lambda w, word: " ".join([*w[:-1], word])
    rows = [(5, " ".join(a)), (6, near(a, "six")), (None, near(a, "none")), (5, near(b, "five")), (3, " ".join(b)), (None, " ".join(c)), (None, " ".join(c)), (None, near(c, "none"))]
    rows += [(9, " ".join(d)), (9, near(d, "nine")), (9, " ".join(d)), (None, ""), (None, ""), (8, " "), (8, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 0.0, 0) for i, t in rows], SCHEMA)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_each(spark, docs, str(tmp_path)).collect()]
    of = lambda w: [i for i, t in got if t.startswith(" ".join(w[:-1]))]
    assert (5, " ".join(a)) in got and (3, " ".join(b)) in got
    assert (of(a), of(b), of(c), of(d)) == ([5], [3], [None], [9])
    assert got.count((None, "")) == 2 and got.count((8, " ")) == 1 and len(got) == 7


def test_queries_are_named():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
