import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from buildlens.llm import byte_bpe

from .helpers import SCHEMA, documents, words

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = ["'s", "'", "''s", "x'll", "'re", "'r", "'tis", "\n's", " ", "  ", "\n", "\t ", " ", " ", "\x1c", "\x85", "1", "²", "Ⅷ", "é", "中文", "🎉", "á", "_", "!?", " x", "…", "ⁿ", "\U0001D7D8"]


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n, size):
    r = random.Random(4)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, size))) for _ in range(n)]


def test_ids_equal_the_library(library):
    texts = odd_texts(2000, 14) + [" ".join(words(k, 50)) for k in range(20)] + ["<|endoftext|>", "y" * 500, "z" * 70 + " " * 300, "", "Ünïcode " * 30]
    enc = byte_bpe.encoder(RANKS)
    assert enc.encode(texts) == [library.encode_ordinary(t) for t in texts]
    assert [enc.decode(i).decode() for i in enc.encode(texts)] == texts


def test_boundaries_equal_the_pattern_at_every_code_point(library):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    found = np.flatnonzero(byte_bpe.token_starts(byte_bpe.codes_of("".join(f"a{c}1 {c}" for c in every))))
    text, want, at = "".join(f"a{c}1 {c}" for c in every), [], 0
    for piece in regex.findall(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"[^\p{White_Space}", r"[^\p{White_Space}"), text):
        want.append(at)
        at += len(piece)
    assert found.tolist() == want
    some = [c for c in every if not c.isascii()][::7] + every[:256]
    assert byte_bpe.encoder(RANKS).encode(["a" + c + "1 " + c for c in some]) == [library.encode_ordinary("a" + c + "1 " + c) for c in some]


def test_the_heap_merges_as_the_list_does(monkeypatch):
    enc, r = byte_bpe.encoder(RANKS), random.Random(1)
    pieces = ["".join(r.choice("aeinrst") for _ in range(r.randint(2, 60))).encode() for _ in range(300)]
    by_list = [enc.merged(p) for p in pieces]
    assert by_list == [[enc.ranks[p]] if p in enc.ranks else enc._merged_by_heap(p) for p in pieces]


def brute(library, texts):
    out = []
    for i, t in texts:
        ids = library.encode_ordinary(t or "")
        out.append((str(i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in df.collect())


def test_chunks_are_stitched_as_whole_texts(spark, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CHUNK", 60)
    monkeypatch.setattr(byte_bpe, "OVERLAP", 24)
    runs = ["x" * 700 + " end", "go " + " " * 400 + "\n" + "on" * 90, "a" * 59 + "'ll" + "b" * 200, "1" * 83 + " " * 37 + "'s", "é" * 61 + "'" * 150 + "s"]
    docs = documents(spark, extra=[*odd_texts(40, 200), *runs, runs[0]]).repartition(3)
    want = brute(library, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert got(byte_bpe.digest_documents(docs, RANKS)) == want


def test_tables_and_nothing(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(byte_bpe.digest_documents(docs, RANKS)) == brute(library, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert byte_bpe.digest_documents(spark.createDataFrame([], SCHEMA), RANKS).count() == 0


def test_copies_of_a_long_text_are_cut_once(spark, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CHUNK", 1000)
    text = " ".join(words(3, 2000))
    docs = spark.createDataFrame([(1, text)] * 30 + [(2, text), (None, text)], "doc_id long, text string").repartition(4)
    assert byte_bpe.chunks(docs).count() == 3 * -(-(len(text) - byte_bpe.OVERLAP) // 1000)
    assert got(byte_bpe.digest_documents(docs, RANKS)) == brute(library, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_a_text_of_megabytes(spark, library):
    texts = [(1, " ".join(words(8, 400_000))), (2, "n" * 300_000), (3, " " * 200_000 + "x")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert got(byte_bpe.digest_documents(docs, RANKS)) == brute(library, texts)
