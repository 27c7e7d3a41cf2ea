"""Byte-level BPE by overlapping chunk encoding.

Long texts are cut into chunks that overlap, and each chunk is pre-tokenised from its own start as if a text began there. A
boundary depends on what follows it alone, so where the boundaries of two neighbours coincide they stay the same from there:
neighbours are stitched at such a place in their overlap. The pieces between are encoded; decoding concatenates raw bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from buildlens.llm.common import discard, doc_key, end_to_end, materialize, pieces_of

#: Characters from one chunk's start to the next, and those that it shares with the next. Texts of fewer bytes are one chunk.
CHUNK, OVERLAP = 1 << 15, 256
#: Near the end of a chunk what follows is not known: a contraction takes three characters, and white space looks at one more.
MARGIN = 3
#: A pre-token of more bytes is merged by a heap.
LONG_PIECE = 64

OTHER, LETTER, NUMBER, SPACE, END = range(5)
_END_CODE = 0x110000


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point, and of the end of a text: the pattern's letters, numbers and white space are Unicode's."""
    out = np.zeros(_END_CODE + 1, np.uint8)
    for low, high in ((0, 0xD800), (0xE000, _END_CODE)):
        every = "".join(map(chr, range(low, high)))
        for kind, of in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(of, every):
                out[low + m.start() : low + m.end()] = kind
    out[_END_CODE] = END
    return out


def token_starts(codes: np.ndarray) -> np.ndarray:
    """Whether a match of the pattern begins at each code point. Texts follow one another, each with an end behind it.

    The pattern's fixed parts: contractions 's 't 're 've 'm 'll 'd; a run of letters, of numbers or of other characters, with
    one space before it; and white space, of which the last before something else stands alone or is that space.
    """
    kind = classes()[codes]
    before = np.r_[np.uint8(END), kind[:-1]]
    changes = kind != before
    blank = kind == SPACE
    spaced = np.r_[False, codes[:-1] == 0x20]
    after = np.r_[kind[1:], np.uint8(END)]
    starts = (changes & ~spaced) | (blank & (changes | ((after != SPACE) & (after != END))))
    p = np.flatnonzero((codes == 0x27) & changes & ~spaced)
    if len(p):
        one, two = (np.r_[codes, np.full(2, _END_CODE, np.uint32)][p + k] for k in (1, 2))
        short = np.isin(one, list(b"stmd"))
        long = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        starts[p[short | long] + 1] = False
        starts[p[long] + 2] = False
        ends = np.r_[p[short] + 2, p[long] + 3]
        starts[ends[ends < len(codes)]] = True
    return starts & (kind != END)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Encoder:
    """Encodes and decodes pre-tokens by ranks; remembers at most ``keep`` of them, but for those of the slice at hand."""

    def __init__(self, ranks: dict[bytes, int], keep: int = 400_000):
        self.ranks, self.keep = ranks, keep
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.known: dict[bytes, tuple[bytes, bytes, int]] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a pre-token: the neighbours of least rank are merged first, of equal ones the leftmost."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > LONG_PIECE:
            return self._merged_by_heap(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(piece[i : i + 2], _END_CODE) for i in range(len(piece) - 1)]  # of each part and the next
        while pairs and (best := min(pairs)) < _END_CODE:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], _END_CODE)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], _END_CODE)
        return [ranks[p] for p in parts]

    def _merged_by_heap(self, piece: bytes) -> list[int]:
        """The same in n log n: ends of parts and a heap of (rank, place) where what is out of date is passed over."""
        n, ranks = len(piece), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1" * n)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or after[j] - i != size:
                continue
            alive[j], end = 0, after[j]
            after[i] = end
            if end < n:
                before[end] = i
                if (r := ranks.get(piece[i : after[end]])) is not None:
                    heapq.heappush(heap, (r, i, after[end] - i))
            k = before[i]
            if k >= 0 and (r := ranks.get(piece[k:end])) is not None:
                heapq.heappush(heap, (r, k, end - k))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def learn(self, pieces: list[bytes]) -> list[tuple[bytes, bytes, int]]:
        """Of each pre-token: its ids in decimal, a comma after each; the bytes that they decode to; how many they are."""
        known = self.known
        new = [p for p in pieces if p not in known]
        if len(known) + len(new) > self.keep:
            known, new = {}, pieces
            self.known = known
        for p in new:
            ids = self.merged(p)
            known[p] = (b"".join([b"%d," % i for i in ids]), self.decode(ids), len(ids))
        return [known[p] for p in pieces]

    def spelled(self, texts: pa.Array) -> Iterator[tuple[memoryview, memoryview, int]]:
        """Of each text, what ``learn`` gives of a pre-token. Every distinct pre-token of a slice is looked at once."""
        for _, part in pieces_of(texts.cast(pa.large_binary())):
            edges = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
            data = np.frombuffer(part.buffers()[2], np.uint8)[edges[0] : edges[-1]] if part.buffers()[2] is not None else np.zeros(0, np.uint8)
            edges = edges - edges[0]
            lead = (data & 0xC0) != 0x80
            codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
            at = np.flatnonzero(lead)  # byte of each code point
            ends = np.searchsorted(at, edges)
            starts = token_starts(np.insert(codes, ends[1:], _END_CODE))
            own = np.ones(len(starts), bool)
            own[ends[1:] + np.arange(len(part))] = False
            begins = at[starts[own]]
            values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(np.r_[begins, len(data)].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
            coded = values.dictionary_encode()
            found = self.learn(coded.dictionary.to_pylist())
            rows = np.searchsorted(begins, edges)
            sums = np.r_[0, np.cumsum(np.array([x[2] for x in found], np.int64)[coded.indices.to_numpy()])]
            ids, raw = (end_to_end(pa.array([x[i] for x in found], pa.large_binary()).take(coded.indices), rows) for i in (0, 1))
            yield from zip(_rows(ids), _rows(raw), (sums[rows[1:]] - sums[rows[:-1]]).tolist())

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return [[int(i) for i in bytes(ids).split(b",")[:-1]] for ids, _, _ in self.spelled(pa.array(texts, pa.string()))]


def _rows(joined: pa.LargeBinaryArray) -> Iterator[memoryview]:
    data, ends = memoryview(joined.buffers()[2]), np.frombuffer(joined.buffers()[1], np.int64).tolist()
    for a, z in zip(ends, ends[1:]):
        yield data[a:z]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file of ranks; each worker reads it once."""
    if path not in _encoders:
        with open(path, "rb") as f:
            _encoders[path] = Encoder({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())})
    return _encoders[path]


def chunks(docs: DataFrame) -> DataFrame:
    """key, chunk (from 0), start, text: overlapping chunks of every distinct document."""

    def run(batches):
        names = ["key", "chunk", "start", "text"]
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                whole = text.as_py()
                at = range(0, max(1, len(whole) - OVERLAP), CHUNK)
                for k in range(0, len(at), 64):
                    some = at[k : k + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(some)), pa.array([i // CHUNK for i in some], pa.int64()), pa.array(some, pa.int64()), pa.array([whole[i : i + CHUNK + OVERLAP] for i in some])], names)

    cut = docs.select(doc_key().alias("key"), "text").mapInArrow(run, "key binary, chunk long, start long, text string")
    return cut.dropDuplicates(["key", "chunk"])  # summed up before the shuffle, so copies travel once a task


def pretokenised(cut: DataFrame) -> DataFrame:
    """``cut`` with heads and tails: the places in the text of boundaries in the overlap with the chunk before, and of the sure ones
    in that with the chunk after, but for those behind white space, which the pattern cuts by what follows."""

    def run(batches):
        for b in batches:
            heads, tails = [], []
            for start, text in zip(b.column(2).to_pylist(), b.column(3)):
                codes = codes_of(text.as_py())
                at = np.flatnonzero(token_starts(np.r_[codes, np.uint32(_END_CODE)]))
                heads.append((start + at[at < OVERLAP]).tolist())
                sure = at[(at >= max(1, len(codes) - OVERLAP)) & (at < len(codes) - MARGIN)]
                tails.append((start + sure[classes()[codes[sure - 1]] != SPACE]).tolist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], ["key", "chunk", "start", "text", "heads", "tails"])

    return cut.select("key", "chunk", "start", "text").mapInArrow(run, "key binary, chunk long, start long, text string, heads array<long>, tails array<long>")


def stitches(cut: DataFrame) -> DataFrame:
    """key, chunk, first (place of the text from which on the chunk's boundaries hold; null if it shares none with the one before),
    after (where the next chunk takes over; null for the last). No texts are shuffled."""
    order = Window.partitionBy("key").orderBy("chunk")
    shared = F.array_min(F.array_intersect(F.lag("tails").over(order), "heads"))
    met = cut.select("key", "chunk", "start", F.when(F.col("chunk") == 0, F.lit(0).cast("long")).otherwise(shared).alias("first"))
    return met.withColumn("after", F.lead("first").over(order))


def stitched(docs: DataFrame) -> DataFrame:
    """key, chunk, text: what each chunk has between its stitch with the one before and that with the next.

    Chunks that share no boundary with the one before, as in a run of letters longer than the overlap, are joined to it and
    pre-tokenised as one, until all can be stitched: at worst a text is one chunk.
    """
    cut = materialize(pretokenised(chunks(docs)), "chunks")
    while True:
        seams = materialize(stitches(cut), "seams")
        if not seams.filter("first is null").limit(1).count():
            break
        span = F.max(F.when(F.col("first").isNotNull(), F.col("chunk"))).over(Window.partitionBy("key").orderBy("chunk"))
        spans = seams.select("key", "chunk", span.alias("span"), (F.lead("start").over(Window.partitionBy("key", span).orderBy("chunk")) - F.col("start")).alias("until"))
        parts = cut.select("key", "chunk", "start", "text").join(spans, ["key", "chunk"])
        parts = parts.withColumn("text", F.expr("if(until is null, text, substring(text, 1, cast(until as int)))"))
        whole = parts.groupBy("key", "span").agg(F.min("start").alias("start"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "text"))), lambda p: p["text"]), "").alias("text"))
        was, cut = cut, materialize(pretokenised(whole.withColumnRenamed("span", "chunk")), "chunks")
        discard(was, seams)
    met = cut.select("key", "chunk", "start", "text").join(seams.select("key", "chunk", "first", "after"), ["key", "chunk"])
    part = F.expr("substring(text, cast(first - start + 1 as int), cast(coalesce(after - first, length(text)) as int))")
    out = materialize(met.select("key", "chunk", part.alias("text")), "stitched")
    discard(cut, seams)
    return out


def _digests_of_chunks(parts: DataFrame, ranks_path: str) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of texts in chunks. A text's chunks pass one after another: none is held."""

    def encoded(batches):
        enc = encoder(ranks_path)
        for b in batches:
            for k in range(0, b.num_rows, 100):
                some = b.slice(k, 100)
                ids, raw, n = zip(*enc.spelled(some.column(2)))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(n, pa.int64()), pa.array([bytes(x) for x in ids], pa.binary()), pa.array([bytes(x) for x in raw], pa.binary())], ["key", "chunk", "n", "ids", "raw"])

    def digested(batches):
        key, total, of_ids, of_raw, open_end = None, 0, None, None, b""

        def closed():
            of_ids.update(open_end[:-1])
            return pa.RecordBatch.from_pylist([{"key": key, "n_tokens": total, "ids_sha256": of_ids.hexdigest(), "decoded_sha256": of_raw.hexdigest()}])

        for b in batches:
            for new, n, ids, raw in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3), b.column(4)):
                if new != key:
                    if key is not None:
                        yield closed()
                    key, total, of_ids, of_raw, open_end = new, 0, hashlib.sha256(), hashlib.sha256(), b""
                of_ids.update(open_end)
                open_end = ids.as_py()  # the last comma of all is not digested
                of_raw.update(raw.as_buffer())
                total += n
        if key is not None:
            yield closed()

    ids = parts.select("key", "chunk", "text").mapInArrow(encoded, "key binary, chunk long, n long, ids binary, raw binary")
    return ids.repartition("key").sortWithinPartitions("key", "chunk").mapInArrow(digested, "key binary, n_tokens long, ids_sha256 string, decoded_sha256 string")


def digest_documents(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document.

    A null text is empty: no tokens, and the digests of nothing. Rows that repeat give rows that repeat. Texts of up to CHUNK bytes
    are one chunk, and are encoded where they are read; longer ones are cut, stitched and encoded in parts, distinct ones once.
    An empty table gives no rows; other columns are not looked at.
    """
    long = F.coalesce(F.octet_length("text"), F.lit(0)) > CHUNK
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches):
        enc = encoder(ranks_path)
        for b in batches:
            if b.num_rows:
                n, ids, raw = zip(*((n, hashlib.sha256(ids[:-1]).hexdigest(), hashlib.sha256(raw).hexdigest()) for ids, raw, n in enc.spelled(b.column(1))))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(raw)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    short = rows.filter(~long).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    parts = stitched(rows.filter(long))
    digests = materialize(_digests_of_chunks(parts, ranks_path), "digests")
    discard(parts)
    of_rows = rows.filter(long).select("doc_id", doc_key().alias("key"))
    return short.unionByName(of_rows.join(digests, "key").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))
