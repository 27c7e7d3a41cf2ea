"""Token ids of documents in sorted-string-table shards.

A shard file: data blocks, the sparse index, the Bloom filter, the footer. A data block holds entries in key order, each
with the length of the prefix it shares with the key before it; every 16th entry shares none, and the block's end lists
where those stand. The index has each block's last key and place. Keys are bytes whose order is the order of doc_ids.
"""

from __future__ import annotations

import bisect
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from buildlens.llm.common import DistinctWords, new_path, pieces_of, rows_of

MAGIC = b"SSTIDS01"
FOOTER = struct.Struct("<QQQQQQI8s")  # index place and size, filter place and size, documents, ids, width of an id, magic
BLOCK_BYTES, RESTART = 64 << 10, 16
FILTER_BITS, FILTER_HASHES = 10, 7
#: The cut of a byte-level tokenizer before its merges, as the public vocabulary's readme gives it.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: A space before other white space: only there do the cuts depend on more than what stands between two spaces.
RUN = r" [\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def key_of(doc_id: int | None, copy: int = 0) -> bytes:
    """Null first, then by number; rows of one doc_id by their copy number."""
    return (b"\0" + bytes(8) if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))) + struct.pack(">I", copy)


def doc_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:9])[0] - (1 << 63) if key[:1] == b"\1" else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def _bits(key: bytes, n_bits: int) -> list[int]:
    a, b = zlib.crc32(key[:9]), zlib.crc32(key[:9], 0x9E3779B9) | 1
    return [(a + i * b) % n_bits for i in range(FILTER_HASHES)]


class Writer:
    """Writes one shard; keys must come in ascending order."""

    def __init__(self, stream, width: int):
        self.stream, self.width = stream, width
        self.place = self.docs = self.ids = 0
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self._fresh()

    def _fresh(self) -> None:
        self.block, self.restarts, self.n, self.last = bytearray(), [], 0, b""

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.n % RESTART:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(len(self.block))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.n, self.last, self.docs, self.ids = self.n + 1, key, self.docs + 1, self.ids + len(value) // self.width
        self.keys.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self._end_block()

    def _end_block(self) -> None:
        if self.n:
            data = bytes(self.block) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
            self.index.append((self.last, self.place, len(data)))
            self._put(data)
        self._fresh()

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.place += len(data)

    def close(self) -> None:
        self._end_block()
        index_at = self.place
        self._put(b"".join(_varint(len(k)) + k + struct.pack("<QI", at, n) for k, at, n in self.index))
        filter_at = self.place
        n_bits = max(64, FILTER_BITS * len(self.keys)) + 7 & ~7
        bits = np.zeros(n_bits, bool)
        for k in self.keys:
            bits[_bits(k, n_bits)] = True
        self._put(np.packbits(bits).tobytes())
        self._put(FOOTER.pack(index_at, filter_at - index_at, filter_at, self.place - filter_at, self.docs, self.ids, self.width, MAGIC))
        self.stream.close()


class Reader:
    """Reads one shard by its footer; of the data, only the blocks asked for."""

    def __init__(self, file):
        self.file = file
        file.seek(file.size() - FOOTER.size)
        index_at, index_n, self.filter_at, self.filter_n, self.docs, self.ids, self.width, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of token ids, or not whole")
        raw, at, self.index = self._at(index_at, index_n), 0, []
        while at < len(raw):
            n, at = _number(raw, at)
            self.index.append((raw[at : at + n], *struct.unpack_from("<QI", raw, at + n)))
            at += n + 12
        self.filter: bytes | None = None

    def _at(self, place: int, n: int) -> bytes:
        self.file.seek(place)
        return self.file.read(n)

    def _block(self, k: int) -> tuple[bytes, int]:
        data = self._at(*self.index[k][1:])
        (n,) = struct.unpack_from("<I", data, len(data) - 4)
        return data, len(data) - 4 * (n + 1)

    @staticmethod
    def _entries(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < end:
            shared, at = _number(data, at)
            rest, at = _number(data, at)
            size, at = _number(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + size]
            at += size

    def _ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, "<u2" if self.width == 2 else "<u4")

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.index)):
            data, end = self._block(k)
            for key, value in self._entries(data, 0, end):
                yield key, self._ids(value)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of the rows of a doc_id: filter, binary search of the index, then of the block's restarts."""
        key = key_of(doc_id)
        if self.filter is None:
            self.filter = self._at(self.filter_at, self.filter_n)
        if not all(self.filter[b >> 3] >> (7 - (b & 7)) & 1 for b in _bits(key, 8 * self.filter_n)):
            return []
        found = []
        for k in range(bisect.bisect_left(self.index, key, key=lambda x: x[0]), len(self.index)):
            data, end = self._block(k)
            restarts = struct.unpack_from(f"<{(len(data) - end) // 4 - 1}I", data, end)
            at = max(bisect.bisect_right(restarts, key, key=lambda r: next(self._entries(data, r, end))[0]) - 1, 0)
            for other, value in self._entries(data, restarts[at], end):
                if other[:9] > key[:9]:
                    return found
                if other[:9] == key[:9]:
                    found.append(self._ids(value))
        return found


class IdEncoder:
    """Ids of whole texts by the tokenizers library, which gets each distinct piece between cuts once.

    A byte-level tokenizer merges within pieces only, so the ids of a text are those of its pieces in order. No piece
    reaches across the place before a space, but in runs of white space: a text without such runs is looked up by what
    stands between its spaces. Texts that contain a special token's string go to the library whole. At most ``keep``
    strings are remembered of each kind, but for those of the slice at hand.
    """

    def __init__(self, path: str, keep: int = 600_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks have the cores already
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind, self.code = ("<u2", "H") if self.width == 2 else ("<u4", "I")
        self.keep, self.chunks, self.pieces = keep, {}, {}
        vocab = self.tokenizer.get_vocab()
        self.starts = np.zeros(max(vocab.values()) + 1, bool)  # ids of tokens that begin with a space
        self.starts[[i for t, i in vocab.items() if t[:1] == "\u0120"]] = True

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _by_pieces(self, texts: list[str]) -> list[bytes]:
        cut = [PIECES.findall(t) for t in texts]
        every = {p for ps in cut for p in ps}
        new = [p for p in every if p not in self.pieces]
        if len(self.pieces) + len(new) > self.keep:
            self.pieces, new = {}, list(every)
        self.pieces.update(zip(new, self._whole(new)))
        return [b"".join([self.pieces[p] for p in ps]) for ps in cut]

    def _learned(self, chunks: list[str]) -> list[bytes]:
        """A chunk stands for a space and what follows it up to the next.

        New chunks go to the library in one text, whose ids part at the tokens that begin with a space, one for each
        chunk. Should their number be another, the chunks are cut into pieces instead.
        """
        known = self.chunks
        new = [c for c in chunks if c not in known]
        if len(known) + len(new) > self.keep:
            self.chunks = known = {}
            new = chunks
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            (ids,) = self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)
            ids = np.array(ids.ids, self.kind)
            cut = np.flatnonzero(self.starts[ids])
            if "" in part or len(cut) != len(part) or cut[0]:
                known.update(zip(part, self._by_pieces([" " + c for c in part])))
                continue
            data, ends = ids.tobytes(), (np.append(cut, len(ids)) * self.width).tolist()
            known.update(zip(part, [data[a:b] for a, b in zip(ends, ends[1:])]))
        return [known[c] for c in chunks]

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, as bytes; null counts as empty."""
        for _, part in pieces_of(texts):
            out: list[bytes] = [b""] * len(part)
            odd = pc.match_substring_regex(part, RUN)
            special = np.zeros(len(part), bool)
            for s in self.special:
                special |= pc.match_substring(part, s).to_numpy(zero_copy_only=False)
            odd = odd.to_numpy(zero_copy_only=False)
            for rows, ids in ((special, self._whole), (odd & ~special, self._by_pieces)):
                at = np.flatnonzero(rows)
                for i, found in zip(at.tolist(), ids(part.take(pa.array(at)).to_pylist()) if len(at) else ()):
                    out[i] = found
            plain = np.flatnonzero(~(odd | special))
            if len(plain):
                cut = pc.split_pattern(part.take(pa.array(plain)), " ", max_splits=1)  # the head has no space before it
                heads = self._by_pieces(pc.list_element(cut, 0).to_pylist())
                rest = pc.list_slice(cut, 1).combine_chunks() if isinstance(cut, pa.ChunkedArray) else pc.list_slice(cut, 1)
                some = pc.list_value_length(rest).to_numpy(zero_copy_only=False) > 0
                words = DistinctWords(pc.split_pattern(rest.flatten(), " "))
                found = iter(words.joined(pa.array(self._learned(words.words.to_pylist()), pa.large_binary())))
                for i, head, more in zip(plain.tolist(), heads, some.tolist()):
                    out[i] = head + next(found) if more else head
            yield from out


@lru_cache(2)
def encoder(path: str) -> IdEncoder:
    return IdEncoder(path)


MANIFEST = "shard string, docs long, ids long"


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, shard_bytes: int = 256 << 20) -> DataFrame:
    """Encode ``docs`` (doc_id, text; a null text is empty) and write shards under ``path`` in ascending doc_id order.

    One shuffle, by ranges of doc_id and then of a hash of the text. Each task writes under names of its own, and only the shards that the manifest
    lists count, so a task that runs again leaves no double. Returns the manifest: shard, docs, ids; shard names ascend
    with their doc_ids. Null doc_ids come first; rows of one doc_id follow each other by that hash. No documents: no shards.
    """

    def write(batches):
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        enc = encoder(tokenizer_path)
        end = np.array([end_id], enc.kind).tobytes()
        part, out, name, last, copy, done = TaskContext.get().partitionId(), None, "", object(), 0, []

        def close():
            if out:
                out.close()
                done.append((name, out.docs, out.ids))

        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1))):
                copy = copy + 1 if doc_id == last else 0
                if out is None or out.place >= shard_bytes and not copy:
                    close()
                    name = f"{part:08d}-{len(done):06d}-{uuid.uuid4().hex}.sst"
                    out = Writer(fs.open_output_stream(f"{root}/{name}"), enc.width)
                out.add(key_of(doc_id, copy), value + end)
                last = doc_id
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["shard", "docs", "ids"])

    # rows of one doc_id must be told apart in the same way whenever a task runs again, hence the order by text too
    # and rows of one doc_id are spread by a hash of their text, so that no id is one task's
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("spread")).repartitionByRange("doc_id", "spread").sortWithinPartitions("doc_id", "spread", "text")
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{path}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{path}/manifest")


def read_shards(manifest: DataFrame, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the shards that the manifest lists.

    The window over the manifest has a row for each shard; documents themselves are read by as many tasks as shards.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("before", F.coalesce(F.sum("ids").over(before), F.lit(0))).select("shard", "before")

    def scan(batches):
        fs, root = pafs.FileSystem.from_uri(path)
        for shard, start in rows_of(batches):
            rows = []
            with fs.open_input_file(f"{root}/{shard}") as file:
                for key, ids in Reader(file).scan():
                    rows.append((doc_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 20_000:
                        yield _batch(rows)
                        rows = []
            yield _batch(rows)

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.repartition(max(1, manifest.count()), "shard").mapInArrow(scan, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark, manifest: DataFrame, path: str, doc_ids: list[int]) -> dict[int, list[list[int]]]:
    """Ids of a few documents; a shard whose filter says no gives up no data block."""
    fs, root = pafs.FileSystem.from_uri(path)
    found: dict[int, list[list[int]]] = {d: [] for d in doc_ids}
    for row in manifest.select("shard").toLocalIterator():
        with fs.open_input_file(f"{root}/{row['shard']}") as file:
            reader = Reader(file)
            for d in doc_ids:
                found[d] += [ids.tolist() for ids in reader.get(d)]
    return found


def ids_of_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from shards written and read again.

    A null or empty text has its end id alone. Null doc_ids come first, as in Spark's order; rows that repeat a doc_id have an
    entry each, and rows equal in id and text are interchangeable. An empty table gives no rows; other columns are not read.
    """
    path = new_path(docs.sparkSession, "token-ids")
    return read_shards(write_shards(docs, path, tokenizer_path, end_id), path)
