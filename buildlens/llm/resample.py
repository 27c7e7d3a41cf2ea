"""Importance resampling towards a target distribution, by inverted postings that are partitioned by bucket.

Features are hashed into buckets. Postings (bucket, document, count) of the corpus are dealt by ranges of buckets and stored.
Each range meets the target's totals of the same buckets, where the buckets' gains are worked out; every posting hands its
document count times gain, and what the ranges hand over is summed by document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from buildlens.llm.common import discard, doc_key, materialize
from buildlens.llm.runs import crcs, runs_of, shifted, word_mask

BUCKETS = 10_000
ORDERS = 3
#: Ranges of buckets. Every range of a block of documents names these, so more ranges mean more names.
RANGES = 16
#: A block of postings is of documents with so many features together, or of so many documents.
BLOCK_FEATURES, BLOCK_DOCS = 1_500_000, 4096
#: Bytes of texts that are counted together.
SLICE = 3 << 20
LEAST_WORDS = 20
SHARE = 5
#: Candidates of a cell in which ranks are counted, on average.
CELL = 500_000

_WIDTH = -(-BUCKETS // RANGES)
_SPACE = crcs([b" "])[0]


def feature_buckets(crc: np.ndarray, length: np.ndarray, row: np.ndarray, carried: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each run of 1 to 3 consecutive words of a row, of the words' checksums and lengths in bytes. The first
    ``carried`` words were counted before: runs end behind them."""
    rows, buckets = [row[carried:]], [crc[carried:] % BUCKETS]
    spaced = shifted(np.full(len(crc), _SPACE, np.uint32), length) ^ crc  # of a space and the word
    run = crc
    for n in range(1, ORDERS):
        run = shifted(run[:-1], length[n:] + 1) ^ spaced[n:]  # run[i] ends at word i + n
        same = row[n:] == row[:-n] if len(row) > n else np.zeros(0, bool)
        same[: max(0, carried - n)] = False
        rows.append(row[n:][same])
        buckets.append((run % BUCKETS)[same])
    return np.concatenate(rows), np.concatenate(buckets).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes, int, int, np.ndarray, np.ndarray]]:
    """(doc_id, key, words, features, buckets, counts) of each document, buckets ascending."""
    for b in batches:
        if not b.num_rows:
            continue
        ids, keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
        open_row, total, n_words, carry = -1, None, 0, (np.zeros(0, np.uint32), np.zeros(0, np.int64))

        def closed():
            at = np.flatnonzero(total)
            return ids[open_row], keys[open_row], n_words, int(total.sum()), at, total[at]

        for first, part, runs in runs_of(texts, word_mask, SLICE):
            crc, length = crcs(runs.words)[runs.at], runs.lengths
            if part == 0 and open_row >= 0:
                yield closed()
                open_row = -1
            if len(runs.rows) == 2:  # one text, maybe a piece of it: counts in a table
                if part == 0:
                    open_row, total, n_words, carry = first, np.zeros(BUCKETS, np.int64), 0, (crc[:0], length[:0])
                k = len(carry[0])
                n_words += len(crc)
                crc, length = np.r_[carry[0], crc], np.r_[carry[1], length]
                _, bucket = feature_buckets(crc, length, np.zeros(len(crc), np.int64), k)
                total += np.bincount(bucket, minlength=BUCKETS)
                carry = crc[1 - ORDERS :], length[1 - ORDERS :]
                continue
            n = len(runs.rows) - 1
            row = np.repeat(np.arange(n), np.diff(runs.rows))
            of, bucket = feature_buckets(crc, length, row)
            code = np.sort(of * BUCKETS + bucket)
            begins = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
            count, code = np.diff(np.r_[begins, len(code)]), code[begins]
            cut = np.searchsorted(code, np.arange(n + 1) * BUCKETS)
            words = np.diff(runs.rows).tolist()
            for i in range(n):
                a, z = cut[i], cut[i + 1]
                yield ids[first + i], keys[first + i], words[i], int(count[a:z].sum()), code[a:z] - i * BUCKETS, count[a:z]
        if open_row >= 0:
            yield closed()


def pack(lists: np.ndarray, places: np.ndarray, counts: np.ndarray) -> bytes:
    """Postings of a range: how many each bucket has, then the documents' places in bucket order, then the counts less one. A
    count of more than 255 is several postings."""
    return pa.compress(lists.astype("<u4").tobytes() + places.astype("<u2").tobytes() + (counts - 1).astype("u1").tobytes(), "zstd", asbytes=True)


def unpack(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = pa.decompress(data, size, "zstd", asbytes=True)
    lists = np.frombuffer(raw, "<u4", _WIDTH)
    n = int(lists.sum())
    return lists, np.frombuffer(raw, "<u2", n, 4 * _WIDTH), np.frombuffer(raw, "u1", n, 4 * _WIDTH + 2 * n).astype(np.int64) + 1


_POSTINGS = "range int, keys binary, postings binary, size long, totals array<long>, docs array<struct<key:binary,doc_id:long,n_words:long,n_features:long>>"


def postings(docs: DataFrame) -> DataFrame:
    """range (of buckets), keys (16 bytes for each document named), postings (packed), size (unpacked), totals (of the range's
    buckets) of blocks of documents; and with range -1 the block's documents themselves.

    Every row names its documents by their keys, so rows of a task that ran twice fit together.
    """

    def rows(block: list) -> Iterator[tuple]:
        yield -1, None, None, None, None, [{"key": k, "doc_id": i, "n_words": w, "n_features": f} for i, k, w, f, _, _ in block]
        bucket = np.concatenate([x[4] for x in block])
        count = np.concatenate([x[5] for x in block])
        place = np.repeat(np.arange(len(block)), [len(x[4]) for x in block])
        order = np.argsort(bucket, kind="stable")
        bucket, count, place = bucket[order], count[order], place[order]
        keys = np.frombuffer(b"".join(x[1] for x in block), "V16")
        cut = np.searchsorted(bucket, np.arange(RANGES + 1) * _WIDTH)
        for r, (a, z) in enumerate(zip(cut[:-1], cut[1:])):
            if a == z:
                continue
            own, named = bucket[a:z] - r * _WIDTH, np.unique(place[a:z])
            totals = np.bincount(own, count[a:z], _WIDTH).astype(np.int64)
            times = -(-count[a:z] // 255)
            many = np.repeat(count[a:z], times)
            if times.max() > 1:
                last = np.cumsum(times) - 1
                many = np.full(len(many), 255)
                many[last] = (count[a:z] - 1) % 255 + 1
            lists = np.bincount(own, times, _WIDTH).astype(np.int64)
            yield r, keys[named].tobytes(), pack(lists, np.repeat(np.searchsorted(named, place[a:z]), times), many), 4 * _WIDTH + 3 * len(many), totals.tolist(), None

    def run(batches):
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.struct([("key", pa.binary()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64())]))]
        names = ["range", "keys", "postings", "size", "totals", "docs"]
        block, features = [], 0

        def batch():
            columns = zip(*rows(block))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for x in _counted(batches):
            block.append(x)
            features += x[3]
            if features >= BLOCK_FEATURES or len(block) >= BLOCK_DOCS:
                yield batch()
                block, features = [], 0
        if block:
            yield batch()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc_key().alias("key"), "text").mapInArrow(run, _POSTINGS)


def stored(docs: DataFrame, tag: str) -> DataFrame:
    """Postings dealt by range of buckets and written. A range is dealt over as many tasks as its share asks for: rows of a block
    go together by the block's first document."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64(F.coalesce(F.col("keys"), F.col("docs")[0]["key"])), F.lit(max(1, math.ceil(4 * tasks / RANGES))))
    return materialize(postings(docs).repartition(tasks, "range", salt), tag)


def bucket_totals(stored_postings: DataFrame) -> DataFrame:
    """range, bucket (within it), n: no more rows than there are buckets."""
    each = stored_postings.filter("range >= 0").select("range", F.posexplode("totals").alias("bucket", "n"))
    return each.groupBy("range", "bucket").agg(F.sum("n").alias("n"))


def bucket_gains(of_corpus: DataFrame, of_target: DataFrame) -> DataFrame:
    """range, gains (of its buckets): co-grouped totals of both corpora. At most RANGES rows of at most BUCKETS numbers."""
    s, t = (of_corpus.select("range", "bucket", F.col("n").alias("s")), of_target.select("range", "bucket", F.col("n").alias("t")))
    both = s.join(t, ["range", "bucket"], "full").select("range", "bucket", F.coalesce("s", F.lit(0)).cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t"))
    all_s, all_t = (x.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias(f"all_{name}")) for x, name in ((of_corpus, "s"), (of_target, "t")))
    m = float(BUCKETS)
    gain = F.floor(1000 * F.log((F.col("t") + 1) * (F.col("all_s") + m) / ((F.col("s") + 1) * (F.col("all_t") + m)))).cast("long")
    gained = both.join(all_s.hint("broadcast")).join(all_t.hint("broadcast")).select("range", "bucket", gain.alias("gain"))  # one row each
    return gained.groupBy("range").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "gain"))).alias("gain_of")).select("range", F.transform(F.sequence(F.lit(0), F.lit(_WIDTH - 1)), lambda b: F.coalesce(F.col("gain_of")[b], F.lit(0))).alias("gains"))


def contributions(stored_postings: DataFrame, gains: DataFrame) -> DataFrame:
    """key, part: what each range of buckets hands over to each of its documents. Gains are of a proven size, and are broadcast."""

    def run(batches):
        for b in batches:
            keys, parts = [], []
            for names, data, size, gain in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3)):
                lists, places, counts = unpack(data, size)
                each = np.repeat(gain.values.to_numpy(), lists) * counts
                keys.append(names)
                parts.append(np.bincount(places, each, len(names) // 16).astype(np.int64))  # whole numbers far below 2 to the 53
            if keys:
                joined = b"".join(keys)
                names = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(joined) // 16, [None, pa.py_buffer(joined)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([names, pa.array(np.concatenate(parts))], ["key", "part"])

    met = stored_postings.filter("range >= 0").select("range", "keys", "postings", "size").join(F.broadcast(gains), "range")
    return met.select("keys", "postings", "size", "gains").mapInArrow(run, "key binary, part long")


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 times a Gumbel number) of the seed and id; a null id counts as the empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` (with key and copies) with rank, a row for each copy: 1, 2, 3... by score from the highest, ties to smaller
    doc_id, for share percent of the rows of enough words; null for all others. Null ids come last of a tie.

    Rows are dealt into cells by approximate quantiles of the score, which bound the cells' sizes alone: ranks come of exact
    counts, of the cells before and then within each cell.
    """
    able = F.col("n_words") >= least_words
    n = scored.filter(able).agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    drawn = share * n // 100
    steps = max(1, min(5000, n // CELL))
    edges = []
    if parts := [i / steps for i in range(1, steps) if i / steps > 0.99 - share / 100 - 1 / steps]:  # what is drawn lies above
        edges = sorted(set(scored.filter(able).agg(F.percentile_approx("score", parts, max(10_000, 10 * steps))).first()[0]))
    cell = F.lit(0)  # the highest
    if edges:
        above = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e > F.col("score")))
        cell = F.when(F.col("score") < edges[0], len(edges)).otherwise(above)
    celled = scored.withColumn("cell", F.when(able, cell))
    sizes = {r["cell"]: r["n"] for r in celled.filter(able).groupBy("cell").agg(F.sum("copies").alias("n")).collect()}  # one row a cell
    before, so_far = [], 0
    for c in sorted(sizes):
        if so_far < drawn:
            before.append((c, so_far))
        so_far += sizes[c]
    starts = F.broadcast(scored.sparkSession.createDataFrame(before, "cell int, before long"))
    order = Window.partitionBy("cell").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "key").rowsBetween(Window.unboundedPreceding, -1)
    top = celled.join(starts, "cell").withColumn("first", F.col("before") + F.coalesce(F.sum("copies").over(order), F.lit(0))).drop("before")
    rest = celled.join(starts.select("cell"), "cell", "left_anti").withColumn("first", F.lit(None).cast("long"))
    each = top.unionByName(rest).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    rank = F.col("first") + F.col("copy")
    return each.withColumn("rank", F.when(rank <= drawn, rank)).drop("cell", "first", "copy", "copies")


def resample(docs: DataFrame, target: DataFrame, seed: int = 42, share: int = SHARE) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document.

    Null and empty texts have no features and weight 0; an empty corpus gives no rows, an empty target has no features. Rows that
    repeat an id and a text count as often in the corpus, and share their contributions. Other columns are not looked at.
    """
    of_docs = stored(docs, "postings")
    of_target = materialize(bucket_totals(postings(target.select(F.lit(None).cast("long").alias("doc_id"), "text"))), "target-totals")
    of_corpus = materialize(bucket_totals(of_docs), "corpus-totals")
    gains = materialize(bucket_gains(of_corpus, of_target), "gains")
    header = of_docs.filter("range = -1").select(F.explode("docs").alias("d")).select("d.*")
    weights = contributions(of_docs, gains).groupBy("key").agg(F.sum("part").alias("total"))
    per_key = header.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.first("n_features").alias("n_features"))
    one = per_key.join(weights, "key", "left").withColumn("weight", F.expr("coalesce(total, 0L) div copies"))  # copies have handed over the same each
    scored = one.select("key", "copies", "doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"))
    scored = materialize(scored, "scored")
    discard(of_docs, of_target, of_corpus, gains)
    return ranked(scored, share).select("doc_id", "n_features", "weight", "score", "rank")
