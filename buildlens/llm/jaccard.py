"""Jaccard join of word-shingle sets by PartEnum signatures.

Sets are put in bands of like size. Two sets of a band, or of neighbouring bands, that are similar enough differ in at most
k elements. The domain of shingles is cut into more than k parts, so some part holds the same elements of both. A
signature is a part's number and content; sets that share one are candidates, which are then compared exactly.
"""

from __future__ import annotations

import math
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from buildlens.llm.common import discard, doc_key, materialize
from buildlens.llm.components import connected_components

WORDS = 5
#: Link: 100 * intersection >= SHARE * union.
SHARE = 75
#: Signatures of a bucket, on average; a task holds one bucket at a time.
BUCKET = 1_500_000
#: Signatures gathered before a task hands them on.
FLUSH = 2_000_000
#: Candidates name a set by this many high bits of its id. Sets that share them come in together, and cost time alone.
NAME_BITS = 40
#: Sets that share a signature are all paired up to this many; larger groups are compared in blocks.
FEW = 8
BLOCK = 4096
#: Sets of a group in a row, at most.
PART = 4096
#: A set is compared with so many partners first; the others follow where that left components apart.
PARTNERS = 3
#: Keys of candidates are broadcast up to so many, some 30 bytes each; beyond, documents are joined by a shuffle.
BROADCAST_KEYS = 1_000_000

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_GAP = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2 to the 64, and of its inverse."""
    with np.errstate(over="ignore"):
        inverse = U(pow(int(_BASE), -1, 1 << 64))
        return np.cumprod(np.r_[U(1), np.full(n, _BASE)]), np.cumprod(np.r_[U(1), np.full(n, inverse)])


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of lower-cased UTF-8: cut at the six white-space bytes."""
    b = np.frombuffer(data, np.uint8)
    gap = _GAP[b]
    edge = np.flatnonzero(np.diff(np.r_[True, gap, True].astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(1 << max(16, (len(b)).bit_length()))
    total = np.r_[U(0), np.cumsum(_BYTE[b] * power[: len(b)])]
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: str | None) -> np.ndarray:
    """Ascending 64-bit hashes of the distinct 5-word shingles; fewer words: of the whole sequence; no words: none."""
    w = word_hashes(text.encode("utf-8", "replace").lower()) if text else np.zeros(0, np.uint64)
    n = min(WORDS, len(w))
    if not n:
        return w
    h = np.full(len(w) - n + 1, U(n))
    for i in range(n):  # words are mixed already, so a polynomial of them will do
        h = h * U(0x9FB21C651E98DF25) + w[i : len(w) - n + 1 + i]
    return np.unique(mix(h))


def set_id(s: np.ndarray) -> int:
    """One number for equal sets."""
    return int(mix(np.array([mix(s).sum(dtype=np.uint64) + U(len(s))]))[0].astype(np.int64))


def most_difference(total: int) -> int:
    """The most elements in which two linked sets of so many elements together can differ; negative if none can be linked."""
    return total - 2 * -(-SHARE * total // (100 + SHARE))


@lru_cache(1)
def bands() -> list[tuple[int, int, int]]:
    """(smallest size, largest size, most difference) of each band, up to sizes of 10**9; a band's largest size is the most that its smallest can be linked with."""
    out, low = [], 1
    while low < 10**9:
        high = low * 100 // SHARE
        out.append((low, high, max(most_difference(t) for t in range(max(2, 2 * high - 14), 2 * high + 1))))
        low = high + 1
    return out


@lru_cache(4096)
def band_of(size: int) -> int:
    return next(i for i, (_, high, _) in enumerate(bands()) if size <= high)


def _parts(s: np.ndarray, mixed: np.ndarray, tag: int, variant: int, parts: int) -> np.ndarray:
    """A signature for each part of the domain that holds elements of the set."""
    part = ((s >> U(32)) * U(parts)) >> U(32)
    starts = np.r_[0, 1 + np.flatnonzero(part[1:] != part[:-1])]
    content = np.add.reduceat(mixed, starts)
    return mix(content + mix(part[starts] * U(4 * len(bands())) + U(4 * tag + variant)))


def tags_of(n: int) -> list[tuple[int, int]]:
    """The bands that a set of this size has signatures in, its own and, as the smaller of two, the next; and the most
    elements in which it can differ there from a set that it is linked with."""
    own, out = band_of(n), []
    for tag in (own, own + 1):
        largest = min(bands()[tag][1], n * 100 // SHARE)
        if largest >= bands()[tag][0]:
            out.append((tag, max(most_difference(n + b) for b in range(max(1, largest - 7), largest + 1))))
    return out


def parts_of(tag: int) -> int:
    k = bands()[tag][2]
    return math.ceil(1.15 * (k + 1)) + (4 if k else 0)


def signatures(s: np.ndarray) -> np.ndarray:
    """Signatures of a set in its own band and, as the smaller of two, in the next.

    Of k differing elements each spoils one part. A set with more than k parts that hold elements has one which every
    linked set holds too. Should a set have fewer, it adds the signatures of a finer cut, and if these are too few also
    one that all such sets of the band share: two sets that both have too few parts meet there.
    """
    mixed, out = mix(s), []
    for tag, most in tags_of(len(s)):
        found = _parts(s, mixed, tag, 0, parts_of(tag))
        out.append(found)
        if len(found) <= most:
            found = _parts(s, mixed, tag, 1, 4 * bands()[tag][2] + 16)
            out.append(found)
            if len(found) <= most:
                out.append(mix(np.array([4 * tag + 2], np.uint64)))
    return np.concatenate(out)


def slack_of(s: np.ndarray) -> int:
    """How many signatures a set shares at least with every set that it is linked with: in each band, its parts that hold
    elements, less those that differences can spoil; 1 at least, by the way that ``signatures`` makes up for too few."""
    return max(1, min(len(np.unique(((s >> U(32)) * U(parts_of(tag))) >> U(32))) - most for tag, most in tags_of(len(s))))


def odd_sketch(s: np.ndarray) -> bytes:
    """Parity of the elements' count in each cell, a power of two of cells, two to four times the elements, 64 at least.

    A cell is the hash's low bits, so halving a sketch by exclusive or gives that of half as many cells. Two sets'
    sketches of one size differ in no more bits than the sets in elements.
    """
    bits = max(64, 2 << int(len(s) - 1).bit_length())
    odd = np.bincount((s & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, all of the least size among them."""
    least = min(map(len, sketches))
    out = np.empty((len(sketches), least // 8), np.uint64)
    for i, x in enumerate(sketches):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, least // 8), axis=0)
    return out


def most_differences(total: np.ndarray) -> np.ndarray:
    return total - 2 * -(-SHARE * total // (100 + SHARE))


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id, key (tells rows of other id or text apart), n, h (the set's id), slack, sketch of every document."""

    def run(batches):
        for b in batches:
            n, h, slack, sketch = [], [], [], []
            for t in b.column(2).to_pylist():
                s = shingle_set(t)
                n.append(len(s))
                h.append(set_id(s) if len(s) else 0)
                slack.append(slack_of(s) if len(s) else 0)
                sketch.append(odd_sketch(s) if len(s) else b"")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(h, pa.int64()), pa.array(slack, pa.int64()), pa.array(sketch, pa.binary())], ["doc_id", "key", "n", "h", "slack", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc_key().alias("key"), "text").mapInArrow(run, "doc_id long, key binary, n long, h long, slack long, sketch binary")


def name_of(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - NAME_BITS)


def _signature_rows(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, low and high bytes of the sets' names, counts, sigs: signatures packed by bucket, 4 bytes each. A task skips
    sets that it had."""

    def run(batches):
        seen: set[int] = set()
        ids, sigs, size = [], [], 0

        def flush():
            every = np.concatenate(sigs)
            owner = np.repeat(np.arange(len(ids)), [len(x) for x in sigs])
            bucket = ((every >> U(32)) * U(buckets)) >> U(32)
            order = np.argsort(bucket, kind="stable")  # within a bucket still by set
            bucket, owner, low = bucket[order], owner[order], (every[order] & U(0xFFFFFFFF)).astype("<u4")
            names = np.array(ids, "<i8").view("<u8") >> U(64 - NAME_BITS)
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            rows = []
            for a, z in zip(cut, np.r_[cut[1:], len(bucket)]):
                own = owner[a:z]
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                of, count = names[own[first]], np.diff(np.r_[first, len(own)])
                if count.max(initial=0) > 255:  # a row for each 255 signatures of a set
                    of, count = np.repeat(of, -(-count // 255)), np.concatenate([np.r_[np.full((c - 1) // 255, 255), (c - 1) % 255 + 1] for c in count])
                rows.append((int(bucket[a]), of.astype("<u4").tobytes(), (of >> U(32)).astype("u1").tobytes(), count.astype("u1").tobytes(), low[a:z].tobytes()))
            kinds = (pa.int64(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["bucket", "low", "high", "counts", "sigs"])

        for b in batches:
            for t in b.column(0).to_pylist():
                s = shingle_set(t)
                if not len(s) or (h := set_id(s)) in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(h)
                ids.append(h)
                sigs.append(signatures(s))
                size += len(sigs[-1])
                if size >= FLUSH:
                    yield flush()
                    ids, sigs, size = [], [], 0
        if ids:
            yield flush()

    return docs.select("text").mapInArrow(run, "bucket long, low binary, high binary, counts binary, sigs binary")


def _candidates(packed: DataFrame) -> DataFrame:
    """kind 0: sets a < b share n signatures of the bucket, as a small group's pair or as a large one's first and another.
    kind 1: the sets named are a part of a large group, of n sets, the first b, which w signatures of the bucket share; a tells
    groups by their sets.

    A large group is more than a few sets that share a signature. It gives the pairs with its first alone, and its sets once,
    however many signatures just these sets share; so rows are never more than a small multiple of the signatures.
    """

    def run(table: pa.Table) -> pa.Table:
        column = lambda name, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table[name]])
        names = column("low", "<u4").astype(np.int64) | column("high", "u1").astype(np.int64) << 32
        ids = np.repeat(names, column("counts", "u1"))
        sigs = column("sigs", "<u4")
        order = np.lexsort((ids, sigs))
        ids, sigs = ids[order], sigs[order]
        once = np.r_[True, (sigs[1:] != sigs[:-1]) | (ids[1:] != ids[:-1])]
        ids, sigs = ids[once], sigs[once]
        start = np.flatnonzero(np.r_[True, sigs[1:] != sigs[:-1]])
        count = np.diff(np.r_[start, len(sigs)])
        place, many = np.arange(len(ids)) - np.repeat(start, count), np.repeat(count, count)
        pairs = []
        for gap in range(1, FEW):  # ids ascend within a group
            at = np.flatnonzero((place >= gap) & (many <= FEW))
            pairs.append(np.stack([ids[at - gap], ids[at]], 1))
        at = np.flatnonzero((many > FEW) & (place > 0))
        pairs.append(np.stack([ids[at - place[at]], ids[at]], 1))
        pair, n = np.unique(np.concatenate(pairs), axis=0, return_counts=True)
        large = np.flatnonzero(count > FEW)
        tells = mix(np.add.reduceat(mix(ids.astype(np.uint64)), start)[large] + count[large].astype(np.uint64)) if len(large) else np.zeros(0, np.uint64)
        tells, first, weight = np.unique(tells, return_index=True, return_counts=True)
        groups = [(g, int(ids[s]), int(c), w, k, ids[s + k : s + min(k + PART, c)]) for g, s, c, w in zip(tells.astype(np.int64).tolist(), start[large[first]], count[large[first]], weight.tolist()) for k in range(0, int(c), PART)]
        parts = pa.ListArray.from_arrays(pa.array(np.cumsum([0] * (len(pair) + 1) + [len(x[5]) for x in groups]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *[x[5] for x in groups]])))
        numbers = [np.r_[mine, np.array([x[i] for x in groups], np.int64)] for i, mine in enumerate((pair[:, 0], pair[:, 1], n, np.zeros(len(pair), np.int64), np.zeros(len(pair), np.int64)))]
        kind = np.r_[np.zeros(len(pair), np.int32), np.ones(len(groups), np.int32)]
        return pa.table([pa.array(kind), *map(pa.array, numbers), parts], ["kind", "a", "b", "n", "w", "part", "names"])

    return packed.groupBy("bucket").applyInArrow(run, "kind int, a long, b long, n long, w long, part long, names array<long>")


def _members(found: DataFrame) -> DataFrame:
    """g, name, n, w of each set of each large group: n sets, which w signatures of all buckets share."""
    groups = found.filter("kind = 1").groupBy("a", "b", "n", "part").agg(F.sum("w").alias("w"), F.first("names").alias("names"))
    return groups.select(F.xxhash64("a", "b", "n").alias("g"), "n", "w", F.explode("names").alias("name"))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < SHARE * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum())
    return 100 * common >= SHARE * (len(a) + len(b) - common)


def _texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """h, text of a document of each of these sets (key, h). Texts are cheaper to move than elements, which do not compress."""
    n = keys.count()
    return docs.select(doc_key().alias("key"), "text").join(F.broadcast(keys) if n <= BROADCAST_KEYS else keys, "key").select("h", "text").dropDuplicates(["h"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The linked ones of distinct pairs (a, b).

    b's text travels to a's. An a with many partners is dealt over several tasks, each with its own copy of a's text.
    """
    per = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 256).cast("int").alias("salts"))
    dealt = pairs.join(per, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    right = dealt.join(texts.withColumnRenamed("h", "b"), "b")
    left = per.join(texts.withColumnRenamed("h", "a"), "a").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select(F.col("a").alias("a1"), F.col("salt").alias("salt1"), F.col("text").alias("text1"))

    def run(one: pa.Table, many: pa.Table) -> pa.Table:
        keep = []
        if one.num_rows and many.num_rows:
            a = shingle_set(one["text1"][0].as_py())
            keep = [i for i, x in enumerate(many["text"]) if linked(a, shingle_set(x.as_py()))]
        return many.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return left.groupBy("a1", "salt1").cogroup(right.select("a", "salt", "b", "text").groupBy("a", "salt")).applyInArrow(run, "a long, b long")


def _near(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs of names (a, b, n) as pairs of set ids, but for those whose sizes and sketches rule a link out."""
    one, two = (sketches.select(name_of(F.col("h")).alias(x), F.col("h").alias(f"h_{x}"), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")) for x in "ab")

    def run(batches):
        for t in batches:
            most = most_differences(t.column("n_a").to_numpy() + t.column("n_b").to_numpy())
            differ = [int(np.bitwise_count(x[0] ^ x[1]).sum()) for x in map(lambda p: folded(list(p)), zip(t.column("s_a").to_pylist(), t.column("s_b").to_pylist()))]
            near = t.filter(pa.array((np.array(differ, np.int64) <= most) & (t.column("h_a").to_numpy() != t.column("h_b").to_numpy())))
            yield pa.RecordBatch.from_arrays([near.column(c) for c in ("h_a", "h_b", "n")], ["a", "b", "n"])

    return pairs.join(one, "a").join(two, "b").select("h_a", "h_b", "n", "n_a", "s_a", "n_b", "s_b").mapInArrow(run, "a long, b long, n long")


def near_pairs(ids: np.ndarray, sizes: np.ndarray, component: np.ndarray, block: np.ndarray, sketches: list[bytes], most: int) -> np.ndarray | None:
    """Pairs across components whose sketches do not rule a link out; of two blocks, those across blocks alone. None if
    they are more than ``most``."""
    words, two, out, found = folded(sketches), len(np.unique(block)) == 2, [np.zeros((0, 2), np.int64)], 0
    for i in range(len(ids) - 1):
        after = i + 1 + np.flatnonzero(component[i + 1 :] != component[i])
        if two:
            after = after[block[after] != block[i]]
        if len(after):
            near = after[np.bitwise_count(words[after] ^ words[i]).sum(1) <= most_differences(sizes[after] + sizes[i])]
            found += len(near)
            if found > most:
                return None
            out.append(np.stack([np.minimum(ids[near], ids[i]), np.maximum(ids[near], ids[i])], 1))
    return np.concatenate(out)


def spanning_links(ids: np.ndarray, sizes: np.ndarray, component: np.ndarray, block: np.ndarray, sketches: list[bytes], texts: list[str]) -> np.ndarray:
    """Links, compared exactly, that join the same components as all links across blocks do (of one block: all links)."""
    words, two, out = folded(sketches), len(np.unique(block)) == 2, [np.zeros((0, 2), np.int64)]
    sets: list[np.ndarray | None] = [None] * len(ids)
    of = np.unique(component, return_inverse=True)[1]

    def elements(i: int) -> np.ndarray:
        if sets[i] is None:
            sets[i] = shingle_set(texts[i])
        return sets[i]

    for i in range(len(ids) - 1):
        after = i + 1 + np.flatnonzero(of[i + 1 :] != of[i])
        if two:
            after = after[block[after] != block[i]]
        for j in after[np.bitwise_count(words[after] ^ words[i]).sum(1) <= most_differences(sizes[after] + sizes[i])].tolist():
            if of[i] != of[j] and linked(elements(i), elements(j)):
                out.append(np.array([[min(ids[i], ids[j]), max(ids[i], ids[j])]]))
                of[of == of[j]] = of[i]
    return np.concatenate(out)


def _possible(pairs: DataFrame, bounds: DataFrame) -> DataFrame:
    """Pairs (a, b, n) that may be linked: linked sets share as many signatures as the slack of either, and a pair shares no more
    than n, which its small groups gave, and those of its large groups. bounds: name, slack, large."""
    one, two = (bounds.select(F.col("name").alias(x), F.col("slack").alias(f"slack_{x}"), F.col("large").alias(f"large_{x}")) for x in "ab")
    met = pairs.join(one, "a").join(two, "b")
    return met.filter(F.col("n") + F.least("large_a", "large_b") >= F.greatest("slack_a", "slack_b")).select("a", "b", "n")


def _without_hottest(members: DataFrame) -> DataFrame:
    """Members (g, name, h, slack, n, w) without each set's hottest large groups, which stand for fewer signatures together than
    its slack. No link is lost.

    Linked sets share as many signatures as the slack of either, and of a group all that it stands for. The smallest group
    that they share is none that either leaves out: it would have left out all others that they share first.
    """
    hottest = Window.partitionBy("name", "h").orderBy(F.desc("n"), "g").rowsBetween(Window.unboundedPreceding, 0)
    return members.withColumn("so_far", F.sum("w").over(hottest)).filter(F.col("so_far") >= F.col("slack"))


def _blocks(members: DataFrame) -> DataFrame:
    """Groups (g, h, component) that reach across components, dealt as pairs of blocks (g, one, two) of some thousand sets.

    A group's main component, that of most of its sets, needs no comparing within. All other sets, the strays, meet each
    other and the main ones: block ``one`` is of strays, ``two`` of strays (from 0) or of main ones (below 0). So a large
    group of copies that are linked already costs a row for each, and each pair of blocks is one task's. A group that fits
    into one block is that block, with a row for each set. Copies share hundreds of groups: those in which one main component
    has half of the sets at least are taken together.
    """
    per = members.groupBy("g", "component").agg(F.count(F.lit(1)).alias("n"))
    groups = per.groupBy("g").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("m")).filter("m > main.n")
    together = F.when(2 * F.col("main.n") >= F.col("m"), F.xxhash64(F.lit("main"), F.col("main.component"))).otherwise(F.col("g"))
    groups = groups.select("g", F.col("main.component").alias("main"), together.alias("key"))
    df = members.join(groups, "g").select(F.col("key").alias("g"), "h", "component", "main").distinct()
    stray = F.col("component") != F.col("main")
    count = lambda c: F.greatest(F.lit(1), F.ceil(F.count_if(c) / BLOCK)).cast("int")
    df = df.join(df.groupBy("g").agg(count(stray).alias("strays"), count(~stray).alias("mains"), (F.count(F.lit(1)) <= BLOCK).alias("one_block")), "g")
    block = F.when(F.col("one_block"), 0).when(stray, F.pmod(F.xxhash64("h"), F.col("strays")).cast("int")).otherwise(-1 - F.pmod(F.xxhash64("h"), F.col("mains")).cast("int"))
    other = F.when(F.col("one_block"), F.array(F.lit(0))).when(stray, F.expr("sequence(-mains, strays - 1)")).otherwise(F.expr("sequence(0, strays - 1)"))
    df = df.select("g", "h", "component", block.alias("block"), F.explode(other).alias("other"))
    one = F.when(F.least("block", "other") < 0, F.greatest("block", "other")).otherwise(F.least("block", "other"))
    two = F.when(F.least("block", "other") < 0, F.least("block", "other")).otherwise(F.greatest("block", "other"))
    return df.select("g", "h", "component", "block", one.alias("one"), two.alias("two"))


def _group_pairs(dealt: DataFrame, sketches: DataFrame) -> DataFrame:
    """Near pairs (a, b) across components of each pair of blocks, with null g; or, where they are more than the sets are,
    g, one, two of the blocks, which are to be compared exactly then and there."""

    def run(t: pa.Table) -> pa.Table:
        found = np.zeros((0, 2), np.int64)
        if t.num_rows:
            found = near_pairs(*[t[c].to_numpy() for c in ("h", "n", "component", "block")], t["sketch"].to_pylist(), t.num_rows)
            if found is None:
                return pa.table([t[c].slice(0, 1) for c in ("g", "one", "two")] + [pa.nulls(1, pa.int64())] * 2, ["g", "one", "two", "a", "b"])
        none = lambda kind: pa.nulls(len(found), kind)
        return pa.table([none(pa.int64()), none(pa.int32()), none(pa.int32()), pa.array(found[:, 0]), pa.array(found[:, 1])], ["g", "one", "two", "a", "b"])

    return dealt.join(sketches, "h").groupBy("g", "one", "two").applyInArrow(run, "g long, one int, two int, a long, b long")


def _block_links(dealt: DataFrame, sketches: DataFrame, texts: DataFrame) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        found = np.zeros((0, 2), np.int64)
        if t.num_rows:
            found = spanning_links(*[t[c].to_numpy() for c in ("h", "n", "component", "block")], t["sketch"].to_pylist(), t["text"].to_pylist())
        return pa.table([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return dealt.join(sketches, "h").join(texts, "h").groupBy("g", "one", "two").applyInArrow(run, "a long, b long")


def set_components(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """h, component for every set that is linked with another; sets: as ``_sets`` gives.

    Candidates are thinned by sketches, which never rule out a link. Then each set is compared with a few partners, those
    it shares most signatures with, which joins most copies to what they were copied from; the pairs and large groups that
    still reach across components follow in full.
    """
    spark = docs.sparkSession
    total = sets.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(0.9 * total / BUCKET))
    found = materialize(_candidates(_signature_rows(docs, buckets)), "candidates")
    one_key = materialize(sets.filter("n > 0").groupBy("h").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("slack").alias("slack"), F.first("sketch").alias("sketch")), "one-each")
    sketches = one_key.select("h", "n", "sketch")

    def texts_of(ids: DataFrame) -> DataFrame:
        return materialize(_texts(docs, one_key.join(ids.distinct(), "h", "left_semi").select("key", "h")), "texts")

    def of_pairs(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("h"))

    in_large = materialize(_members(found), "in-large")
    least = one_key.groupBy(name_of(F.col("h")).alias("name")).agg(F.min("slack").alias("slack"))
    bounds = least.join(in_large.groupBy("name").agg(F.sum("w").alias("large")), "name", "left").withColumn("large", F.coalesce("large", F.lit(0)))
    bounds = materialize(bounds, "bounds")
    pairs = materialize(_near(_possible(found.filter("kind = 0").groupBy("a", "b").agg(F.sum("n").alias("n")), bounds), sketches), "pairs")
    discard(found, bounds)
    other = pairs.select(F.col("a").alias("x"), "*").unionByName(pairs.select(F.col("b").alias("x"), "*"))
    best = Window.partitionBy("x").orderBy(F.desc("n"), "a", "b")
    chosen = other.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= PARTNERS)
    some = materialize(chosen.select("a", "b").distinct(), "chosen")
    texts = texts_of(of_pairs(some))
    first = connected_components(_verified(some, texts))
    label = materialize(first, "components")
    discard(texts, first)

    def labelled(df: DataFrame, name: str, out: str) -> DataFrame:
        return df.join(label.select(F.col("node").alias(name), F.col("component").alias(out)), name, "left").withColumn(out, F.coalesce(out, name))

    across = labelled(labelled(pairs.select("a", "b").join(some, ["a", "b"], "left_anti"), "a", "ca"), "b", "cb").filter("ca <> cb").select("a", "b")
    members = in_large
    names = labelled(one_key.select(name_of(F.col("h")).alias("name"), "h", "slack"), "h", "component")
    members = materialize(_without_hottest(members.join(names, "name")).select("g", "h", "component"), "members")
    dealt = materialize(_blocks(members), "dealt")
    within = materialize(_group_pairs(dealt, sketches), "within")
    rest = materialize(across.union(within.filter("g is null").select("a", "b")).distinct().join(some, ["a", "b"], "left_anti"), "rest")
    rest_texts = texts_of(of_pairs(rest))
    more = [_verified(rest, rest_texts)]
    held = [rest_texts]
    dense = within.filter("g is not null").select("g", "one", "two")
    if dense.limit(1).count():
        compact = materialize(dealt.join(dense, ["g", "one", "two"], "left_semi"), "dense")
        held += [compact, texts_of(compact.select("h"))]
        more.append(_block_links(compact, sketches, held[-1]))
    stars = label.select(F.col("node").alias("a"), F.col("component").alias("b"))  # as good as the links that they come from
    joined = connected_components(reduce(DataFrame.union, more, stars))
    out = joined.select(F.col("node").alias("h"), "component")
    out._written_at = joined._written_at
    discard(one_key, in_large, pairs, some, label, members, dealt, within, rest, *held)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Documents without words have no shingles and are their own component. Equal sets are one node of the graph, whatever
    the number of copies; rows that repeat a doc_id get one row each. A null doc_id is never the smallest of a component;
    a component of such alone has a null id.
    """
    sets = materialize(_sets(docs), "sets")
    label = set_components(docs, sets)
    by_set = sets.filter("n > 0").groupBy("h").agg(F.min("doc_id").alias("least")).join(label, "h", "left").withColumn("component", F.coalesce("component", "h"))
    smallest = by_set.groupBy("component").agg(F.min("least").alias("component_id"))
    named = by_set.join(smallest, "component").select("h", "component_id")
    out = sets.join(named, "h", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def redundant_keys(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys (of id and text, as ``_sets`` gives) whose rows a corpus of one document a group drops, and the other keys
    that stand on more than one row, of which one row stays.

    Of a component the row of smallest doc_id stays, null after all others, and of these that of smallest key. Rows
    without words are in no group; such of equal id and text are one document, unless the id is null.
    """
    sets = materialize(_sets(docs), "sets")
    label = set_components(docs, sets)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("first")
    by_set = sets.filter("n > 0").groupBy("h").agg(first).join(label, "h", "left").withColumn("component", F.coalesce("component", "h"))
    best = by_set.groupBy("component").agg(F.min("first").alias("first"))
    named = by_set.drop("first").join(best, "component").select("h", F.col("first.key").alias("stays"))
    others = materialize(sets.filter("n > 0").join(named, "h").filter("key <> stays").select("key").distinct(), "others")
    many = sets.filter("n > 0 or doc_id is not null").groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("key")
    repeated = materialize(many.join(others, "key", "left_anti"), "repeated")
    discard(sets, label)
    return others, repeated
