"""Consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import bisect
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: The ring has this many cells; a key's cell is the high half of its 32-bit hash.
CELLS = 1 << 16


def ring_owners(n_shards: int, vnodes: int = 128) -> list[int]:
    """The shard that owns each cell: that of the first virtual node at or after it, clockwise.

    Two virtual nodes that meet in one cell: the smaller shard keeps it.
    """
    at: dict[int, int] = {}
    for shard in range(n_shards):
        for v in range(vnodes):
            cell = zlib.crc32(f"shard {shard} node {v}".encode()) >> 16
            at[cell] = min(shard, at.get(cell, shard))
    places = sorted(at)
    return [at[places[bisect.bisect_left(places, cell) % len(places)]] for cell in range(CELLS)]


def fill(counts: dict[int, int], n_shards: int, vnodes: int = 128) -> list[tuple[int, int, int, int, int]]:
    """Where the keys of each cell go, when no shard may hold more than its share.

    Shares differ by one row at most. A shard first takes the keys of its own cells, in ring order; what it can't take
    goes on clockwise, to the next shard with room. Returns (cell, first rank, rank after the last, shard, first slot).
    The work is on cell counts, of which there are 65,536, whatever the number of keys.
    """
    total, owners = sum(counts.values()), ring_owners(n_shards, vnodes)
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    used = [0] * n_shards
    out: list[tuple[int, int, int, int, int]] = []

    def give(cell: int, rank: int, n: int, shard: int) -> int:
        take = min(n, room[shard] - used[shard])
        if take:
            out.append((cell, rank, rank + take, shard, used[shard]))
            used[shard] += take
        return take

    over: dict[int, tuple[int, int]] = {}
    for cell in range(CELLS):
        if n := counts.get(cell, 0):
            took = give(cell, 0, n, owners[cell])
            if took < n:
                over[cell] = (took, n - took)
    waiting: list[tuple[int, int, int]] = []
    for step in range(2 * CELLS):
        cell = step % CELLS
        if step < CELLS and cell in over:
            waiting.append((cell, *over[cell]))
        while waiting and used[owners[cell]] < room[owners[cell]]:
            at, rank, n = waiting.pop(0)
            took = give(at, rank, n, owners[cell])
            if took < n:
                waiting.insert(0, (at, rank + took, n - took))
        if step >= CELLS and not waiting:
            break
    return out


def assign_shards(docs: DataFrame, n_shards: int, key: str = "doc_id", order: tuple[Column, ...] = (), vnodes: int = 128) -> DataFrame:
    """``docs`` with ``shard`` and ``slot`` (gapless from 0 in each shard); row counts of shards differ by one at most.

    A row's place on the ring is that of its key together with ``order``, so rows of one key, or without a key, are no hot
    cell unless they are equal in all of these, and then they are interchangeable. Only these columns are read to count the
    cells; then one shuffle, of the columns given, ranks the rows of each cell. An empty table gives no rows. Columns of docs
    named shard or slot are replaced; helper columns have names that no column of docs begins with.
    """
    spark = docs.sparkSession
    p = "_ring_"
    while any(c.startswith(p) for c in docs.columns):
        p = "_" + p
    h = F.pmod(F.xxhash64(F.col(key), *order), F.lit(1 << 32))
    cell = F.shiftright(h, 16)
    counts = {int(r["cell"]): r["n"] for r in docs.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()}
    kind = T.StructType([T.StructField(p + n, T.LongType() if n != "shard" else T.IntegerType()) for n in ("to", "from", "until", "shard", "slot")])
    ranges = spark.createDataFrame(fill(counts, n_shards, vnodes), kind)  # a row for each cell, and for each split of one
    ranked = docs.withColumn(p + "h", h).withColumn(p + "cell", cell)
    ranked = ranked.withColumn(p + "rank", F.row_number().over(Window.partitionBy(p + "cell").orderBy(p + "h", F.col(key), *order)) - 1)
    c = lambda n: F.col(p + n)
    met = ranked.join(F.broadcast(ranges), (c("cell") == c("to")) & (c("rank") >= c("from")) & (c("rank") < c("until")))
    return met.withColumn("shard", c("shard")).withColumn("slot", c("slot") + c("rank") - c("from")).drop(*[p + n for n in ("h", "cell", "rank", "to", "from", "until", "shard", "slot")])


def shard_documents(docs: DataFrame, n_shards: int = 40, vnodes: int = 128) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of all documents, by the law of rows: counts at most one apart.

    A null text has no bytes: size 16, checksum 0. Rows that repeat an id, a text or both have a slot each; rows equal in both
    are interchangeable. Null ids go by their text. An empty table gives no rows, and columns besides are not looked at.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = assign_shards(rows, n_shards, "doc_id", (F.col("text_crc32"), F.col("size")), vnodes)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
