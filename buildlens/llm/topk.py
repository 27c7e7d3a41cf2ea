"""Exact top-k by inner product with multi-resolution segment statistics."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from buildlens.llm.common import materialize

#: Segments of a vector at each level, coarse to fine; a level with more segments than components is left out.
LEVELS = (1, 4, 16)
#: Most rows of a block of candidates and of a block of queries: what one task holds at a time, whatever the table's size. The
#: larger the blocks, the fewer copies of a vector are shipped. A small table has blocks of LEAST_ROWS candidates at least.
CANDIDATE_ROWS, QUERY_ROWS, LEAST_ROWS, STEP = 65_536, 32_768, 4_096, 128


def quantised(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vec: each component x as floor(256 * x). Vectors null, empty, or with null or non-finite components are left out; so are rows with a null id. Rows that repeat id and vector count once."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(fine).select("id", F.transform("v", lambda x: F.floor(x * 256)).alias("vec")).distinct()


def segment_features(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, times the root of a segment's length.

    The product of two rows bounds the vectors' inner product from above, hence their distance from below: within a
    segment, sum(q * x) = n * mean * mean + sum of products of deviations, which Cauchy-Schwarz bounds.
    """
    cuts = np.linspace(0, x.shape[1], segments + 1).astype(int)
    parts = [x[:, a:b] for a, b in zip(cuts, cuts[1:])]
    root = np.sqrt(np.diff(cuts))
    return np.hstack([np.stack([p.mean(1) for p in parts], 1) * root, np.stack([p.std(1) for p in parts], 1) * root])


def block_top_k(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int) -> tuple[list, list, list]:
    """(query place, candidate id, score) of the k best candidates of each query; ties to smaller ids; a query's own row is left out."""
    d = x.shape[1]
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * d < 2**53
    qf, xf = q.astype(np.float64), x.astype(np.float64)
    dot = (lambda rows, v: (xf[rows] @ v).astype(np.int64)) if exact else (lambda rows, v: x[rows] @ v.astype(np.int64))
    levels = [n for n in LEVELS if n <= d]
    x_at = [segment_features(xf, n) for n in levels]
    out: tuple[list, list, list] = ([], [], [])
    for at in range(0, len(q), STEP):
        part = slice(at, at + STEP)
        q_at = [segment_features(qf[part], n) for n in levels]
        size = np.linalg.norm(qf[part], axis=1)[:, None] * np.linalg.norm(xf, axis=1)[None] * 1e-9 + 1e-6  # rounding
        bound = q_at[0] @ x_at[0].T + size
        own = q_ids[part][:, None] == x_ids[None]
        first = min(len(x), 8 * k + 8)
        likely = np.argpartition(-bound, first - 1, axis=1)[:, :first]
        least = np.full(len(bound), -np.inf)  # the k-th best score known so far
        for r in range(len(bound)):
            scores = dot(likely[r], q[at + r])[~own[r, likely[r]]]
            if len(scores) >= k:
                least[r] = np.partition(scores, -k)[-k]
        alive = (bound >= least[:, None]) & ~own
        for qa, xa in zip(q_at[1:], x_at[1:]):
            columns = np.flatnonzero(alive.any(0))
            alive[:, columns] &= qa @ xa[columns].T + size[:, columns] >= least[:, None]
        for r in range(len(bound)):
            rows = np.flatnonzero(alive[r])
            scores = dot(rows, q[at + r])
            best = np.lexsort((x_ids[rows], -scores))[:k]
            out[0].extend([at + r] * len(best))
            out[1].extend(x_ids[rows[best]].tolist())
            out[2].extend(scores[best].tolist())
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k vectors with the highest inner product for each query.

    vectors, queries: (id, vec) as ``quantised`` gives; vectors of another length than the query's are no candidates. The
    stated queries meet all rows in blocks: a task holds one block of each, so the queries are never broadcast. Fewer
    candidates than k: all. No queries or no candidates: no rows.
    """
    n = vectors.count()
    n_chunks = max(1, math.ceil(n / CANDIDATE_ROWS), min(n // LEAST_ROWS, vectors.sparkSession.sparkContext.defaultParallelism))
    n_blocks = max(1, math.ceil(queries.count() / QUERY_ROWS))
    dim = F.size("vec").alias("dim")
    chunk, block = F.pmod(F.xxhash64("id", "vec"), F.lit(n_chunks)), F.pmod(F.xxhash64("id", "vec"), F.lit(n_blocks))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    x = vectors.select("id", "vec", dim, chunk.cast("int").alias("chunk"), every(n_blocks).alias("block"))
    q = queries.select("id", "vec", dim, every(n_chunks).alias("chunk"), block.cast("int").alias("block"), F.xxhash64("id", "vec").alias("row"))

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        d = key[0].as_py()
        whole = lambda t: t["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        at, ids, scores = [], [], []
        if left.num_rows and right.num_rows:
            at, ids, scores = block_top_k(left["id"].to_numpy(), whole(left), right["id"].to_numpy(), whole(right), k)
        return pa.table({"query_id": left["id"].take(pa.array(at, pa.int64())), "row": left["row"].take(pa.array(at, pa.int64())), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.int64())})

    met = q.groupBy("dim", "chunk", "block").cogroup(x.groupBy("dim", "chunk", "block")).applyInArrow(meet, "query_id long, row long, vec_id long, score long")
    best = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_embeddings(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row whose vec_id is divisible by ``every``.

    Vectors that are null or hold null or non-finite components, and rows with a null id, take no part. Rows that repeat id
    and vector count once; of an id with several vectors each is a row, and none is a candidate of another. Ties go to the
    smaller id. Other columns are not looked at; an empty table gives no rows.
    """
    vectors = materialize(quantised(embeddings, "vec_id", "embedding"), "vectors")
    return top_k(vectors, vectors.filter(F.pmod(F.col("id"), F.lit(every)) == 0), k)


ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.e, x.e)::BIGINT AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
) WHERE rank <= 5
"""
