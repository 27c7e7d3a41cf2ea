"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.llm.common import discard, materialize


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node), for every node of links (a, b: long).

    Each round hangs larger neighbours, then smaller ones, under the least node known; it ends when no edge changes. Edges
    never grow in number, and every round's are written to the shared folder, so a lost executor costs one round. Nodes
    of many edges are joined with one row each, which Spark can split.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    before = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = _least(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        was, edges = edges, materialize(small.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "links")
        discard(was)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v")).distinct()
    out._written_at = edges._written_at  # so that it can be given up
    return out
