"""Which names end others: an index of reversed names in order, in which those with a common end are neighbours.

No end of a name is spelled out, so rows grow with the names and with what is found, not with the names' lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Stands between reversed segments; lower than any character of a path, so a path comes before what only begins like it.
GAP = "\u0001"
BEHIND = "\u0002"
#: Behind all that begins with a name.
LAST = "\U0010ffff"


def reversed_segments(path: Column) -> Column:
    return F.array_join(F.reverse(F.split(path, "/")), GAP)


def _common(a: Column, b: Column) -> Column:
    """How many segments two reversed paths have in common from the start."""
    x, y = F.split(a, GAP), F.split(b, GAP)
    differs = F.array_position(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), False).cast("int")
    return F.when(b.isNull(), 0).when(differs == 0, F.greatest(F.size(x), F.size(y))).otherwise(differs - 1)


def longest_ends(asks: DataFrame, files: DataFrame) -> DataFrame:
    """root, asked, whole, matches, path: of each path asked for (root, asked, whole), how many files (root, path) have its longest end
    that any file of the root has, and the first of them. If ``whole``, only all of it counts as an end. Asks without one are left out.

    Among reversed paths in order the longest common end is with a neighbour. The files that have it stand together, so they are
    counted by the files before the first and behind the last: one window over each root's files and asks, and one for the counts.
    """
    kinds = {"key": "string", "path": "string", "asked": "string", "whole": "boolean", "side": "int"}

    def rows(df: DataFrame, **given: Column) -> DataFrame:
        return df.select("root", *[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])

    have = rows(files.select("root", "path").distinct(), key=reversed_segments(F.col("path")), path=F.col("path"))
    want = rows(asks.select("root", "asked", "whole").distinct(), key=reversed_segments(F.col("asked")), asked=F.col("asked"), whole=F.col("whole"))
    order = Window.partitionBy("root").orderBy("key", F.col("path").isNull(), "path")
    at = F.when(F.col("path").isNotNull(), F.col("key"))
    near = have.unionByName(want)
    near = near.withColumn("prev", F.last(at, True).over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("next", F.first(at, True).over(order.rowsBetween(1, Window.unboundedFollowing)))
    near = near.filter("asked is not null").withColumn("n", F.greatest(_common(F.col("key"), F.col("prev")), _common(F.col("key"), F.col("next"))))
    segments = F.split("key", GAP)
    near = near.filter((F.col("n") > 0) & (~F.col("whole") | (F.col("n") >= F.size(segments))))
    end = F.array_join(F.slice(segments, F.lit(1), F.col("n")), GAP)
    bounds = near.select("root", "asked", "whole", F.explode(F.array(F.struct(F.lit(0).alias("side"), end.alias("key")), F.struct(F.lit(1).alias("side"), F.concat(end, F.lit(BEHIND)).alias("key")))).alias("b"))
    bounds = rows(bounds, key=F.col("b.key"), asked=F.col("asked"), whole=F.col("whole"), side=F.col("b.side"))
    order = Window.partitionBy("root").orderBy("key", F.coalesce("side", F.lit(2)), "path")  # bounds come before the files of their key
    counted = have.unionByName(bounds).withColumn("files", F.count("path").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    counted = counted.withColumn("first", F.first("path", True).over(order.rowsBetween(1, Window.unboundedFollowing))).filter("asked is not null")
    side = lambda k, c: F.max(F.when(F.col("side") == k, F.col(c)))
    met = counted.groupBy("root", "asked", "whole").agg((side(1, "files") - side(0, "files")).alias("matches"), side(0, "first").alias("path"))
    return met


def ending(names: DataFrame, asks: DataFrame, by: str) -> DataFrame:
    """asks (by, ask, text) with each name (by, name) that their text ends in: by, ask, name.

    Reversed, a name spans all that begins with it, and spans are one inside another. So a text has as many names as spans are
    open where it stands, and the name of each depth is the last one that opened there: one window for depths, one for names.
    """
    opened = names.select(by, F.reverse("name").alias("key"), "name").distinct()
    blank = F.lit(None).cast("string")
    ask = asks.schema["ask"].dataType
    spans = opened.select(by, "key", F.lit(0).alias("turn"), F.lit(1).alias("step"), "name", F.lit(None).cast(ask).alias("ask"))
    ends = opened.select(by, F.concat("key", F.lit(LAST)).alias("key"), F.lit(2).alias("turn"), F.lit(-1).alias("step"), blank.alias("name"), F.lit(None).cast(ask).alias("ask"))
    asked = asks.select(by, F.reverse("text").alias("key"), F.lit(1).alias("turn"), F.lit(0).alias("step"), blank.alias("name"), "ask")
    so_far = Window.partitionBy(by).orderBy("key", "turn").rowsBetween(Window.unboundedPreceding, 0)
    deep = spans.unionByName(ends).unionByName(asked).withColumn("depth", F.sum("step").over(so_far)).filter("turn < 2")
    levels = F.when(F.col("turn") == 0, F.array("depth")).when(F.col("depth") > 0, F.sequence(F.lit(1).cast("long"), "depth"))
    each = deep.withColumn("level", F.explode(levels))
    last = Window.partitionBy(by, "level").orderBy("key", "turn").rowsBetween(Window.unboundedPreceding, 0)
    return each.withColumn("name", F.last("name", True).over(last)).filter("turn = 1").select(by, "ask", "name")
