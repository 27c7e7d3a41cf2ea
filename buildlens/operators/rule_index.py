"""Rule libraries of any size: an index of literals that a pattern's matches must hold names the few rules to try on a message."""

from __future__ import annotations

import re
from re import _parser as parser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from buildlens.functions.scratch import written

#: Code points of the pieces that are looked up.
GRAM = 4
#: Rows of an index that are broadcast; a larger one is joined by a shuffle.
AT_HAND = 200_000
KEY = ["kind", "rule_ord", "regex_ord"]
#: What Java reads in another way than the reader of patterns used here: sets within sets, and case beyond ASCII.
OTHER = re.compile(r"&&|\[[^\]]*\[|\(\?[a-z]*u", re.S)


def _covers(seq) -> list[list[str]]:
    """For a sequence of a parsed pattern: lists of literals, of each of which every match holds at least one."""
    out, run = [], ""
    for op, arg in [*seq, (None, None)]:
        if op is parser.LITERAL and 32 <= arg < 127:
            run += chr(arg).lower()
            continue
        if len(run) >= GRAM:
            out.append([run])
        run = ""
        if op in (parser.MAX_REPEAT, parser.MIN_REPEAT, parser.POSSESSIVE_REPEAT) and arg[0] > 0:
            out += _covers(arg[2])
        elif op is parser.SUBPATTERN:
            out += _covers(arg[-1])
        elif op is parser.ATOMIC_GROUP:
            out += _covers(arg)
        elif op is parser.BRANCH:
            best = [max(_covers(way), key=lambda c: min(map(len, c)), default=None) for way in arg[1]]
            if all(best):
                out.append(list(dict.fromkeys(text for cover in best for text in cover)))
    return out


def covers(regex: str | None) -> list[list[str]]:
    """Covers of a pattern in Java's syntax, lower-cased; none if it has none or cannot be read here, so that it is tried on all."""
    if regex is None or OTHER.search(regex):
        return []
    try:
        return _covers(parser.parse(re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", regex)))
    except (re.error, OverflowError, RecursionError):
        return []


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def _covers_of(regex: pd.Series) -> pd.Series:
    return regex.map(covers)


def grams(text) -> F.Column:
    """Distinct pieces of ``GRAM`` code points, lower-cased; found by an empty match at each place, so in linear time."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def index(rules: DataFrame, messages: DataFrame) -> DataFrame:
    """The rules' rows with gram and before: the rarest cover by counts over all messages (kind, message), a row for each of its pieces.

    A rule without cover has one row with a null gram. ``before`` holds the cover's pieces that come first, so that a message which
    holds several meets the rule once.
    """
    lit = rules.select(*KEY, F.posexplode(_covers_of("regex")).alias("cover", "texts")).select(*KEY, "cover", F.posexplode("texts").alias("place", "text"))
    pieces = written(lit.select(*KEY, "cover", "place", F.explode(grams(F.col("text"))).alias("gram")), "rule-pieces")
    asked = pieces.select("kind", "gram").distinct()
    n = messages.select("kind", F.explode(grams(F.col("message"))).alias("gram")).join(asked, ["kind", "gram"], "left_semi").groupBy("kind", "gram").agg(F.count(F.lit(1)).alias("n"))
    rare = pieces.join(n, ["kind", "gram"], "left").groupBy(*KEY, "cover", "place").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
    ways = rare.groupBy(*KEY, "cover").agg(F.sum("least.n").alias("n"), F.array_sort(F.collect_set("least.gram")).alias("grams"))
    best = ways.groupBy(*KEY).agg(F.min_by("grams", F.struct("n", "cover")).alias("grams"))
    rows = rules.join(best, KEY, "left").select("*", F.posexplode_outer("grams").alias("at", "gram"))
    return rows.withColumn("before", F.slice("grams", 1, F.coalesce("at", F.lit(0)))).drop("grams", "at")


def hits(ev: DataFrame, rules: DataFrame) -> DataFrame:
    """Events with each rule of their kind of which a pattern is found and no negative one, as trying every rule gives.

    A null message, or a null pattern, is no hit; without a negative pattern nothing is refused. Events that repeat are hit each.
    Pieces of a message are exploded where it is read and meet an index that is broadcast only up to ``AT_HAND`` rows. A task holds
    the pieces of one message at a time, some 60 bytes a code point.
    """
    held = written(index(rules, ev.select("kind", "message")), "rule-index")
    named, others = held.filter("gram is not null"), held.filter("gram is null").drop("gram", "before")
    if held.count() <= AT_HAND:
        named, others = F.broadcast(named), F.broadcast(others)
    low = F.lower("message")
    found = (F.regexp_instr("message", F.col("regex")) > 0) & (F.coalesce(F.regexp_instr("message", F.col("negative")), F.lit(0)) == 0)
    met = ev.select("*", F.explode(grams(F.col("message"))).alias("gram")).join(named, ["kind", "gram"])
    met = met.filter(F.contains(low, F.col("gram")) & ~F.exists("before", lambda g: F.contains(low, g)) & found)
    out = [*ev.columns, *(c for c in rules.columns if c != "kind")]
    return met.select(*out).unionByName(ev.join(others, "kind").filter(found).select(*out))
