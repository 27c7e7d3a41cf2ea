"""Benchmark decontamination by a distributed positional inverted index. DataFrame operations only.

Postings are rows (doc key, pos, term). A test item's windows are looked up from their rarest term: its postings, moved by
the term's offset, meet those of the second rarest term; what is left is held word by word against the document.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens.llm.common import doc_key, materialize

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Test vocabulary and anchors are broadcast up to so many rows, of a word and some numbers each; beyond, joins shuffle.
BROADCAST_ROWS = 500_000


def exact_words(text: Column) -> Column:
    """Words of the text with A-Z lower-cased; none for null."""
    return F.coalesce(F.array_remove(F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), GAP), ""), F.array().cast("array<string>"))


def index_words(text: Column) -> Column:
    """As many words, with all letters lower-cased, which is much faster. Equal exact words are equal here, in any context."""
    return F.coalesce(F.array_remove(F.split(F.replace(F.lower(text), F.lit("ς"), F.lit("σ")), GAP), ""), F.array().cast("array<string>"))


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def postings(docs: DataFrame) -> DataFrame:
    """The index: key, pos (from 0), term, a row for each word of every document."""
    return docs.select(doc_key().alias("key"), F.posexplode(index_words(F.col("text"))).alias("pos", "term"))


def item_positions(items: DataFrame) -> DataFrame:
    """item (text of the id; null: empty), words, and per window its first word's place."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), exact_words(F.col("text")).alias("words"), index_words(F.col("text")).alias("terms")).filter(F.size("words") > 0).distinct()
    rows = rows.withColumn("row", F.xxhash64("item", "words"))
    return rows.withColumn("first", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - WINDOW, F.lit(0)))))


def anchors(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """For each window its two rarest terms by their counts over all documents: row, p1, term1, p2, term2 (places in the item).

    Windows that share both give one row. A window with a term that no document has can't occur and gives none.
    A window of one word has that word twice.
    """
    terms = materialize(windows.select("row", "first", F.explode(F.expr(f"transform(slice(terms, first + 1, {WINDOW}), (t, i) -> struct(t as term, first + i as place))")).alias("x")).select("row", "first", "x.term", "x.place"), "terms")
    vocabulary = materialize(terms.select("term").distinct(), "vocabulary")
    known = postings(docs).select("term").join(small(vocabulary, vocabulary.count()), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    known = materialize(known, "counts")
    ranked = terms.join(small(known, known.count()), "term", "left").groupBy("row", "first").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "term"))).alias("by_rarity"))
    one, two = F.col("by_rarity")[0], F.element_at("by_rarity", F.least(F.size("by_rarity"), F.lit(2)))
    return materialize(ranked.filter(one["n"] > 0).select("row", one["place"].alias("p1"), one["term"].alias("term1"), two["place"].alias("p2"), two["term"].alias("term2")).distinct(), "anchors")


def phrase_candidates(docs: DataFrame, anchored: DataFrame) -> DataFrame:
    """key, row, p1, q: where term1 stands at q of a document and term2 at the same distance from it as in the item."""
    n = anchored.count()
    used = materialize(anchored.select(F.explode(F.array("term1", "term2")).alias("term")).distinct(), "anchor-terms")
    lists = materialize(postings(docs).join(small(used, n), "term"), "postings")
    first = lists.join(small(anchored, n), lists["term"] == anchored["term1"]).select("key", F.col("pos").alias("q"), "row", "p1", "term2", (F.col("pos") + F.col("p2") - F.col("p1")).alias("q2"))
    second = lists.select("key", F.col("pos").alias("q2"), F.col("term").alias("term2"))
    return first.join(second, ["key", "q2", "term2"], "left_semi").select("key", "row", "p1", "q").distinct()


def proximity_matches(docs: DataFrame, pairs: DataFrame, within: int) -> DataFrame:
    """Documents in which two terms stand at most ``within`` words apart, in either order.

    pairs: term1, term2. Returns key, term1, term2, pos1, pos2. Postings meet by cells of the document, not all by all.
    """
    pairs = pairs.select("term1", "term2").distinct()
    n = pairs.count()
    lists = postings(docs).join(small(pairs.select(F.explode(F.array("term1", "term2")).alias("term")).distinct(), n), "term")
    one = lists.join(small(pairs, n), lists["term"] == pairs["term1"]).select("key", F.col("pos").alias("pos1"), "term1", "term2")
    one = one.withColumn("cell", F.explode(F.array(*[F.floor(F.col("pos1") / (within + 1)) + i for i in (-1, 0, 1)])))
    two = lists.select("key", F.col("pos").alias("pos2"), F.col("term").alias("term2"), F.floor(F.col("pos") / (within + 1)).alias("cell"))
    return one.join(two, ["key", "term2", "cell"]).filter((F.abs(F.col("pos1") - F.col("pos2")) <= within) & (F.col("pos1") != F.col("pos2"))).select("key", "term1", "term2", "pos1", "pos2")


def contaminated_stretches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """key, runs: per document, the stretches of words that are windows of items: array of (item, start, n).

    A stretch is the longest run of equal words on one alignment of item and document, of ten words at least or the whole
    of an item of fewer: just the union of the windows that occur there.
    """
    windows = materialize(item_positions(items), "windows")
    found = phrase_candidates(docs, anchors(docs, windows))
    words = windows.select("row", "item", "words").distinct()
    found = found.join(words, "row").groupBy("key").agg(F.collect_list(F.struct("item", "words", "p1", "q")).alias("found"))
    held = docs.select(doc_key().alias("key"), "text").join(found, "key").select("key", exact_words(F.col("text")).alias("doc"), "found")
    held = held.withColumn("runs", F.transform("found", lambda c: F.struct(c["item"].alias("item"), F.size(c["words"]).alias("whole"), _run_of(c).alias("run"))))
    runs = F.filter("runs", lambda r: r["run"]["n"] >= F.least(r["whole"], F.lit(WINDOW)))
    return held.select("key", F.array_distinct(F.transform(runs, lambda r: F.struct(r["item"].alias("item"), r["run"]["start"].alias("start"), r["run"]["n"].alias("n")))).alias("runs")).filter(F.size("runs") > 0).groupBy("key").agg(F.first("runs").alias("runs"))


def _run_of(c: Column) -> Column:
    words, place, doc, at = c["words"], c["p1"], F.col("doc"), c["q"]
    ahead, back = F.least(F.size(words) - place, F.size(doc) - at), F.least(place, at)

    def first_difference(a: Column, b: Column) -> Column:
        return F.array_position(F.zip_with(a, b, lambda x, y: x == y), False).cast("int")

    ahead = F.greatest(ahead, F.lit(0))  # a key that two documents met in
    right = first_difference(F.slice(words, place + 1, ahead), F.slice(doc, at + 1, ahead))
    left = first_difference(F.reverse(F.slice(words, place - back + 1, back)), F.reverse(F.slice(doc, at - back + 1, back)))
    n_right, n_left = F.when(right == 0, ahead).otherwise(right - 1), F.when(left == 0, back).otherwise(left - 1)
    return F.struct((at - n_left).alias("start"), F.when(n_right == 0, 0).otherwise(n_left + n_right).alias("n"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document.

    Null and empty texts have no words; items without words match nothing; item_ids that repeat count once. Texts are
    read whole, four times: to count the test terms, for the anchors' postings, for the candidates, for the word counts.
    """
    runs = contaminated_stretches(docs, items)
    places = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["n"] - 1))))
    ids = F.array_sort(F.array_distinct(F.transform("runs", lambda r: r["item"])))
    hits = runs.select("key", F.size(places).cast("long").alias("n_hit"), ids.alias("ids"))
    hits = hits.select("key", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "ids"), 256).alias("items_sha256"))
    all_docs = docs.select("doc_id", doc_key().alias("key"), F.size(index_words(F.col("text"))).cast("long").alias("n_words"))
    out = all_docs.join(hits, "key", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
