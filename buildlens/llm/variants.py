"""Spelling variants by forward and backward minimal acyclic automata with perfect-hash word numbers.

Two words one error apart have a half in common: the error is in the last half of the shorter, or its first half holds it and
the last is equal. Words that share a half are dealt together. There a forward automaton, and a backward one of reversed
words, follow each word's half exactly and complete it with one error; the path's arcs add up to the found word's number.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens.llm.common import discard, materialize
from buildlens.llm.runs import crcs, letter_mask, runs_of, shifted

LEAST_LETTERS, LEAST_COUNT = 5, 3
#: One run in so many loses a letter.
ONE_IN = 97
#: Words of a task's automaton, on average; groups of more than LARGE words are parted by finer keys.
SHARD_WORDS, LARGE = 60_000, 20_000
#: Queries that follow the automaton together.
TOGETHER = 20_000


# words and their counts


def letters_of(words: list[bytes]) -> np.ndarray:
    """Code points of each word: all bytes but the first ones of two."""
    return np.fromiter((len(w) - w.count(b"\xc3") for w in words), np.int64, len(words))


def _without(word: bytes, at: int) -> bytes:
    text = word.decode()
    return (text[:at] + text[at + 1 :]).encode()


def counted_words(docs: DataFrame) -> DataFrame:
    """word, n: the words of all texts, after the deletions, with their numbers of occurrences, from LEAST_COUNT on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            names = [f"{'' if i is None else i}:".encode() for i in b.column(0).to_pylist()]
            prefix = crcs(names)
            for first, _, runs in runs_of(b.column(1), letter_mask):
                n = np.bincount(runs.at, minlength=len(runs.words)).astype(np.int64)
                row = np.repeat(np.arange(len(runs.rows) - 1), np.diff(runs.rows))
                h = shifted(prefix[first + row], runs.lengths) ^ crcs(runs.words)[runs.at]
                hit = np.flatnonzero(h % ONE_IN == 0)
                size = letters_of(runs.words)
                found: dict[bytes, int] = {}
                for at, x in zip(runs.at[hit].tolist(), h[hit].tolist()):
                    n[at] -= 1
                    word = _without(runs.words[at], x % int(size[at]))
                    if size[at] > LEAST_LETTERS:
                        found[word] = found.get(word, 0) + 1
                kept = np.flatnonzero((size >= LEAST_LETTERS) & (n > 0))
                words = [runs.words[i].decode() for i in kept] + [w.decode() for w in found]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(np.r_[n[kept], np.fromiter(found.values(), np.int64, len(found))])], ["word", "n"])

    each = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


# the automaton


class Automaton:
    """The minimal acyclic automaton of ascending distinct words, as tables. An arc's ``before`` is how many words end at its state
    or go on by a smaller letter, so the sum along a word's path is the word's number."""

    def __init__(self, words: list[bytes]):
        register: dict[tuple, int] = {}
        first, label, to, before, final, size = [0], [], [], [], [], []
        path: list[tuple[list, list, list]] = [([False], [], [])]  # states still open: final, labels, targets

        def close(depth: int) -> int:
            """Closes the states deeper than ``depth``: each becomes one with a state of the same arcs, if there is one."""
            state = -1
            while len(path) > depth:
                end, labels, targets = path.pop()
                known = (end[0], bytes(labels), tuple(targets))
                state = register.get(known, -1)
                if state < 0:
                    state = register[known] = len(final)
                    so_far = int(end[0])
                    for c, t in zip(labels, targets):
                        label.append(c)
                        to.append(t)
                        before.append(so_far)
                        so_far += size[t]
                    first.append(len(label))
                    final.append(end[0])
                    size.append(so_far)
                if path:
                    path[-1][2].append(state)
            return state

        was = b""
        for w in words:
            common = 0
            for a, b in zip(was, w):
                if a != b:
                    break
                common += 1
            close(common + 1)
            for c in w[common:]:
                path[-1][1].append(c)
                path.append(([False], [], []))
            path[-1][0][0] = True
            was = w
        self.start = close(0)
        self.first, self.final = np.array(first, np.int64), np.array(final, bool)
        self.label, self.to, self.before = np.array(label, np.uint8), np.array(to, np.int64), np.array(before, np.int64)
        self.arc_keys = np.repeat(np.arange(len(final)), np.diff(self.first)) * 256 + self.label  # ascending

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The arc of each state by its letter, or -1."""
        if not len(self.arc_keys):
            return np.full(len(state), -1)
        key = state * 256 + letter
        at = np.minimum(np.searchsorted(self.arc_keys, key), len(self.arc_keys) - 1)
        return np.where(self.arc_keys[at] == key, at, -1)

    def fans(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All arcs of the states: (whose, arc)."""
        n = self.first[state + 1] - self.first[state]
        whose = np.repeat(np.arange(len(state)), n)
        return whose, np.arange(len(whose)) - np.repeat(np.cumsum(n) - n, n) + self.first[state][whose]

    def one_error(self, words: list[bytes], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, number found): each word's first ``exact`` letters are followed as they are, the rest with just one letter
        inserted, deleted or replaced. All words go on together, a letter at a time."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        start = np.cumsum(size) - size
        clean = np.arange(len(words))
        state, number = np.full(len(words), self.start), np.zeros(len(words), np.int64)
        rows = (np.zeros(0, np.int64),) * 3  # word, state, number of those with their error behind them
        found = []
        for p in range(int(size.max(initial=-1)) + 1):
            new = [rows]
            erring = exact[clean] <= p
            who, s, n = clean[erring], state[erring], number[erring]
            whose, arc = self.fans(s)
            new.append((who[whose], self.to[arc], n[whose] + self.before[arc]))  # a letter before this one
            owner, at, total = (np.concatenate(x) for x in zip(*new))
            ended = size[owner] == p
            ok = ended & self.final[at]
            found.append((owner[ok], total[ok]))
            owner, at, total = owner[~ended], at[~ended], total[~ended]
            arc_of = self.step(at, data[start[owner] + p])
            go = arc_of >= 0
            moved = (owner[go], self.to[arc_of[go]], total[go] + self.before[arc_of[go]])
            inside = size[who] > p
            who, s, n = who[inside], s[inside], n[inside]
            whose, arc = self.fans(s)
            other = self.label[arc] != data[start[who[whose]] + p]
            whose, arc = whose[other], arc[other]
            rows = tuple(np.concatenate(x) for x in zip(moved, (who[whose], self.to[arc], n[whose] + self.before[arc]), (who, s, n)))  # replaced, deleted
            if len(rows[0]) > 8 * len(clean):  # errors at several places of a run of one letter come to the same
                rows = tuple(np.unique(np.stack(rows), axis=1))
            inside = size[clean] > p
            clean, state, number = clean[inside], state[inside], number[inside]
            arc_of = self.step(state, data[start[clean] + p])
            go = arc_of >= 0
            clean, state, number = clean[go], self.to[arc_of[go]], number[go] + self.before[arc_of[go]]
        last = size[rows[0]] == size.max(initial=0)  # those that lost the last letter of a longest word
        ok = last & self.final[rows[1]] if len(rows[0]) else last
        found.append((rows[0][ok], rows[2][ok]))
        return tuple(np.concatenate(x) for x in zip(*found))


def near_words(words: list[str], exact: np.ndarray, backward: bool) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), distinct: words one error apart, of which i was followed by its first (backward: last) ``exact[i]`` letters.

    Letters are up to U+00FF, so a byte each."""
    coded = [w.encode("latin-1")[:: -1 if backward else 1] for w in words]
    distinct = sorted(set(coded))
    automaton = Automaton(distinct)
    place = {w: i for i, w in enumerate(distinct)}
    of = np.fromiter((place[w] for w in coded), np.int64, len(coded))
    some = np.zeros(len(distinct), np.int64)
    some[of] = np.arange(len(coded))  # any row of each word
    asks = np.unique(np.stack([of, exact], 1), axis=0)
    pairs = []
    for k in range(0, len(asks), TOGETHER):
        part = asks[k : k + TOGETHER]
        who, number = automaton.one_error([distinct[i] for i in part[:, 0]], part[:, 1])
        pairs.append(np.unique(part[who, 0] * len(distinct) + number))
    both = np.unique(np.concatenate([np.zeros(0, np.int64), *pairs]))
    return some[both // len(distinct)], some[both % len(distinct)]


# dealing words by what they share


def _group(rows: DataFrame) -> DataFrame:
    """``rows`` (word, m, left, right, ...) with g: words of m letters or one more with the same first ``left`` and last ``right`` ones."""
    first, last = F.expr("substring(word, 1, left)"), F.expr("if(right = 0, '', substring(word, -right))")
    return rows.withColumn("g", F.xxhash64("m", "left", "right", first, F.lit("\0"), last))


def dealt_words(words: DataFrame) -> DataFrame:
    """word, n, m, left, right, g of each group that a word is in. Any two words one error apart share a group.

    A word of m letters meets others of m, and of one more, by its first half and by its last half. Of a large group what is
    between is halved again: either half of it may hold the error, so the other is shared. That ends when one letter is left.
    """
    size = F.length("word")
    both = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m"))
    half = F.floor(F.col("m") / 2).cast("int")
    ways = F.array(F.struct(half.alias("left"), F.lit(0).alias("right")), F.struct(F.lit(0).alias("left"), (F.col("m") - half).alias("right")))
    rows = _group(both.select("word", "n", "m", F.explode(ways).alias("w")).select("word", "n", "m", "w.*"))
    done = []
    while True:
        rows = materialize(rows, "variant-groups")
        large = rows.filter("m - left - right > 1").groupBy("g").agg(F.count(F.lit(1)).alias("words")).filter(F.col("words") > LARGE).select("g")
        large = materialize(large, "large-groups")
        if not large.limit(1).count():
            return _union([*done, rows])
        done.append(rows.join(large, "g", "left_anti"))
        h = F.floor((F.col("m") - F.col("left") - F.col("right")) / 2).cast("int")
        finer = F.array(F.struct((F.col("left") + h).alias("left"), F.col("right")), F.struct(F.col("left"), (F.col("m") - F.col("left") - h).alias("right")))
        parted = rows.join(large, "g", "left_semi").select("word", "n", "m", F.explode(finer).alias("w")).select("word", "n", "m", "w.*")
        rows = _group(parted)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, near, near_n for any two words one error apart, in both directions; a pair may come several times."""
    dealt = materialize(dealt_words(words), "variant-rows")
    shards = max(1, math.ceil(dealt.count() / SHARD_WORDS))

    def run(t: pa.Table) -> pa.Table:
        words, n = t["word"].to_pylist(), t["n"].to_numpy()
        backward = not t["forward"][0].as_py()
        i, j = near_words(words, t["exact"].to_numpy(), backward)
        column = t["word"].combine_chunks()
        return pa.table([column.take(pa.array(i)), pa.array(n[i]), column.take(pa.array(j)), pa.array(n[j])], ["word", "n", "near", "near_n"])

    forward = F.col("left") > 0
    asked = dealt.select("word", "n", forward.alias("forward"), F.when(forward, F.col("left")).otherwise(F.col("right")).cast("long").alias("exact"), F.pmod("g", F.lit(shards)).alias("shard"))
    return asked.groupBy("forward", "shard").applyInArrow(run, "word string, n long, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of (word, form): the end of the chain of forms. Counts at least double along it, so it has no circle and is
    short; each round doubles what is known of it."""
    known = materialize(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("next")).filter("root <> next")
        step = known.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        was, step = known, materialize(step, "roots")
        moved = step.filter("moved").limit(1).count()
        known = step.select("word", "root")
        known._written_at = step._written_at
        discard(was)
        if not moved:
            return known


def group_variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of all texts.

    Null and empty texts have no words; a null doc_id counts as the empty text in the rule of deletions; rows that repeat count
    again. Ties of forms go to the smaller word. No documents or words: no rows. Other columns are not looked at.
    """
    words = materialize(counted_words(docs), "words")
    of_word = near_pairs(words).repartition("word").groupBy("word", "n", "near").agg(F.first("near_n").alias("near_n"))
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("form"))).alias("best")
    near = of_word.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best)
    far = -F.col("best.minus") >= 2 * F.col("n")
    near = near.select("word", "n_near", F.when(far, F.col("best.form")).alias("form"), F.when(far, -F.col("best.minus")).alias("form_n"))
    all_words = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n")
    all_words = materialize(all_words, "forms")
    discard(words)
    return all_words.join(roots(all_words), "word")
