"""Language identification: the family first, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from buildlens.llm.common import is_held_out
from buildlens.llm.features import damped, entries, linear_svm, ngram_counts, pack, platt, sigmoid, table

DIMS = 8192
#: At most about so many documents of each language are learned from: the bounded sample of labelled rows.
SAMPLE = 500
#: Stretches of so many words of the held-out texts show how much the evidence of short texts varies.
STRETCHES = (1, 2, 4, 8, 32, 128)
#: A text is in no language learned if its evidence is so many spreads of held-out texts of its size below their middle; the least spread.
SPREADS, LEAST_SPREAD = 6.0, 0.3
#: Classes of text sizes.
SIZES = 24
#: What a row drawn serves for.
LEARN, HELD, STRETCH = range(3)
#: Language families. A language that is not listed is a family of its own.
FAMILIES = {
    "baltic": ["lt", "lv"],
    "celtic": ["br", "cy", "ga", "gd"],
    "germanic": ["af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "or", "pa", "sa", "si", "ur"],
    "iranian": ["fa", "ku", "ps", "tg"],
    "romance": ["ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"],
    "semitic": ["am", "ar", "he", "mt"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "turkic": ["az", "kk", "ky", "tr", "tt", "ug", "uz"],
    "uralic": ["et", "fi", "hu"],
}


def family_of(lang: str) -> str:
    return next((f for f, ls in FAMILIES.items() if lang.split("-")[0].lower() in ls), lang)


def size_class(n: np.ndarray) -> np.ndarray:
    """Of numbers of n-grams: by powers of two."""
    return np.minimum(np.log2(np.maximum(n, 1)).astype(int), SIZES - 1)


@dataclass
class Evidence:
    """Whether a text looks like the language it is given at all. Unlike a machine's score, this is not against the other
    languages: one of two families always has half of the score, whatever the text."""

    langs: dict[str, int]
    log_share: np.ndarray  # of each n-gram in each language
    centre: np.ndarray  # mean log-likelihood of an n-gram in each language's own texts
    floor: np.ndarray  # by size class

    def of(self, x: np.ndarray, langs: list[str]) -> np.ndarray:
        """Mean log-likelihood of a text's n-grams (x * x is their distribution) in its language, less that of the language's own texts."""
        at = np.array([self.langs[g] for g in langs], int)
        return ((x * x) @ self.log_share)[np.arange(len(x)), at] - self.centre[at]

    def holds(self, x: np.ndarray, n: np.ndarray, langs: list[str]) -> np.ndarray:
        return self.of(x, langs) >= self.floor[size_class(n)]


def fit_evidence(rows: list[bytes], langs: np.ndarray, held: list[bytes], held_n: np.ndarray, held_langs: np.ndarray) -> Evidence | None:
    """rows, langs: packed texts that the shares come from; held: texts and stretches of others, which set the floors.

    A floor is far under the middle of what held-out texts of that size have, measured by their own spread, so that odd
    rows among them do not move it. A size without held-out texts has the floor of the nearest size that has some.
    """
    known = sorted(set(langs.tolist()))
    at = {g: i for i, g in enumerate(known)}
    keep = [i for i, g in enumerate(held_langs) if g in at]
    if not known or not keep:
        return None
    share, number = np.zeros((DIMS, len(known))), np.zeros(len(known))
    for data, g in zip(rows, langs):
        place, value = entries(data)
        share[place, at[g]] += value.astype(np.float64) ** 2
        number[at[g]] += 1
    log_share = np.log(0.98 * share / number + 0.02 / DIMS)

    def mean_log(data: bytes, g: str) -> float:
        place, value = entries(data)
        return float((value.astype(np.float64) ** 2) @ log_share[place, at[g]])

    centre = np.zeros(len(known))
    for data, g in zip(rows, langs):
        centre[at[g]] += mean_log(data, g) / number[at[g]]
    out = Evidence(at, log_share.astype(np.float32), centre, np.full(SIZES, -np.inf))
    found = np.array([mean_log(held[i], held_langs[i]) - centre[at[held_langs[i]]] for i in keep])
    size = size_class(held_n[keep])
    enough = [k for k in range(SIZES) if (size == k).sum() >= 8] or sorted(set(size.tolist()))
    for k in range(SIZES):
        own = found[size == min(enough, key=lambda e: (abs(e - k), e))]
        middle, low = np.quantile(own, [0.5, 0.16])
        out.floor[k] = middle - SPREADS * max(middle - low, LEAST_SPREAD)
    return out


@dataclass
class Model:
    """weights: a column for each machine, bias last. family machines: one against the rest, in the order of families."""

    weights: np.ndarray
    scale: np.ndarray  # a, b of each machine's probability
    families: dict[str, list[str]]
    pairs: list[tuple[str, str]]
    evidence: Evidence | None = None

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score: the family's probability times that of the language's weakest pair in it."""
        p = sigmoid((x @ self.weights[:-1] + self.weights[-1]) * self.scale[:, 0] + self.scale[:, 1])
        names, k = list(self.families), len(self.families)
        by_family = p[:, :k] / np.maximum(p[:, :k].sum(1, keepdims=True), 1e-12)
        at = {pair: k + i for i, pair in enumerate(self.pairs)}
        langs, scores = [], []
        for row, f in enumerate(by_family.argmax(1)):
            own = self.families[names[f]]
            votes, least = dict.fromkeys(own, 0), dict.fromkeys(own, 1.0)
            for a, b in combinations(own, 2):
                pa_, pb = p[row, at[a, b]], 1 - p[row, at[a, b]]
                votes[a if pa_ >= pb else b] += 1
                least[a], least[b] = min(least[a], pa_), min(least[b], pb)
            best = max(own, key=lambda g: (votes[g], least[g]))
            langs.append(best)
            scores.append(by_family[row, f] * least[best])
        return langs, np.array(scores)


def counted(text: str) -> tuple[np.ndarray, int]:
    """The features and the number of n-grams."""
    counts = ngram_counts(text, DIMS, letters_only=True)
    return damped(counts), int(counts.sum())


def features(text: str) -> np.ndarray:
    return counted(text)[0]


def stretches(text: str) -> list[str]:
    words, place = text.split(), zlib.crc32(text.encode("utf-8", "replace")) // 5
    return [" ".join(words[(at := place % (len(words) - k)) : at + k]) for k in STRETCHES if k < len(words)]


def fit(x: np.ndarray, langs: np.ndarray) -> Model | None:
    """Machines learn from four of five rows; the fifth sets their probabilities."""
    known = sorted(set(langs.tolist()))
    if not known:
        return None
    families: dict[str, list[str]] = {}
    for g in known:
        families.setdefault(family_of(g), []).append(g)
    families = dict(sorted(families.items()))
    own_family = np.array([family_of(g) for g in langs])
    pairs = [pair for own in families.values() for pair in combinations(own, 2)]
    rest = np.arange(len(x)) % 5 > 0
    weights, scale = [], []

    def machine(rows: np.ndarray, positive: np.ndarray) -> None:
        if positive[rows].all():
            weights.append(np.r_[np.zeros(DIMS), 1.0])
            scale.append((1.0, 20.0))
            return
        learn = rows & rest
        if len(set(positive[learn].tolist())) < 2:
            learn = rows
        w = linear_svm(x[learn], np.where(positive[learn], 1, -1))
        test = rows & ~rest
        test = test if len(set(positive[test].tolist())) == 2 else rows
        weights.append(w)
        scale.append(platt(x[test] @ w[:-1] + w[-1], positive[test]))

    for f in families:
        machine(np.full(len(x), True), own_family == f)
    for a, b in pairs:
        machine((langs == a) | (langs == b), langs == a)
    return Model(np.stack(weights, 1).astype(np.float32), np.array(scale), families, pairs)


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model | None:
    """labelled: text, lang, salt (any column to draw by). Rows with null text or lang count for nothing.

    A fifth of the texts drawn, with stretches of them, sets what evidence of a language is asked for.

    Rows of a language are drawn by hash, at a rate that its count sets, so what reaches the driver is bounded by
    ``sample`` and the number of languages: the feature vectors, not the texts. Of rows of equal text and language one is taken.
    """
    labelled = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    rate = F.lit(0.0)
    for lang, n in counts.items():
        rate = F.when(F.col("lang") == lang, F.lit(sample / n)).otherwise(rate)
    drawn = labelled.filter(F.pmod(F.xxhash64("salt", "text"), F.lit(1 << 30)) < rate * (1 << 30)).select("text", "lang").distinct()

    def run(batches):
        for b in batches:
            rows = []
            for lang, text in zip(b.column(1).to_pylist(), b.column(0).to_pylist()):
                held = zlib.crc32(text.encode("utf-8", "replace")) % 5 == 0
                rows.append((lang, HELD if held else LEARN, *counted(text)))
                rows += [(lang, STRETCH, *counted(t)) for t in stretches(text) if any(map(str.isalpha, t))] if held else []
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([pack(r[2]) for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.int64())], ["lang", "use", "x", "n"])

    got = sorted((r["lang"], bytes(r["x"]), r["use"], r["n"]) for r in drawn.mapInArrow(run, "lang string, use int, x binary, n long").collect())
    rows = [r for r in got if r[2] != STRETCH]
    rows = [rows[i] for i in np.random.default_rng(0).permutation(len(rows))]
    learn, held = [r for r in rows if r[2] == LEARN], [r for r in got if r[2] != LEARN and r[3]]
    model = fit(table([r[1] for r in rows], DIMS), np.array([r[0] for r in rows], object))
    if model and held:
        model.evidence = fit_evidence([r[1] for r in learn], np.array([r[0] for r in learn], object), [r[1] for r in held], np.array([r[3] for r in held]), np.array([r[0] for r in held], object))
    return model


def predict(docs: DataFrame, model: Model | None, prefix: str = "", judge: bool = False) -> DataFrame:
    """``docs`` with lang_pred and score; only the text is looked at. Null, or without a letter, or nothing learned: und, 0.

    judge: a text without evidence of the language that the machines give it is und, 0, too.

    The new columns take the place of any of their names; ``prefix`` keeps them apart.
    """
    spark, kept = docs.sparkSession, docs.drop(f"{prefix}lang_pred", f"{prefix}score")
    shared = spark.sparkContext.broadcast(model)
    names = kept.columns
    text_at = names.index("text")

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                texts = part.column(text_at).to_pylist()
                langs, scores = ["und"] * len(texts), np.zeros(len(texts))
                rows = [i for i, t in enumerate(texts) if t and shared.value and any(map(str.isalpha, t))]
                if rows:
                    x, n = zip(*(counted(texts[i]) for i in rows))
                    found, score = shared.value.predict(np.stack(x))
                    known = [True] * len(rows)
                    if judge and (evidence := shared.value.evidence):
                        known = [g in evidence.langs for g in found]
                        at = np.flatnonzero(known)
                        for i, holds in zip(at, evidence.holds(np.stack(x)[at], np.array(n)[at], [found[i] for i in at])):
                            known[i] = bool(holds)
                    for i, g, s, held in zip(rows, found, score, known):
                        if held:
                            langs[i], scores[i] = g, s
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, f"{prefix}lang_pred", f"{prefix}score"])

    schema = T.StructType([*kept.schema.fields, T.StructField(f"{prefix}lang_pred", T.StringType()), T.StructField(f"{prefix}score", T.DoubleType())])
    return kept.mapInArrow(run, schema)


def learned_from(docs: DataFrame) -> DataFrame:
    return docs.filter(~is_held_out(F.col("doc_id"), 5, 0)).select("text", "lang", F.col("doc_id").alias("salt"))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learning from those that are not held out.

    A text that is null or has no letter is ``und`` with score 0; so is every text if no labelled row is left to learn from. A
    null doc_id counts as the empty text where rows are held out. Rows that repeat are predicted each; ties of votes and
    scores go to the language that comes first in its family. An empty table gives no rows.
    """
    model = train(learned_from(docs), sample)
    held_out: Column = is_held_out(F.col("doc_id"), 5, 0)
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")
