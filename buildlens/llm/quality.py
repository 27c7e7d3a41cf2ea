"""Quality classification by co-training a view of the text and a view of the page's metadata.

Both views start from a bounded draw of labelled rows. Then every document of the corpus takes part in each round: a task
hands the rows that one view is sure of, as pseudo-labels, to the other view's weights, and the tasks' weights are averaged
by the number of rows that they were given.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from buildlens.llm.common import materialize
from buildlens.llm.features import damped, logistic, ngram_counts, pack, platt, sigmoid, table

TEXT_DIMS, CONTENT = 4096, 6
#: The metadata's hashed values, and the classes of stated length.
META_HASH, LENGTHS = 256, 24
DIMS = TEXT_DIMS + CONTENT + META_HASH + LENGTHS
TEXT, META = slice(0, TEXT_DIMS + CONTENT), slice(TEXT_DIMS + CONTENT, DIMS)
#: Bound of what the classifiers start from: labelled rows of each class.
LABELLED = 1500
#: Rounds of exchange over the whole corpus; a view is sure of a row beyond these probabilities.
ROUNDS, SURE = 2, (0.05, 0.95)
#: A task takes STEPS steps on so many rows handed over, mixed with as many labelled ones.
CHUNK, STEPS = 512, 4
#: Rejected are documents whose probability of good quality is less; very short clean ones come down to about 0.25.
LEAST = 0.2


def content(text: str) -> np.ndarray:
    """The text view: hashed character n-grams, punctuation included, and how much the words repeat."""
    words = text.lower().split()
    n = max(1, len(words))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    same = sum(a == b for a, b in zip(words, words[1:]))
    extra = [len(counts) / n, same / n, max(counts.values(), default=0) / n, min(sum(map(len, words)) / n / 10, 3), np.log1p(len(words)) / 10, float(not words)]
    return np.r_[damped(ngram_counts(text, TEXT_DIMS, letters_only=False)), extra].astype(np.float32)


def metadata(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """The metadata view: source, language and stated length, alone and by pairs. It never sees the text."""
    out = np.zeros(META_HASH + LENGTHS, np.float32)
    length = 0 if n_chars is None else 1 + min(int(2 * math.log2(1 + max(n_chars, 0)) / 3), LENGTHS - 2)
    out[META_HASH + length] = 0.5
    for name in (f"source {source}", f"lang {lang}", f"both {source} {lang}", f"long {source} {length}"):
        out[zlib.crc32(name.encode("utf-8", "replace")) % META_HASH] += 0.5
    return out


@dataclass
class Model:
    """Weights of the two views (bias last), their calibration, and the weights that combine calibrated log-odds."""

    text: np.ndarray
    meta: np.ndarray
    text_scale: tuple[float, float]
    meta_scale: tuple[float, float]
    combine: np.ndarray
    prior: float = 0.0  # log-odds by which good documents are more frequent in the corpus than in the draw

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z1, z2 = _log_odds(x[:, TEXT], self.text, self.text_scale), _log_odds(x[:, META], self.meta, self.meta_scale)
        return sigmoid(z1 + self.prior), sigmoid(z2 + self.prior), sigmoid(z1 * self.combine[0] + z2 * self.combine[1] + self.combine[2] + self.prior)


def _log_odds(x: np.ndarray, w: np.ndarray, scale: tuple[float, float]) -> np.ndarray:
    return np.clip(scale[0] * (x @ w[:-1] + w[-1]) + scale[1], -12, 12)


def balanced(y: np.ndarray) -> np.ndarray:
    """Weights by which both classes count alike."""
    return np.where(y > 0.5, 0.5 / max((y > 0.5).sum(), 1), 0.5 / max((y <= 0.5).sum(), 1)) * len(y)


def start(x: np.ndarray, y: np.ndarray) -> tuple[Model, np.ndarray] | None:
    """Both views fitted on labelled rows, and which rows were left out: a quarter, which set the calibration and the
    combination. With one class only there is nothing to learn."""
    if len(set(y.tolist())) < 2:
        return None
    test = np.arange(len(x)) % 4 == 0
    if len(set(y[test].tolist())) < 2 or len(set(y[~test].tolist())) < 2:
        fit = test = np.full(len(x), True)
    else:
        fit = ~test
    w = [logistic(x[fit][:, v], y[fit].astype(float), balanced(y[fit]), l2=0.3) for v in (TEXT, META)]
    return calibrated(w[0], w[1], x[test], y[test]), test


def calibrated(text: np.ndarray, meta: np.ndarray, x: np.ndarray, y: np.ndarray) -> Model:
    scale = [platt(x[:, v] @ w[:-1] + w[-1], y == 1) for v, w in ((TEXT, text), (META, meta))]
    z = np.stack([_log_odds(x[:, v], w, s) for v, w, s in zip((TEXT, META), (text, meta), scale)], 1)
    combine = logistic(z, y.astype(float), l2=1.0, rounds=500)
    combine[:2] = np.maximum(combine[:2], 0)
    return Model(text.astype(np.float32), meta.astype(np.float32), scale[0], scale[1], combine)


def _step(w: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float) -> np.ndarray:
    slope = weight * (sigmoid(x @ w[:-1] + w[-1]) - y) / len(x)
    return w - rate * np.r_[slope @ x, slope.sum()]


class Exchange:
    """What one task learns in one round. Rows that a view is sure of go to the other view in equal numbers of both classes,
    which its labelled rows keep in place; what is left over at the end of a task is learned from too."""

    def __init__(self, model: Model, x: np.ndarray, y: np.ndarray):
        self.model, self.x, self.y = model, x, y
        self.w = [model.text.astype(np.float64), model.meta.astype(np.float64)]
        self.given = [0, 0]
        self.held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]

    def add(self, rows: np.ndarray) -> None:
        p = self.model.predict(rows)
        for other in (0, 1):
            sure = (p[1 - other] <= SURE[0]) | (p[1 - other] >= SURE[1])
            if sure.any():
                self.held[other].append((rows[sure][:, (TEXT, META)[other]], (p[1 - other][sure] > 0.5).astype(float)))
                if sum(len(y) for _, y in self.held[other]) >= CHUNK:
                    self.learn(other)

    def learn(self, other: int) -> None:
        if not self.held[other]:
            return
        x, y = (np.concatenate(p) for p in zip(*self.held[other]))
        self.held[other] = []
        labelled = np.resize(np.arange(len(self.x)), max(len(x), 256))
        every = np.concatenate([x, self.x[labelled][:, (TEXT, META)[other]]])
        target = np.r_[y, self.y[labelled]]
        weight = balanced(target) * np.r_[np.full(len(x), 0.5), np.ones(len(labelled))]
        for _ in range(STEPS):
            self.w[other] = _step(self.w[other], every, target, weight, 0.5)
        self.given[other] += len(x)


COLUMNS = ("text", "source", "lang", "n_chars")


def _vectors(columns: list[list], rows: range | list[int]) -> list[np.ndarray]:
    text, source, lang, n_chars = columns
    return [np.r_[content(text[i] or ""), metadata(source[i], lang[i], n_chars[i])] for i in rows]


def _collected(drawn: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Feature vectors and labels (-1: none) of a bounded draw, in an order that does not depend on tasks."""

    def run(batches):
        for b in batches:
            x = _vectors([b.column(n).to_pylist() for n in COLUMNS], range(b.num_rows))
            yield pa.RecordBatch.from_arrays([b.column("quality"), pa.array([pack(v) for v in x], pa.binary())], ["quality", "x"])

    got = sorted((int(r["quality"]), bytes(r["x"])) for r in drawn.select(*COLUMNS, "quality").mapInArrow(run, "quality int, x binary").collect())
    order = np.random.default_rng(0).permutation(len(got))
    return table([got[i][1] for i in order], DIMS), np.array([got[i][0] for i in order], int)


WEIGHTS = "part int, view int, given long, weights binary"


def _weights(rows: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)] + [pa.array([r[3].astype("<f4").tobytes() for r in rows], pa.binary())], ["part", "view", "given", "weights"])


def one_round(docs: DataFrame, model: Model, x: np.ndarray, y: np.ndarray) -> tuple[Model, list[int]]:
    """The views' weights after every document's say, and how many rows each view was given. The tasks' weights are
    averaged in groups of 32, so no task and not the driver holds more than so many of them."""
    shared = docs.sparkSession.sparkContext.broadcast((model, [pack(row) for row in x], y))

    def run(batches):
        begun, rows, labels = shared.value
        own = Exchange(begun, table(rows, DIMS), labels)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                own.add(np.stack(_vectors([part.column(i).to_pylist() for i in range(len(COLUMNS))], range(part.num_rows))))
        own.learn(0)
        own.learn(1)
        yield _weights([(TaskContext.get().partitionId(), i, own.given[i], own.w[i]) for i in (0, 1) if own.given[i]])

    def average(t: pa.Table) -> pa.Table:
        total, mean = 0, 0.0
        for n, data in sorted(zip(t["given"].to_pylist(), t["weights"].to_pylist())):
            total += n
            mean = mean + (np.frombuffer(data, "<f4").astype(np.float64) - mean) * (n / total)
        return pa.Table.from_batches([_weights([(t["part"][0].as_py() // 32, t["view"][0].as_py(), total, mean)])])

    parts = materialize(docs.select(*COLUMNS).mapInArrow(run, WEIGHTS), "weights")
    while parts.count() > 64:
        parts = materialize(parts.groupBy(F.expr("part div 32"), "view").applyInArrow(average, WEIGHTS), "weights")
    w, given = [model.text, model.meta], [0, 0]
    rows = sorted((r["view"], r["given"], bytes(r["weights"])) for r in parts.collect())
    for i in (0, 1):
        given[i] = sum(n for view, n, _ in rows if view == i)
        if given[i]:
            w[i] = sum(np.frombuffer(data, "<f4").astype(np.float64) * (n / given[i]) for view, n, data in rows if view == i).astype(np.float32)
    return replace(model, text=w[0], meta=w[1]), given


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> Model | None:
    """labels: doc_id, quality (0 or 1; rows with null count for nothing, of two for one document the lower holds).

    Labelled ids are drawn by hash at rates that the counts set, so that about ``labelled`` of each class reach the
    driver, as vectors, of one row each however often an id is there. The rounds of exchange run over all of ``docs``, whether labelled or not.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    hashed = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("draw")), F.lit(1 << 30))
    drawn = known.filter(hashed < F.when(F.col("quality") == 1, labelled / counts[1]).otherwise(labelled / counts[0]) * (1 << 30))
    docs = docs.select("doc_id", *COLUMNS)
    one_each = docs.join(F.broadcast(drawn), "doc_id").dropDuplicates(["doc_id"])  # the drawn ids are about twice ``labelled``
    x, y = _collected(one_each)
    if (begun := start(x, y)) is None:
        return None
    model, test = begun
    fit = ~test if not test.all() else test
    prior = float(np.log(counts[1] / counts[0] * (y == 0).sum() / (y == 1).sum()))
    for _ in range(rounds):
        told, given = one_round(docs, model, x[fit], y[fit])
        if not any(given):
            break
        model = calibrated(told.text, told.meta, x[test], y[test])
    model.prior = prior
    return model


def score(docs: DataFrame, model: Model | None, least: float = LEAST, prefix: str = "") -> DataFrame:
    """``docs`` with p_text, p_meta, quality_score and keep. Nothing learned: all three null, and every document is kept.

    A null text counts as empty, null metadata as values of their own. The new columns take the place of any of their
    names; ``prefix`` keeps them apart.
    """
    new = [f"{prefix}{n}" for n in ("p_text", "p_meta", "quality_score")]
    spark, kept = docs.sparkSession, docs.drop(*new, f"{prefix}keep")
    shared = spark.sparkContext.broadcast(model)
    names = kept.columns
    at = [names.index(c) for c in COLUMNS]

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                if shared.value is None:
                    found = [pa.nulls(part.num_rows, pa.float64())] * 3
                else:
                    found = [pa.array(p, pa.float64()) for p in shared.value.predict(np.stack(_vectors([part.column(i).to_pylist() for i in at], range(part.num_rows))))]
                yield pa.RecordBatch.from_arrays([*part.columns, *found], [*names, *new])

    schema = T.StructType([*kept.schema.fields, *[T.StructField(n, T.DoubleType()) for n in new]])
    return kept.mapInArrow(run, schema).withColumn(f"{prefix}keep", F.coalesce(F.col(new[2]) >= least, F.lit(True)))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_text, p_meta, quality_score, keep of every document.

    A null or empty text is scored as such, a null in a metadata column as a value of its own. Rows that repeat are scored
    alike, each in a row of its own; an empty table gives none. Without labels of both classes the scores are null and every
    document is kept. A score just at the limit is kept.
    """
    return score(docs.select("doc_id", *COLUMNS), train(docs, labels)).drop(*COLUMNS)
