"""Gated recurrent language model: truncated backpropagation in numpy, class-factored output, state carried through documents.

Frequent words have ids and lie in classes of equal size, by rank. Every other word belongs to a class by its last two
bytes; such a class gives out its words by their counts in the corpus. A token's probability is that of its class, by the
network's state, times that of the word in its class.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens.llm.common import DistinctWords, is_held_out, materialize, pieces_of

#: Words with ids, in classes of PER; classes of other words; sizes of embedding and state.
WORDS, PER, RARE, EMBED, STATE = 1024, 32, 16, 16, 24
CLASSES = WORDS // PER + RARE
#: At most so many of the most frequent words have their counts at hand in every task; the counts of all others meet their
#: documents by a join.
AT_HAND = 131_072
#: Steps of a window of truncated backpropagation, and windows learned from at once.
WINDOW, STREAMS, LEAST_STREAMS = 20, 384, 192
#: Windows that are laid out at once.
LAID_WINDOWS = 50
#: First the driver learns on a draw of at most about so many documents, for so many steps of so many streams.
DRAW, FIRST_STEPS, FIRST_STREAMS = 600, 300, 64
#: Tokens that a task lays out, at two bytes each, before it learns from them.
LAID = 20_000_000
#: Rate of the pass over the corpus.
RATE = 0.002
#: Documents scored side by side.
ABREAST = 1024
END = b""


class Tokens:
    """Tokens of a slice of texts: ``words``, each distinct one once, as bytes; ``at``, the place of every token's word
    among them; ``rows``, the first token of each text, and their number at last. The end of a text is its last token."""

    def __init__(self, part: pa.Array):
        w = DistinctWords(pc.ascii_split_whitespace(pc.ascii_lower(part)))
        at = w.at.to_numpy()
        blank = w.words.index("").as_py()
        real = at != blank
        text = np.repeat(np.arange(len(part), dtype=np.int32), np.diff(w.rows))[real]
        self.rows = np.r_[0, np.cumsum(np.bincount(text, minlength=len(part)) + 1)]
        self.at = np.full(self.rows[-1], blank if blank >= 0 else len(w.words), np.int32)
        self.at[np.arange(len(text)) + text] = at[real]
        self.words = w.words.cast(pa.binary())
        if blank < 0:
            self.words = pa.concat_arrays([self.words, pa.array([END], pa.binary())])


def count_tokens(docs: DataFrame) -> DataFrame:
    """token (binary; the end of a document is empty), n over all texts."""

    def run(batches):
        for b in batches:
            for _, part in pieces_of(b.column(0), 16 << 20):
                tokens = Tokens(part)
                n = np.bincount(tokens.at, minlength=len(tokens.words))
                yield pa.RecordBatch.from_arrays([tokens.words, pa.array(n)], ["token", "n"])

    return docs.select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    counts: dict[bytes, int]  # of the words at hand
    ids: dict[bytes, int]  # of the words with ids; the end has 0
    suffixes: dict[bytes, int]  # class of other words, from 0; the last class has all other suffixes
    rare_tokens: np.ndarray  # by such a class: tokens in the corpus
    rare_words: np.ndarray  # and distinct words
    total: int
    distinct: int

    def rare_class(self, word: bytes) -> int:
        return self.suffixes.get(word[-2:], RARE - 1)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """What tasks need of the counts: of fixed size, but for the sums, which run over all words."""
    total, distinct = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    # a word's level is the logarithm of its count, so there are some thousand levels, whatever the corpus
    level = F.floor(F.log("n") * 100)
    words, least = 0, None
    for r in counts.filter("n > 0").groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("v")).orderBy(F.desc("level")).collect():
        words += r["v"]
        if words > AT_HAND:
            break
        least = r["level"]
    top = sorted(((bytes(r["token"]), r["n"]) for r in counts.filter(level >= least).collect()), key=lambda x: (-x[1], x[0])) if least is not None else []
    ids = {END: 0}
    for w, _ in top:
        if len(ids) == WORDS:
            break
        ids.setdefault(w, len(ids))
    tails: Counter = Counter()
    for w, n in top:
        if w not in ids:
            tails[w[-2:]] += n
    suffixes = {s: i for i, (s, _) in enumerate(sorted(tails.items(), key=lambda x: (-x[1], x[0]))[: RARE - 1])}
    place: Column = F.lit(RARE - 1)
    if suffixes:
        table = F.create_map(*[x for s, i in suffixes.items() for x in (F.lit(s.hex().upper()), F.lit(i))])
        place = F.coalesce(table[F.hex(F.substring("token", -2, 2))], F.lit(RARE - 1))
    tokens, words = np.zeros(RARE), np.zeros(RARE)
    for r in counts.groupBy(place.alias("k")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        tokens[r["k"]], words[r["k"]] = r["n"], r["v"]
    held = dict(top)
    for w in ids:
        if w in held:
            k = suffixes.get(w[-2:], RARE - 1)
            tokens[k] -= held[w]
            words[k] -= 1
    return Vocabulary(held, ids, suffixes, tokens, words, total or 0, distinct or 0)


def _by_gate(w: np.ndarray) -> np.ndarray:
    """Columns of update, reset and content as three tables, each end to end in memory. The first two are halved, as a gate is
    (1 + tanh(x / 2)) / 2."""
    out = np.ascontiguousarray(w.reshape(len(w), 3, STATE).swapaxes(0, 1), np.float32)
    out[:2] *= np.float32(0.5)
    return out


def _side_by_side(w: np.ndarray) -> np.ndarray:
    """Three tables as columns of one."""
    return np.concatenate(list(w), axis=1)


@dataclass
class Network:
    """p: embedding of inputs, weights of the gates, of the classes and of the words in a class."""

    p: dict[str, np.ndarray]
    m: dict = field(default_factory=dict)
    t: int = 0
    scratch: dict = field(default_factory=dict)

    def room(self, name: str, *shape: int) -> np.ndarray:
        """An array that is kept from window to window: fresh memory costs as much time as the arithmetic."""
        n = math.prod(shape)
        if name not in self.scratch or self.scratch[name].size < n:
            self.scratch[name] = np.empty(n, np.float32)
        return self.scratch[name][:n].reshape(shape)

    @staticmethod
    def fresh(words: int, log_share: np.ndarray, log_in_class: np.ndarray, seed: int = 0) -> "Network":
        """Starts at the corpus's own frequencies; places of a class without a word have no share."""
        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) / math.sqrt(s[-2])).astype(np.float32)
        return Network({"e": 0.3 * r.standard_normal((WORDS + RARE, EMBED)).astype(np.float32), "wx": f(EMBED, 3 * STATE), "b": np.zeros(3 * STATE, np.float32), "u": f(STATE, 3 * STATE), "wc": 0.3 * f(STATE, CLASSES), "bc": log_share.astype(np.float32), "wo": 0.3 * f(WORDS // PER, STATE, PER), "bo": log_in_class.astype(np.float32)})

    def step(self, xp: np.ndarray, u: np.ndarray, h: np.ndarray, acts: np.ndarray | None = None, passed: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
        """Next state. xp, u: what inputs and states add, by gate; acts: room for update, reset and new content; passed: for what
        the reset gate meets of the state."""
        acts = np.matmul(h, u, out=acts)
        gates, c = acts[:2], acts[2]
        if passed is not None:
            passed[:] = c
        gates += xp[:2]
        np.tanh(gates, out=gates)
        gates *= np.float32(0.5)
        gates += np.float32(0.5)
        c *= acts[1]
        c += xp[2]
        np.tanh(c, out=c)
        after = np.subtract(h, c, out=after)
        after *= acts[0]
        after += c
        return after

    def table(self) -> np.ndarray:
        """What each input adds, by gate."""
        return _by_gate(self.p["e"] @ self.p["wx"] + self.p["b"])

    def train_window(self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, h: np.ndarray, rate: float) -> np.ndarray:
        """One window of every stream: x, y (steps, streams) inputs and targets, y < 0 for none; fresh: a document starts here."""
        p, s, (steps, streams) = self.p, STATE, x.shape
        g, starts = {}, fresh.any(1).tolist()
        xp = np.take(self.table(), x, axis=1, out=self.room("xp", 3, steps, streams, s), mode="clip")
        before, after, passed = (self.room(k, steps, streams, s) for k in ("before", "after", "passed"))
        acts, u = self.room("acts", steps, 3, streams, s), _by_gate(p["u"])
        for t in range(steps):
            before[t] = h
            if starts[t]:
                before[t][fresh[t]] = 0
            h = self.step(xp[:, t], u, before[t], acts[t], passed[t], after[t])
        hk, tk = after.reshape(-1, s), y.reshape(-1)
        known = None
        if (tk < 0).any():
            known = np.flatnonzero(tk >= 0)
            hk, tk = hk[known], tk[known]
        n = max(1, len(tk))
        cls = np.where(tk < WORDS, tk // PER, WORDS // PER + tk - WORDS)
        d = np.matmul(hk, p["wc"], out=self.room("classes", len(hk), CLASSES))
        d = _slopes(d, p["bc"] - _above(p["wc"], p["bc"]), cls, n)
        g["wc"], g["bc"] = hk.T @ d, np.ones(len(d), np.float32) @ d
        dk = np.matmul(d, p["wc"].T, out=self.room("dk", len(hk), s))
        order, cut = by_class(cls)
        ho, to = hk[order], tk[order]
        d, back = self.room("words", len(order), PER), self.room("back", len(order), s)
        bias = p["bo"] - _above(p["wo"], p["bo"])
        used = [(c, slice(a, b)) for c, (a, b) in enumerate(zip(cut, cut[1:])) if a < b]
        for c, own in used:
            np.matmul(ho[own], p["wo"][c], out=d[own])
            d[own] += bias[c]
        d = _slopes(d, None, to % PER, n)
        g["wo"], g["bo"] = np.zeros_like(p["wo"]), np.zeros_like(p["bo"])
        if used:
            g["bo"][[c for c, _ in used]] = np.add.reduceat(d, [own.start for _, own in used], axis=0)
        for c, own in used:
            g["wo"][c] = ho[own].T @ d[own]
            np.matmul(d[own], p["wo"][c].T, out=back[own])
        dk[order] += back
        if known is not None:
            dh = np.zeros((steps * streams, s), np.float32)
            dh[known] = dk
            dk = dh
        dh = dk.reshape(steps, streams, s)
        # slopes of update, reset and content by what inputs add; and of the last, behind the reset gate, by what states add
        dx, dp = self.room("dx", 3, steps, streams, s), self.room("dp", steps, streams, s)
        ut, back = np.ascontiguousarray(p["u"].reshape(s, 3, s).transpose(1, 2, 0)), np.zeros((streams, s), np.float32)
        ahead, one = self.room("ahead", 3, streams, s), np.float32(1)
        for t in range(steps - 1, -1, -1):
            (z, r, c), dt, dc = acts[t], dh[t], dx[2, t]
            dt += back
            keep = dt * z
            dt -= keep  # what passes through the new content
            np.multiply(c, c, out=dc)
            np.subtract(one, dc, out=dc)
            dc *= dt
            np.multiply(dc, r, out=dp[t])
            own = np.subtract(before[t], c, out=dx[0, t])
            own *= keep
            own *= one - z
            own = np.multiply(dp[t], passed[t], out=dx[1, t])
            own *= one - r
            np.matmul(dx[:2, t], ut[:2], out=ahead[:2])
            np.matmul(dp[t], ut[2], out=ahead[2])
            back = keep
            for k in range(3):
                back += ahead[k]
            if starts[t]:
                back[fresh[t]] = 0
        flat, at = dx.reshape(3, -1, s), x.reshape(-1)
        states, n = before.reshape(-1, s).T, np.ones(len(at), np.float32)
        g["u"] = np.concatenate([states @ flat[0], states @ flat[1], states @ dp.reshape(-1, s)], axis=1)
        g["b"], g["wx"] = np.concatenate(list(n @ flat)), _side_by_side(p["e"][at].T @ flat)
        order = np.argsort(at.astype(np.int16), kind="stable")
        at = at[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        g["e"] = np.zeros_like(p["e"])
        g["e"][at[first]] = np.add.reduceat(sum(flat[k] @ p["wx"][:, k * s : (k + 1) * s].T for k in range(3))[order], first, axis=0)
        h = h.copy()
        self._adam(g, rate)
        return h

    def _adam(self, g: dict[str, np.ndarray], rate: float) -> None:
        norm = math.sqrt(sum(float((v * v).sum()) for v in g.values()))
        cut = min(1.0, 5.0 / (norm + 1e-12))
        self.t += 1
        for k, v in g.items():
            a, b = self.m.setdefault(k, (np.zeros_like(v), np.zeros_like(v)))
            a += 0.1 * (cut * v - a)
            b += 0.01 * ((cut * v) ** 2 - b)
            self.p[k] -= np.float32(rate / (1 - 0.9**self.t)) * a / (np.sqrt(b / (1 - 0.99**self.t)) + np.float32(1e-8))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def unflat(self, x: np.ndarray) -> "Network":
        out, at = {}, 0
        for k in sorted(self.p):
            n = self.p[k].size
            out[k] = x[at : at + n].reshape(self.p[k].shape).astype(np.float32)
            at += n
        return Network(out)

    def log10_likelihood(self, docs: list[np.ndarray]) -> np.ndarray:
        """Of each document's ids, without what a rare word has within its class. Documents of like length go side by side, longest first, each with its own state from start to end."""
        out = np.zeros(len(docs))
        order = np.argsort([-len(d) for d in docs], kind="stable")
        table = self.table()
        for at in range(0, len(order), ABREAST):
            rows = order[at : at + ABREAST]
            out[rows] = self._abreast([docs[i] for i in rows], table)
        return out

    def _abreast(self, docs: list[np.ndarray], table: np.ndarray) -> np.ndarray:
        size = np.array([len(d) for d in docs])  # descending
        every, starts = np.concatenate(docs), np.cumsum(size) - size
        out, h, u = np.zeros(len(docs)), np.zeros((len(docs), STATE), np.float32), _by_gate(self.p["u"])
        states, found, held = [], [], 0
        for t in range(int(size[0])):
            n = int(np.searchsorted(-size, -t, "left"))  # documents longer than t
            x = every[starts[:n] + t - 1] if t else np.zeros(n, np.int64)
            h = self.step(np.take(table, x, axis=1), u, h[:n])
            states.append(h)
            found.append(every[starts[:n] + t])
            held += n
            if held >= 32_768 or t + 1 == size[0]:
                got = self._log10(np.concatenate(states), np.concatenate(found))
                out += np.bincount(np.concatenate([np.arange(len(f)) for f in found]), got, minlength=len(docs))
                states, found, held = [], [], 0
        return out

    def _log10(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        cls = np.where(y < WORDS, y // PER, WORDS // PER + y - WORDS)
        z = h @ self.p["wc"] + self.p["bc"]
        out = z[np.arange(len(y)), cls].astype(np.float64)
        out -= _log_sum(z, _above(self.p["wc"], self.p["bc"]))
        order, cut = by_class(cls)
        ho, z = h[order], np.empty((len(order), PER), h.dtype)
        for c, (a, b) in enumerate(zip(cut, cut[1:])):
            if a < b:
                z[a:b] = ho[a:b] @ self.p["wo"][c] + self.p["bo"][c]
        out[order] += z[np.arange(len(order)), y[order] % PER].astype(np.float64) - _log_sum(z, _above(self.p["wo"], self.p["bo"]))
        return out / math.log(10)


def by_class(cls: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Places of the tokens of words with ids, in order of class, and where each class begins among them."""
    order = np.argsort(cls.astype(np.int16), kind="stable")
    cut = np.searchsorted(cls[order], np.arange(WORDS // PER + 1))
    return order[: cut[-1]], cut.tolist()


def _above(w: np.ndarray, b: np.ndarray) -> np.float32:
    """About the most that a logit can be, as states lie between -1 and 1. One number, taken from every logit of a table
    for its exponential, spares looking for each row's own largest."""
    return np.float32(min((np.abs(w).sum(-2) + b).max(), 60.0))


def _slopes(z: np.ndarray, bias: np.ndarray | None, target: np.ndarray, n: int) -> np.ndarray:
    """Slopes of the mean of n losses by the logits, in their place."""
    if bias is not None:
        z += bias
    np.exp(z, out=z)
    z *= (1 / n / z.sum(1, keepdims=True)).astype(np.float32)
    z[np.arange(len(z)), target] -= np.float32(1 / n)
    return z


def _log_sum(z: np.ndarray, above: np.float32) -> np.ndarray:
    z -= above
    return above + np.log(np.exp(z, out=z).sum(1))


class Lookup:
    """Words to ids and counts; each distinct word of a slice is looked up once."""

    def __init__(self, v: Vocabulary):
        self.v, self.place = v, {w: i for i, w in enumerate(v.counts)}
        for w in v.ids:
            self.place.setdefault(w, len(self.place))
        self.id = np.array([v.ids.get(w, WORDS + v.rare_class(w)) for w in self.place], np.int64)
        self.log = np.array([math.log10(v.counts.get(w, 0) + 1) for w in self.place])

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ids, and the place of each word among those at hand, -1 for none."""
        get = self.place.get
        at = np.array([get(w, -1) for w in words], np.int64)
        ids = self.id[at]
        other = np.flatnonzero(at < 0).tolist()
        ids[other] = [WORDS + self.v.rare_class(words[i]) for i in other]
        return ids, at

    def texts(self, column: pa.Array, most_bytes: int = 24 << 20) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for _, part in pieces_of(column, most_bytes):
            tokens = Tokens(part)
            ids = self(tokens.words.to_pylist())[0][tokens.at]
            for a, b in zip(tokens.rows.tolist(), tokens.rows[1:].tolist()):
                yield ids[a:b]


def start_network(v: Vocabulary) -> Network:
    count = np.zeros(WORDS)
    for w, i in v.ids.items():
        count[i] = v.counts.get(w, 0) + 1
    by_class = count.reshape(-1, PER)
    share = np.r_[by_class.sum(1), v.rare_tokens + 1]
    in_class = np.where(by_class > 0, np.log(np.maximum(by_class, 1e-9) / np.maximum(by_class.sum(1, keepdims=True), 1e-9)), -40.0)
    return Network.fresh(WORDS, np.log(np.maximum(share, 1e-3) / share.sum()), np.maximum(in_class, -40.0))


def whole(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.r_[0, ids[:-1]], ids


def learn(net: Network, texts: list[tuple[np.ndarray, np.ndarray]], rate: float, steps: int) -> None:
    """Lays texts (inputs, targets) end to end in streams and learns window by window for so many steps, over and over; the
    state is carried from window to window of a text."""
    if not texts:
        return
    x, y = (np.concatenate(p) for p in zip(*texts))
    fresh = np.concatenate([np.r_[True, np.zeros(len(t[0]) - 1, bool)] for t in texts])
    streams = max(1, min(FIRST_STREAMS, len(x) // WINDOW))
    long = -(-len(x) // streams)
    pad = streams * long - len(x)
    x, y, fresh = (np.r_[a, np.full(pad, f)].reshape(streams, long).T for a, f in ((x, 0), (y, -1), (fresh, False)))
    done = 0
    while done < steps:
        h = np.zeros((streams, STATE), np.float32)
        for start in range(0, min(long, WINDOW * (steps - done)), WINDOW):
            part = slice(start, start + WINDOW)
            h = net.train_window(x[part], y[part], fresh[part], h, rate * (1 - 0.8 * done / steps))
            done += 1


def learn_whole(net: Network, texts: list[np.ndarray], rate: float) -> int:
    """Learns once from every token of the texts (ids), each with the state carried from its start: a text lies whole in one
    stream, the longest first in the shortest, and a window has the streams that are not at their end. There are fewer
    streams if the longest text would outlast the others. Returns the tokens."""
    texts = sorted(filter(len, texts), key=lambda t: -len(t))
    if not texts:
        return 0
    total = sum(map(len, texts))
    count = min(len(texts), max(LEAST_STREAMS, min(STREAMS, total // len(texts[0]))))
    ends, streams = [(0, i) for i in range(count)], [[] for _ in range(count)]
    for t in texts:
        n, i = heapq.heappop(ends)
        streams[i].append(t)
        heapq.heappush(ends, (n + len(t), i))
    streams = [streams[i] for _, i in sorted(ends, reverse=True)]
    size = np.array([sum(map(len, own)) for own in streams])
    ids = [np.concatenate(own) for own in streams]
    starts = [np.cumsum([0, *map(len, own[:-1])]) for own in streams]
    h = np.zeros((count, STATE), np.float32)
    for begin in range(0, int(size[0]), WINDOW * LAID_WINDOWS):
        # so many windows are laid out at once: a row a step, from the token before the first one
        n, steps = int((size > begin).sum()), min(WINDOW * LAID_WINDOWS, int(size[0]) - begin)
        y, fresh = np.full((n, steps + 1), -1, np.int16), np.zeros((n, steps), bool)
        for i in range(n):
            part = ids[i][max(begin - 1, 0) : begin + steps]
            y[i, (begin == 0) : (begin == 0) + len(part)] = part
            a, b = np.searchsorted(starts[i], (begin, begin + steps))
            fresh[i, starts[i][a:b] - begin] = True
        y, fresh = np.ascontiguousarray(y.T), np.ascontiguousarray(fresh.T)
        x = np.where(fresh, 0, np.maximum(y[:-1], 0))
        for at in range(0, steps, WINDOW):
            own, m = slice(at, at + WINDOW), int((size > begin + at).sum())
            h = net.train_window(x[own, :m].astype(np.int64), y[at + 1 : at + 1 + WINDOW, :m].astype(np.int64), fresh[own, :m], h[:m], rate)
    return total


WEIGHTS = "part long, tokens long, weights binary"


def _weights(parts, tokens, weights) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(tokens, pa.int64()), pa.array([w.astype("<f4").tobytes() for w in weights], pa.binary())], ["part", "tokens", "weights"])


def one_pass(docs: DataFrame, shared, begun) -> DataFrame:
    """part, tokens (learned from), weights of each partition; shared, begun: broadcast vocabulary and weights to start at."""

    def go_on(batches):
        look = Lookup(shared.value)
        own, held, size, seen = start_network(shared.value).unflat(begun.value), [], 0, 0
        for b in batches:
            for ids in look.texts(b.column(0)):
                held.append(ids.astype(np.int16))
                size += len(ids)
                if size >= LAID:
                    seen += learn_whole(own, held, RATE)
                    held, size = [], 0
        seen += learn_whole(own, held, RATE)
        if seen:
            yield _weights([TaskContext.get().partitionId()], [seen], [own.flat()])

    return docs.select("text").mapInArrow(go_on, WEIGHTS)


def train(docs: DataFrame, v: Vocabulary) -> Network:
    """The driver learns on a bounded draw; then each partition learns on from there, on every token of every one of its
    documents. The weights are averaged by tokens in a tree of groups of 32, so no task and not the driver holds more
    than so many of them."""
    spark = docs.sparkSession
    n = docs.count()
    net = start_network(v)
    if not n:
        return net
    shared = spark.sparkContext.broadcast(v)

    def encoded(batches):
        look = Lookup(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([ids.astype("<i4").tobytes() for ids in look.texts(b.column(0))], pa.binary())], ["ids"])

    drawn = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.lit(DRAW / n * (1 << 30))).select("text").distinct()
    first = sorted(bytes(r["ids"]) for r in drawn.mapInArrow(encoded, "ids binary").collect())
    order = np.random.default_rng(0).permutation(len(first))
    learn(net, [whole(np.frombuffer(first[i], "<i4").astype(np.int64)) for i in order], 0.01, FIRST_STEPS)

    def average(t: pa.Table) -> pa.Table:
        total, mean = 0, 0.0
        for k, data in sorted(zip(t["tokens"].to_pylist(), t["weights"].to_pylist())):
            total += k
            mean = mean + (np.frombuffer(data, "<f4") - mean) * (k / total)
        return pa.Table.from_batches([_weights([t["part"][0].as_py() // 32], [total], [mean])])

    parts = materialize(one_pass(docs, shared, spark.sparkContext.broadcast(net.flat())), "weights")
    while parts.count() > 32:
        parts = materialize(parts.groupBy(F.expr("part div 32")).applyInArrow(average, WEIGHTS), "weights")
    rows = [(r["tokens"], bytes(r["weights"])) for r in parts.collect()]
    if not rows:
        return net
    total = sum(k for k, _ in rows)
    return net.unflat(sum(np.frombuffer(w, "<f4").astype(np.float64) * (k / total) for k, w in sorted(rows)))


def score(docs: DataFrame, counts: DataFrame, v: Vocabulary, net: Network) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every document.

    A task knows the counts of frequent words; the others it lists, and these meet the table of counts in one join of
    (document, word) rows. A null or empty text is its end alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast((v, net))

    def run(batches):
        voc, model = shared.value
        look = Lookup(voc)
        floor = math.log10(voc.total + voc.distinct + 1)
        rare = np.log10(voc.rare_tokens + voc.rare_words + 1)
        known = np.array([voc.counts.get(w, 0) > 0 for w in look.place])
        for b in batches:
            for first, part in pieces_of(b.column(1), 16 << 20):
                tokens = Tokens(part)
                ids, place = look(tokens.words.to_pylist())
                met = place >= 0
                log, seen = np.where(met, look.log[place], 0.0), met & known[place]
                # of a rare word's share, the denominator here; the numerator is in the logs, or comes by the join
                in_class = np.where(ids >= WORDS, log - rare[np.maximum(ids - WORDS, 0)], 0.0)
                n, text = np.diff(tokens.rows), np.repeat(np.arange(len(part), dtype=np.int32), np.diff(tokens.rows))
                total = lambda x: np.bincount(text, x[tokens.at], len(part))  # noqa: B023, E731
                own = ids[tokens.at]
                score = total(in_class) + model.log10_likelihood(np.split(own, tokens.rows[1:-1]))
                other = np.flatnonzero(~met[tokens.at])
                pair, times = np.unique(text[other].astype(np.int64) * len(tokens.words) + tokens.at[other], return_counts=True)
                ends = pa.array(np.searchsorted(pair, np.arange(len(part) + 1) * len(tokens.words)), pa.int32())
                listed = pa.ListArray.from_arrays(ends, tokens.words.take(pa.array(pair % len(tokens.words))))
                counts = pa.ListArray.from_arrays(ends, pa.array(times, pa.int32()))
                columns = [b.column(0).slice(first, len(part)).cast(pa.int64()), pa.array(n), pa.array(total(seen).astype(np.int64)), pa.array(total(log) - n * floor), pa.array(score), listed, counts]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "base_score", "score", "tokens", "times"])

    kind = "doc_id long, n_tokens long, n_known long, base_score double, score double, tokens array<binary>, times array<int>"
    scored = materialize(docs.select("doc_id", "text").mapInArrow(run, kind).withColumn("row", F.monotonically_increasing_id()), "scored")
    listed = scored.select("row", F.explode(F.arrays_zip("tokens", "times")).alias("x")).select("row", F.col("x.tokens").alias("token"), F.col("x.times").alias("times"))
    met = listed.join(counts, "token").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs"))
    out = scored.drop("tokens", "times").join(met, "row", "left")
    more, logs = F.coalesce("more", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    return out.select("doc_id", "n_tokens", (F.col("n_known") + more).alias("n_known"), (F.col("base_score") + logs).alias("base_score"), (F.col("score") + logs).alias("score"))


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document, learning from those not held out.

    A null or empty text is its end alone. A null doc_id counts as the empty text where documents are held out. Rows that
    repeat are scored each, and learned from each. An empty table gives no rows; if all documents are held out, nothing is
    known and N and V are 0. Words of equal count are ranked by their bytes.
    """
    held_out = is_held_out(F.col("doc_id"), 7, 2)
    learned = docs.filter(~held_out).select("doc_id", "text")
    counts = materialize(count_tokens(learned), "token-counts")
    v = vocabulary(counts)
    out = score(docs, counts, v, train(learned, v))
    return out.withColumn("held_out", held_out).withColumn("train_tokens", F.lit(v.total).cast("long")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
