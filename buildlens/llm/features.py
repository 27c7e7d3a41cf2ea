"""Feature vectors of texts, and the linear models on them, in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: A text is counted in pieces of this many characters, so a very long one takes no more memory.
PIECE = 1 << 20


@lru_cache(1)
def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def ngram_counts(text: str, dims: int, letters_only: bool, orders: tuple[int, ...] = (1, 2, 3)) -> np.ndarray:
    """Hashed counts of character n-grams of the lower-cased text; letters_only: all else counts as one gap."""
    out = np.zeros(dims)
    longest = max(orders)
    for at in range(0, len(text), PIECE):
        c = codes(text[at : at + PIECE + longest - 1].lower())
        if letters_only:
            c = np.where(letter_table()[np.minimum(c, 0x10FFFF)], c, 0).astype(np.uint32)
            c = np.concatenate([[0], c[(c > 0) | (np.roll(c, 1) > 0)], [0]]).astype(np.uint32)
        h = np.zeros(len(c), np.uint32)
        for n in range(1, longest + 1):
            if len(c) < n:
                break
            h = (h[: len(c) - n + 1] * np.uint32(0x01000193)) ^ (c[n - 1 :] * np.uint32(0x9E3779B1))
            if n in orders:
                mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77 + 2 * n)
                out += np.bincount((mixed >> np.uint32(8)) % np.uint32(dims), minlength=dims)
    return out


def damped(counts: np.ndarray) -> np.ndarray:
    """Root of the counts, to length 1."""
    x = np.sqrt(counts)
    n = np.linalg.norm(x)
    return (x / n if n else x).astype(np.float32)


def pack(x: np.ndarray) -> bytes:
    """The entries that are not 0, as place and value."""
    at = np.flatnonzero(x).astype("<u4")
    return at.tobytes() + x[at].astype("<f4").tobytes()


def table(rows: list[bytes], dims: int) -> np.ndarray:
    """Packed rows as one table."""
    x = np.zeros((len(rows), dims), np.float32)
    for i, data in enumerate(rows):
        at, value = entries(data)
        x[i, at] = value
    return x


def entries(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a packed row."""
    n = len(data) // 8
    return np.frombuffer(data, "<u4", n), np.frombuffer(data, "<f4", n, 4 * n)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 20, seed: int = 0) -> np.ndarray:
    """Weights, with the bias last, of the linear support vector machine; y is 1 or -1. Dual coordinate descent on the hinge
    loss, on the entries of each row that are not 0: no copy of the whole table is made."""
    at = [np.r_[np.flatnonzero(row), x.shape[1]] for row in x]
    rows = [np.r_[row[k[:-1]], 1].astype(np.float64) for row, k in zip(x, at)]
    w, alpha, square = np.zeros(x.shape[1] + 1), np.zeros(len(x)), [float(r @ r) for r in rows]
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in order.permutation(len(x)).tolist():
            was = alpha[i]
            alpha[i] = min(max(was - (y[i] * (rows[i] @ w[at[i]]) - 1) / square[i], 0.0), c)
            if alpha[i] != was:
                w[at[i]] += (alpha[i] - was) * y[i] * rows[i]
    return w


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1.0, rounds: int = 200) -> np.ndarray:
    """Weights, with the bias last, of L2-regularised logistic regression; y from 0 to 1. Accelerated gradient descent, on
    the table as it is: no copy of it is made."""
    weight = np.ones(len(x)) if weight is None else weight
    square = float(weight @ np.einsum("ij,ij->i", x, x)) + weight.sum()
    rate = 1 / (0.25 * square * min(1.0, 4 / (x.shape[1] + 1) + 0.25) + l2)
    penalty = np.r_[np.full(x.shape[1], l2), 1e-6]
    w = v = np.zeros(x.shape[1] + 1)
    for k in range(rounds):
        slope = weight * (sigmoid(x @ v[:-1].astype(x.dtype) + v[-1]) - y)
        step = v - rate * (np.r_[slope.astype(x.dtype) @ x, slope.sum()] + penalty * v)
        w, v = step, step + k / (k + 3) * (step - w)
    return w


def platt(margin: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """a, b of the probability sigmoid(a * margin + b), with Platt's smoothed targets; a is never negative."""
    n1, n0 = positive.sum(), (~positive).sum()
    y = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * margin + b)
        g, s = p - y, p * (1 - p) + 1e-9
        h = np.array([[(s * margin * margin).sum() + 1e-6, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        da, db = np.linalg.solve(h, [(g * margin).sum(), g.sum()])
        a, b = a - float(np.clip(da, -2, 2)), b - float(np.clip(db, -2, 2))
    return max(a, 0.0), b
