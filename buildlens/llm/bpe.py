"""Byte-pair encoding by a tokenization automaton.

The automaton reads token labels. Before any merge it has one state and an arc for each base symbol. A merge (a, b) -> c
adds its gadget: no arc b leaves the state that an a leads to any more; an arc c is added beside each arc a that is left,
and leads where b led. After the last merge a label sequence is accepted just if it is the encoding of its text, so
exactly one path spells a given word. States that allow the same arcs are one, labels that the same states allow are one.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from buildlens.llm.common import DistinctWords, end_to_end, pieces_of

#: The cut of the word tokenizer before its merges: a fixed value of its public configuration. White space is Unicode's.
#: A line break is a word here, to tell the chunks of a text apart.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+|\n")
#: The same for lower-case ASCII.
ASCII_WORDS = re.compile(r"[a-z]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\t-\r a-z0-9]+|\n")
#: Words of more symbols than this are spelled one at a time instead of in columns of equal length.
LONG_WORD = 48


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


@dataclass
class Automaton:
    """Tables alone: arcs[state of the last token, class of the next label], and the trie that spells labels."""

    arcs: np.ndarray  # a bit for each state and label class; state 0 is the start
    state_after: np.ndarray  # by token
    label_class: np.ndarray  # by token
    trie_keys: np.ndarray  # node * 512 + symbol, ascending; symbols from 256 end a word
    trie_next: np.ndarray
    node_token: np.ndarray  # -1: no label ends here
    labels: list[str]  # by token
    longest: int

    def allows(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        label = self.label_class[token]
        return (self.arcs[state, label >> 3] >> (7 - (label & 7)) & 1).astype(bool)

    def step(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The trie's next node, or -1."""
        key = node * 512 + symbol
        at = np.searchsorted(self.trie_keys, key)
        at[at == len(self.trie_keys)] = 0
        return np.where(self.trie_keys[at] == key, self.trie_next[at], -1)


def compile_automaton(vocab: dict[str, int], merges: list[tuple[str, str]], end: str = "</w>", extra: dict[str, int] | None = None) -> Automaton:
    """Adds the merges' gadgets one after another.

    A gadget takes one arc away, so it parts at most one state and one label class from those that they were one with;
    the new label shares a's class of labels and b's state. Hence a merge costs one row and one column of the table. The
    table is bits from the start: a byte for each arc takes 160 MB, and twice that while it grows, in every worker at once.
    """
    size = max([*vocab.values(), *(extra or {}).values()]) + 1
    arcs = np.zeros((2048, 256), np.uint8)
    arcs[0, 0] = arcs[1, 0] = 128
    state, label = np.full(size, 1), np.zeros(size, int)  # the start allows all; so does a base symbol, until merges say otherwise
    states, classes = 2, 1
    in_state, in_class = {1: size}, {0: size}
    for left, right in merges:
        a, b, c = vocab[left], vocab[right], vocab[left + right]
        if states == arcs.shape[0]:
            arcs = np.vstack([arcs, np.zeros((2048, arcs.shape[1]), np.uint8)])
        if classes == 8 * arcs.shape[1]:
            arcs = np.hstack([arcs, np.zeros((arcs.shape[0], 256), np.uint8)])
        before = state[b]
        if in_state[state[a]] > 1 or a == b:
            arcs[states] = arcs[state[a]]
            in_state[state[a]] -= 1
            state[a], in_state[states], states = states, 1, states + 1
        if in_class[label[b]] > 1:
            like = int(label[b])
            arcs[:, classes >> 3] |= (arcs[:, like >> 3] >> (7 - (like & 7)) & 1) << (7 - (classes & 7))
            in_class[label[b]] -= 1
            label[b], in_class[classes], classes = classes, 1, classes + 1
        arcs[state[a], label[b] >> 3] &= 255 - (128 >> (int(label[b]) & 7))
        in_state[state[c]] -= 1
        in_class[label[c]] -= 1
        state[c], label[c] = before, label[a]
        in_state[before] += 1
        in_class[label[a]] += 1
    byte_of = {s: i for i, s in enumerate(byte_symbols())}
    tree: list[dict[int, int]] = [{}]
    token_at, labels, longest = [-1], [""] * size, 0
    for text, token in vocab.items():
        labels[token] = text
        ends = bool(end) and text.endswith(end)
        chars = text[: -len(end)] if ends else text
        if not chars or any(ch not in byte_of for ch in chars):
            continue
        symbols = [byte_of[ch] for ch in chars]
        symbols[-1] += 256 * ends
        node = 0
        for s in symbols:
            if s not in tree[node]:
                tree[node][s] = len(tree)
                tree.append({})
                token_at.append(-1)
            node = tree[node][s]
        token_at[node], longest = token, max(longest, len(symbols))
    for text, token in (extra or {}).items():
        labels[token] = text
    pairs = np.array(sorted((n * 512 + s, m) for n, t in enumerate(tree) for s, m in t.items()), np.int64)
    return Automaton(arcs[:states, : classes + 7 >> 3].copy(), state.astype(np.int32), label.astype(np.int32), pairs[:, 0].copy(), pairs[:, 1].copy(), np.array(token_at, np.int64), labels, longest)


def _spell_columns(m: Automaton, words: np.ndarray) -> list[list[int]]:
    """Token ids of words of one length; words: symbols, a row for each word.

    state[:, j] is where the automaton stands after the encoding of the first j symbols. Every label that starts at j
    is followed through the trie; it is taken if the state at j has its arc. Just one label that ends at each place is.
    """
    count, n = words.shape
    state = np.zeros((n + 1, count), np.int32)
    token = np.full((n + 1, count), -1, np.int64)
    length = np.zeros((n + 1, count), np.int64)
    symbols = np.ascontiguousarray(words.T)
    for j in range(n):
        rows = np.flatnonzero(token[j] >= 0) if j else np.arange(count)
        node = np.zeros(len(rows), np.int64)
        for k in range(j, min(n, j + m.longest)):
            node = m.step(node, symbols[k, rows])
            going = node >= 0
            rows, node = rows[going], node[going]
            if not len(rows):
                break
            found = m.node_token[node]
            some = np.flatnonzero(found >= 0)
            r, t = rows[some], found[some]
            taken = m.allows(state[j, r], t)
            r, t = r[taken], t[taken]
            token[k + 1, r], length[k + 1, r], state[k + 1, r] = t, k + 1 - j, m.state_after[t]
    back, at, rows = [], np.full(count, n), np.arange(count)
    while at.any():
        back.append(np.where(at > 0, token[at, rows], -1))
        at = at - length[at, rows]
    return [[i for i in row if i >= 0] for row in np.stack(back[::-1], 1).tolist()]


def _spell_long(m: Automaton, word: np.ndarray, tree: dict[int, int]) -> list[int]:
    """The same for one long word, symbol by symbol."""
    n = len(word)
    state, token, length = [0] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
    symbols = word.tolist()
    for j in range(n):
        if j and token[j] < 0:
            continue
        node, row = 0, np.unpackbits(m.arcs[state[j]])
        for k in range(j, min(n, j + m.longest)):
            node = tree.get(node * 512 + symbols[k], -1)
            if node < 0:
                break
            t = int(m.node_token[node])
            if t >= 0 and row[m.label_class[t]]:
                token[k + 1], length[k + 1], state[k + 1] = t, k + 1 - j, int(m.state_after[t])
    ids, at = [], n
    while at:
        ids.append(token[at])
        at -= length[at]
    return ids[::-1]


def _plain_words(text: str) -> list[str]:
    if text.isascii():
        return ASCII_WORDS.findall(text.lower())
    return WORDS.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())


class Encoder:
    """Encodes and decodes whole texts; remembers at most ``keep`` words, but for those of the slice at hand."""

    def __init__(self, automaton: Automaton, special: dict[str, int], keep: int = 500_000):
        self.m, self.special, self.keep = automaton, special, keep
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.words: dict[str, tuple[bytes, bytes, int]] = {}
        self.decimal = [b"%d " % i for i in range(len(automaton.labels))]
        self.spelled = [f"{t} ".encode() for t in automaton.labels]
        self.tree: dict[int, int] | None = None

    def ids_of_words(self, words: list[str]) -> list[list[int]]:
        coded = [w.encode("utf-8", "replace") for w in words]
        size = np.array([len(c) for c in coded], np.int64)
        starts, data = np.cumsum(size) - size, np.frombuffer(b"".join(coded), np.uint8).astype(np.int64)
        data[starts + size - 1] += 256  # the last symbol of a word is another symbol than the same byte within
        out: list[list[int]] = [[]] * len(words)
        for n in np.unique(size).tolist():
            at = np.flatnonzero(size == n)
            symbols = data[starts[at][:, None] + np.arange(n)]
            if n > LONG_WORD:
                if self.tree is None:
                    self.tree = dict(zip(self.m.trie_keys.tolist(), self.m.trie_next.tolist()))
                found = [_spell_long(self.m, row, self.tree) for row in symbols]
            else:
                found = _spell_columns(self.m, symbols)
            for i, ids in zip(at.tolist(), found):
                out[i] = ids
        return out

    def _words_of(self, chunks: list[str]) -> list[str]:
        """The words of the chunks, a line break after those of each chunk. A special token is a word as it stands."""
        text = "\n".join(chunks) + "\n"
        if self.cut is not None and any(s in text for s in self.special):
            parts = self.cut.split(text)
            return [w for p in parts for w in ([p] if p in self.special else _plain_words(p))]
        return _plain_words(text)

    def _spell(self, ids: list[int]) -> tuple[bytes, bytes, int]:
        return b"".join([self.decimal[i] for i in ids]), b"".join([self.spelled[i] for i in ids]), len(ids)

    def learn(self, words: list[str]) -> list[tuple[bytes, bytes, int]]:
        """Of each word: its ids in decimal and the labels of its path, a space after each, and how many they are."""
        known = self.words
        new = [w for w in words if w not in known]
        if len(known) + len(new) > self.keep:
            known, new = {"\n": (b"", b"", 0)}, [w for w in words if w != "\n"]
            self.words = known
        special = [w for w in new if w in self.special]
        known.update((w, self._spell([self.special[w]])) for w in special)
        if plain := [w for w in new if w not in self.special] if special else new:
            known.update(zip(plain, map(self._spell, self.ids_of_words(plain))))
        return [known[w] for w in words]

    def spelled_texts(self, texts: pa.Array) -> Iterator[tuple[memoryview, memoryview, int]]:
        """Of each text, what ``learn`` gives of a word.

        No word, no composition of characters and no lower-casing reaches across white space, so texts are cut at ASCII
        white space, each distinct chunk is cut into words once, and each distinct word is spelled once.
        """
        self.words.setdefault("\n", (b"", b"", 0))
        for _, part in pieces_of(texts):
            chunks = DistinctWords(pc.ascii_split_whitespace(part))
            words = pa.array(self._words_of(chunks.words.to_pylist()), pa.string()).dictionary_encode()
            found = self.learn(words.dictionary.to_pylist())
            codes = words.indices.to_numpy()
            ends = np.flatnonzero(codes == words.dictionary.index("\n").as_py()) + 1
            rows = np.r_[0, ends]
            ids, labels = (end_to_end(pa.array([x[i] for x in found], pa.large_binary()).take(words.indices), rows) for i in (0, 1))
            total = np.r_[0, np.cumsum(np.array([x[2] for x in found], np.int64)[codes])]
            yield from zip(chunks.joined(ids), chunks.joined(labels), chunks.sums(total[rows[1:]] - total[rows[:-1]]).tolist())

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return [[int(i) for i in bytes(ids).split()] for ids, _, _ in self.spelled_texts(pa.array(texts, pa.string()))]

    def decode(self, ids: list[int]) -> str:
        """The labels along the path, joined by a space, as the library does for a tokenizer that has no decoder."""
        return " ".join([self.m.labels[i] for i in ids if 0 <= i < len(self.m.labels) and self.m.labels[i]])

    def digests(self, texts: pa.Array) -> Iterator[tuple[int, str, str]]:
        """Count of ids, SHA-256 of the ids in decimal, SHA-256 of the decoded text."""
        for ids, labels, n in self.spelled_texts(texts):
            yield n, hashlib.sha256(ids[:-1]).hexdigest(), hashlib.sha256(labels[:-1]).hexdigest()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file; each worker compiles it once."""
    if path not in _encoders:
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        model = config["model"]
        special = {t["content"]: t["id"] for t in config["added_tokens"]}
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        automaton = compile_automaton(model["vocab"], merges, model.get("end_of_word_suffix") or "", special)
        _encoders[path] = Encoder(automaton, special)
    return _encoders[path]


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids (array of int), decoded (string) of every document. A null text is empty and has no ids."""

    def run(batches):
        enc = encoder(tokenizer_path)
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                ids = enc.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([enc.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document: no shuffle, and no list of ids leaves the task.

    A null text is empty: no tokens, and the digests of the empty string. Rows that repeat give rows that repeat.
    """

    def run(batches):
        enc = encoder(tokenizer_path)
        for b in batches:
            if b.num_rows:
                n, ids, text = zip(*enc.digests(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids), pa.array(text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
