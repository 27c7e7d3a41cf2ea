"""Runs of letters or word characters in UTF-8 texts: cut, told apart and hashed in numpy and Arrow."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from buildlens.llm.common import pieces_of

#: Bytes of texts that are looked at together; a longer text comes in several pieces, cut between runs.
PIECE = 8 << 20


def lower_table() -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = lower_table()
_AT = np.arange(256)
#: Digits, letters and all that is not ASCII.
WORD_BYTES = (_AT >= 0x80) | ((_AT >= 48) & (_AT < 58)) | ((_AT >= 65) & (_AT < 91)) | ((_AT >= 97) & (_AT < 123))
#: ASCII letters, and the first byte of U+00C0 to U+00FF; its second byte follows.
LETTER_BYTES = ((_AT >= 65) & (_AT < 91)) | ((_AT >= 97) & (_AT < 123)) | (_AT == 0xC3)


def word_mask(b: np.ndarray) -> np.ndarray:
    return WORD_BYTES[b]


def letter_mask(b: np.ndarray) -> np.ndarray:
    mask = LETTER_BYTES[b]
    mask[1:] |= b[:-1] == 0xC3
    return mask


class Runs:
    """Lower-cased runs of some texts: ``words`` has each distinct one, ``at`` every run's place among them, ``rows`` the first
    run of each text and their number at last."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, mask_of):
        mask = mask_of(data) if len(data) else np.zeros(0, bool)
        begins = mask.copy()
        begins[1:] &= ~mask[:-1]
        inner = offsets[:-1][offsets[:-1] < len(data)]
        begins[inner] = mask[inner]  # a run ends where its text does
        starts = np.flatnonzero(begins)
        before = np.cumsum(mask)
        ends = np.r_[before[starts] - 1, before[-1] if len(before) else 0].astype(np.int64)
        kept = LOWER[data[mask]]
        runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(kept))])
        coded = runs.dictionary_encode()
        self.words = coded.dictionary.to_pylist()
        self.at = coded.indices.to_numpy()
        self.lengths = np.diff(ends)
        self.rows = np.searchsorted(starts, offsets)


def runs_of(texts: pa.Array, mask_of, most_bytes: int | None = None) -> Iterator[tuple[int, int, Runs]]:
    """(first row, part, runs) of slices of the texts. Part is 0, but for the second and later pieces of a long text; these are
    cut where no run is."""
    most = most_bytes or PIECE
    for at, part in pieces_of(texts.cast(pa.large_binary()), most):
        buffers, first = part.buffers(), part.offset
        offsets = np.frombuffer(buffers[1], np.int64)[first : first + len(part) + 1]
        data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        if len(part) > 1 or len(data) <= most:
            yield at, 0, Runs(data, offsets, mask_of)
            continue
        begin = piece = 0
        while begin < len(data):
            end = min(begin + most, len(data))
            while end < len(data):  # on to the next byte that is in no run
                gap = np.flatnonzero(~mask_of(data[end - 1 : end + most])[1:])
                if len(gap):
                    end += int(gap[0])
                    break
                end = min(end + most, len(data))
            yield at, piece, Runs(data[begin:end], np.array([0, end - begin]), mask_of)
            begin, piece = end, piece + 1


# CRC-32 of words that follow one another


@lru_cache(1)
def _byte_step() -> np.ndarray:
    """The register of the reflected polynomial EDB88320 after one more byte."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


def _applied(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    return table[0][c & 255] ^ table[1][c >> 8 & 255] ^ table[2][c >> 16 & 255] ^ table[3][c >> 24]


@lru_cache(1)
def _shift_tables() -> tuple[np.ndarray, np.ndarray]:
    """What each byte of a checksum becomes when so many zero bytes follow: for 0 to 64 bytes, and for powers of two."""
    step = _byte_step()
    start = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    short = [start]
    for _ in range(64):
        short.append((short[-1] >> 8) ^ step[short[-1] & 255])
    powers = [short[1]]
    for _ in range(31):
        powers.append(_applied(powers[-1], powers[-1]))
    return np.stack(short), np.stack(powers)


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The part of a checksum of a + b that comes of a: of a's checksum, and b's length in bytes. XORed with b's own, it is the
    checksum of both."""
    short, powers = _shift_tables()
    flat, base = short.reshape(-1), (np.minimum(n, 64) * 1024).astype(np.int64)
    out = flat[base + (crc & 255)] ^ flat[base + 256 + (crc >> 8 & 255)] ^ flat[base + 512 + (crc >> 16 & 255)] ^ flat[base + 768 + (crc >> 24)]
    long = np.flatnonzero(n > 64)
    if len(long):
        c, m = crc[long], n[long].astype(np.int64)
        for k in range(32):
            c = np.where(m >> k & 1, _applied(powers[k], c), c)
        out[long] = c
    return out


def crcs(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
