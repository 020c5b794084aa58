"""Word spans and 64-bit hashes of words, by numpy over the UTF-8 bytes of an Arrow text column."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer, so that every bit of a hash depends on every bit of ``x``."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_BASE = 0xD6E8FEB86659FD93  # odd, so that it has an inverse modulo 2**64
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, _CHUNK * 2)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans of ``data``, which are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + _CHUNK, side="right")))
        part = data[base : ends[j - 1]]
        up, down = _power(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[e] - sums[s]) * down[s] ^ (e - s).astype(np.uint64) * _STEP)
        i = j
    return out


@dataclass
class Words:
    """Words of a text column. data: its bytes; rows: offsets of the rows in data; starts, ends: of the words; first: for each row, and one more, the number of words before it."""

    data: np.ndarray
    rows: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        return hash_spans(self.data, self.starts, self.ends)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def row_sums(self, weights: np.ndarray) -> np.ndarray:
        """For each row, the sum of ``weights`` (one for each byte)."""
        sums = np.concatenate([[0], np.cumsum(weights, dtype=np.int64)])
        return np.diff(sums[self.rows])


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and the offsets of its rows."""
    _, offsets, data = texts.buffers()
    rows = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[rows[0] : rows[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return raw, rows - rows[0]


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """The words of a string array without nulls; ``lower``: A-Z count as a-z."""
    data, rows = bytes_of(texts)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data | 32, data)
    inside = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[rows] = True
    starts = np.flatnonzero(inside & (cut[:-1] | np.concatenate([[True], ~inside[:-1]])[: len(data)]))
    ends = np.flatnonzero(inside & (cut[1:] | np.concatenate([~inside[1:], [True]])[: len(data)])) + 1
    return Words(data, rows, starts, ends, np.searchsorted(starts, rows))


def shingles(words: Words, hashes: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words, and their offsets by row; a row with fewer words, but one, has one run of all of them."""
    count = np.diff(words.first)
    runs = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    offsets = np.concatenate([[0], np.cumsum(runs)])
    at = np.arange(offsets[-1]) + np.repeat(words.first[:-1] - offsets[:-1], runs)
    last = np.repeat(words.first[1:], runs)
    total = np.zeros(len(at), np.uint64)
    padded = np.concatenate([hashes, np.zeros(n, np.uint64)])
    for i in range(n):
        total = mix(total * _STEP + np.where(at + i < last, padded[at + i], np.uint64(0)) + np.uint64(i + 1))
    return total, offsets
