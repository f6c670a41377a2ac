"""Hashes of words and shingles of whole Arrow columns at once, without an object for each word.

Words are cut at ASCII white space, with A-Z in lower case. A word's hash is a polynomial of its bytes modulo 2^64, taken
from prefix sums over a block of bytes, and mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .common import mix, random_u64

SHINGLE = 5
#: Bytes that prefix sums are taken over at once; a longer word makes its block longer.
BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
#: Multipliers that keep a shingle's words in order.
ORDER = np.array([pow(_BASE, k + 1, 2**64) for k in range(SHINGLE)], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


@lru_cache(maxsize=1)
def _values() -> np.ndarray:
    """A number for each byte, the same for A and a."""
    v = random_u64(256, 17).copy()
    v[65:91] = v[97:123]
    return v


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        p = np.full(n, np.uint64(base))
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def portions(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, where each row ends) of a column of texts, in portions of at most `size` bytes or one row; null is empty."""
    column = column.cast(pa.string()).fill_null("")
    many = len(column)
    if not many:
        return
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + many + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < many:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + size, side="right")) - 1)
        yield i, data[ends[i] : ends[j]], ends[i + 1 : j + 1] - ends[i]
        i = j


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word of the rows that end there."""
    n = len(data)
    inside = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[ends] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:n]
    end = inside
    end[:-1] &= ~inside[1:] | cut[1:n]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    row = np.searchsorted(ends, start, side="right")
    h = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK, side="right")))
        at = start[i]
        block = data[at : end[j - 1]]
        up, down = _powers(max(BLOCK, 1 << (len(block) - 1).bit_length()))
        total = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(_values()[block] * up[: len(block)], out=total[1:])
        s, e = start[i:j] - at, end[i:j] - at
        h[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return h, row


def shingles(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, its first word) of every shingle within one row."""
    n = max(0, len(h) - SHINGLE + 1)
    at = np.flatnonzero(row[SHINGLE - 1 :] == row[:n])
    total = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        total += h[k : k + n] * ORDER[k]
    return mix(total[at]), row[at], at
