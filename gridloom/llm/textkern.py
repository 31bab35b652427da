"""Vectorised text kernels over Arrow string buffers.

All of them work on whole texts, a slice of documents at a time, without making a Python string for each word. A word is a maximal run
of bytes outside 0x20 and 0x09-0x0D; since these are ASCII, UTF-8 texts can be
cut by byte. Hashes are 64 bits wide: texts with equal hashes and lengths
count as equal, which is wrong once in about 1.8e19 pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
U = np.uint64
WS = np.zeros(256, bool)
WS[[0x20, *range(0x09, 0x0E)]] = True
_B = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BINV = pow(_B, -1, 1 << 64)
BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
BYTE_LOWER = BYTE.copy()
BYTE_LOWER[65:91] = BYTE[97:123]
_C = [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the output."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, b in enumerate((_B, _BINV)):
            p = np.full(max(n, SLICE + 1), b, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def slices(strings: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets from 0, bytes) of runs of rows of about ``size`` bytes; null rows are empty."""
    if isinstance(strings, pa.ChunkedArray):
        strings = strings.combine_chunks()
    if strings.null_count:
        strings = strings.fill_null("")
    wide = pa.types.is_large_string(strings.type) or pa.types.is_large_binary(strings.type)
    if not wide and not (pa.types.is_string(strings.type) or pa.types.is_binary(strings.type)):
        strings = strings.cast(pa.large_string())
        wide = True
    n = len(strings)
    if not n:
        return
    _, off, data = strings.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[strings.offset : strings.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + size, "right")) - 1)
        yield a, b, off[a : b + 1] - off[a], data[off[a] : off[b]]
        a = b


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order; by sorting, which is faster here than hashing them."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


class Hasher:
    """Hashes of any byte ranges of one slice, from one prefix sum."""

    def __init__(self, data: np.ndarray, table: np.ndarray = BYTE):
        pw, self.inverse = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * pw[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * U(_C[0]))


def words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in bytes, and for each row the number of the first word (with an end)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~WS[data]
    new = np.zeros(len(data) + 1, bool)
    new[offsets] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | new))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | new))
    return start, end, np.searchsorted(start, offsets)


def shingles(word: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words of each row, in order: (hash, first shingle of each row with an end, word at which each starts)."""
    n = np.diff(first)
    m = np.maximum(n - k + 1, 0)
    bounds = np.concatenate(([0], np.cumsum(m)))
    at = np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], m)
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        h += word[at + j] * U(_C[j % 5] + 2 * (j // 5))
    return mix(h), bounds, at


def shingle_sets(offsets: np.ndarray, data: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of each row, A-Z lower-cased: (hashes sorted within the row, bounds).

    A row of fewer than ``k`` words has its whole sequence as one shingle, a
    row without words has none.
    """
    start, end, first = words(offsets, data)
    word = Hasher(data, BYTE_LOWER).of(start, end)
    h, bounds, _ = shingles(word, first, k)
    n, rows = np.diff(first), len(offsets) - 1
    parts: list[np.ndarray] = []
    size = np.zeros(rows, np.int64)
    for r in range(rows):
        if n[r] >= k:
            x = np.sort(h[bounds[r] : bounds[r + 1]])
            if len(x) > 1:
                x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        elif n[r]:
            x = np.zeros(1, np.uint64)
            for j in range(n[r]):
                x = mix(x * U(_C[1]) + word[first[r] + j] + U(n[r]))
        else:
            continue
        parts.append(x)
        size[r] = len(x)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(size)))
