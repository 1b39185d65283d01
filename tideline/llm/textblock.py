"""Batches of texts as NumPy arrays: words, word hashes and shingles.

Texts stay the UTF-8 bytes of Arrow's buffers. Words are maximal runs of bytes
other than 0x20 and 0x09-0x0D. A word's hash is a polynomial of its bytes
(upper-case A-Z lowered first), mixed to 64 bits: equal words have equal hashes
in every task, and no Python object is made per word.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15
SEGMENT = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    out = []
    for p in (BASE, inverse):
        a = np.full(n, p, U64)
        a[0] = 1
        out.append(np.cumprod(a, dtype=U64))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = SEGMENT + 1
    while size < n:
        size *= 2
    return _powers(size)


def arrow_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, without a copy; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, most: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``most`` bytes; a longer row is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def trim() -> None:
    """Give memory freed by a finished task back; Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable) -> Callable:
    """``run`` over a partition's batches, then ``trim``."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return whole


def _cuts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about SEGMENT bytes that end at a text's end or at white space."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        to = min(at + SEGMENT, end)
        while to < end and not SPACE[data[to]] and offsets[np.searchsorted(offsets, to)] != to:
            ahead = data[to : to + SEGMENT]
            space = np.flatnonzero(SPACE[ahead])
            stop = int(offsets[np.searchsorted(offsets, to)])
            to = min(stop, to + int(space[0]) if len(space) else to + len(ahead))
        yield at, to
        at = to


class Words:
    """The words of some texts: byte range, hash and text number of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hashes: bool = True):
        starts, ends, hashed = [], [], []
        for a, b in _cuts(data, offsets):
            solid = ~SPACE[data[a:b]]
            first = solid.copy()
            first[1:] &= ~solid[:-1]
            edge = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a
            first[edge] = solid[edge]
            last = solid.copy()
            last[:-1] &= ~solid[1:]
            edge = edge[edge > 0]
            last[edge - 1] = solid[edge - 1]
            s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
            starts.append(s + a)
            ends.append(e + a)
            if hashes:
                up, down = powers(b - a + 1)
                total = np.zeros(b - a + 1, U64)
                np.cumsum((LOWER[data[a:b]].astype(U64) + U64(1)) * up[: b - a], out=total[1:])
                hashed.append(mix((total[e] - total[s]) * down[s]))
        empty = np.zeros(0, np.int64)
        self.data, self.offsets = data, offsets
        self.start = np.concatenate(starts) if starts else empty
        self.end = np.concatenate(ends) if ends else empty
        self.hash = np.concatenate(hashed) if hashed else np.zeros(0, U64)
        self.first = np.searchsorted(self.start, offsets)  # text i has words first[i]:first[i + 1]

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's set of hashed k-word shingles, sorted, as one array and its offsets.

    A text of 1 to k-1 words has one shingle: all its words. Without words the
    set is empty.
    """
    h, first = words.hash, words.first
    n = len(first) - 1
    sets, sizes = [], np.zeros(n, np.int64)
    if len(h) >= k:
        roll = np.zeros(len(h) - k + 1, U64)
        for j in range(k):
            roll = mix(roll * U64(BASE) + h[j : j + len(roll)])
    for i in range(n):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= k:
            s = np.unique(roll[a : b - k + 1])
        elif b > a:
            x = np.array([b - a], U64)
            for j in range(a, b):
                x = mix(x * U64(BASE) + h[j])
            s = x
        else:
            continue
        sets.append(s)
        sizes[i] = len(s)
    flat = np.concatenate(sets) if sets else np.zeros(0, U64)
    return flat, np.concatenate([[0], np.cumsum(sizes)])
