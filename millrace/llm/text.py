"""Vectorised words, word hashes and word shingles over Arrow string buffers.

A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r. Everything works on the
UTF-8 bytes of a whole batch at once, in slices of bounded size; a document is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
SLICE_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD6E8FEB86659FD93


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The splitmix64 finaliser, on a copy."""
    x = x + U((seed * _BASE + _STEP) & (2**64 - 1))
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows; null rows are empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if len(offs) == 0:
        offs = np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most limit units each, or one row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 2**64)
    out = []
    for base in (_BASE, inverse):
        p = np.full(n, base, U)
        p[0] = 1
        out.append(np.cumprod(p, dtype=U))
    return out[0], out[1]


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of all words, and the word offsets of the rows."""
    full = ~SPACE[buf]
    start, end = full.copy(), full.copy()
    if len(buf):
        start[1:] &= ~full[:-1]
        end[:-1] &= ~full[1:]
        first = offs[:-1][offs[1:] > offs[:-1]]
        start[first] = full[first]
        last = offs[1:][offs[1:] > offs[:-1]] - 1
        end[last] = full[last]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offs)


def word_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words' bytes, from one running sum."""
    if not len(s):
        return np.zeros(0, U)
    up, down = _powers(1 << max(20, int(len(buf)).bit_length()))
    total = np.zeros(len(buf) + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * up[: len(buf)], out=total[1:])
    return mix((total[e] - total[s]) * down[s])


def shingle_hashes(words: np.ndarray, offs: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words in order, and the shingle offsets of the rows. A row of 1 to k-1 words has one shingle, of all its words."""
    n, count = len(words), np.diff(offs)
    sizes = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    at = np.arange(out[-1]) + np.repeat(offs[:-1] - out[:-1], sizes)
    h = np.zeros(max(n - k + 1, 0), U)  # of all runs, then those within a row
    for j in range(k):
        h = mix(h * U(_STEP) + words[j : j + len(h)])
    h = h[np.minimum(at, len(h) - 1)] if len(h) else np.zeros(len(at), U)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        own = np.zeros(len(short), U)
        for j in range(k):
            inside = j < count[short]
            own = mix(own * U(_STEP) + np.where(inside, words[np.minimum(offs[short] + j, n - 1)], U(0)))
        h[out[short]] = own
    return h, out


def text_words(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each slice of rows i to j: the word hashes and the word offsets of its rows."""
    buf, offs = string_bytes(column)
    for i, j in slices(offs, limit):
        part, rel = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        s, e, w = word_spans(part, rel)
        yield i, j, word_hashes(part, s, e), w
