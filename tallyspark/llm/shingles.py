"""Vectorised word hashing and shingle sets over whole texts (numpy, inside Spark tasks).

Words are runs of bytes other than 0x20 and 0x09-0x0D; A-Z is lower-cased.  A
word's hash is a polynomial over random 64-bit byte values, taken from prefix
sums, so the cost is a few array operations per byte whatever the word length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tallyspark.llm.common import text_bytes, text_chunks

_rng = np.random.default_rng(0x7A11)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[np.arange(65, 91)] = _BYTE[np.arange(97, 123)]
_SEP = np.zeros(256, bool)
_SEP[[0x20, 9, 10, 11, 12, 13]] = True
_RUN = np.zeros(256, bool)
_RUN[48:58] = _RUN[65:91] = _RUN[97:123] = _RUN[128:] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_powers = {"n": 0, "up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
_MASK = (1 << 64) - 1
#: Longest stretch of bytes hashed at once; longer texts are cut at a separator.
STRETCH = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = max(n, 1 << 16)
        for key, base in (("up", _BASE), ("down", _INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[key] = np.multiply.accumulate(a)
        _powers["n"] = size
    return _powers["up"][:n], _powers["down"][:n]


def _spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside``; a row's edge ends a run."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(inside))]
    starts[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words."""
    return _spans(~_SEP[data], offsets)


def run_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ASCII letters, digits and bytes beyond ASCII."""
    return _spans(_RUN[data], offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, byte: np.ndarray = _BYTE) -> np.ndarray:
    """Hash of each span, equal for equal (lower-cased) bytes wherever they stand."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + STRETCH, "right")))
        piece = data[base : ends[j - 1]]
        up, down = _pow(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(byte[piece] * up[: len(piece)], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the rows, and the row offsets into them."""
    data, offsets = text_bytes(column)
    starts, ends = word_spans(data, offsets)
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def shingle_rows(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k-word shingles of every row, in text order; a row of 1..k-1 words gives its whole sequence."""
    n = np.diff(bounds)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(counts, out=at[1:])
    full = n >= k
    first = np.repeat(bounds[:-1] - at[:-1], counts) + np.arange(at[-1])
    out = np.zeros(at[-1], np.uint64)
    whole = np.repeat(full, counts)
    pos = first[whole]
    acc = np.zeros(len(pos), np.uint64)
    for i in range(k):
        acc = mix(acc + hashes[pos + i] + np.uint64(i + 1))
    out[whole] = acc
    for r in np.flatnonzero(~full & (n > 0)):
        x = np.uint64(0x5EED + int(n[r]))
        for h in hashes[bounds[r] : bounds[r + 1]]:
            x = np.uint64((int(x) + int(h)) & _MASK)
            x = mix(np.array([x], np.uint64))[0]
        out[at[r]] = x
    return out, at


def shingle_sets(column: pa.Array, k: int):
    """Per row (in order): the sorted distinct shingles of the whole text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    for lo, hi in text_chunks(column):
        h, b = words(column.slice(lo, hi - lo))
        s, at = shingle_rows(h, b, k)
        yield [np.unique(s[at[i] : at[i + 1]]) for i in range(hi - lo)]


def fingerprint(unique: np.ndarray) -> bytes | None:
    """128-bit fingerprint of a set; None for the empty set."""
    if not len(unique):
        return None
    a = mix(unique + np.uint64(0x1234567))
    b = mix(unique ^ np.uint64(0xC0FFEE123456789))
    with np.errstate(over="ignore"):
        return (a.sum(dtype=np.uint64) + np.uint64(len(unique))).tobytes() + mix(b).sum(dtype=np.uint64).tobytes()
