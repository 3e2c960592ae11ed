"""Vectorised words of UTF-8 text: numpy over the Arrow buffers, without Python strings.

A word is a run of bytes outside 0x20 and 0x09-0x0D, which equals ``[^\\x20\\x09-\\x0D]+``
over code points because UTF-8 uses no such byte inside a longer sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = _U(0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each; the largest table so far is kept."""
    size = max(_powers, default=0)
    if n > size:
        size = 1 << max(16, int(n).bit_length())
        _powers.clear()
        both = []
        for b in (_BASE, _INVERSE):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[size] = tuple(both)
    return _powers[size]


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of the rows); a null row is empty."""
    if pa.types.is_large_string(arr.type):
        kind = np.int64
    else:
        arr, kind = arr.cast(pa.string()), np.int32
    if arr.null_count:
        arr = arr.fill_null("")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = arr.buffers()
    off = np.frombuffer(bufs[1], dtype=kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8)[off[0] : off[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def pieces(arr: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) with at most ``limit`` bytes each, or one longer row."""
    if len(arr) == 0:
        return
    lengths = np.diff(utf8(arr)[1])
    lo, held = 0, 0
    for i, n in enumerate(lengths):
        if i > lo and held + n > limit:
            yield lo, arr.slice(lo, i - lo)
            lo, held = i, 0
        held += int(n)
    yield lo, arr.slice(lo)


def _spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word = ~SEPARATOR[data]
    first, last = word.copy(), word.copy()
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    first[1:] &= ~word[:-1] | edge[1:-1]
    last[:-1] &= ~word[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(data: np.ndarray, off: np.ndarray, lower: bool = False, limit: int = 4 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, 64-bit hash, row) of each word. Works through long rows in parts cut between words."""
    starts, ends = _spans(data, off)
    row = np.searchsorted(off, starts, side="right") - 1
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + limit, side="right")))
        lo, hi = starts[i], ends[j - 1]
        part = data[lo:hi]
        if lower:
            part = LOWER[part]
        up, down = power_table(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + _U(1)) * up[: len(part)], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (total[e] - total[s]) * down[s]
        i = j
    return starts, ends, mix(out), row


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k consecutive word hashes (len(h) - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        acc *= _STEP
        acc += h[j : j + n]
    return mix(acc)


def batch_rows(table: pa.RecordBatch, cap: int = 8 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch by the bytes of a text column, so that temporaries stay bounded."""
    for lo, part in pieces(table.column(column), cap):
        yield table.slice(lo, len(part))
