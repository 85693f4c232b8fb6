"""Whole-batch text kernels: words, n-grams and character codes straight from Arrow buffers.

A batch is cut into pieces of about ``PIECE`` bytes (never inside a document), so the arrays stay small
whatever the batch holds; a single longer document is a piece of its own and is processed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
SPACE, WORD, MARK = 0, 1, 2

_CLASS = np.full(256, MARK, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_":
    _CLASS[_c] = WORD
_CLASS[128:] = WORD
_WORDS_ONLY = np.where(_CLASS == WORD, WORD, SPACE).astype(np.uint8)

_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, 1 << 16)
        out = []
        for base in (_P, _PINV):
            t = np.full(n, base, np.uint64)
            t[0] = 1
            out.append(np.multiply.accumulate(t))
        _powers[:] = out
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def strings(col: pa.Array | pa.ChunkedArray, lower: bool = False) -> pa.Array:
    """A plain string array without nulls (a null reads as an empty text)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    col = pc.fill_null(col, "")
    return pc.utf8_lower(col) if lower else col


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string array; offsets start at 0."""
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(col: pa.Array, size: int = PIECE) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) with about ``size`` bytes each."""
    _, off = buffers(col)
    i, n = 0, len(col)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, col.slice(i, j - i)
        i = j


class Tokens:
    """Tokens of one piece: ``start``/``end`` byte offsets, ``doc`` row index, ``hash`` 64-bit."""

    def __init__(self, col: pa.Array, marks: bool = False):
        self.data, self.off = data, off = buffers(col)
        n, rows = len(data), len(col)
        self.rows = rows
        if not n:
            self.start = self.end = np.zeros(0, np.int64)
            self.doc = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            self.first = np.zeros(rows + 1, np.int64)
            return
        cls = (_CLASS if marks else _WORDS_ONLY)[data]
        edge = np.empty(n + 1, bool)
        edge[0] = edge[n] = True
        np.not_equal(cls[1:], cls[:-1], out=edge[1:n])
        edge[off] = True
        at = np.flatnonzero(edge)
        start, end = at[:-1], at[1:]
        keep = cls[start] != SPACE
        self.start, self.end = start[keep], end[keep]
        self.kind = cls[self.start]
        self.first = np.searchsorted(self.start, off)  # token index at which each row begins
        self.doc = np.repeat(np.arange(rows), np.diff(self.first))
        pw, inv = _power_tables(n + 1)
        cs = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * pw[:n], out=cs[1:])
        self.hash = mix((cs[self.end] - cs[self.start]) * inv[self.start])

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(doc, hash) of all runs of k tokens inside a document, and of the whole of shorter documents."""
        n = len(self.hash)
        counts = np.diff(self.first)
        size = np.minimum(counts, k)[self.doc] if n else np.zeros(0, np.int64)
        left = self.first[1:][self.doc] - np.arange(n) if n else size
        h = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k):
                use = np.flatnonzero((size > j) & (left > j))
                h[use] = mix(h[use] * np.uint64(0x100000001B3) + self.hash[use + j] + np.uint64(j + 1))
        ok = left >= size
        return self.doc[ok], h[ok]


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one byte a character, row offsets, code points): those from 256 on fold into the bytes 128..159."""
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=off[1:])
    cp = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    out = cp.astype(np.uint8)
    far = cp > 255
    if far.any():
        out[far] = (128 + cp[far] % 32).astype(np.uint8)
    return out, off, cp
