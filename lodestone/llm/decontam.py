"""Benchmark decontamination: q-gram lemma filtering and banded alignment.

Texts and items are compared in lower case with white space collapsed. Items are cut into windows of
``WINDOW`` characters, half overlapping (a shorter item is one window), and a window is found in a document if
some stretch is within ``k = floor(EDITS * length)`` edits. By the q-gram lemma such a stretch shares all but ``k * Q`` of any chosen set
of the window's q-grams, on diagonals at most ``k`` apart; so of each window the rarest ``k * Q + SHARED``
q-grams are looked up, hits are counted in diagonal bands of ``BAND + k`` that overlap by ``k``, bands with
enough hits are retained, and each is verified by banded alignment. The filter loses nothing.

The benchmark is broadcast in slices of at most ``SLICE_BYTES`` of text; a larger one takes several passes over
the documents, each exact for its items.

Defined results: null and empty texts match nothing; null, empty and items shorter than ``Q`` match nothing;
repeated items with equal ids count once with their windows together; repeated rows are reported each; a null
``doc_id`` or ``item_id`` is carried as null; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import fresh
from ._text import codes, pieces, strings

Q = 8
WINDOW = 96
EDITS = 0.075
SHARED = 10
BAND = 16
SLICE_BYTES = 4 << 20
_HASH = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22


def plain(text: str) -> str:
    return " ".join(text.lower().split())


def _grams(code: np.ndarray) -> np.ndarray:
    """The packed q-gram at each position (the last ``Q - 1`` reach beyond the end)."""
    pad = np.concatenate([code, np.zeros(Q, np.uint8)])
    return np.lib.stride_tricks.as_strided(np.frombuffer(pad, "<u8", count=1), (len(code),), (1,)).copy()


class Index:
    """The q-gram index of some items."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.item: list = []
        texts: list[str] = []
        for item, text in items:
            t = plain(text or "")
            if len(t) < Q:
                continue
            starts = [0] if len(t) <= WINDOW else sorted({*range(0, len(t) - WINDOW, WINDOW // 2), len(t) - WINDOW})
            for s in starts:
                self.item.append(item)
                texts.append(t[s : s + WINDOW])
        self.texts = texts
        n = len(texts)
        size = np.array([len(t) for t in texts], np.int64)
        self.size = size
        self.k = np.minimum(np.floor(EDITS * size + 1e-9).astype(np.int64), np.maximum(0, (size - Q) // Q))
        code, off, cp = codes(texts)
        self.cp = np.full((n, WINDOW), -2, np.int64)
        for i in range(n):
            self.cp[i, : size[i]] = cp[off[i] : off[i + 1]]
        g = _grams(code)
        pos = np.arange(len(code)) - np.repeat(off[:-1], size)
        win = np.repeat(np.arange(n), size)
        ok = pos <= size[win] - Q
        g, pos, win = g[ok], pos[ok], win[ok]
        _, inverse, often = np.unique(g, return_inverse=True, return_counts=True)
        order = np.lexsort((pos, often[inverse], win))
        rank = np.arange(len(g)) - np.repeat(np.searchsorted(win[order], np.arange(n)), np.bincount(win, minlength=n))
        use = rank < self.k[win[order]] * Q + SHARED
        g, pos, win = g[order][use], pos[order][use], win[order][use]
        self.need = np.maximum(1, np.bincount(win, minlength=n) - self.k * Q)
        order = np.argsort(g, kind="stable")
        self.pos, self.win = pos[order], win[order]
        self.keys, first = np.unique(g[order], return_index=True)
        self.first = np.append(first, len(g))
        self.map = np.zeros(1 << _BITS, bool)
        self.map[(self.keys * _HASH) >> np.uint64(64 - _BITS)] = True

    def search(self, texts: list[str]):
        """(row, window, start, edits) arrays of the windows found in ``texts`` (plain)."""
        code, off, cp = codes(texts)
        none = (np.zeros(0, np.int64),) * 4
        if len(code) < Q or not len(self.keys):
            return none
        g = _grams(code)
        at = np.flatnonzero(self.map[(g * _HASH) >> np.uint64(64 - _BITS)])
        key = np.searchsorted(self.keys, g[at])
        key[key == len(self.keys)] = 0
        row = np.searchsorted(off, at, "right") - 1
        ok = (self.keys[key] == g[at]) & (at + Q <= off[row + 1])
        at, key, row = at[ok], key[ok], row[ok]
        n = self.first[key + 1] - self.first[key]
        hit = np.repeat(np.arange(len(at)), n)
        post = np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n) + self.first[key][hit]
        win, row = self.win[post], row[hit]
        diagonal = at[hit] - off[row] - self.pos[post] + WINDOW  # never negative
        band = diagonal // BAND
        also = (diagonal % BAND < self.k[win]) & (band > 0)
        row, win, band = (np.concatenate([x, y]) for x, y in ((row, row[also]), (win, win[also]), (band, band[also] - 1)))
        bands, wins = int(band.max(initial=0)) + 1, len(self.texts)
        named, count = np.unique((row * wins + win) * bands + band, return_counts=True)
        win = named // bands % wins
        good = count >= self.need[win]
        named, win = named[good], win[good]
        row, low = named // bands // wins, named % bands * BAND - WINDOW
        edits = self.align(cp, off, row, win, low)
        good = edits <= self.k[win]
        return row[good], win[good], np.maximum(0, low[good]), edits[good]

    def align(self, cp, off, row, win, low) -> np.ndarray:
        """Fewest edits between a window and any stretch of its row along the diagonals ``low - k .. low + BAND + 2 k``."""
        out = np.zeros(len(row), np.int64)
        for s in range(0, len(row), 4096):
            r, w, lo = (x[s : s + 4096] for x in (row, win, low))
            k = int(self.k[w].max(initial=0))
            c = np.arange(BAND + 3 * k + 1)
            cost = np.zeros((len(r), len(c)), np.int64)
            best = cost.copy()
            begin, length = off[r][:, None], (off[r + 1] - off[r])[:, None]
            for i in range(int(self.size[w].max(initial=0))):
                t = i + lo[:, None] - k + c
                inside = (t >= 0) & (t < length)
                ch = np.where(inside, cp[np.where(inside, begin + t, 0)].astype(np.int64), -1)
                new = cost + (ch != self.cp[w, i][:, None])
                new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
                cost = np.minimum.accumulate(new - c, axis=1) + c
                live = (i < self.size[w])[:, None]
                best = np.where(live, cost, best)
            out[s : s + 4096] = best.min(axis=1)
        return out


def indexes(benchmark: DataFrame, slice_bytes: int = SLICE_BYTES):
    """The benchmark's index in slices, one at a time in the driver's memory."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // slice_bytes))
    for i in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i)
        yield Index([tuple(r) for r in part.orderBy("item_id", "text").collect()])


def contaminations(docs: DataFrame, benchmark: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, item_id, n_windows, start, edits): an item's windows found in a document; start in the plain text, fewest edits."""
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for index in indexes(benchmark, slice_bytes):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def find(batches, held=held):
            index = held.value
            for b in batches:
                ids, found = b.column(0), {}
                for at, piece in pieces(strings(b.column(1)), 1 << 19):
                    for row, win, start, edits in zip(*(x.tolist() for x in index.search([plain(t) for t in piece.to_pylist()]))):
                        f = found.setdefault((at + row, index.item[win]), [set(), start, edits])
                        f[0].add(win)
                        f[1], f[2] = min(f[1], start), min(f[2], edits)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([r for r, _ in found], pa.int64())), pa.array([i for _, i in found], pa.int64()), pa.array([len(f[0]) for f in found.values()], pa.int64()), pa.array([f[1] for f in found.values()], pa.int64()), pa.array([f[2] for f in found.values()], pa.int64())], ["doc_id", "item_id", "n_windows", "start", "edits"])

        part = rows.mapInArrow(find, "doc_id long, item_id long, n_windows long, start long, edits long")
        out = part if out is None else out.unionByName(part)
    return out


def without_benchmark(docs: DataFrame, benchmark: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The documents, all columns, in which no item's window is found."""
    (flag,) = fresh(docs, "clean")
    at = docs.columns.index("text")
    out = docs
    for index in indexes(benchmark, slice_bytes):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def mark(batches, held=held):
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                for first, piece in pieces(strings(b.column(at)), 1 << 19):
                    clean[first + held.value.search([plain(t) for t in piece.to_pylist()])[0]] = False
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(clean)], [*b.schema.names, flag])

        out = out.mapInArrow(mark, T.StructType([*docs.schema.fields, T.StructField(flag, T.BooleanType())])).where(F.col(flag)).drop(flag)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
