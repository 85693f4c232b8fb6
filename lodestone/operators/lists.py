"""Postings in lists: a task reads whole texts and gives out, for some millions of postings at a time, a row for each key and up to ``LIST`` documents.

Texts are cleaned by Spark's expressions, so characters and case are those of ``functions.text``; what is left are keys between
white space, which are cut and counted by Arrow batches. Lists are moved and sorted instead of single postings.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Postings that a task holds before it gives them out, documents of a row, characters that are cut at a time.
HELD, LIST, PIECE = 2_000_000, 256, 1 << 20
#: Grams of up to so many characters are cut as numbers of 21 bits a character.
PACKED = 3


def _texts(batches):
    for b in batches:
        for at in range(0, b.num_rows, 64):
            part = b.slice(at, 64)
            yield from ((d, t) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if t)


def windows(text: str, n: int) -> np.ndarray:
    """The distinct windows of ``n`` characters without white space, as numbers."""
    found = []
    for at in range(0, max(1, len(text) - n + 1), PIECE):
        a = np.frombuffer(text[at : at + PIECE + n - 1].encode("utf-32-le"), np.uint32).astype(np.int64)
        m = len(a) - n + 1
        if m <= 0:
            continue
        gap = (a == 32) | (a >= 9) & (a <= 13)
        key, whole = np.zeros(m, np.int64), np.ones(m, bool)
        for i in range(n):
            key = key << 21 | a[i : i + m]
            whole &= ~gap[i : i + m]
        found.append(np.unique(key[whole]))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def names(keys: np.ndarray, n: int) -> pa.Array:
    return pa.array(["".join(chr(k >> 21 * i & 0x1FFFFF) for i in range(n - 1, -1, -1)) for k in keys.tolist()], pa.string())


def _rows(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): postings by key, and where the rows of one key and ``LIST`` postings at most begin."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    run = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    within = np.arange(len(k)) - np.repeat(run, np.diff(np.r_[run, len(k)]))
    return order, np.flatnonzero(within % LIST == 0)


def _offsets(starts: np.ndarray, n: int) -> pa.Array:
    return pa.array(np.r_[starts, n].astype(np.int32))


def gram_lists(docs: DataFrame, n: int = 3, case_sensitive: bool = False) -> DataFrame:
    """(gram, doc, docs): documents of a gram, ``doc`` the first of them; n of at most ``PACKED``."""

    def out(keys, ids):
        key, doc = np.concatenate(keys), np.repeat(np.array(ids, np.int64), [len(k) for k in keys])
        order, starts = _rows(key)
        doc = doc[order]
        return pa.RecordBatch.from_arrays([names(key[order][starts], n), pa.array(doc[starts]), pa.ListArray.from_arrays(_offsets(starts, len(doc)), pa.array(doc))], names=["gram", "doc", "docs"])

    def run(batches):
        keys, ids, held = [], [], 0
        for d, t in _texts(batches):
            k = windows(t, n)
            if len(k):
                keys.append(k)
                ids.append(d)
                held += len(k)
            if held >= HELD:
                yield out(keys, ids)
                keys, ids, held = [], [], 0
        if held:
            yield out(keys, ids)

    return docs.select(F.col("doc").cast("long"), cleaned(n, case_sensitive)).mapInArrow(run, "gram string, doc long, docs array<long>")


def gram_counts(docs: DataFrame, n: int = 3, case_sensitive: bool = False) -> DataFrame:
    """(gram, n): documents of a gram, in parts; a row of ``docs`` is a document; n of at most ``PACKED``."""

    def run(batches):
        keys, held = [], 0

        def out():
            k, c = np.unique(np.concatenate(keys), return_counts=True)
            return pa.RecordBatch.from_arrays([names(k, n), pa.array(c.astype(np.int64))], names=["gram", "n"])

        for _, t in _texts(batches):
            k = windows(t, n)
            if len(k):
                keys.append(k)
                held += len(k)
            if held >= HELD:
                yield out()
                keys, held = [], 0
        if held:
            yield out()

    return docs.select(F.lit(0).cast("long").alias("doc"), cleaned(n, case_sensitive)).mapInArrow(run, "gram string, n long")


def cleaned(n: int, case_sensitive: bool):
    """White-space words of letters and decimal digits, as ``text.gram_words`` has them, in one string."""
    if not 0 < n <= PACKED:
        raise ValueError(f"grams of 1 to {PACKED} characters")
    plain = F.regexp_replace("text", r"[^\p{L}\p{Nd}\s]+", "")
    return (plain if case_sensitive else F.lower(plain)).alias("text")


def term_lists(docs: DataFrame) -> DataFrame:
    """(term, doc, n, total, docs): documents of a term with its count ``tf`` and their length ``dl``; ``doc`` the first of them, ``total`` the sum of the counts."""

    def out(terms, tfs, ids, lens, dls):
        words = pa.array(terms, pa.string()).dictionary_encode()
        order, starts = _rows(words.indices.to_numpy())
        doc, dl = (np.repeat(np.array(x, np.int64), lens)[order] for x in (ids, dls))
        tf = np.array(tfs, np.int64)[order]
        each = pa.StructArray.from_arrays([pa.array(doc), pa.array(tf), pa.array(dl)], names=["doc", "tf", "dl"])
        return pa.RecordBatch.from_arrays([words.dictionary.take(words.indices.take(pa.array(order[starts]))), pa.array(doc[starts]), pa.array(np.diff(np.r_[starts, len(doc)])), pa.array(np.add.reduceat(tf, starts)), pa.ListArray.from_arrays(_offsets(starts, len(doc)), each)], names=["term", "doc", "n", "total", "docs"])

    def run(batches):
        held = ([], [], [], [], [])
        for d, t in _texts(batches):
            w = t.split()  # nothing else that counts as white space is left
            if w:
                c = Counter(w)
                held[0].extend(c)
                held[1].extend(c.values())
                for x, v in zip(held[2:], (d, len(c), len(w))):
                    x.append(v)
            if len(held[0]) >= HELD:
                yield out(*held)
                held = ([], [], [], [], [])
        if held[0]:
            yield out(*held)

    return docs.select(F.col("doc").cast("long"), spaced()).mapInArrow(run, "term string, doc long, n long, total long, docs array<struct<doc:long,tf:long,dl:long>>")


def spaced():
    """The words of ``text.words`` with single spaces between them."""
    return F.regexp_replace(F.lower("text"), r"[^\p{IsAlphabetic}\p{N}]+", " ").alias("text")


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, n): documents of a term, in parts; a row of ``docs`` is a document."""

    def run(batches):
        seen, held = Counter(), 0
        for _, t in _texts(batches):
            w = set(t.split())
            seen.update(w)
            held += len(w)
            if held >= HELD:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])
                seen, held = Counter(), 0
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])

    return docs.select(F.lit(0).cast("long").alias("doc"), spaced()).mapInArrow(run, "term string, n long")
