"""Line dedup by winnowing.

A text's lines end at a newline or, inside long lines, after a word whose hash is 0 modulo ``WRAP``: wrapping by
content gives a passage the same lines wherever it is pasted. The minimum of every window of ``WINDOW`` line
hashes is a fingerprint, so any two texts that share ``WINDOW`` successive lines share one. A fingerprint is
matched with all earlier occurrences of its hash (in order of ``doc_id`` and position), and each match is
extended both ways: a fingerprint carries the hashes of the ``WINDOW - 1`` lines on either side, which reaches
the next fingerprint of the run or its end. That finds every shared run of ``WINDOW`` lines; a shorter one of
``MIN_WORDS`` words is found where a fingerprint lies in it. What any earlier occurrence shares is read off the first one with the
same hash and the same lines before, after or on both sides. A match counts if it has ``WINDOW`` lines or ``MIN_WORDS`` words.
Matched lines form runs; a later run of at least ``MIN_WORDS`` words is deleted from its text.

One shuffle of fingerprints (a row each, sorted inside a hash by the lines around; frequent lines spill to disk) and
one that brings the runs to their documents. Lines that recur in a large share of the corpus, which a sample of documents
names (``hot_lines``; at most ``HOT_LINES``), would gather in one task: their fingerprints travel as rows for each of
the matches they can be part of instead, keyed by all lines of the match, and of equal ones in a piece of a batch only the first
travels under that key, since the others are repeats already. The result is the same whatever is named hot.

Defined results: null and empty texts come back as they are; a row with a null ``doc_id`` is neither searched
nor changed; repeated rows (same ``doc_id`` and text) are one document and stay, all of them alike; rows with
one ``doc_id`` and different texts are documents of their own; of a text that repeats wholly nothing is left
but ''. Words compare without ASCII case. Other columns are ignored by ``line_dedup`` and kept by ``without_repeats``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import fresh
from ._text import _power_tables, buffers, mix, pieces, strings

WRAP = 6
WINDOW = 3
MIN_WORDS = 25
#: A line is hot beyond so many estimated occurrences; so many are named at most; the sample is one document in so many.
HOT_ROWS, HOT_LINES, HOT_SAMPLE = 100_000, 10_000, 64
#: A document that loses words and of whose words more than this share lies in matched lines isn't kept by ``without_repeats``.
MOST = 0.4
#: Lines before and after a fingerprint that one earlier occurrence may share. Longer matches (2 and 1, 2 and 2) are unions of these.
KINDS = ((0, 0), (1, 0), (2, 0), (0, 1), (0, 2), (1, 1))

_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True


class Lines:
    """Wrapped lines of a piece: byte ``start``/``end``, ``words``, ``hash``, and ``first`` line of each row."""

    def __init__(self, col: pa.Array):
        self.data, self.off = data, off = buffers(col)
        n = len(data)
        if not n or _GAP[data].all():
            self.start = self.end = self.words = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            self.first = np.zeros(len(col) + 1, np.int64)
            return
        gap = _GAP[data]
        edge = np.empty(n + 1, bool)
        edge[0] = edge[n] = True
        np.not_equal(gap[1:], gap[:-1], out=edge[1:n])
        edge[off] = True
        at = np.flatnonzero(edge)
        start, end = at[:-1], at[1:]
        keep = ~gap[start]
        start, end = start[keep], end[keep]
        pw, inv = _power_tables(n + 1)
        cs = np.zeros(n + 1, np.uint64)
        np.cumsum((_ASCII_LOWER[data].astype(np.uint64) + np.uint64(1)) * pw[:n], out=cs[1:])
        word = mix((cs[end] - cs[start]) * inv[start])
        row_first = np.searchsorted(start, off)  # word index at which each row begins
        newline = np.concatenate([[0], np.cumsum(data == 10)])
        last = (word >> np.uint64(40)) % np.uint64(WRAP) == 0
        last[:-1] |= newline[start[1:]] > newline[end[:-1]]
        last[row_first[1:][row_first[1:] > 0] - 1] = True
        stop = np.flatnonzero(last) + 1
        begin = np.concatenate([[0], stop[:-1]])
        ws = np.zeros(len(word) + 1, np.uint64)
        np.cumsum(word * pw[: len(word)], out=ws[1:])
        self.hash = mix((ws[stop] - ws[begin]) * inv[begin])
        self.start, self.end, self.words = start[begin], end[stop - 1], stop - begin
        self.first = np.searchsorted(begin, row_first)


def winnow(lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """(row, line index in the piece) of the fingerprints: the last minimum of each window."""
    h = lines.hash
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    count = np.diff(lines.first)
    row = np.repeat(np.arange(len(count)), count)
    end = lines.first[1:][row] - 1
    i = np.arange(len(h))
    opens = (i + WINDOW - 1 <= end) | (i == lines.first[:-1][row])
    i, end = i[opens], end[opens]
    best = i
    for j in range(1, WINDOW):
        k = np.minimum(i + j, end)
        best = np.where(h[k] <= h[best], k, best)
    best = np.unique(best)
    return row[best], best


FINGERPRINTS = "h long, doc_id long, at long, before long, after long, kind byte, known boolean"


def fingerprints(docs: DataFrame, hot: np.ndarray, min_words: int) -> DataFrame:
    """(h, doc_id, at, before, after, kind, known) of (doc_id, text, tag).

    ``at`` holds the text's tag and the line number, ``before`` and ``after`` two lines' hashes on each side. Of hot lines
    ``h`` names all lines of a match of ``kind`` and the sides are 0; ``known`` are those that follow an equal one in
    their piece, and their ``h`` only spreads them.
    """
    held = docs.sparkSession.sparkContext.broadcast(np.sort(hot))

    def find(batches):
        hot = held.value
        for b in batches:
            ids, tags = b.column(0).to_numpy(), b.column(2).to_numpy()
            for at, piece in pieces(strings(b.column(1))):
                lines = Lines(piece)
                row, i = winnow(lines)
                short = (lines.hash >> np.uint64(32)) | np.uint64(1)

                def side(step):
                    out = np.zeros(len(i), np.uint64)
                    for j in range(1, WINDOW):
                        k = i + step * j
                        ok = (k >= lines.first[row]) & (k < lines.first[row + 1])
                        out[ok] |= short[k[ok]] << np.uint64(32 * (j - 1))
                    return out.view(np.int64)

                h, doc, where, before, after = lines.hash[i].view(np.int64), ids[at + row], (tags[at + row] << 32) | (i - lines.first[row]), side(-1), side(1)
                far = np.isin(h, hot) if len(hot) else np.zeros(len(h), bool)
                near = ~far
                n = int(near.sum())
                if n:
                    yield pa.RecordBatch.from_arrays([*(pa.array(x[near]) for x in (h, doc, where, before, after)), pa.array(np.full(n, -1, np.int8)), pa.array(np.zeros(n, bool))], NAMES)
                if not far.any():
                    continue
                i, row, doc, where = i[far], row[far], doc[far], where[far]
                so_far = np.concatenate([[0], np.cumsum(lines.words)])
                parts = []
                for kind, (back, on) in enumerate(KINDS):
                    lo, hi = i - back, i + on
                    ok = np.flatnonzero((lo >= lines.first[row]) & (hi < lines.first[row + 1]))
                    ok = ok[(back + on + 1 >= WINDOW) | (so_far[hi[ok] + 1] - so_far[lo[ok]] >= min_words)]
                    key = np.full(len(ok), kind + 1, np.uint64)
                    for j in range(-back, on + 1):
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + lines.hash[i[ok] + j])
                    parts.append((key.view(np.int64), doc[ok], where[ok], np.full(len(ok), kind, np.int8)))
                key, doc, where, kind = (np.concatenate(x) for x in zip(*parts))
                order = np.lexsort([where, doc, key])
                key, doc, where, kind = key[order], doc[order], where[order], kind[order]
                starts = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
                first = np.maximum.accumulate(np.where(starts, np.arange(len(key)), 0))
                known = (doc[first] != doc) | (where[first] != where)
                spread = mix((doc.astype(np.uint64) << np.uint64(20)) ^ where.astype(np.uint64) ^ (kind.astype(np.uint64) << np.uint64(59))).view(np.int64)
                zero = np.zeros(len(key), np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (np.where(known, spread, key), doc, where, zero, zero)), pa.array(kind), pa.array(known)], NAMES)

    return docs.mapInArrow(find, FINGERPRINTS)


NAMES = [c.split()[0] for c in FINGERPRINTS.split(", ")]


def hot_lines(key: DataFrame, rows: int = HOT_ROWS, most: int = HOT_LINES, sample: int = HOT_SAMPLE) -> np.ndarray:
    """Hashes of the ``most`` fingerprints that recur most, beyond ``rows`` times as estimated from one document in ``sample``."""
    seen = fingerprints(key.where(F.pmod(F.xxhash64("doc_id", "tag"), F.lit(sample)) == 0), np.zeros(0, np.int64), MIN_WORDS)
    often = seen.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") * sample > rows)
    return np.array([r.h for r in often.orderBy(F.desc("n"), "h").limit(most).collect()], np.int64)


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, hot: np.ndarray | None = None) -> DataFrame:
    """(doc_id, tag, spans) of documents with matched lines; spans are (line, kinds): a bit for each of ``KINDS`` that an earlier occurrence shares."""
    key = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), tag_of("text").alias("tag"))
    low = F.lit(0xFFFFFFFF)
    # One exchange by hash.
    found = fingerprints(key, hot_lines(key) if hot is None else hot, min_words)
    seen = found.repartition("h").select("h", F.struct("doc_id", "at").alias("own"), "before", "after", "kind", "known", F.col("before").bitwiseAND(low).alias("b"), F.col("after").bitwiseAND(low).alias("a"))

    def shared(*context):
        """Whether an earlier document or line has the same hash and the same lines around; repeated rows are one."""
        return F.min("own").over(Window.partitionBy("h", *context)) < F.col("own")

    two = {c: F.shiftrightunsigned(c, 32) != 0 for c in ("before", "after")}
    one = {c: F.col(c) != 0 for c in ("b", "a")}
    # Hashes of one occurrence go before the sorts for the lines after and on both sides.
    seen = seen.sortWithinPartitions("h", "b", "before")
    seen = seen.withColumns({"last": F.max("own").over(Window.partitionBy("h")), "k0": shared() | F.col("known"), "k1": one["b"] & shared("b"), "k2": two["before"] & shared("b", "before")}).where(F.col("k0") | (F.col("last") != F.col("own"))).drop("last")
    seen = seen.sortWithinPartitions("h", "a", "after").withColumns({"k3": one["a"] & shared("a"), "k4": two["after"] & shared("a", "after")})
    seen = seen.withColumn("k5", one["b"] & one["a"] & shared("b", "a")).where("k0")
    kinds = sum((F.when(F.col(f"k{i}"), 1 << i).otherwise(0) for i in range(len(KINDS))), F.lit(0))
    kinds = F.when(F.col("kind") < 0, kinds).otherwise(F.call_function("shiftleft", F.lit(1), F.col("kind").cast("int")))
    spans = seen.select("own.doc_id", F.shiftright("own.at", 32).alias("tag"), F.struct(F.col("own.at").bitwiseAND(low).cast("int").alias("line"), kinds.cast("byte").alias("kinds")).alias("span"))
    # Sets are merged before they move: rows that repeat wholly name one document.
    return spans.groupBy("doc_id", "tag").agg(F.collect_set("span").alias("spans"))


def tag_of(text: str):
    return F.pmod(F.xxhash64(F.col(text).cast("string")), F.lit(1 << 31))


def cut_runs(data: bytes, start: np.ndarray, end: np.ndarray, words: np.ndarray, matched: np.ndarray, min_words: int) -> tuple[bytes, int, int]:
    """(text left, words deleted, runs deleted) of one text whose ``matched`` lines repeat."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], matched.view(np.int8), [0]])))
    out, at, deleted, runs = [], 0, 0, 0
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        n = int(words[a:b].sum())
        if n < min_words:
            continue
        deleted, runs = deleted + n, runs + 1
        s, e = int(start[a]), int(end[b - 1])
        tail = e
        while tail < len(data) and _GAP[data[tail]]:
            tail += 1
        out.append(data[at:s])
        fresh_line = s == 0 or data[s - 1] == 10
        if not fresh_line and (tail == len(data) or b"\n" in data[e:tail]):
            out[-1] = out[-1].rstrip(b" \t") + data[e:tail]
        at = tail
    out.append(data[at:])
    return b"".join(out), deleted, runs


def clean(texts: pa.Array, spans: pa.Array, min_words: int) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """(text, words deleted, runs deleted, share of words in matched lines) of each row."""
    col = strings(texts)
    out = col.to_pylist()
    words, runs, share = np.zeros(len(out), np.int64), np.zeros(len(out), np.int64), np.zeros(len(out))
    own = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
    if len(own):
        col, spans = col.take(pa.array(own)), spans.take(pa.array(own))
        n_spans = pc.list_value_length(spans).to_numpy(zero_copy_only=False).astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(n_spans)])
        line, kinds = (spans.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("line", "kinds"))
        for at, piece in pieces(col):
            lines, n = Lines(piece), len(piece)
            part = slice(upto[at], upto[at + n])
            place = lines.first[np.repeat(np.arange(n), n_spans[at : at + n])] + line[part]
            so_far = np.concatenate([[0], np.cumsum(lines.words)])
            mark = np.zeros(len(so_far), np.int64)
            for k, (back, on) in enumerate(KINDS):
                lo = place[kinds[part] >> k & 1 == 1] - back
                hi = lo + back + on + 1
                counts = np.full(len(lo), back + on + 1 >= WINDOW) | (so_far[hi] - so_far[lo] >= min_words)
                mark += np.bincount(lo[counts], minlength=len(mark)) - np.bincount(hi[counts], minlength=len(mark))
            matched = np.cumsum(mark[:-1]) > 0
            hit = np.concatenate([[0], np.cumsum(np.where(matched, lines.words, 0))])
            hit, total = (x[lines.first[1:]] - x[lines.first[:-1]] for x in (hit, so_far))
            share[own[at : at + n]] = hit / np.maximum(1, total)
            for j in np.flatnonzero(hit >= min_words).tolist():
                ls, i, base = slice(lines.first[j], lines.first[j + 1]), own[at + j], lines.off[j]
                left, words[i], runs[i] = cut_runs(out[i].encode(), lines.start[ls] - base, lines.end[ls] - base, lines.words[ls], matched[ls], min_words)
                out[i] = left.decode()
    valid = texts.is_valid().to_numpy(zero_copy_only=False)
    return [t if v else None for t, v in zip(out, valid)], words, runs, share


def with_spans(docs: DataFrame, d: str, t: str, s: str, min_words: int, hot: np.ndarray | None = None) -> DataFrame:
    """The documents with their matched spans, null where they have none."""
    found = repeats(docs, min_words, hot).select(F.col("doc_id").alias(d), F.col("tag").alias(t), F.col("spans").alias(s)).hint("shuffle_hash")
    return docs.withColumns({d: F.col("doc_id").cast("long"), t: tag_of("text")}).join(found, [d, t], "left").drop(d, t)


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, hot: np.ndarray | None = None) -> DataFrame:
    """(doc_id, text, words_deleted, runs_deleted) of every row. ``hot``: hashes of hot lines, found in a sample where None."""

    def apply(batches):
        for b in batches:
            text, words, runs, _ = clean(b.column(1), b.column(2), min_words)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string()), pa.array(words), pa.array(runs)], ["doc_id", "text", "words_deleted", "runs_deleted"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_spans(base, "d", "tag", "spans", min_words, hot).select("doc_id", "text", "spans").mapInArrow(apply, "doc_id long, text string, words_deleted long, runs_deleted long")


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, most: float = MOST) -> DataFrame:
    """The documents, all columns, with the text (and ``n_chars``, if there) after deletion.

    Documents that would lose words and of whose words more than the share ``most`` lies in matched lines (runs of any
    length) go whole: what is left of a near copy is a stump that nothing later would recognise.
    """
    d, t, s, words, part = fresh(docs, "d", "tag", "spans", "words", "share")
    at = docs.columns.index("text")
    names = docs.columns

    def apply(batches):
        for b in batches:
            text, n, _, share = clean(b.column(at), b.column(len(names)), min_words)
            columns = b.columns[: len(names)]
            columns[at] = pa.array(text, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n), pa.array(share)], [*names, words, part])

    schema = T.StructType([*docs.schema.fields, T.StructField(words, T.LongType()), T.StructField(part, T.DoubleType())])
    out = with_spans(docs, d, t, s, min_words).select(*[F.col(f"`{c}`") for c in names], s).mapInArrow(apply, schema)
    out = out.where((F.col(words) == 0) | (F.col(part) <= most))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col(words) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.drop(words, part)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
