"""Quality rules: hashed n-gram log-likelihood ratio between a trusted-target and a raw-corpus multinomial.

Words and runs of marks are the tokens; lower-cased unigrams and bigrams are hashed into ``BUCKETS`` cells
(a token that repeats its predecessor has one cell for all words, so stuttering text is visible whatever the
word is). Cell counts of all documents give the raw multinomial, those of all trusted documents
(``labels.quality = 1``) the target one, smoothed by ``BUCKETS`` draws from the raw one; a document's score is the mean of ``log p_target - log p_raw`` over its n-grams
and it is kept when that is at least ``threshold``.

Defined results: a null or empty text (or one without any token) has score null and is not kept; a null
``doc_id`` is scored like any other row and never counts as trusted; repeated rows are scored, and counted,
each by itself; other columns of the input are ignored. With no trusted documents the target is the raw
multinomial: every score is 0 and every document with a token is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import fresh, only_ids
from ._text import Tokens, mix, pieces, strings

BUCKETS = 1 << 14
THRESHOLD = -0.18

_AGAIN = np.uint64(0xA5A5F00D12345677)


def gram_cells(col: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of every unigram and bigram of a piece of lower-cased texts."""
    t = Tokens(col, marks=True)
    h = t.hash
    same = t.doc[1:] == t.doc[:-1]
    with np.errstate(over="ignore"):
        pair = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    pair[h[1:] == h[:-1]] = _AGAIN
    doc = np.concatenate([t.doc, t.doc[1:][same]])
    cell = (np.concatenate([h, pair[same]]) >> np.uint64(20)) % np.uint64(buckets)
    return doc, cell.astype(np.int64)


def cell_counts(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(cell, raw, target) over all documents.

    One pass counts every text where it lies; a second one the trusted texts, which an id filter of bounded size picks
    before the exact join moves them.
    """
    ids = trusted.select(F.col("doc_id").cast("long").alias("id")).where("id is not null").distinct()

    def count(batches):
        n = np.zeros(buckets, np.int64)
        for b in batches:
            for _, piece in pieces(strings(b.column(0), lower=True)):
                n += np.bincount(gram_cells(piece, buckets)[1], minlength=buckets)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n[seen])], ["cell", "n"])

    def counts(rows, raw):
        return rows.select("text").mapInArrow(count, "cell long, n long").select("cell", F.when(F.lit(raw), F.col("n")).otherwise(0).alias("raw"), F.when(F.lit(raw), 0).otherwise(F.col("n")).alias("target"))

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    both = counts(own, True).union(counts(only_ids(own, "doc_id", ids), False))
    return both.groupBy("cell").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def ratios(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The log ratio of each cell. The table has ``buckets`` rows at most, whatever the corpus."""
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in counts.collect():
        raw[r.cell], target[r.cell] = r.raw, r.target
    share = raw / max(1.0, raw.sum())
    seen = raw > 0
    out = np.zeros(buckets)
    out[seen] = np.log((target[seen] / share[seen] + buckets) / (target.sum() + buckets))
    return out


def score_texts(col, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, mean log ratio or NaN) of each text."""
    col = strings(col, lower=True)
    n, total = np.zeros(len(col), np.int64), np.zeros(len(col))
    for at, piece in pieces(col):
        doc, cell = gram_cells(piece, len(table))
        n[at : at + len(piece)] = np.bincount(doc, minlength=len(piece))
        total[at : at + len(piece)] = np.bincount(doc, weights=table[cell], minlength=len(piece))
    return n, np.divide(total, n, out=np.full(len(col), np.nan), where=n > 0)


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    return ratios(cell_counts(docs, labels.where(F.col("quality") == 1), buckets), buckets)


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_grams, score, keep) of every document."""
    table = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, buckets))

    def score(batches):
        for b in batches:
            n, s = score_texts(b.column(1), table.value)
            s = np.round(s, 9)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(s, mask=np.isnan(s)), pa.array(np.nan_to_num(s, nan=-np.inf) >= threshold)], ["doc_id", "n_grams", "score", "keep"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, n_grams long, score double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """The documents that ``quality_rules`` keeps, with all their columns."""
    table = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, buckets))
    (flag,) = fresh(docs, "keep")
    at = docs.columns.index("text")

    def mark(batches):
        for b in batches:
            s = score_texts(b.column(at), table.value)[1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.round(np.nan_to_num(s, nan=-np.inf), 9) >= threshold)], [*b.schema.names, flag])

    return docs.mapInArrow(mark, T.StructType([*docs.schema.fields, T.StructField(flag, T.BooleanType())])).where(F.col(flag)).drop(flag)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
