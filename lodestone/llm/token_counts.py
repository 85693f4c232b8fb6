"""Token counts: the exact histogram of encoded lengths, and what its suffix sums answer.

Every whole text is encoded; documents are aggregated by length. For each occurring length L, taken as a
context limit, the suffix sums give the documents beyond it, the tokens that documents hold in all, the total
after truncation at L and the share of documents within it (the inverse of the quantile function). Between
two occurring lengths all answers follow from the lower one: see ``at_limit``; ``quantile`` gives the length that a
share of the documents doesn't exceed.

Defined results: null and empty texts are documents of 0 tokens; an empty table gives no row; repeated rows
count each; ``doc_id`` and other columns don't matter.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._tokens import VOCABULARY, encode, on_executor, shipped


def lengths(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(*keep, n_tokens) of every row."""

    name = shipped(docs.sparkSession, vocabulary)

    def count(batches):
        enc = on_executor(name)
        for b in batches:
            n = [len(encode(enc, t.as_py())) if t.is_valid else 0 for t in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(n, pa.int64())], [*keep, "n_tokens"])

    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    return rows.mapInArrow(count, ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes[: len(keep)]), "n_tokens long"]))


def length_report(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each occurring length, as ``context_limit``."""
    hist = lengths(docs, vocabulary).groupBy(F.col("n_tokens").alias("context_limit")).agg(F.count("*").alias("n_docs"))
    # One row for each distinct length (bounded by the longest document, not by the corpus): a single partition holds them.
    over = Window.orderBy(F.desc("context_limit")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    zero = F.lit(0).cast("long")
    tokens = F.col("context_limit") * F.col("n_docs")
    sums = hist.withColumns({"docs_over": F.coalesce(F.sum("n_docs").over(over), zero), "tokens_over": F.coalesce(F.sum(tokens).over(over), zero), "docs_total": F.sum("n_docs").over(every), "tokens_total": F.sum(tokens).over(every)})
    return sums.select(
        "context_limit",
        "n_docs",
        "docs_over",
        (F.col("docs_total") - F.col("docs_over")).alias("docs_within"),
        ((F.col("docs_total") - F.col("docs_over")) / F.col("docs_total")).alias("quantile"),
        "tokens_total",
        (F.col("tokens_total") - F.col("tokens_over") + F.col("context_limit") * F.col("docs_over")).alias("truncated_total"),
        (F.col("tokens_over") - F.col("context_limit") * F.col("docs_over")).alias("tokens_lost"),
    )


def at_limit(report: DataFrame, limit: int) -> DataFrame:
    """(docs_over, truncated_total, tokens_lost) for any context limit, from the report's next lower row."""
    total = F.max("tokens_total")
    low = report.where(F.col("context_limit") <= limit).agg(F.max_by(F.struct("context_limit", "docs_over", "truncated_total"), "context_limit").alias("low"))
    every = report.agg(F.sum("n_docs").alias("docs"), total.alias("tokens"))
    over = F.coalesce("low.docs_over", "docs")
    kept = F.coalesce(F.col("low.truncated_total") + (F.lit(limit) - F.col("low.context_limit")) * F.col("low.docs_over"), F.lit(limit) * F.col("docs"))
    return low.crossJoin(every).select(over.alias("docs_over"), kept.alias("truncated_total"), (F.col("tokens") - kept).alias("tokens_lost"))


def quantile(report: DataFrame, share: float) -> DataFrame:
    """(context_limit): the smallest length that at least ``share`` of the documents don't exceed; null for an empty report."""
    if not 0 <= share <= 1:
        raise ValueError("a share is from 0 to 1")
    every = report.agg(F.sum("n_docs").alias("docs"))
    # The right side has one row.
    return report.crossJoin(F.broadcast(every)).where(F.col("docs_within") >= F.lit(share) * F.col("docs")).agg(F.min("context_limit").alias("context_limit"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
