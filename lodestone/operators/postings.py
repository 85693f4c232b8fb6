"""Building the index relations: ranked ids, postings, dictionaries, lengths, impacts, facets, permutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.staging import ROW_GROUP, fresh, staged
from . import lists as L


#: Rows that name the borders of a range sort (about), partitions at most, rows of a partition at least.
BORDERS, PARTS, PART_ROWS = 40_000, 512, 2048


def assign_ranks(df: DataFrame, rank: str | None, key: str, name: str = "doc", weight: str | None = None) -> DataFrame:
    """Dense ids by descending ``rank`` (nulls last; none: by ``key`` alone), then ascending ``key``.

    A range sort numbers the rows of each partition; the partitions' sizes (a row for each) give what precedes
    it. Neither a frequent rank nor a unique one gathers in one task. The sorted rows are staged, so that sizes and
    numbers come from the same sort. Borders come from a sample of ``rank``, ``key`` and ``weight`` (what makes partitions even; none: rows)
    alone: Spark's own range partitioning evaluates whole rows for its sample, twice where they lie in one partition.
    """
    at, p, b = fresh(df, "__at", "__part", "__base")
    order = ([F.desc_nulls_last(rank)] if rank else []) + [F.asc(key)]
    cuts = _borders(df, rank, key, weight)
    moved = df.repartitionById(len(cuts) + 1, _part(df, rank, key, cuts)).sortWithinPartitions(*order)
    rows = staged(moved.withColumn(at, F.monotonically_increasing_id()), ROW_GROUP)
    part = F.shiftright(at, 33)
    sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    joined = rows.join(F.broadcast(base.toDF(p, b)), part == F.col(p))  # one row for each partition
    return joined.withColumn(name, F.col(b) + F.col(at).bitwiseAND((1 << 33) - 1)).drop(p, b, at)


def _borders(df: DataFrame, rank: str | None, key: str, weight: str | None) -> list[tuple]:
    """(rank, key) of the rows at which partitions of about the same weight begin, from the second partition on."""
    few = df.select((F.col(rank) if rank else F.lit(0)).alias("r"), F.col(key).alias("k"), (F.greatest(F.lit(1), F.col(weight)) if weight else F.lit(1)).cast("double").alias("w"))
    n = few.count()
    parts = min(PARTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // PART_ROWS + 1)
    if parts == 1:
        return []
    asked = few.sample(min(1.0, BORDERS / n), 1).orderBy(F.desc_nulls_last("r"), F.asc("k")).collect()
    total, so_far, out = sum(x.w for x in asked), 0.0, []
    for x in asked:
        if so_far >= total * (len(out) + 1) / parts and (x.r, x.k) not in out[-1:]:
            out.append((x.r, x.k))
        so_far += x.w
    return out


def _part(df: DataFrame, rank: str | None, key: str, cuts: list[tuple]) -> Column:
    """The number of ``cuts`` that a row doesn't precede, by halving."""

    def ahead(r, k) -> Column:
        key_ahead = F.lit(False) if k is None else F.col(key).isNull() | (F.col(key) < F.lit(k).cast(df.schema[key].dataType))
        if not rank:
            return key_ahead
        if r is None:
            return F.col(rank).isNotNull() | key_ahead
        at = F.lit(r).cast(df.schema[rank].dataType)
        return F.coalesce((F.col(rank) > at) | (F.col(rank) == at) & key_ahead, F.lit(False))

    def within(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(ahead(*cuts[mid]), within(lo, mid)).otherwise(within(mid + 1, hi))

    return within(0, len(cuts))


def gram_postings(docs: DataFrame, n: int = 3, only: list[str] | None = None, case_sensitive: bool = False) -> DataFrame:
    """Distinct (gram, doc). Grams are distinct inside a document already, so nothing is shuffled."""
    if n > L.PACKED:
        rows = docs.select("doc", F.explode(X.ngrams(F.col("text"), n, case_sensitive)).alias("gram"))
        return (rows.where(F.col("gram").isin(only)) if only is not None else rows).select("gram", "doc")
    lists = L.gram_lists(docs, n, case_sensitive)
    return (lists.where(F.col("gram").isin(only)) if only is not None else lists).select("gram", F.explode("docs").alias("doc"))


def gram_df(docs: DataFrame, n: int = 3, case_sensitive: bool = False) -> DataFrame:
    """(gram, df) of texts without ids: a row of ``docs`` is a document."""
    if n > L.PACKED:
        return dictionary(docs.select(F.explode(X.ngrams(F.col("text"), n, case_sensitive)).alias("gram")), "gram")
    return L.gram_counts(docs, n, case_sensitive).groupBy("gram").agg(F.sum("n").alias("df"))


def term_df(docs: DataFrame) -> DataFrame:
    """(term, df) of texts without ids: a row of ``docs`` is a document."""
    return L.term_counts(docs).groupBy("term").agg(F.sum("n").alias("df"))


def term_postings(docs: DataFrame, only: list[str] | None = None, stop: tuple[str, ...] = (), stem=None) -> DataFrame:
    """(term, doc, tf); ``stem`` maps a term's column after the stop words have gone. Only stems, which terms share, have to be added up across rows."""
    rows = L.term_lists(docs)
    if stop:
        rows = rows.where(~F.col("term").isin(*stop))
    if stem is not None:
        rows = rows.withColumn("term", stem(F.col("term")))
    if only is not None:
        rows = rows.where(F.col("term").isin(only))
    flat = rows.select("term", F.inline("docs")).select("term", "doc", "tf")
    return flat if stem is None else flat.groupBy("term", "doc").agg(F.sum("tf").alias("tf"))


def kept_lengths(docs: DataFrame, stop: tuple[str, ...] = X.ENGLISH) -> DataFrame:
    """(doc, n_kept): the words of a text without stop words; a document that keeps none has no row."""
    return docs.select("doc", F.size(X.without_stop_words(X.words(F.col("text")), stop)).cast("long").alias("n_kept")).where("n_kept > 0")


def dictionary(postings: DataFrame, key: str) -> DataFrame:
    return postings.groupBy(key).agg(F.count("*").alias("df"))


def length_of(text) -> Column:
    return F.size(X.words(text)).cast("long")


def doc_lengths(docs: DataFrame) -> DataFrame:
    """(doc, dl): a stored length where there is one."""
    return docs.select("doc", "dl") if "dl" in docs.columns else docs.select("doc", length_of(F.col("text")).alias("dl"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: documents and their mean length."""
    return doc_lengths(docs).agg(F.count("*").alias("n"), (F.sum("dl").cast("double") / F.count("*")).alias("avgdl"))


def weighed(counts: DataFrame, stats: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(term, doc, tf, impact) of rows (term, doc, tf, dl); the statistics are one row."""
    return counts.crossJoin(F.broadcast(stats)).select("term", "doc", "tf", X.quantize_impact(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b).alias("impact"))


def impacts(docs: DataFrame, only: list[str] | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(term, doc, tf, impact)."""
    rows = L.term_lists(docs)
    return weighed((rows.where(F.col("term").isin(only)) if only is not None else rows).select("term", F.inline("docs")), corpus_stats(docs), k1, b)


def permutation(docs: DataFrame, value: str) -> DataFrame:
    """(sec_doc, doc): the documents by descending ``value``, missing values last, ties by ``doc``."""
    return assign_ranks(docs.select("doc", value), value, "doc", "sec_doc").select("sec_doc", "doc")
