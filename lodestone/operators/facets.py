"""Facets as a tall relation (field, category, doc): filters and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tall(docs: DataFrame, fields: dict[str, F.Column]) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), c.cast("string").alias("category")) for f, c in fields.items()])).alias("x")
    return docs.select("doc", rows).select("x.field", "x.category", "doc").where("category is not null").distinct()


def dictionary(facets: DataFrame) -> DataFrame:
    return facets.groupBy("field", "category").agg(F.count("*").alias("cnt"))


def chosen(sel: list[tuple[str, str]]):
    return reduce(lambda a, b: a | b, [(F.col("field") == f) & (F.col("category") == c) for f, c in sel], F.lit(False))


def parse_filter(entries) -> list[tuple[str, str]]:
    """Filter entries as pairs of strings; anything else is an error."""
    out = []
    for e in entries:
        if not (isinstance(e, (list, tuple)) and len(e) == 2 and all(isinstance(x, str) for x in e)):
            raise ValueError(f"not a (field, category) pair: {e!r}")
        out.append((e[0], e[1]))
    return out


def matching(facets: DataFrame, include: list[tuple[str, str]]) -> DataFrame:
    """Documents with a chosen category in every chosen field. A field without one that exists matches nothing."""
    include = parse_filter(include)
    need = len({f for f, _ in include})
    return facets.where(chosen(include)).groupBy("doc").agg(F.countDistinct("field").alias("n")).where(F.col("n") == need).select("doc")


def apply(hits: DataFrame, facets: DataFrame, include: list[tuple[str, str]] = (), exclude: list[tuple[str, str]] = ()) -> DataFrame:
    """Hits inside ``include`` and outside every excluded category; names that don't exist exclude nothing."""
    if include:
        hits = hits.join(matching(facets, list(include)), "doc", "left_semi")
    if exclude:
        hits = hits.join(facets.where(chosen(parse_filter(exclude))), "doc", "left_anti")
    return hits


def full_set(facets: DataFrame, include: list[tuple[str, str]], exclude: list[tuple[str, str]] = ()) -> DataFrame:
    """The documents inside ``include`` and outside ``exclude``, without hits to start from; none where nothing is included."""
    if not include:
        return facets.select("doc").limit(0)
    return apply(matching(facets, include), facets, exclude=exclude)


def counts(hits: DataFrame, facets: DataFrame, head: int | None = None, zeros: bool = True, known: DataFrame | None = None) -> DataFrame:
    """(field, category, cnt) over the hits, or over those with ``doc < head``; ``known``: a stored dictionary, whose categories are listed."""
    if head is not None:
        hits = hits.where(F.col("doc") < head)
    got = facets.join(hits.select("doc"), "doc", "left_semi").groupBy("field", "category").agg(F.count("*").alias("cnt"))
    if not zeros:
        return got
    return (dictionary(facets) if known is None else known).drop("cnt").join(got, ["field", "category"], "left").select("field", "category", F.coalesce("cnt", F.lit(0).cast("long")).alias("cnt"))


def counts_top(hits: DataFrame, facets: DataFrame, n: int, head: int) -> DataFrame:
    """Exact counts for the ``n`` largest categories of each field, counts over the head for the rest."""
    order = Window.partitionBy("field").orderBy(F.desc("cnt"), "category")
    top = dictionary(facets).withColumn("o", F.row_number().over(order)).select("field", "category", (F.col("o") <= n).alias("exact"))
    both = facets.join(hits.select("doc"), "doc", "left_semi").groupBy("field", "category").agg(F.count("*").alias("whole"), F.count_if(F.col("doc") < head).alias("part"))
    return top.join(both, ["field", "category"], "left").select("field", "category", "exact", F.coalesce(F.when(F.col("exact"), F.col("whole")).otherwise(F.col("part")), F.lit(0).cast("long")).alias("cnt"))


def counts_for(hits: DataFrame, facets: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(pos, field, category, cnt) for named pairs in their order; unknown ones count 0."""
    asked = facets.sparkSession.createDataFrame([(i, f, c) for i, (f, c) in enumerate(parse_filter(pairs))], "pos int, field string, category string")
    got = facets.where(chosen(pairs)).join(hits.select("doc"), "doc", "left_semi").groupBy("field", "category").agg(F.count("*").alias("cnt"))
    return asked.join(got, ["field", "category"], "left").select("pos", "field", "category", F.coalesce("cnt", F.lit(0).cast("long")).alias("cnt"))


def count_bound(dictionary: DataFrame, include: list[tuple[str, str]]) -> DataFrame:
    """(bound): the smallest, over the chosen fields, of the sum of their categories' counts."""
    return dictionary.where(chosen(include)).groupBy("field").agg(F.sum("cnt").alias("c")).agg(F.coalesce(F.when(F.count("*") == len({f for f, _ in include}), F.min("c")), F.lit(0).cast("long")).alias("bound"))
