"""Split sets: document ranges with a manifest, tiered and keyed search, base plus delta with tombstones."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import fresh, staged
from . import facets as FA
from . import search as S


def assign(docs: DataFrame, size: int) -> DataFrame:
    """``split`` by ranges of ``size`` documents."""
    return docs.withColumn("split", F.floor(F.col("doc") / size).cast("long"))


def seal(doc_keys: DataFrame, cap: int, cap_max: int, stride: int = 64, band: int | None = None) -> DataFrame:
    """(doc, split, tier): exact greedy sealing by estimated bytes, in document order.

    The decision depends on all keys of the open split, so it is one ordered pass over a ``band`` of document ids
    (tiers start anew in each band; bands are sealed side by side); without a band, over all documents in
    one task. ``doc_keys`` is (doc, keys).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, split, seen, incidences = [], 0, set(), 0
        for doc, keys in pdf.sort_values("doc")[["doc", "keys"]].itertuples(index=False):
            keys = set(keys)
            n = len(seen | keys)
            grown = 20 + n * 64 + -(-n // stride) * 8 + 2 * (incidences + len(keys))
            if seen and grown > min(cap << min(split, 40), cap_max):
                split, seen, incidences = split + 1, set(), 0
            seen |= keys
            incidences += len(keys)
            out.append((doc, split, split))
        return pd.DataFrame(out, columns=["doc", "split", "tier"])

    (b,) = fresh(doc_keys, "band")
    banded = doc_keys.withColumn(b, F.lit(0).cast("long") if band is None else F.floor(F.col("doc") / band).cast("long"))
    local = banded.groupBy(b).applyInPandas(run, "doc long, split long, tier long")
    if band is None:
        return local
    local = staged(local.withColumn("band", F.floor(F.col("doc") / band).cast("long")))
    sizes = local.groupBy("band").agg(F.max("split").alias("last"))  # a row for each band
    base = sizes.select(F.col("band").alias("b"), F.coalesce(F.sum(F.col("last") + 1).over(Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return local.join(F.broadcast(base), F.col("band") == F.col("b")).select("doc", (F.col("base") + F.col("split")).alias("split"), "tier")


def merged(bands: list[DataFrame]) -> DataFrame:
    """The manifests of separately built bands as one, split numbers running on; document ranges that overlap are an error."""
    out, base, end = None, 0, -1
    for m in bands:
        lo, hi, n = m.where("doc_count > 0").agg(F.min("doc_lo"), F.max("doc_hi"), F.max("split")).first()
        if lo is None:
            continue
        if lo <= end:
            raise ValueError(f"document {lo} lies in two bands")
        part = m.withColumn("split", F.col("split") + base)
        out, base, end = part if out is None else out.unionByName(part), base + n + 1, hi
    if out is None:
        raise ValueError("no band holds a document")
    return out


def manifest(docs: DataFrame) -> DataFrame:
    """(split, doc_lo, doc_hi, doc_count)."""
    return docs.groupBy("split").agg(F.min("doc").alias("doc_lo"), F.max("doc").alias("doc_hi"), F.count("*").alias("doc_count"))


def locate(ids: DataFrame, splits: DataFrame) -> DataFrame:
    """Each id's split and its number inside it, by an equi-join on cells of the id space about as wide as a split."""
    held = splits.where("doc_count > 0")
    width = max(1, int(held.agg(F.avg(F.col("doc_hi") - F.col("doc_lo") + 1)).first()[0] or 1))
    cells = held.withColumn("cell", F.explode(F.sequence(F.floor(F.col("doc_lo") / width), F.floor(F.col("doc_hi") / width)))).select("cell", "split", "doc_lo", "doc_hi")
    near = ids.withColumn("cell", F.floor(F.col("doc") / width)).join(cells, "cell")
    return near.where("doc between doc_lo and doc_hi").select("doc", "split", (F.col("doc") - F.col("doc_lo")).alias("local"))


def summary(postings: DataFrame, key: str) -> DataFrame:
    """(split, key, df): what each split holds, for pruning and for prices. ``postings`` has ``split``."""
    return postings.groupBy("split", key).agg(F.count("*").alias("df"))


def facet_summary(facets: DataFrame) -> DataFrame:
    """(split, field, category, df) of ``facets`` with ``split``."""
    return facets.groupBy("split", "field", "category").agg(F.count("*").alias("df"))


def holding(stored: DataFrame, key: str, keys: list[str]) -> DataFrame:
    """(split): the splits in which no key is absent."""
    return stored.where(F.col(key).isin(keys)).groupBy("split").agg(F.countDistinct(key).alias("n")).where(F.col("n") == len(set(keys))).select("split")


def allowing(digest: DataFrame, include: list[tuple[str, str]]) -> DataFrame:
    """(split): the splits with a chosen category in every chosen field."""
    need = len({f for f, _ in FA.parse_filter(include)})
    return digest.where(FA.chosen(include)).groupBy("split").agg(F.countDistinct("field").alias("n")).where(F.col("n") == need).select("split")


def search_filtered(postings: DataFrame, facets: DataFrame, stored: DataFrame, digest: DataFrame, key: str, keys: list[str], include: list[tuple[str, str]], limit: int, exclude=()) -> DataFrame:
    """The first ``limit`` matches inside ``include``: splits without a key or a category aren't read. Excludes are an error."""
    if exclude:
        raise ValueError("split sets take no excludes")
    # A row for each split at most, so broadcast by Spark while it is small.
    splits = holding(stored, key, keys)
    if include:
        splits = splits.join(allowing(digest, include), "split", "left_semi")
    hits = S.k_of_n(postings.join(splits, "split", "left_semi"), key, keys).select("doc")
    if include:
        hits = FA.apply(hits, facets.join(splits, "split", "left_semi"), include)
    return S.page(hits, limit)


def alive(hits: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Every tombstone hides its document, in base and delta alike."""
    return hits.join(tombstones.select("doc").distinct(), "doc", "left_anti")


def tiered(postings: DataFrame, splits: DataFrame, key: str, keys: list[str], limit: int) -> DataFrame:
    """The first ``limit`` matches in rank order: splits are read from the best on, four times as many each time, until the page is full.

    ``postings`` should be stored: each step reads the row groups of its keys and documents only.
    """
    bounds = [r.doc_hi for r in splits.where("doc_count > 0").orderBy("doc_lo").select("doc_hi").collect()]
    done, step = 0, 1
    while True:
        done = min(len(bounds), done + step)
        bound = bounds[done - 1] if bounds else -1
        hits = S.k_of_n(postings.where(F.col("doc") <= bound), key, keys).select("doc").orderBy("doc").limit(limit)
        if done >= len(bounds) or hits.count() >= limit:
            return hits
        step *= 4


def stable_key(hits: DataFrame, columns: DataFrame, value: str | None, limit: int, ascending: bool = False) -> DataFrame:
    """The first ``limit`` hits by a stored column, either way; without one, in rank order."""
    if value is None:
        return S.page(hits.select("doc"), limit)
    v = F.col(value)
    return hits.join(columns, "doc").orderBy(v.asc_nulls_last() if ascending else v.desc_nulls_last(), "doc").select("doc", value).limit(limit)


def base_then_delta(base: DataFrame, delta: DataFrame, tombstones: DataFrame, limit: int) -> DataFrame:
    """Surviving base hits in rank order, then surviving delta hits in order of ingestion."""
    both = base.select("doc", F.lit(False).alias("is_delta")).unionByName(delta.select("doc", F.lit(True).alias("is_delta")))
    return alive(both, tombstones).orderBy("is_delta", "doc").limit(limit)


def facet_counts(hits: DataFrame, facets: DataFrame) -> DataFrame:
    return FA.counts(hits, facets, zeros=False)


def facet_counts_top(hits: DataFrame, facets: DataFrame, n: int = 128) -> DataFrame:
    """(field, category, cnt) summed over splits, each split counting its ``n`` largest categories of a field only; no zeros. Both have ``split``."""
    order = Window.partitionBy("split", "field").orderBy(F.desc("df"), "category")
    top = facet_summary(facets).withColumn("o", F.row_number().over(order)).where(F.col("o") <= n).select("split", "field", "category")
    mine = facets.join(hits.select("doc"), "doc", "left_semi").groupBy("split", "field", "category").agg(F.count("*").alias("c"))
    return mine.join(top, ["split", "field", "category"], "left_semi").groupBy("field", "category").agg(F.sum("c").alias("cnt"))


def count_estimate(stored: DataFrame, key: str, keys: list[str], changed: bool = False) -> DataFrame:
    """(estimate, exact): the sum over splits of the smallest document count, 0 where a key is absent; exact for one key with neither deltas nor tombstones (``changed``)."""
    low = stored.where(F.col(key).isin(keys)).groupBy("split").agg(F.count("*").alias("n"), F.min("df").alias("low")).where(F.col("n") == len(set(keys)))
    return low.agg(F.coalesce(F.sum("low"), F.lit(0).cast("long")).alias("estimate")).withColumn("exact", F.lit(len(set(keys)) == 1 and not changed))


def verify(docs: DataFrame, splits: DataFrame) -> DataFrame:
    """(split, problem): splits whose documents and manifest disagree, and ranges that overlap. Nothing means sound."""
    real = manifest(docs).withColumnsRenamed({"doc_lo": "lo", "doc_hi": "hi", "doc_count": "n"})
    both = splits.join(real, "split", "full").select("split", F.when(F.col("doc_count").isNull(), "not in the manifest").when(F.col("n").isNull() & (F.col("doc_count") > 0), "no documents").when(F.coalesce((F.col("lo") != F.col("doc_lo")) | (F.col("hi") != F.col("doc_hi")), F.lit(False)), "range").when(F.coalesce(F.col("n") != F.col("doc_count"), F.lit(False)), "count").alias("problem"))
    # A row for each split.
    after = splits.where("doc_count > 0").withColumn("next", F.lead("doc_lo").over(Window.orderBy("doc_lo"))).where("next <= doc_hi")
    return both.where("problem is not null").unionByName(after.select("split", F.lit("overlap").alias("problem")))
