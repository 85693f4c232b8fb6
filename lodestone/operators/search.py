"""Boolean retrieval over postings: conjunction, k of n, candidates, prefixes, estimates, paging, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stemming import stem, stem_word


def k_of_n(postings: DataFrame, key: str, keys: list[str], missing: int = 0) -> DataFrame:
    """Documents that hold all but ``missing`` of the keys (absent keys count as missing); at least one."""
    need = max(1, len(set(keys)) - missing)
    if not keys:
        return postings.select("doc").limit(0)
    return postings.where(F.col(key).isin(list(set(keys)))).groupBy("doc").agg(F.countDistinct(key).alias("n_match")).where(F.col("n_match") >= need)


def min_match(postings: DataFrame, dictionary: DataFrame, key: str, keys: list[str], least: int) -> DataFrame:
    """(doc, n_match) with at least ``least`` of the keys that exist, as far as there are so many; nothing where none exists."""
    n = dictionary.where(F.col(key).isin(keys)).agg(F.count("*").alias("__n"))
    need = F.greatest(F.lit(1), F.least(F.lit(least), F.col("__n")))
    # One row on the right.
    got = postings.where(F.col(key).isin(keys)).groupBy("doc").agg(F.countDistinct(key).alias("n_match"))
    return got.crossJoin(F.broadcast(n)).where(F.col("n_match") >= need).select("doc", "n_match")


def query_postings(postings: DataFrame, dictionary: DataFrame, key: str, keys: list[str], strict: bool = True) -> DataFrame:
    """The postings of a query's keys; strict: none at all where one of them is absent, else those of the keys that exist."""
    rows = postings.where(F.col(key).isin(keys))
    if not strict:
        return rows
    whole = dictionary.where(F.col(key).isin(keys)).agg((F.count("*") == len(set(keys))).alias("__whole"))
    return rows.crossJoin(F.broadcast(whole)).where("__whole").drop("__whole")


class Cursor:
    """Pages of a hit list in rank order. Each page starts after the last one's document, so none is read twice."""

    def __init__(self, hits: DataFrame):
        self.hits, self.last, self.loaded = hits.select("doc"), -1, 0

    def next(self, n: int) -> list[int]:
        """The next ``n`` documents at most, and always as many as there are."""
        got = [r.doc for r in self.hits.where(F.col("doc") > self.last).orderBy("doc").limit(n).collect()]
        self.last = got[-1] if got else self.last
        self.loaded += len(got)
        return got

    def page(self, offset: int, limit: int) -> DataFrame:
        return page(self.hits, limit, offset)


def page(hits: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return hits.orderBy("doc").offset(offset).limit(limit)


def rarest(dictionary: DataFrame, key: str, keys: list[str], k: int) -> list[str]:
    """The ``k`` keys with the fewest documents; none if any key is absent."""
    found = dictionary.where(F.col(key).isin(keys)).orderBy("df", key).collect()
    return [r[key] for r in found[:k]] if len(found) == len(set(keys)) else []


def estimate(dictionary: DataFrame, key: str, keys: list[str]) -> DataFrame:
    """(estimate, exact, cost): the smallest document count, whether that is exact, and the postings to be read."""
    n = len(set(keys))
    got = dictionary.where(F.col(key).isin(keys)).agg(F.count("*").alias("found"), F.min("df").alias("low"), F.sum("df").alias("total"))
    whole = F.col("found") == n
    zero = F.lit(0).cast("long")
    return got.select(F.when(whole, F.col("low")).otherwise(zero).alias("estimate"), (~whole | F.lit(n == 1)).alias("exact"), F.when(whole, F.col("total")).otherwise(zero).alias("cost"))


def complete(dictionary: DataFrame, prefix: str, n: int) -> DataFrame:
    return dictionary.where(F.col("term").startswith(prefix.lower())).orderBy("term").limit(n)


def prefix_search(postings: DataFrame, prefix: str, cap: int = 2048) -> DataFrame:
    """Documents with any of the first ``cap`` terms (in term order) that start with ``prefix``."""
    rows = postings.where(F.col("term").startswith(prefix.lower()))
    terms = rows.select("term").distinct().orderBy("term").limit(cap)
    return rows.join(terms, "term", "left_semi").select("doc").distinct()


def prefix_truncated(dictionary: DataFrame, prefix: str, cap: int = 2048) -> DataFrame:
    """(n_terms, truncated): how many terms a prefix search takes, and whether the cap leaves some out."""
    n = dictionary.where(F.col("term").startswith(prefix.lower())).agg(F.count("*").alias("n"))
    return n.select(F.least("n", F.lit(cap)).cast("long").alias("n_terms"), (F.col("n") > cap).alias("truncated"))


def containing(hits: DataFrame, docs: DataFrame, phrase: str) -> DataFrame:
    """The hits whose text holds the phrase, whatever the case: n-gram hits are a superset of them."""
    found = docs.where(F.contains(F.lower("text"), F.lit(phrase.lower()))).select("doc")
    return hits.join(found, "doc", "left_semi")


def forms(dictionary: DataFrame, word: str, language: str = "english") -> list[str]:
    """The terms of a dictionary, or of the part of it that is asked about, with the stem of ``word``: a word's inflections, a short list."""
    same = dictionary.where(stem(F.col("term"), language) == stem_word(word, language))
    return sorted(r.term for r in same.select("term").collect())


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc").intersect(b.select("doc"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc").union(b.select("doc")).distinct()


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc").subtract(b.select("doc"))
