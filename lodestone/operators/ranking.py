"""Relevance and orders: BM25, fusion, sort columns, secondary orders, gathers, vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def rerank(candidates: DataFrame, impacts: DataFrame, dictionary: DataFrame, stats: DataFrame, keys: list[str], k: int, k1: float = 1.2, digits: int | None = None) -> DataFrame:
    """The best ``k`` candidates by summed ``idf * impact`` of the query's ``keys``; those without a term score 0. ``digits``: scores that agree so far are ties."""
    few = dictionary.where(F.col("term").isin(keys))  # a row for each term of the query
    weights = few.crossJoin(F.broadcast(stats)).select("term", X.idf(F.col("n"), F.col("df")).alias("w"))
    near = impacts.where(F.col("term").isin(keys)).join(candidates.select("doc"), "doc", "left_semi")
    part = near.join(F.broadcast(weights), "term").groupBy("doc").agg(F.sum(F.col("w") * F.col("impact") * (k1 + 1) / 255.0).alias("s"))
    return candidates.select("doc").join(part, "doc", "left").select("doc", rounded(F.coalesce("s", F.lit(0.0)), digits).alias("score")).orderBy(F.desc("score"), "doc").limit(k)


def rounded(score: Column, digits: int | None) -> Column:
    return score if digits is None else F.round(score, digits)


def fuse(lists: list[DataFrame], k: float = 60.0, weights: list[float] | None = None) -> DataFrame:
    """Reciprocal-rank fusion of (doc, rank) lists, ranks from 1."""
    weights = weights or [1.0] * len(lists)
    if len(weights) != len(lists):
        raise ValueError("as many weights as lists")
    parts = [d.select("doc", (F.lit(float(w)) / (F.lit(float(k)) + F.col("rank"))).alias("s")) for d, w in zip(lists, weights)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("doc").agg(F.sum("s").alias("score"))


def with_rank(df: DataFrame, *order) -> DataFrame:
    """``rank`` from 1 over a list that a limit has made short."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def sort_topk(hits: DataFrame, columns: DataFrame, value: str, k: int, ascending: bool = False) -> DataFrame:
    v = F.col(value).cast("double")
    return hits.join(columns, "doc").orderBy(v.asc() if ascending else v.desc(), "doc").limit(k)


def column_metadata(docs: DataFrame, names: list[str]) -> DataFrame:
    """(name, n_values, low, high) of numeric sort columns, in one pass (from the files' statistics where Spark can)."""
    wide = docs.agg(*[x for n in names for x in (F.count(n).alias(f"n_{n}"), F.min(n).alias(f"lo_{n}"), F.max(n).alias(f"hi_{n}"))])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"n_{n}").alias("n_values"), F.col(f"lo_{n}").cast("long").alias("low"), F.col(f"hi_{n}").cast("long").alias("high")) for n in names])))


def column_values(docs: DataFrame, ids: list[int], name: str) -> DataFrame:
    """(doc, value) of the named documents in any order; an id beyond the column is an error."""
    rows = docs.count()
    if any(not 0 <= i < rows for i in ids):
        raise ValueError(f"ids go from 0 to {rows - 1}")
    return docs.where(F.col("doc").isin(list(ids))).select("doc", F.col(name).alias("value"))


def secondary_page(hits: DataFrame, perm: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return hits.join(perm, "doc").orderBy("sec_doc").offset(offset).limit(limit).select("sec_doc", "doc")


def gather(ids: DataFrame, table: DataFrame) -> DataFrame:
    """The table's row for each id; nulls where there is none."""
    return ids.join(table, "doc", "left")


def exact_knn(vectors: DataFrame, query: list[float], k: int, metric: str = "ip", digits: int | None = None) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in query])
    score = X.dot(F.col("v"), q) if metric == "ip" else -X.squared_distance(F.col("v"), q)
    return vectors.select("doc", rounded(score, digits).alias("score")).orderBy(F.desc("score"), "doc").limit(k)


def kmeans(x: np.ndarray, k: int, rounds: int = 25, seed: int = 42) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        a = ((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)).argmin(1)
        for j in range(len(c)):
            c[j] = x[a == j].mean(0) if (a == j).any() else x[rng.integers(len(x))]
    return c


#: At most about so many vectors train an index (chosen by a hash of their ids), whatever their number; all are encoded.
TRAIN_BOUND = 20_000


#: Vectors encoded at a time, and queries that meet a block of vectors in one task (about).
AT_ONCE, ASKED = 512, 1024


class Ivfpq:
    """Inverted lists over product-quantised residuals. Fitted on a bounded sample (``TRAIN_BOUND``) or given as parts; every vector is encoded by Arrow batches."""

    def __init__(self, centroids: np.ndarray, books: np.ndarray, metric: str = "ip"):
        """``centroids``: nlist x dim; ``books``: m x codes x dim/m."""
        if centroids.ndim != 2 or books.ndim != 3 or centroids.shape[1] != books.shape[0] * books.shape[2]:
            raise ValueError("dimensions differ")
        if metric not in ("ip", "l2"):
            raise ValueError(f"unknown metric {metric!r}")
        if not (np.isfinite(centroids).all() and np.isfinite(books).all()):
            raise ValueError("parts must be finite")
        self.centroids, self.books, self.metric = centroids, books, metric

    def take(self, codes: DataFrame) -> DataFrame:
        """Codes (cluster, doc, code) made elsewhere, checked against the parts."""
        bad = codes.where((F.col("cluster") < 0) | (F.col("cluster") >= len(self.centroids)) | (F.size("code") != len(self.books)) | F.exists("code", lambda c: (c < 0) | (c >= self.books.shape[1])))
        if not bad.isEmpty():
            raise ValueError("codes don't fit the parts")
        return codes

    def _unit(self, x: np.ndarray) -> np.ndarray:
        return x / np.maximum(1e-12, np.linalg.norm(x, axis=1))[:, None] if self.metric == "ip" else x

    @classmethod
    def train(cls, vectors: DataFrame, nlist: int = 16, m: int = 8, bits: int = 6, metric: str = "ip", sample: int = TRAIN_BOUND) -> Ivfpq:
        n = vectors.count()
        rows = vectors.where(F.pmod(F.xxhash64("doc"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / max(1, n)))).orderBy("doc").toPandas()
        x = np.stack(rows.v).astype(np.float64)
        if metric == "ip":
            x = x / np.maximum(1e-12, np.linalg.norm(x, axis=1))[:, None]
        c = kmeans(x, min(nlist, len(x)))
        near = ((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)).argmin(1)
        rest = (x - c[near]).reshape(len(x), m, -1)
        size = min(1 << bits, len(x))
        return cls(c, np.stack([kmeans(rest[:, s], size, seed=s) for s in range(m)]), metric)

    def encode(self, vectors: DataFrame) -> DataFrame:
        """(cluster, doc, code); write it partitioned by cluster."""
        c, books, unit = self.centroids, self.books, self._unit

        def run(parts):
            for pdf in parts:
                if not len(pdf):
                    continue
                for at in range(0, len(pdf), AT_ONCE):
                    part = pdf[at : at + AT_ONCE]
                    x = unit(np.stack(part.v).astype(np.float64))
                    near = ((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)).argmin(1)
                    rest = (x - c[near]).reshape(len(x), len(books), -1)
                    code = np.stack([((rest[:, s, None] - books[s]) ** 2).sum(2).argmin(1) for s in range(len(books))], axis=1)
                    yield pd.DataFrame({"cluster": near, "doc": part.doc, "code": list(code.astype(np.int16))})

        return vectors.select("doc", "v").mapInPandas(run, "cluster int, doc long, code array<smallint>")

    def search(self, codes: DataFrame, query: list[float], k: int, nprobe: int = 8) -> DataFrame:
        """(doc, score) of the best ``k`` in the ``nprobe`` nearest lists, by table look-ups inside the JVM."""
        q = np.asarray(query, np.float64)
        if len(q) != self.centroids.shape[1]:
            raise ValueError("dimensions differ")
        q = self._unit(q[None])[0]
        lists = np.argsort(((self.centroids - q) ** 2).sum(1), kind="stable")[: max(1, nprobe)]
        tables = []
        for c in lists.tolist():
            rest = (q - self.centroids[c]).reshape(len(self.books), -1)
            tables.append((c, [((self.books[s] - rest[s]) ** 2).sum(1).tolist() for s in range(len(self.books))]))
        adc = codes.sparkSession.createDataFrame(tables, "cluster int, adc array<array<double>>")
        near = codes.where(F.col("cluster").isin(lists.tolist())).join(F.broadcast(adc), "cluster")
        dist = F.aggregate(F.zip_with("adc", "code", lambda t, c: F.element_at(t, c.cast("int") + 1)), F.lit(0.0), lambda a, x: a + x)
        score = 1 - F.col("dist") / 2 if self.metric == "ip" else -F.col("dist")
        return near.select("doc", dist.alias("dist")).orderBy("dist", "doc").limit(k).select("doc", score.alias("score"))

    def search_rerank(self, codes: DataFrame, vectors: DataFrame, query: list[float], k: int, r: int = 100, nprobe: int = 8) -> DataFrame:
        found = self.search(codes, query, max(r, k), nprobe).select("doc")
        return exact_knn(vectors.join(F.broadcast(found), "doc", "left_semi"), query, k, self.metric)

    def search_all(self, codes: DataFrame, queries: DataFrame, k: int, nprobe: int = 8, block: int = 32768) -> DataFrame:
        """(q, doc, score): the best ``k`` of each of the ``queries`` (q, v), approximately.

        Each query goes to the lists it probes. A task scores a block (about ``block``) of one list's codes for a block (about
        ``ASKED``) of the queries and passes on the best ``k`` of each, so its memory doesn't follow the number of either.
        """
        c, books, unit, metric = self.centroids, self.books, self._unit, self.metric

        # A row for each list, whatever the number of vectors.
        blocks = {r.cluster: -(-r.n // block) for r in codes.groupBy("cluster").agg(F.count("*").alias("n")).collect()}
        m = max(1, -(-queries.count() // ASKED))

        def probe(parts):
            for pdf in parts:
                for at in range(0, len(pdf), 64):
                    part = pdf[at : at + 64]
                    x = unit(np.stack(part.v).astype(np.float64))
                    near = np.argsort((c**2).sum(1) - 2 * x @ c.T, axis=1, kind="stable")[:, : max(1, nprobe)]
                    yield pd.DataFrame({"q": part.q, "cells": list(near.astype(np.int32)), "v": part.v})

        sizes = codes.sparkSession.createDataFrame(list(blocks.items()) or [(0, 1)], "cluster int, blocks int")
        codes = codes.join(F.broadcast(sizes), "cluster").withColumn("b", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
        spread = codes.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
        asked = queries.select("q", "v").mapInPandas(probe, "q long, cells array<int>, v array<double>").select("q", "v", F.pmod(F.xxhash64("q"), F.lit(m)).cast("int").alias("i"), F.explode("cells").alias("cluster"))
        asked = asked.join(F.broadcast(sizes), "cluster").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

        def score(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(qs) and len(cs):
                cell = int(qs.cluster.iloc[0])
                code, doc = np.stack(cs.code).astype(np.int64).T.copy(), cs.doc.to_numpy()
                for v in unit(np.stack(qs.v).astype(np.float64)):
                    rest = (v - c[cell]).reshape(len(books), -1)
                    dist = sum(((books[s] - rest[s]) ** 2).sum(1)[code[s]] for s in range(len(books)))
                    out.append((*_first(dist, doc, k),))
            if not out:
                return pd.DataFrame({"q": [], "doc": [], "dist": []})
            return pd.DataFrame({"q": np.repeat(qs.q.to_numpy(), [len(d) for d, _ in out]), "doc": np.concatenate([d for d, _ in out]), "dist": np.concatenate([x for _, x in out])})

        by = ["cluster", "b", "i"]
        found = asked.drop("blocks").groupBy(*by).cogroup(spread.drop("blocks").groupBy(*by)).applyInPandas(score, "q long, doc long, dist double")
        best = found.withColumn("o", F.row_number().over(Window.partitionBy("q").orderBy("dist", "doc"))).where(F.col("o") <= k)
        return best.select("q", "doc", (1 - F.col("dist") / 2 if metric == "ip" else -F.col("dist")).alias("score"))


def _first(low: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, values) of the ``k`` lowest values, ties by document."""
    near = np.flatnonzero(low <= np.partition(low, k - 1)[k - 1]) if len(low) > k else np.arange(len(low))
    best = near[np.lexsort([doc[near], low[near]])[:k]]
    return doc[best], low[best]


def exact_all(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "ip", block: int = 8192) -> DataFrame:
    """(q, doc, score): the exact best ``k`` of every query (q, v), queries in blocks against all vectors.

    The queries are a stated set; each block of vectors meets each block (about ``ASKED``) of queries in one task, which scores a few
    queries at a time and passes on the best ``k`` of each, so its memory doesn't follow the number of either.
    """
    n = max(1, -(-queries.count() // ASKED))
    m = max(1, -(-vectors.count() // block))
    a = queries.select("q", "v", F.pmod(F.xxhash64("q"), F.lit(n)).cast("int").alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    b = vectors.select("doc", "v", F.pmod(F.xxhash64("doc"), F.lit(m)).cast("int").alias("j")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def best(qs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(vs):
            return pd.DataFrame({"q": [], "doc": [], "score": []})
        x, y, doc = np.stack(qs.v).astype(np.float64), np.stack(vs.v).astype(np.float64), vs.doc.to_numpy()
        length, out = (y**2).sum(1), []
        for at in range(0, len(x), 64):
            z = x[at : at + 64]
            s = z @ y.T if metric == "ip" else -((z**2).sum(1)[:, None] - 2 * z @ y.T + length)
            out += [_first(-r, doc, k) for r in s]
        return pd.DataFrame({"q": np.repeat(qs.q.to_numpy(), [len(d) for d, _ in out]), "doc": np.concatenate([d for d, _ in out]), "score": np.concatenate([-x for _, x in out])})

    found = a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInPandas(best, "q long, doc long, score double")
    return found.withColumn("o", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc"))).where(F.col("o") <= k).drop("o")


def rerank_all(found: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, metric: str = "ip") -> DataFrame:
    """The best ``k`` of each query's candidates (q, doc) by their full vectors."""
    both = found.select("q", "doc").join(vectors.select("doc", F.col("v").alias("dv")), "doc").join(queries.select("q", F.col("v").alias("qv")), "q")
    score = X.dot(F.col("dv"), F.col("qv")) if metric == "ip" else -X.squared_distance(F.col("dv"), F.col("qv"))
    got = both.select("q", "doc", score.alias("score"))
    return got.withColumn("o", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc"))).where(F.col("o") <= k).drop("o")
