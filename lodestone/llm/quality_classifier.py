"""Quality classifier with hierarchical empirical Bayes over host and path.

A logistic regression on hashed token n-gram shares and a few shape features gives each document's own
evidence. Documents are grouped by host and path (any two columns: ``source`` and ``lang`` of ``documents``, which has no
addresses; ``with_site`` takes them from a URL); the expected number of good documents in each group updates Beta priors - a
path's prior is its host's posterior, a host's the global mean, with strengths from the spread between groups
(method of moments) - so sparse sites shrink towards the global rate. A document's own evidence is left out of its
path's, host's and the global rate before it is added to them: the posterior log-odds are its own plus its path's
shift against the global rate. All group sums are grouped aggregations over every document.

The regression is fitted on at most about ``FIT_BOUND`` labelled documents (chosen by a hash of ``doc_id``).

Defined results: null and empty texts have ``p_doc`` null, add nothing to their groups and take the path's
posterior; a null host or path is a group of its own; repeated rows count each; with labels of one
kind or none every ``p_doc`` is the labels' rate (1/2 with none); other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import bound_sample, cut
from ._text import pieces, strings
from .quality_rules import gram_cells

CELLS = 512
FIT_BOUND = 6_000
RIDGE = 1.0
STRENGTH = (2.0, 1e6)


def features(col, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """(n x (cells + 4) features, n-grams of each text)."""
    col = strings(col)
    out, n = np.zeros((len(col), cells + 4), np.float32), np.zeros(len(col), np.int64)
    low = pc.utf8_lower(col)
    for at, piece in pieces(low):
        doc, cell = gram_cells(piece, cells)
        rows = len(piece)
        count = np.bincount(doc * cells + cell, minlength=rows * cells).reshape(rows, cells)
        n[at : at + rows] = total = count.sum(axis=1)
        out[at : at + rows, :cells] = np.sqrt(count / np.maximum(1, total)[:, None])
    size = np.maximum(1, pc.utf8_length(col).to_numpy(zero_copy_only=False))
    for i, pattern in enumerate((r"\p{Lu}", r"[^\p{L}\p{N}\s]", r"\p{Nd}")):
        out[:, cells + i] = np.sqrt(pc.count_substring_regex(col, pattern).to_numpy(zero_copy_only=False) / size)
    out[:, cells + 3] = np.log1p(size) / 10
    return out, n


def fit(docs: DataFrame, labels: DataFrame, bound: int = FIT_BOUND, cells: int = CELLS, ridge: float = RIDGE) -> np.ndarray:
    """Weights, the intercept last, by iteratively reweighted least squares."""
    rows = bound_sample(labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good")).distinct(), "doc_id", bound)
    sample = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(rows), "doc_id")

    def extract(batches):
        for b in batches:
            x, n = features(b.column(1), cells)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(n)], ["doc_id", "good", "x", "n"])

    got = sample.select("doc_id", "text", "good").mapInArrow(extract, "doc_id long, good boolean, x binary, n long").where("n > 0").drop("n").toPandas().sort_values(["doc_id", "good"], kind="stable")
    w = np.zeros(cells + 5)
    good = got.good.to_numpy(bool)
    if not len(got) or good.all() or not good.any():
        rate = (good.sum() + 1) / (len(got) + 2)
        w[-1] = np.log(rate / (1 - rate))
        return w
    x = np.ones((len(got), cells + 5))
    x[:, :-1] = np.frombuffer(b"".join(got.x), np.float32).reshape(len(got), -1)
    penalty = np.full(cells + 5, ridge)
    penalty[-1] = 1e-6
    for _ in range(8):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        v = np.maximum(p * (1 - p), 1e-5)
        step = np.linalg.solve((x * v[:, None]).T @ x + np.diag(penalty), x.T @ (good - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def with_site(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``host`` (lower case, no port) and ``path`` (the first segment) of a URL; both null where it has no host."""
    host = F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]*)", 1)
    return pages.withColumns({"host": host, "path": F.when(host.isNotNull(), path)})


def document_evidence(docs: DataFrame, weights: np.ndarray, cells: int = CELLS, host: str = "source", path: str = "lang") -> DataFrame:
    """(doc_id, host, path, p_doc) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batches):
        w = held.value
        for b in batches:
            p = np.empty(b.num_rows)
            for at in range(0, b.num_rows, 512):
                x, n = features(b.column(3).slice(at, 512), cells)
                z = x @ w[:-1] + w[-1]
                p[at : at + len(n)] = np.where(n > 0, np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1e-6, 1 - 1e-6), np.nan)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.round(p, 9), mask=np.isnan(p))], ["doc_id", "host", "path", "p_doc"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, host string, path string, p_doc double")


def site_sums(evidence: DataFrame) -> DataFrame:
    """(host, path, n, s, k, host_n, host_s, host_k, all_n, all_s) of every path: documents, expected good ones and prior strengths."""
    path = evidence.groupBy("host", "path").agg(F.count("p_doc").alias("n"), F.coalesce(F.sum("p_doc"), F.lit(0.0)).alias("s"))
    hosts = path.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    total = hosts.agg(F.coalesce(F.sum("host_n"), F.lit(0)).alias("all_n"), F.coalesce(F.sum("host_s"), F.lit(0.0)).alias("all_s"))

    def strength(groups: DataFrame, n: str, s: str, m, name: str) -> DataFrame:
        """m(1-m) over the spread of the groups' rates around their prior mean beyond what their sizes explain, less one."""
        spread = F.avg(F.pow(F.col(s) / F.col(n) - m, 2) - m * (1 - m) / F.col(n))
        k = F.avg(m * (1 - m)) / F.greatest(spread, F.lit(1e-9)) - 1
        return groups.where(F.col(n) > 0).agg(F.least(F.lit(STRENGTH[1]), F.greatest(F.lit(STRENGTH[0]), F.coalesce(k, F.lit(STRENGTH[1])))).alias(name))

    # The right sides of these cross joins have one row.
    hosts = hosts.crossJoin(F.broadcast(total))
    hosts = hosts.crossJoin(F.broadcast(strength(hosts, "host_n", "host_s", rate("all_n", "all_s"), "host_k")))
    paths = path.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    return paths.crossJoin(F.broadcast(strength(paths, "n", "s", shrunk("host_n", "host_s", "host_k", rate("all_n", "all_s")), "k")))


def rate(n: str, s: str, own_n=0, own=0.0):
    """Mean over ``n`` documents without a document's own part; 1/2 over none."""
    return F.coalesce((F.col(s) - own) / F.nullif(F.col(n) - own_n, F.lit(0)), F.lit(0.5))


def shrunk(n: str, s: str, k: str, prior, own_n=0, own=0.0):
    return (F.col(k) * prior + F.col(s) - own) / (F.col(k) + F.col(n) - own_n)


def classify(docs: DataFrame, labels: DataFrame, bound: int = FIT_BOUND, host: str = "source", path: str = "lang") -> DataFrame:
    """(doc_id, p_doc, p_host, p_path, p_quality, keep) of every row; ``p_host`` and ``p_path`` are without the row's own evidence."""
    return combined(cut(document_evidence(docs, fit(docs, labels, bound), host=host, path=path)))


def combined(evidence: DataFrame) -> DataFrame:
    """The same from (doc_id, host, path, p_doc). A hot path is one row on the right: the join splits its rows or broadcasts the sums while they are few."""
    sums = site_sums(evidence).withColumnsRenamed({"host": "h", "path": "p"})
    joined = evidence.join(sums, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
    own_n, own = F.when(F.col("p_doc").isNull(), 0).otherwise(1), F.coalesce("p_doc", F.lit(0.0))
    # Sums less a part of them may end below 0 by rounding.
    bound = lambda c: F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), c))
    prior = bound(rate("all_n", "all_s", own_n, own))
    at_host = bound(shrunk("host_n", "host_s", "host_k", prior, own_n, own))
    at_path = bound(shrunk("n", "s", "k", at_host, own_n, own))

    def logit(c):
        return F.log(c / (1 - c))

    out = joined.select("doc_id", "p_doc", prior.alias("p_all"), at_host.alias("p_host"), at_path.alias("p_path"))
    z = F.when(F.col("p_doc").isNull(), F.lit(0.0)).otherwise(logit(F.col("p_doc")) - logit(F.col("p_all"))) + logit(F.col("p_path"))
    out = out.withColumn("p_quality", F.round(1 / (1 + F.exp(-z)), 9))
    return out.select("doc_id", "p_doc", F.round("p_host", 9).alias("p_host"), F.round("p_path", 9).alias("p_path"), "p_quality", (F.col("p_quality") >= 0.5).alias("keep"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
