"""Sharding by a hierarchical weighted hash tree.

A key descends region, rack and shard levels. At each node every child draws ``-ln(u) / weight`` with ``u``
hashed from the key and the child's path, and the smallest draw wins, so children get keys in proportion to
their weights. A node's weight is the sum of the weights below it. Where a shard's weight changes,
keys move, at each level, only to or from the one child above it: placement inside all other subtrees stays.

Defined results: the key is ``doc_id`` alone, so repeated rows get the same shard; a null ``doc_id`` is placed
as the key ``null``; the text and other columns don't matter; a child of weight 0 gets nothing. A negative
weight, an empty tree or a tree without weight is an error.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = ("region", "rack", "shard")
#: region -> rack -> shard -> weight
TREE: dict[str, dict[str, dict[str, float]]] = {
    "north": {f"n{r}": {f"n{r}s{s}": 1.0 + (s % 3) for s in range(8)} for r in range(4)},
    "south": {f"s{r}": {f"s{r}s{s}": 2.0 for s in range(6)} for r in range(3)},
    "west": {f"w{r}": {f"w{r}s{s}": 1.5 if s else 4.0 for s in range(4)} for r in range(2)},
}


def flat(tree: dict) -> list[list[tuple[str, str, float]]]:
    """For each level (parent's path, name, weight) with weight > 0."""
    out: list[list[tuple[str, str, float]]] = [[], [], []]

    def weigh(node, path: str, level: int) -> float:
        if not isinstance(node, dict):
            if node < 0 or not math.isfinite(node):
                raise ValueError(f"weight {node} at {path}")
            return float(node)
        total = 0.0
        for name in sorted(node):
            w = weigh(node[name], f"{path}/{name}", level + 1)
            if w:
                out[level].append((path, name, w))
            total += w
        return total

    if not weigh(tree, "", 0):
        raise ValueError("the tree has no weight")
    return out


def place(docs: DataFrame, tree: dict = TREE) -> DataFrame:
    """(doc_id, region, rack, shard) of every row."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    out = docs.select(F.col("doc_id"), key.alias("__key"), F.lit("").alias("__path"))
    for level, nodes in zip(LEVELS, flat(tree)):
        by: dict[str, list] = {}
        for path, name, w in nodes:
            by.setdefault(path, []).append(F.struct(F.lit(name).alias("name"), F.lit(w).alias("w")))
        children = F.create_map(*[x for path, kids in by.items() for x in (F.lit(path), F.array(*kids))])

        def draw(c):
            word = F.conv(F.substring(F.md5(F.concat_ws("|", "__key", F.concat("__path", F.lit("/"), c["name"]))), 1, 13), 16, 10).cast("double")
            return F.struct((-F.log((word + 0.5) / float(1 << 52)) / c["w"]).alias("d"), c["name"].alias("name"))

        out = out.withColumn(level, F.array_min(F.transform(F.element_at(children, F.col("__path")), draw))["name"]).withColumn("__path", F.concat("__path", F.lit("/"), level))
    return out.select("doc_id", *LEVELS)


def oracle(tree: dict = TREE) -> str:
    """The same placement in DuckDB."""
    sql, before = "WITH l AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, '' AS path FROM documents)", "l"
    done: list[str] = []
    for level, nodes in zip(LEVELS, flat(tree)):
        values = ", ".join(f"('{p}', '{n}', {w!r}::DOUBLE)" for p, n, w in nodes)
        keep = "".join(f", l.{x}" for x in done)
        sql += f""",
t_{level}(p, name, w) AS (VALUES {values}),
d_{level} AS (SELECT l.rid, l.doc_id, l.k, l.path{keep}, t.name, -ln((('0x' || substr(md5(l.k || '|' || l.path || '/' || t.name), 1, 13))::BIGINT + 0.5e0) / 4503599627370496e0) / t.w AS d
  FROM {before} l JOIN t_{level} t ON t.p = l.path),
p_{level} AS (SELECT rid, doc_id, k, path || '/' || name AS path{keep.replace('l.', '')}, name AS {level} FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY d, name) AS o FROM d_{level}) WHERE o = 1)"""
        before = f"p_{level}"
        done.append(level)
    return sql + f"\nSELECT doc_id, {', '.join(LEVELS)} FROM {before}"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(spark.read.parquet(f"{sf_dir}/documents.parquet"))
