"""Lineage cutting, id filters and size-checked joins shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of an id filter at most; it has one row of 64 bits for each word that some id sets, so 2^20 rows at most.
FILTER_BITS = 1 << 26


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a temporary one only where the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def forget(spark: SparkSession, where: str, now: bool = False) -> None:
    """Delete a folder when the driver's JVM ends, or now."""
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(path, True) if now else fs.deleteOnExit(path)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lost executors cost no recomputation.

    The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    where = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(where)
    forget(spark, where)
    return spark.read.schema(df.schema).parquet(where)


def maybe_in(rows: DataFrame, key: str, ids: DataFrame, flag: str) -> DataFrame:
    """``rows`` with ``flag``: false only where ``key`` is certainly not among ``ids`` (one long column).

    The ids set bits of a filter of ``FILTER_BITS`` at most, broadcast as (word, bits): its size has that bound
    whatever the number of ids. A filter that is too full lets more rows through; what uses it checks them exactly.
    """
    (name,) = ids.columns
    w, b = fresh(rows, "word", "bits")
    bits = 1 << 12
    n = ids.count()
    while bits < min(FILTER_BITS, 16 * n):
        bits <<= 1

    def place(c):
        return F.pmod(F.xxhash64(c), F.lit(bits))

    at = place(F.col(name))
    words = ids.where(F.col(name).isNotNull()).groupBy(F.shiftright(at, 6).alias(w)).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))).alias(b))
    mine = place(F.col(key).cast("long"))
    bit = F.call_function("getbit", F.col(b), mine.bitwiseAND(63).cast("int"))
    out = rows.join(F.broadcast(words), F.shiftright(mine, 6) == F.col(w), "left")
    return out.withColumn(flag, F.coalesce(bit == 1, F.lit(False)) & F.col(key).isNotNull()).drop(w, b)


def only_ids(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The ``rows`` whose ``key`` is among ``ids``: only rows that the id filter lets through are moved."""
    (flag,) = fresh(rows, "may")
    near = maybe_in(rows, key, ids, flag).where(F.col(flag)).drop(flag)
    return near.join(ids.withColumnRenamed(ids.columns[0], flag), F.col(key).cast("long") == F.col(flag), "left_semi")


def without_ids(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The ``rows`` whose ``key`` isn't among ``ids``. Rows that the id filter clears stay where they are."""
    (flag,) = fresh(rows, "may")
    marked = maybe_in(rows, key, ids, flag)
    gone = ids.withColumnRenamed(ids.columns[0], flag)
    rest = marked.where(F.col(flag)).drop(flag).join(gone, F.col(key).cast("long") == F.col(flag), "left_anti")
    return marked.where(~F.col(flag)).drop(flag).unionByName(rest)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like ``wanted`` that ``df`` doesn't use, whatever the letters' case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        n = f"__{name}"
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def bound_sample(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """About ``bound`` rows at most, chosen by a hash of ``key``: the same rows on every run."""
    n = rows.count()
    if n <= bound:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_000)) < int(1_000_000 * bound / n))
