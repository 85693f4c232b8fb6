"""Relations written once to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of a row group where texts lie in rank order: long texts come first, so files of as many rows differ in size and
#: have to be split finely among tasks.
ROW_GROUP = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def filesystem(spark: SparkSession, path: str):
    """(the file system, the path) as the JVM's objects."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def staged(df: DataFrame, row_group: int = 128 << 20) -> DataFrame:
    """``df`` written and read back: what follows sees one and the same rows, whatever is lost. Deleted with the session."""
    spark = df.sparkSession
    where = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", row_group).parquet(where)
    fs, p = filesystem(spark, where)
    fs.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(where)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like ``wanted`` that ``df`` doesn't use."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
