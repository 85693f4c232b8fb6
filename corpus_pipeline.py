"""The corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination, packing.

Each stage takes what its predecessor kept (``docs``) and returns it filtered or rewritten with the columns of
``documents``; the last returns the packed sequences: token ids, loss mask and the documents they hold. Stages are
written as Parquet and read again, so a lost executor repeats one stage's work at most; the stage folders go as soon as
the next one is written, the last with the session.

Line dedup comes before near-dedup: a document of whose words more than ``lines.MOST`` repeat earlier ones goes with it, so
that no stump of a near copy is left which near-dedup couldn't recognise.

Defined results: null and empty texts and those without a word fail the quality rules; a row with a null ``doc_id``
passes line dedup and near-dedup unchanged and is packed under a null id; of rows with equal ``doc_id`` and text all stay
(they are one document to both dedups); ties between near copies go to the smallest ``doc_id``; an empty
table gives no sequence; further columns, whatever their names, are carried through to the packing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontam, lines, minhash, packing, quality_rules
from lodestone.llm._spark import forget, shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.without_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("packing", pack)]

#: Hashing, tokenization and alignment aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    forget(spark, base)
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}-{name}")
        docs = spark.read.parquet(f"{base}/{i}-{name}")
        if i:
            forget(spark, f"{base}/{i - 1}-{STAGES[i - 1][0]}", now=True)
    return docs
