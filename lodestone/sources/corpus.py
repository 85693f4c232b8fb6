"""Reading corpora: works as JSON lines, documents with rank ids, embeddings, identifiers, facet columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import facets as FA
from ..operators import postings as P

WORK = "id string, display_name string, abstract_inverted_index map<string,array<int>>, authorships array<struct<author:struct<display_name:string>>>, publication_year int, type string, language string, primary_topic struct<display_name:string>, concepts array<struct<display_name:string>>, cited_by_count long, doi string"


def load_works(spark: SparkSession, glob: str) -> DataFrame:
    """JSON lines (plain or gzip); malformed lines and rows without a title are dropped."""
    raw = spark.read.schema(WORK).option("mode", "DROPMALFORMED").json(glob).where("display_name is not null and display_name <> ''")
    places = F.flatten(F.transform(F.map_entries("abstract_inverted_index"), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    abstract = F.substring(F.array_join(F.transform(F.sort_array(places), lambda x: x["w"]), " "), 1, 2000)
    return raw.select(
        F.substring_index("id", "/", -1).alias("id"),
        F.col("display_name").alias("title"),
        F.coalesce(abstract, F.lit("")).alias("abstract"),
        F.array_join(F.transform("authorships", lambda a: a["author"]["display_name"]), "; ").alias("authors"),
        F.coalesce(F.col("primary_topic.display_name"), F.try_element_at("concepts", F.lit(1))["display_name"]).alias("topic"),
        F.col("publication_year").alias("year"),
        "type",
        "language",
        F.coalesce("cited_by_count", F.lit(0).cast("long")).alias("cited"),
        F.regexp_replace(F.lower("doi"), r"^https?://(dx\.)?doi\.org/", "").alias("doi"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with their rank ids."""
    return P.assign_ranks(spark.read.parquet(f"{sf_dir}/documents.parquet"), "n_chars", "doc_id", weight="n_chars")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without ranks, for counts that don't depend on ids; spread by key, since a row group, however large, is read by one task."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").repartition("doc_id").select("text")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v"))


def facet_columns() -> dict[str, Column]:
    band = F.when(F.col("n_chars") < 1000, "short").when(F.col("n_chars") < 5000, "medium").otherwise("long")
    return {"lang": F.col("lang"), "source": F.col("source"), "len_band": band}


def facet_rows(docs: DataFrame) -> DataFrame:
    return FA.tall(docs, facet_columns())


def lookup(ids: DataFrame, key: str) -> DataFrame:
    """(norm_id, doc) of ``ids`` (key, doc); identifiers that normalise to nothing have no row."""
    return ids.select(X.normalize_id(F.col(key)).alias("norm_id"), "doc").where("norm_id <> ''")


def table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A stored relation, or an empty one with ``schema`` where it doesn't exist."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)
