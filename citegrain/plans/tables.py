"""The driver's tables in the engine's shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval as R

#: Sources in scope: those with an even number.
SELECTED = [f"src{i}" for i in range(0, 20, 2)]
#: Devices in scope, by the embeddings' label; label 0 declares none.
SCOPE = [str(i) for i in range(1, 7)]
DIMENSION = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def passage_id(source="source", doc_id="doc_id"):
    return F.concat(F.col(source), F.lit("#"), F.lpad(F.col(doc_id).cast("string"), 6, "0"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document; without a vector of its number it has neither vector nor device."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")
    devices = F.when(F.coalesce("label", F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("label").cast("string")))
    return docs.join(vectors, "doc_id", "left").select(passage_id().alias("passage_id"), F.col("source").alias("source_id"), devices.alias("devices"), "text", "vector", "doc_id")


def with_vector(df: DataFrame) -> DataFrame:
    """Passages or questions that the dense arm can compare."""
    return df.where("vector IS NOT NULL")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text of each benchmark item, with the vector of the same number if there is one, whose own passage is left out."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), passage_id().alias("excluded"))
    array = lambda xs: F.array(*map(F.lit, xs))
    return items.join(vectors, "qid", "left").join(own, "qid", "left").select("qid", "text", "vector", array(SELECTED).alias("sources"), array(SCOPE).alias("scope"), "excluded")


def index(spark: SparkSession, sf_dir: str) -> R.LexicalIndex:
    return R.lexical_index(passages(spark, sf_dir))
