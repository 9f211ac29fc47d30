"""The test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """The vector of one row, as a literal for plans."""
    row = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row[0]]


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with vectors, as chunks for retrieval."""
    documents = table(spark, sf_dir, "documents")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return documents.join(vectors, F.col("doc_id") == F.col("vec_id")).select(
        F.col("doc_id").alias("child_id"),
        F.col("doc_id").cast("string").alias("document_id"),
        F.col("source").alias("file_name"),
        F.col("lang").alias("file_type"),
        F.col("text").alias("child_text"),
        F.lit("").alias("parent_text"),
        "embedding",
    )
