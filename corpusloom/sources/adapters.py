"""The engine's inputs made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as articles; the title is the first line, the subtitle null for odd ids."""
    d = table(spark, sf_dir, "documents")
    title = F.substring_index("text", "\n", 1)
    return d.select(
        F.col("doc_id"), F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("https://"), "source", F.lit("/doc/"), F.col("doc_id").cast("string")).alias("link"),
        F.col("source").alias("platform"), F.col("source").alias("author_id"), F.concat(F.lit("Author "), "source").alias("author_full_name"), title.alias("title"), "text", "lang",
        F.create_map(F.lit("Title"), title, F.lit("Subtitle"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")), F.lit("Content"), F.col("text"), F.lit("language"), F.col("lang")).alias("content"),
        F.element_at(F.array(F.lit("posts"), F.lit("articles"), F.lit("repositories")), (F.col("doc_id") % 3 + 1).cast("int")).alias("category"),
    )


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as chunks: the label is the document."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label", F.concat(F.lit("chunk_"), F.col("vec_id").cast("string")).alias("chunk_id"), F.col("label").alias("document_id"))
