"""The given tables as the inputs of retrieval: chunks, queries and their vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk for each document: its first line as title, its source as journal and document, its language as keyword."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), F.col("text").alias("content"),
        F.substring_index("text", "\n", 1).alias("title_cn"), F.col("lang").alias("keywords_cn"), F.col("lang").alias("article_type"),
        F.col("source").alias("journal"), F.lit("").alias("title"), F.array("lang").alias("heading_stack"),
    )


def with_metadata(rows: DataFrame) -> DataFrame:
    """chunks with the two fields of their metadata that are searched: the last line as a title, the source as a keyword."""
    return rows.withColumn("metadata_title_cn", F.substring_index("content", "\n", -1)).withColumn("metadata_keywords_cn", F.col("journal"))


def listing(spark: SparkSession, sf_dir: str, *names: str) -> tuple:
    """Path, size and time of the tables' files, by which a change shows."""
    found = []
    for name in names:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
        found += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files]
    return tuple(sorted(found))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector that has the query's number stands for its embedding."""
    vectors = chunk_vectors(spark, sf_dir).withColumnRenamed("chunk_id", "query_id")
    return vectors.join(queries(spark, sf_dir).select("query_id"), "query_id", "left_semi")
