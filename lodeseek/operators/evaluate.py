"""Checks of encoders, classes and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, doubles, greatest_difference, norm

# Verdicts on the least cosine.
PASS, WARN = 0.99, 0.95


def drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """(chunk_id, cosine, max_diff, norm_a, norm_b, same_dim) of two vector tables (chunk_id, embedding)."""
    both = a.select("chunk_id", doubles(F.col("embedding")).alias("x")).join(b.select("chunk_id", doubles(F.col("embedding")).alias("y")), "chunk_id")
    x, y = F.col("x"), F.col("y")
    same = F.size(x) == F.size(y)
    return both.select("chunk_id", F.when(same, F.round(cosine(x, y), 6)).alias("cosine"), F.when(same, F.round(greatest_difference(x, y), 6)).alias("max_diff"), F.round(norm(x), 6).alias("norm_a"), F.round(norm(y), 6).alias("norm_b"), same.alias("same_dim"))


def verdict(each: DataFrame) -> DataFrame:
    least = F.min("cosine")
    ok = F.coalesce(F.min("same_dim"), F.lit(False))
    return each.agg(F.count("*").alias("n"), F.min("cosine").alias("least"), F.round(F.avg("cosine"), 6).alias("mean"), F.max("max_diff").alias("max_diff"), F.when(~ok, "fail").when(least >= PASS, "pass").when(least >= WARN, "warn").otherwise("fail").alias("verdict"))


def accuracy(rows: DataFrame) -> DataFrame:
    """(n, n_ok, accuracy) of rows with expected and predicted; a null prediction is wrong."""
    ok = F.coalesce(F.col("expected") == F.col("predicted"), F.lit(False))
    return rows.agg(F.count("*").alias("n"), F.count_if(ok).alias("n_ok"), F.round(F.avg(ok.cast("double")), 6).alias("accuracy"))


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("expected", "predicted").agg(F.count("*").alias("n"))


def overlap_at(hits: DataFrame, relevant: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, n_relevant, non_increasing): relevant ids (query_id, chunk_id) among the first k, and whether scores fall."""
    marks = relevant.select("query_id", "chunk_id").distinct().withColumn("_relevant", F.lit(1))
    rows = hits.join(marks, ["query_id", "chunk_id"], "left").withColumn("_last", F.lag("score").over(Window.partitionBy("query_id").orderBy("rank")))
    return rows.groupBy("query_id").agg(F.count_if((F.col("rank") <= k) & (F.col("_relevant") == 1)).alias("n_relevant"), F.min(F.coalesce(F.col("score") <= F.col("_last"), F.lit(True))).alias("non_increasing"))
