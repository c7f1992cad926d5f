"""Top-k by group, rank fusion, payload merge and reranking."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import present

#: Rank shown for a hit that a source lacks.
ABSENT = 999_999


def top_k(hits: DataFrame, k: int, by: Sequence[str] = ("query_id",), order: Sequence[Column] | None = None, rank: str = "rank") -> DataFrame:
    """The best k rows of each group with their rank from 1. The window limit cuts each partition before the shuffle."""
    order = order or [F.desc("score"), F.asc("chunk_id")]
    return hits.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def rrf(text_hits: DataFrame, vector_hits: DataFrame, k: int = 20, top: int = 20) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (k + rank) over both lists; ties by vector rank, then text rank.

    Returns query_id, chunk_id, score_rrf (6 places), rank_vector, rank_text (null where absent) and rank.
    """
    both = vector_hits.select("query_id", "chunk_id", F.col("rank").alias("rank_vector"), F.lit(None).cast("int").alias("rank_text"))
    both = both.unionByName(text_hits.select("query_id", "chunk_id", F.lit(None).cast("int").alias("rank_vector"), F.col("rank").alias("rank_text")))
    fused = both.groupBy("query_id", "chunk_id").agg(F.min("rank_vector").alias("rank_vector"), F.min("rank_text").alias("rank_text"))
    part = lambda r: F.coalesce(F.lit(1.0) / (k + F.col(r)), F.lit(0.0))
    fused = fused.withColumn("score_rrf", F.round(part("rank_vector") + part("rank_text"), 6))
    return top_k(fused, top, order=[F.desc("score_rrf"), F.coalesce("rank_vector", F.lit(ABSENT)), F.coalesce("rank_text", F.lit(ABSENT)), F.asc("chunk_id")])


def merge_payload(preferred: DataFrame, other: DataFrame, key: Sequence[str], strings: Sequence[str], arrays: Sequence[str] = ()) -> DataFrame:
    """Full join on key: non-empty values of the preferred side win, else the other's."""
    a, b = preferred.alias("a"), other.alias("b")
    joined = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in key], "full")
    keys = [F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in key]
    texts = [F.coalesce(present(F.col(f"a.{c}")), F.col(f"b.{c}")).alias(c) for c in strings]
    lists = [F.when(F.size(f"a.{c}") > 0, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in arrays]
    return joined.select(*keys, *texts, *lists)


def with_payload(hits: DataFrame, chunks: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Payload columns joined after the last top-k, so that only rows that are shown carry texts.

    A left join can't broadcast its left side, so the chunks that are shown are picked first: the others aren't shuffled.
    """
    shown = chunks.select("chunk_id", *columns).join(hits.select("chunk_id"), "chunk_id", "left_semi")
    return hits.join(shown, "chunk_id", "left")


def rerank(hits: DataFrame, score: Callable[[DataFrame], DataFrame], top_n: int = 5) -> DataFrame:
    """Hits (query_id, chunk_id, rank, content) in a new order, none left out.

    score adds a column `scored` to the hits with content. The best top_n keep theirs, all others have 0; then hits
    with content stand first, by score and former rank. If the scorer gives null, the score is 0.
    """
    has_text = present(F.col("content")).isNotNull()
    scored = score(hits.where(has_text)).select("query_id", "chunk_id", F.coalesce("scored", F.lit(0.0)).alias("scored"))
    kept = top_k(scored.join(hits.select("query_id", "chunk_id", "rank").hint("merge"), ["query_id", "chunk_id"]), top_n, order=[F.desc("scored"), F.asc("rank")], rank="at")
    out = hits.join(kept.select("query_id", "chunk_id", F.col("scored").alias("score_rerank")).hint("merge"), ["query_id", "chunk_id"], "left")
    out = out.withColumn("score_rerank", F.coalesce("score_rerank", F.lit(0.0)))
    order = Window.partitionBy("query_id").orderBy(F.desc(has_text), F.desc("score_rerank"), F.asc("rank"))
    return out.withColumn("rank_rerank", F.row_number().over(order))
