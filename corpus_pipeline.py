"""From raw documents to a training mix: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodeseek.cluster import ship_code
from lodeseek.llm import decontam, mixing, near_dedup, substring_dedup, toxicity
from lodeseek.llm.shared import read_table, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half, unchanged.

    Null and empty texts have no windows and stay, very long ones are scored whole, repeated rows fare alike; without
    labels of both classes all stay; an empty table gives no rows, and other columns pass unread.
    """
    return toxicity.without_toxic(docs, read_table(ship_code(spark), sf_dir, "labels"))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate class, unchanged.

    Texts without words (null, empty) are near nothing and stay, as do rows without an id; of rows that repeat an id one
    stays; very long texts are compared whole; an empty table gives no rows, and other columns pass unread.
    """
    ship_code(spark)
    return near_dedup.keep_one(docs)


def first_of_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without passages that an earlier document or passage has.

    Null texts stay null and empty ones empty; rows equal in id and text count as one and stay alike; null ids rank
    first; a text of which nothing remains becomes empty; an empty table gives no rows, and other columns pass unread.
    """
    return substring_dedup.without_repeats(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the stretches that benchmark items share; those mostly made of such go.

    Null and empty texts have no words and stay; repeated rows fare alike; very long texts are read whole; an empty table
    of items changes nothing, one of documents gives no rows, and other columns pass unread.
    """
    return decontam.decontaminate(docs, read_table(ship_code(spark), sf_dir, "benchmark"))


def mix_of_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with their number of copies, by target weights of sources.

    Null and empty texts have no words and are never taken; a null source is one of its own; rows that repeat id and text
    share their fate; ties are settled by id; an empty table gives no rows, and columns named like the mix's are replaced.
    """
    return mixing.mixed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("near_dedup", one_of_near_duplicates),
    ("substring_dedup", first_of_repeated_passages),
    ("decontamination", without_benchmark),
    ("mixing", mix_of_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs


#: Compression, hashing and random ranks aren't expressible in SQL; tests/llm compares with brute force.
ORACLE_SQL = None
