"""Plug-in points for models, called with Arrow batches and created once for each Python worker; with plain defaults."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import present, tokens
from .phrases import occurrences

Encoder = Callable[[list[str]], np.ndarray]
Scorer = Callable[[list[str], list[str]], list[float]]
Completer = Callable[[list[str]], list[str]]
#: Queries of fewer characters are doubled before they are encoded.
SHORT_QUERY = 15


def hashing_encoder(dim: int = 64) -> Encoder:
    """A deterministic stand-in for an embedding model: signed counts of hashed words, normalised."""
    import re
    import zlib

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if (h >> 16) & 1 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def embed(rows: DataFrame, make: Callable[[], Encoder], key: str = "chunk_id", text: str = "content") -> DataFrame:
    """(key, embedding) of the rows with content; make() runs once for each task."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make()
        for b in batches:
            if len(b):
                yield pd.DataFrame({key: b[key], "embedding": [list(map(float, v)) for v in encode(list(b[text]))]})

    return rows.where(present(F.col(text)).isNotNull()).select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<float>")


def score_with(make: Callable[[], Scorer]) -> Callable[[DataFrame], DataFrame]:
    """A scorer for rerank(): of hits with query and content; a failing batch gets null scores."""

    def scored(hits: DataFrame) -> DataFrame:
        kinds = {c: hits.schema[c].dataType.simpleString() for c in ("query_id", "chunk_id")}

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            score = make()
            for b in batches:
                try:
                    s = [float(x) for x in score(list(b["query"]), list(b["content"]))]
                except Exception:  # a model that fails must not end the job
                    s = [None] * len(b)
                yield b[["query_id", "chunk_id"]].assign(scored=pd.Series(s, index=b.index, dtype="float64"))

        return hits.select("query_id", "chunk_id", "query", "content").mapInPandas(run, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, scored double")

    return scored


def lexical_overlap(hits: DataFrame) -> DataFrame:
    """The default scorer: the part of the query's distinct tokens that the content has, without Python."""
    q = F.array_distinct(tokens(F.col("query")))
    return hits.withColumn("scored", F.round(F.size(F.array_intersect(q, tokens(F.col("content")))) / F.size(q), 6))


def complete(rows: DataFrame, make: Callable[[], Completer], key: str = "query_id", prompt: str = "prompt", out: str = "answer") -> DataFrame:
    """(key, answer) of the rows with a prompt; an error's text becomes the answer."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answer = make()
        for b in batches:
            if not len(b):
                continue
            try:
                texts = list(answer(list(b[prompt])))
            except Exception as e:
                texts = [f"{type(e).__name__}: {e}"] * len(b)
            yield pd.DataFrame({key: b[key], out: texts})

    return rows.where(F.col(prompt).isNotNull()).select(key, prompt).mapInPandas(run, f"{key} {kind}, {out} string")


def doubled(queries: DataFrame) -> DataFrame:
    """Short queries twice in a row."""
    return queries.select("query_id", F.when(F.length("query") < SHORT_QUERY, F.concat_ws(" ", "query", "query")).otherwise(F.col("query")).alias("query"))


INTENT = "domain string, coverage string, rewritten_query string, keywords array<string>, suggestion string"


def with_intent(queries: DataFrame, replies: DataFrame) -> DataFrame:
    """queries with the fields of a model's JSON reply (query_id, reply); without a readable one the query passes unchanged."""
    parsed = replies.select("query_id", F.from_json("reply", INTENT).alias("i"))
    out = queries.join(parsed.hint("merge"), "query_id", "left")
    return out.select("query_id", "query", F.coalesce(present(F.col("i.rewritten_query")), "query").alias("rewritten_query"), F.coalesce("i.domain", F.lit("")).alias("domain"), F.coalesce("i.coverage", F.lit("unknown")).alias("coverage"), F.coalesce("i.keywords", F.array().cast("array<string>")).alias("keywords"), F.coalesce("i.suggestion", F.lit("")).alias("suggestion"))


def coverage(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, domain, coverage) by a table (domain, term, coverage): the best tier among terms, of one word or several, that the query has."""
    tier = F.create_map(F.lit("high"), F.lit(0), F.lit("medium"), F.lit(1), F.lit("low"), F.lit(2))
    words = occurrences(queries, terms, "query_id", "query", "term").select("query_id", F.col("phrase").alias("term")).distinct()
    terms = terms.withColumn("term", F.array_join(tokens(F.col("term")), " "))
    found = words.join(terms.hint("merge"), "term").groupBy("query_id").agg(F.min(F.struct(F.coalesce(tier[F.col("coverage")], F.lit(3)).alias("tier"), "domain", "coverage")).alias("b"))
    return queries.select("query_id").join(found.hint("merge"), "query_id", "left").select("query_id", F.coalesce("b.domain", F.lit("")).alias("domain"), F.coalesce("b.coverage", F.lit("out_of_domain")).alias("coverage"))


def expanded(queries: DataFrame, synonyms: DataFrame, most: int = 6, enabled: bool = True) -> DataFrame:
    """(query_id, query) with the terms of synonyms (phrase, terms) for the phrases, of one word or several, that it has, at most so many.

    They are appended only if there are any, differ from the query and are longer than 5 characters together.
    """
    if not enabled:
        return queries.select("query_id", "query")
    words = occurrences(queries, synonyms, "query_id", "query")
    terms = words.join(synonyms.withColumn("phrase", F.array_join(tokens(F.col("phrase")), " ")).hint("merge"), "phrase").select("query_id", "pos", F.posexplode("terms").alias("at", "term"))
    first = terms.groupBy("query_id", "term").agg(F.min(F.struct("pos", "at")).alias("o"))
    more = first.groupBy("query_id").agg(F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("o", "term"))), lambda x: x["term"]), 1, most), " ").alias("more"))
    add = (F.length("more") > 5) & (F.col("more") != F.col("query"))
    return queries.join(more.hint("merge"), "query_id", "left").select("query_id", F.when(add, F.concat_ws(" ", "query", "more")).otherwise(F.col("query")).alias("query"))
