"""Hybrid search of one knowledge base: text and vector hits, each with the same filters, fused."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored
from . import plugins, ranking, text_index, vector_cells, vector_index


@dataclass
class Target:
    """The tables of a knowledge base; with cells, which then have its vectors, the search is in the nearest of them."""

    index: text_index.Index
    chunks: DataFrame
    vectors: DataFrame | None
    fields: Mapping[str, str]
    cells: vector_cells.VectorCells | None = None


def query_vectors(queries: DataFrame, make_encoder=plugins.hashing_encoder) -> DataFrame:
    """(query_id, embedding) of queries (query_id, query); short ones are encoded twice in a row."""
    return plugins.embed(plugins.doubled(queries), make_encoder, "query_id", "query")


def allowed(chunks: DataFrame, filters: Mapping[str, str | list] | None) -> DataFrame | None:
    """(chunk_id) of the chunks that have the wanted values, a list meaning any of them; None if no column is filtered."""
    known = {c: v for c, v in (filters or {}).items() if c in chunks.columns}
    for c, v in known.items():
        chunks = chunks.where(F.col(c).isin(v if isinstance(v, list) else [v]))
    return chunks.select("chunk_id") if known else None


def hybrid(queries: DataFrame, vectors: DataFrame, target: Target, filters: Mapping[str, str | list] | None = None, each: int = 200, k: int = 20, top: int = 20, n_probe: int = 16) -> DataFrame:
    """The fused hits (see ranking.rrf) of queries (query_id, query) with vectors (query_id, embedding) in one target.

    Both sides see the same filters and give `each` hits a query before they are fused. A query without a usable vector
    has text hits only, one without known words vector hits only.
    """
    vectors = stored(vectors, "asked")  # a model's work, which is done once
    text = text_index.bm25(queries, target.chunks, target.fields, k=each, filters=filters, index=target.index)
    rows, only = target.vectors, allowed(target.chunks, filters)
    if target.cells is not None:
        near = target.cells.top_k(vectors, each, n_probe, only)
    else:
        near = vector_index.exact_top_k(vectors, rows if only is None else rows.join(only.hint("merge"), "chunk_id", "left_semi"), each)
    return ranking.rrf(text, near, k, top)
