"""Vector search for all queries at once, exact; see vector_cells for the approximate one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import doubles, norm
from ..sources.shared import stored
from .ranking import top_k

#: Query vectors of one pass; each pass broadcasts so many at most.
QUERIES_A_PASS = 2_000


def prepared(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """(chunk_id, vector, norm), without null or zero vectors and, if dim is given, those of another length."""
    out = vectors.select("chunk_id", doubles(F.col("embedding")).alias("vector")).where("vector is not null")
    out = out.where(F.size("vector") == dim) if dim else out
    return out.withColumn("norm", norm(F.col("vector"))).where("norm > 0")


def wrong_dimension(vectors: DataFrame, dim: int) -> DataFrame:
    """The rows to set aside instead of recreating the store."""
    return vectors.where(F.col("embedding").isNull() | (F.size("embedding") != dim))


QUERY_ROW = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("chunk_id", T.LongType()), T.StructField("score", T.DoubleType())])


class Best:
    """The k best rows of each query so far: scores in descending order, ties by id."""

    def __init__(self, n: int, k: int):
        self.k, self.ids, self.scores = k, [np.zeros(0, np.int64)] * n, [np.zeros(0)] * n

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(self.scores[q]) == self.k:
            hopeful = scores >= self.scores[q][-1]
            ids, scores = ids[hopeful], scores[hopeful]
        if len(ids):
            ids, scores = np.concatenate([self.ids[q], ids]), np.concatenate([self.scores[q], scores])
            at = np.lexsort((ids, -scores))[: self.k]
            self.ids[q], self.scores[q] = ids[at], scores[at]


def _passes(queries: DataFrame) -> list[DataFrame]:
    """The queries in passes of a bounded number."""
    n_passes = max(1, -(-queries.count() // QUERIES_A_PASS))
    return [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n_passes)) == i) for i in range(n_passes)]


def search_rows(rows_of: Callable[[set[int]], DataFrame], queries: DataFrame, k: int, probe: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The k nearest rows of each query (query_id, vector, norm) within its cells.

    probe: the cells of each of a matrix of unit vectors, in rows of one length. rows_of: the rows (chunk_id, vector,
    norm, cell) of some cells, which are all that a pass of queries reads.
    """
    found = None
    for asked in _passes(queries):
        got = asked.select("query_id", "vector", "norm").collect()  # QUERIES_A_PASS on average
        names = np.array([q["query_id"] for q in got], np.int64)
        table = {}
        for dim in {len(q["vector"]) for q in got}:
            at = np.array([i for i, q in enumerate(got) if len(q["vector"]) == dim])
            matrix = np.array([got[i]["vector"] for i in at]) / np.array([got[i]["norm"] for i in at])[:, None]
            cells = probe(matrix)
            for c in np.unique(cells):
                of = np.flatnonzero((cells == c).any(axis=1))
                table[dim, int(c)] = (at[of], matrix[of])
        shared = queries.sparkSession.sparkContext.broadcast((names, table))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, of = shared.value
            best = Best(len(names), k)
            for batch in batches:
                ids, norms, cells = (batch.column(c).to_numpy() for c in (0, 2, 3))
                first = batch.column(1).offsets.to_numpy()
                sizes, values = np.diff(first), batch.column(1).values.to_numpy()
                for dim, cell in set(zip(sizes.tolist(), cells.tolist(), strict=True)) & set(of):
                    at = np.flatnonzero((sizes == dim) & (cells == cell))
                    who, matrix = of[dim, cell]
                    vectors = values[first[at][:, None] + np.arange(dim)[None, :]] / norms[at][:, None]
                    scores = np.round(matrix @ vectors.T, 6)
                    for q, s in zip(who, scores, strict=True):
                        best.add(q, ids[at], s)
            n = [len(x) for x in best.ids]
            if sum(n):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, n)), pa.array(np.concatenate(best.ids)), pa.array(np.concatenate(best.scores))], names=QUERY_ROW.names)

        rows = rows_of({c for _, c in table})
        hits = rows.select(F.col("chunk_id").cast("long"), "vector", "norm", "cell").mapInArrow(run, QUERY_ROW)
        found = hits if found is None else found.unionByName(hits)
    return stored(top_k(found, k), "hits")  # k rows a query, which joins with themselves read again


def asked_vectors(queries: DataFrame) -> DataFrame:
    return prepared(queries.withColumnRenamed("query_id", "chunk_id")).withColumnRenamed("chunk_id", "query_id")


def exact_top_k(queries: DataFrame, vectors: DataFrame, k: int = 200) -> DataFrame:
    """(query_id, chunk_id, score, rank) by cosine, rounded to 6 places, ties by chunk_id; ids are whole numbers.

    queries: query_id, embedding. A pass of bounded size goes to every partition of the vectors, which multiplies
    matrices and keeps the best k of each query; vectors are read once a pass and never shuffled. Only vectors of a
    query's own length are compared with it.
    """
    rows = prepared(vectors).withColumn("cell", F.lit(0))
    return search_rows(lambda _: rows, asked_vectors(queries), k, lambda matrix: np.zeros((len(matrix), 1), np.int64))
