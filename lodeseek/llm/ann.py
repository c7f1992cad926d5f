"""Approximate nearest neighbours by inner product, with collision-counting hashing over sorted single projections.

Vectors are lengthened to one norm, so that the largest inner product is the smallest distance. Rows are hashed into
blocks; a block keeps, for each random projection, its rows in sorted order. A query opens a window around its own
projection in each of these arrays and widens all of them step by step (virtual rehashing); each step lists the rows
that the windows newly take in and counts their collisions, and rows with enough of them are verified by their exact
inner product. A query is done when a row as near as its k-th best so far would have collided often enough, but for a
chance of one in fifteen, and nearer ones for much smaller ones: the stop depends on distances alone, not on how many rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import read_table, stored

#: Rows of a block on average; projections; part of them that must collide.
BLOCK_ROWS, PROJECTIONS, COLLISIONS = 8_192, 32, 0.5
#: Half a window's width, for a row's distance, at which it collides in one and a half standard deviations more than that part.
REACH = NormalDist().inv_cdf((1 + COLLISIONS + 1.5 * (COLLISIONS * (1 - COLLISIONS) / PROJECTIONS) ** 0.5) / 2)
#: Factor by which windows widen, and the first window, in parts of the common norm.
WIDEN, FIRST = 1.25, 0.05
QUERIES_AT_ONCE = 128


def usable(embedding: str) -> Column:
    """Not null, finite throughout, and not all zero."""
    x = F.col(embedding).cast("array<double>")
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.col(embedding).isNotNull() & F.forall(x, fine) & F.exists(x, lambda v: v != 0)


class Block:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norm: float):
        self.ids, self.vectors, self.norm = ids, vectors, norm
        dim = vectors.shape[1]
        missing = np.sqrt(np.maximum(norm * norm - (vectors * vectors).sum(1), 0.0))
        self.lines = np.random.default_rng(20240601).normal(size=(dim + 1, PROJECTIONS))
        projected = vectors @ self.lines[:dim] + missing[:, None] * self.lines[dim]
        self.order = np.ascontiguousarray(np.argsort(projected, axis=0, kind="stable").T)
        self.sorted = np.take_along_axis(projected, self.order.T, 0).T.copy()
        self.start = 0

    def windows(self, centres: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last places of each query's windows: (queries, projections) each."""
        half = self.norm * FIRST * WIDEN**level
        return tuple(np.stack([np.searchsorted(s, c + shift, side) for s, c in zip(self.sorted, centres.T, strict=True)], 1) for shift, side in ((-half, "left"), (half, "right")))

    def listed(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The rows at places lo to hi of each sorted array, one array after the other."""
        return np.concatenate([o[a:b] for o, a, b in zip(self.order, lo.tolist(), hi.tolist(), strict=True)])

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, exact: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query id, ids, scores) of the best k of the verified rows; exact: of all rows."""
        n = len(self.ids)
        scale = self.norm / np.sqrt((queries * queries).sum(1))
        centres = (queries * scale[:, None]) @ self.lines[:-1]
        needed = int(np.ceil(COLLISIONS * PROJECTIONS))
        opened: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for i, q in enumerate(query_ids):
            vector, level, done = queries[i], max(0, self.start - 1), np.zeros(n, bool)
            own = self.ids == q
            rows, scores = np.zeros(0, np.int64), np.zeros(0)
            counts, lo, hi = None, None, None
            while True:
                half = self.norm * FIRST * WIDEN**level
                if exact:
                    new = np.flatnonzero(~own)
                else:
                    if level not in opened:
                        opened[level] = self.windows(centres, level)
                    wider_lo, wider_hi = (x[i] for x in opened[level])
                    if lo is None:
                        counts = np.bincount(self.listed(wider_lo, wider_hi), minlength=n)
                    else:
                        counts = counts + np.bincount(np.concatenate([self.listed(wider_lo, lo), self.listed(hi, wider_hi)]), minlength=n)
                    lo, hi = wider_lo, wider_hi
                    new = np.flatnonzero((counts >= needed) & ~done & ~own)
                if len(new):
                    done[new] = True
                    rows, scores = np.concatenate([rows, new]), np.concatenate([scores, self.vectors[new] @ vector])
                    if len(rows) > k:
                        at = np.partition(scores, len(scores) - k)[len(scores) - k]
                        near = scores >= at - 1e-9 * max(1.0, abs(float(at)))  # ties are told apart below
                        rows, scores = rows[near], scores[near]
                if exact or done.sum() + own.sum() == n:
                    break
                if len(rows) >= k:
                    worst = np.sqrt(max(0.0, 2 * self.norm**2 - 2 * scale[i] * np.partition(scores, len(scores) - k)[len(scores) - k]))
                    if half >= REACH * worst:
                        break
                level += 1
            self.start = level
            found = (self.vectors[rows] * vector).sum(1)
            best = np.lexsort((self.ids[rows], -found))[:k]
            yield int(q), self.ids[rows][best], found[best]


def nearest(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", embedding: str = "embedding", block_rows: int = BLOCK_ROWS, exact: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k nearest by inner product, ties to the smaller id.

    Vectors that are null, zero, not finite or without an id take no part, on either side; a query meets the vectors of
    its own length, except those with its id; of rows that repeat an id the smallest vector counts. An empty table
    gives no rows. All rows are indexed, in blocks; each query goes to each block, one row a pair, where it sees the
    rows in its windows. exact: every row is verified, with the same results where the windows miss none.
    """
    shape = [F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("vector"), F.size(embedding).alias("dim")]
    rows = vectors.where(usable(embedding) & F.col(vec_id).isNotNull()).select(*shape)
    asked = queries.where(usable(embedding) & F.col(vec_id).isNotNull()).select(*shape)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v))
    sizes = stored(rows.groupBy("dim").agg(F.ceil(F.count("*") / block_rows).alias("n_blocks"), F.max(norm).alias("norm")), "sizes")
    at = [F.col("dim"), F.col("n_blocks"), F.col("norm")]
    rows = rows.join(sizes.hint("merge") if sizes.count() > 1000 else F.broadcast(sizes), "dim").select("id", "vector", *at, F.pmod(F.xxhash64("id"), F.col("n_blocks")).alias("block"), F.lit(0).alias("asks"))
    asked = asked.join(sizes.hint("merge") if sizes.count() > 1000 else F.broadcast(sizes), "dim").select("id", "vector", *at, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block"), F.lit(1).alias("asks"))
    both = rows.union(asked).select("dim", "block", "asks", "id", "norm", "vector")
    # several parts a block, so that few blocks share one
    n_parts = 4 * int(sizes.agg(F.coalesce(F.sum("n_blocks"), F.lit(1))).first()[0])
    dealt = both.repartition(min(n_parts, 20_000), F.col("dim"), F.col("block")).sortWithinPartitions("dim", "block", "asks", "id", "vector")
    found = dealt.mapInArrow(_searcher(k, exact), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searcher(k: int, exact: bool):
    """Over rows sorted by block, a block's own rows before its queries: memory holds one block and some queries."""

    def answers(block: Block | None, ids: list, vectors: list) -> Iterator[pa.RecordBatch]:
        if block is None or not ids:
            return
        q, x = np.concatenate(ids), np.concatenate(vectors)
        first = np.unique(q, return_index=True)[1]
        for i in range(0, len(first), QUERIES_AT_ONCE):
            part = first[i : i + QUERIES_AT_ONCE]
            got = list(block.search(q[part], x[part], k, exact))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([g[0] for g in got], [len(g[1]) for g in got]).astype(np.int64)), pa.array(np.concatenate([g[1] for g in got])), pa.array(np.concatenate([g[2] for g in got]))],
                names=["query_id", "vec_id", "score"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block, rows, ids, vectors = None, None, [], [], []
        for batch in batches:
            dim, where, asks = (batch.column(c).to_numpy() for c in range(3))
            cuts = [0, *(np.flatnonzero((np.diff(dim) != 0) | (np.diff(where) != 0) | (np.diff(asks) != 0)) + 1), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if (dim[a], where[a]) != at:
                    yield from answers(block, ids, vectors)
                    at, block, rows, ids, vectors = (dim[a], where[a]), None, [], [], []
                own = part.column(3).to_numpy(), part.column(5).flatten().to_numpy().reshape(b - a, int(dim[a]))
                if asks[a] == 0:
                    rows.append(own)
                    continue
                if block is None and rows:
                    i, x = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
                    first = np.unique(i, return_index=True)[1]
                    block, rows = Block(i[first], x[first], float(part.column(4)[0].as_py())), []
                ids.append(own[0])
                vectors.append(own[1])
                if sum(map(len, ids)) >= 8 * QUERIES_AT_ONCE:
                    yield from answers(block, ids, vectors)
                    ids, vectors = [ids[-1][-1:]], [vectors[-1][-1:]]  # a repeated id may follow
        yield from answers(block, ids, vectors)

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)


def brute_force(vectors: DataFrame, queries: DataFrame, k: int) -> dict[int, list[tuple[int, float]]]:
    """By all inner products, for small tables."""
    out = {}
    rows = [(r[0], np.array(r[1], float)) for r in vectors.where(usable("embedding") & F.col("vec_id").isNotNull()).select("vec_id", "embedding").collect()]
    for q, x in [(r[0], np.array(r[1], float)) for r in queries.where(usable("embedding") & F.col("vec_id").isNotNull()).select("vec_id", "embedding").collect()]:
        out[q] = sorted(((i, float((v * x).sum())) for i, v in rows if i != q and len(v) == len(x)), key=lambda t: (-t[1], t[0]))[:k]
    return out
