"""Approximate vector search over cells of k-means that lie in folders, so that cells that no query probes aren't read.

A large cell is split by a second level of centres. Rows of its parts lie one after the other in the cell's files, which
a reader skips by them. Batches of upserts and deletions add parts of their own, in folders by the same cells, with
tombstones for what they hide in earlier ones; parts merge as they grow.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import unit
from ..sources.shared import new_path, written
from ..sources.snapshots import SMALL_BYTES, TASK_BYTES, Snapshots, tail_to_merge, write_sorted
from .vector_index import asked_vectors, prepared, search_rows

#: Rows up to which a cell isn't split, and the number of leaves over all cells, whose centres go to every task: with more
#: rows than the product, leaves are larger.
LEAF_ROWS, MOST_LEAVES = 50_000, 32_768
#: Rows of a large cell that its leaves are fitted on.
LEAF_SAMPLE = 20_000
ROW = "chunk_id long, vector array<double>, norm double, cell int, leaf int"


def fit_centres(vectors: DataFrame, n_cells: int = 128, sample: int = 100_000, seed: int = 1) -> np.ndarray:
    """Centres of cells, fitted on a sample of at most about `sample` normalised vectors of the commonest length."""
    rows = prepared(vectors)
    n, dim = max(((r["n"], r["dim"]) for r in rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).collect()), default=(0, 0))
    if not n:
        raise ValueError("no vectors to fit cells on")
    rows, part = rows.where(F.size("vector") == dim), min(1.0, sample / n)
    chosen = rows.where(F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 20)) < int(part * (1 << 20)) + 1)
    return np.array(KMeans(k=n_cells, seed=seed, maxIter=10).fit(chosen.select(array_to_vector(unit(F.col("vector"))).alias("features"))).clusterCenters())


def nearest(matrix: np.ndarray, centres: np.ndarray, n: int = 1) -> np.ndarray:
    """Numbers of the n centres nearest to each row, nearest first, ties to the smaller number."""
    apart = (centres * centres).sum(axis=1)[None, :] - 2 * matrix @ centres.T
    return np.argsort(apart, axis=1, kind="stable")[:, :n]


def lloyd(rows: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k centres or fewer: those of rows that are spread over their order, moved to the means of what is nearest."""
    centres = np.unique(rows[np.linspace(0, len(rows) - 1, k).astype(int)], axis=0)
    for _ in range(rounds):
        of = nearest(rows, centres)[:, 0]
        n = np.bincount(of, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, of, rows)
        centres = sums[n > 0] / n[n > 0, None]
    return centres


class VectorCells:
    """The cells of one table's vectors (chunk_id, embedding) below a path. Those of another length than most have no place."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.snapshots = Snapshots(spark, path)
        self._opened: dict[str, DataFrame] = {}  # parts and centres don't change, and need listing once

    def _open(self, path: str) -> DataFrame:
        if path not in self._opened:
            self._opened[path] = self.spark.read.parquet(path)
        return self._opened[path]

    def create(self, vectors: DataFrame, n_cells: int = 128, leaf_rows: int = LEAF_ROWS) -> int:
        """Fit centres and commit all vectors. n_cells should grow with the square root of the rows."""
        centres = fit_centres(vectors, n_cells)
        leaves = [(i, i, c.tolist()) for i, c in enumerate(centres)]
        draft = new_path(self.spark, "cells")
        rows = written(self._placed(vectors, leaves), draft)
        n_rows = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # n_cells
        most = max(leaf_rows, -(-sum(n_rows.values()) // MOST_LEAVES))
        large = {c: n for c, n in n_rows.items() if n > most}
        if large:
            split = self._split(rows.where(F.col("cell").isin([*large])), large, most)
            kept = [(c, centre) for c, _, centre in leaves if c not in large]
            leaves = [(c, i, centre) for i, (c, centre) in enumerate(sorted(kept + split))]
            rows = self._placed(rows.select("chunk_id", F.col("vector").alias("embedding")), leaves)
        self._write_centres(leaves)
        part = self._write(rows, None, self.snapshots.bytes_of(draft))
        fs = self.snapshots._at(draft)
        fs[1].delete(fs[0], True)
        return self.snapshots.commit([part], 0)

    def _split(self, rows: DataFrame, large: dict[int, int], most: int) -> list[tuple[int, list[float]]]:
        """Centres of leaves: each large cell's are fitted in a task, on a bounded sample of its rows."""
        share = F.create_map(*[F.lit(x) for c, n in large.items() for x in (c, int(min(1.0, LEAF_SAMPLE / n) * (1 << 20)) + 1)])
        chosen = rows.where(F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 20)) < share[F.col("cell")])

        def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("chunk_id")
            matrix = np.stack(part["vector"].to_numpy()) / part["norm"].to_numpy()[:, None]
            centres = lloyd(matrix, -(-large[key[0]] // most))
            return pd.DataFrame({"cell": key[0], "centre": centres.tolist()})

        found = chosen.groupBy("cell").applyInPandas(fit, "cell int, centre array<double>").collect()  # MOST_LEAVES and n_cells at most
        return [(r["cell"], r["centre"]) for r in found]

    def _write_centres(self, leaves: list[tuple[int, int, list[float]]]) -> None:
        self.spark.createDataFrame(leaves, "cell int, leaf int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.snapshots.path}/centres")

    def _leaves(self) -> list[tuple[int, int, list[float]]]:
        rows = self._open(f"{self.snapshots.path}/centres").collect()  # MOST_LEAVES and n_cells at most
        return sorted((r["cell"], r["leaf"], r["centre"]) for r in rows)

    def _placed(self, vectors: DataFrame, leaves: list[tuple[int, int, list[float]]]) -> DataFrame:
        """ROW of each usable vector, in the cell and the leaf whose centre is nearest; others have no row."""
        cells, numbers = np.array([c for c, _, _ in leaves]), np.array([i for _, i, _ in leaves])
        shared = self.spark.sparkContext.broadcast((cells, numbers, np.array([c for _, _, c in leaves])))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells, numbers, centres = shared.value
            for batch in batches:
                if batch.num_rows:
                    first, norms = batch.column(1).offsets.to_numpy(), batch.column(2).to_numpy()
                    matrix = batch.column(1).values.to_numpy()[first[0] : first[-1]].reshape(batch.num_rows, -1) / norms[:, None]
                    at = nearest(matrix, centres)[:, 0]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells[at], pa.int32()), pa.array(numbers[at], pa.int32())], names=[*batch.schema.names, "cell", "leaf"])

        dim = len(leaves[0][2])
        return prepared(vectors, dim).select(F.col("chunk_id").cast("long").alias("chunk_id"), "vector", "norm").mapInArrow(run, ROW)

    def _write(self, rows: DataFrame, gone: DataFrame | None, n_bytes: int) -> dict:
        path = self.snapshots.new_part()
        n = max(1, -(-n_bytes // TASK_BYTES), min(self.spark.sparkContext.defaultParallelism, n_bytes // SMALL_BYTES))
        order = ["cell", "leaf", "chunk_id"]  # so a cell of any size is dealt to as many tasks as it needs
        rows.repartitionByRange(n, *order).sortWithinPartitions(*order).write.partitionBy("cell").parquet(f"{path}/rows")
        some = not self.spark.read.schema(ROW).parquet(f"{path}/rows").isEmpty()
        if gone is not None:
            write_sorted(gone, f"{path}/gone", 1 + n_bytes // 16, "chunk_id")
        return {"path": path, "bytes": self.snapshots.bytes_of(path), "rows": some, "gone": gone is not None}

    def apply(self, upserts: DataFrame | None = None, deleted: DataFrame | None = None) -> int:
        """Commit a batch: vectors, new or in place of others, and chunk_ids that go; one that is both stays.

        Of rows with one id the greatest counts; an id whose new vector is unusable goes. Returns the new version.
        """
        parts, last = self.snapshots.parts(), max(self.snapshots.versions(), default=0)
        if not parts:
            raise ValueError("no cells were created")
        draft, touched = new_path(self.spark, "batch"), []
        rows = self.spark.createDataFrame([], ROW)
        if upserts is not None:
            one = written(upserts.where("chunk_id is not null").groupBy("chunk_id").agg(F.max("embedding").alias("embedding")), draft)
            rows = self._placed(one, self._leaves())
            touched.append(one.select("chunk_id"))
        if deleted is not None:
            touched.append(deleted.where("chunk_id is not null").select("chunk_id"))
        if not touched:
            return last
        gone = reduce(DataFrame.unionByName, touched).select(F.col("chunk_id").cast("long").alias("chunk_id")).distinct()
        part = self._write(rows, gone, self.snapshots.bytes_of(draft) if upserts is not None else 0)
        return self.snapshots.commit([*parts, part], last)

    def merge(self) -> int | None:
        """Merge the newest parts where they have grown; the new version, or None if all may stay."""
        parts = self.snapshots.parts()
        at = tail_to_merge([p["bytes"] for p in parts])
        if len(parts) - at < 2:
            return None
        tail, last = parts[at:], self.snapshots.versions()[-1]
        gone = [self._gone(p) for p in tail if p["gone"]]
        merged = self._write(self._alive(tail), reduce(DataFrame.unionByName, gone).distinct() if at else None, sum(p["bytes"] for p in tail))
        return self.snapshots.commit([*parts[:at], merged], last)

    def _gone(self, part: dict) -> DataFrame:
        return self._open(f"{part['path']}/gone")

    def _alive(self, parts: list[dict], cells: set[int] | None = None, leaves: set[int] | None = None) -> DataFrame:
        """Rows that no later part hides; of some cells and leaves only, of which then no other files or groups of rows are read."""
        out = []
        for i, part in enumerate(parts):
            rows = self._open(f"{part['path']}/rows") if part["rows"] else self.spark.createDataFrame([], ROW)
            if cells is not None:
                rows = rows.where(F.col("cell").isin(sorted(cells)))
            if leaves is not None:
                rows = rows.where(F.col("leaf").isin(sorted(leaves)))
            for later in parts[i + 1 :]:
                rows = rows.join(self._gone(later), "chunk_id", "left_anti") if later["gone"] else rows
            out.append(rows)
        return reduce(DataFrame.unionByName, out)

    def rows(self, cells: set[int] | None = None, version: int | None = None) -> DataFrame:
        return self._alive(self.snapshots.parts(version), cells)

    def top_k(self, queries: DataFrame, k: int = 200, n_probe: int = 16, only: DataFrame | None = None) -> DataFrame:
        """As exact_top_k, over the n_probe leaves nearest to each query (query_id, embedding); all leaves are an exact search.

        only: (chunk_id) of the rows that may be found.
        """
        leaves, parts = self._leaves(), self.snapshots.parts()
        cell_of = {i: c for c, i, _ in leaves}
        numbers, centres = np.array([i for _, i, _ in leaves]), np.array([c for _, _, c in leaves])
        split = len(leaves) > len(set(cell_of.values()))

        def rows_of(probed: set[int]) -> DataFrame:
            some = probed & set(cell_of)
            rows = self._alive(parts, {cell_of[i] for i in some}, some if split else None)
            rows = rows.join(only.hint("merge"), "chunk_id", "left_semi") if only is not None else rows
            return rows.select("chunk_id", "vector", "norm", F.col("leaf").alias("cell"))

        def probe(matrix: np.ndarray) -> np.ndarray:
            if matrix.shape[1] != centres.shape[1]:
                return np.full((len(matrix), 1), -1)
            return numbers[nearest(matrix, centres, n_probe)]

        return search_rows(rows_of, asked_vectors(queries), k, probe)
