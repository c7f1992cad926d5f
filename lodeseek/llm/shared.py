"""Folders that driver and executors share, and small helpers for Spark tables and Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path, stored

__all__ = ["dropped", "new_path", "read_table", "slices", "stored", "text_column", "text_or_empty"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dropped(df: DataFrame) -> None:
    """Delete the files behind a table made by stored(), once nothing reads it any more."""
    spark = df.sparkSession
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch by rows so that each slice holds about most_bytes of text; a longer text is a slice alone."""
    at, n = 0, batch.num_rows
    ends = text_column(batch, column)[1]
    while at < n:
        to = at + 1
        while to < n and ends[to + 1] - ends[at] <= most_bytes:
            to += 1
        yield batch.slice(at, to - at)
        at = to


def text_column(batch: pa.RecordBatch, column: str):
    """UTF-8 bytes of a text column as one numpy array, and row offsets into it; null counts as empty."""
    import numpy as np
    import pyarrow.compute as pc

    a = batch.column(batch.schema.get_field_index(column))
    if a.null_count:
        a = pc.fill_null(a, "")
    a = a.cast(pa.large_string())
    offsets = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset : a.offset + len(a) + 1]
    data = a.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(offsets):
        return whole[:0], np.zeros(1, np.int64)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]
