"""Tables of immutable parts: a numbered manifest, put in place last, says which parts make a version.

A part is a folder that nothing names until the manifest with it is there; a writer that dies before leaves the last
version as it was. Manifests are never changed, so a reader keeps the version that it opened. One writer at a time: of
two that start from one version the second fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a file by which the number of tasks grows with what is written (its rows, which a task sorts, take many times
#: as much), and those of a file of a small table, which has no more files than the cluster has cores.
TASK_BYTES, SMALL_BYTES = 32 << 20, 4 << 20


class Snapshots:
    """The versions below one path. A part is a dict with its `path`, its `bytes`, and what else its owner notes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    def _at(self, path: str):
        p = self._hadoop.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        p, fs = self._at(f"{self.path}/manifests/*.json")
        return sorted(int(f.getPath().getName().removesuffix(".json")) for f in fs.globStatus(p) or [])

    def parts(self, version: int | None = None) -> list[dict]:
        """The parts of a version, the last one if none is given; none before the first commit."""
        version = version or max(self.versions(), default=0)
        if not version:
            return []
        p, fs = self._at(f"{self.path}/manifests/{version:010d}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def new_part(self) -> str:
        return f"{self.path}/parts/{uuid.uuid4().hex}"

    def bytes_of(self, path: str) -> int:
        p, fs = self._at(path)
        return fs.getContentSummary(p).getLength()

    def files_of(self, path: str) -> int:
        """Files with data below a path."""
        p, fs = self._at(f"{path}/part-*")
        return len(fs.globStatus(p) or [])

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def commit(self, parts: list[dict], after: int) -> int:
        """Make these parts the version that follows `after`; an error if that isn't the last one any more."""
        to, fs = self._at(f"{self.path}/manifests/{after + 1:010d}.json")
        draft, _ = self._at(f"{self.path}/drafts/{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(parts).encode()))
        stream.close()
        fs.mkdirs(to.getParent())
        rename = self._hadoop.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        self._hadoop.FileContext.getFileContext(to.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, to, options)  # fails if it is there
        return after + 1

    def clean(self, keep: int = 2) -> None:
        """Delete what the last `keep` versions don't name; no writer may be at work."""
        versions = self.versions()
        named = {p["path"].rsplit("/", 1)[1] for v in versions[-keep:] for p in self.parts(v)}
        for v in versions[:-keep]:
            p, fs = self._at(f"{self.path}/manifests/{v:010d}.json")
            fs.delete(p, False)
        p, fs = self._at(f"{self.path}/parts/*")
        for f in fs.globStatus(p) or []:
            if f.getPath().getName() not in named:
                fs.delete(f.getPath(), True)


def tail_to_merge(sizes: list[int]) -> int:
    """From which part on the parts are merged into one, so that each that stays is at least twice as large as all after it.

    There are then no more parts than the size has binary digits; a row is written anew when what it lies in has grown
    by a half.
    """
    after = 0
    at = len(sizes)
    for i in range(len(sizes) - 1, -1, -1):
        if sizes[i] < 2 * after:
            at = i
        after += sizes[i]
    return at


def n_tasks(spark: SparkSession, n_bytes: int) -> int:
    return max(1, -(-n_bytes // TASK_BYTES), min(spark.sparkContext.defaultParallelism, n_bytes // SMALL_BYTES))


def write_sorted(rows: DataFrame, path: str, n_bytes: int, *order: str) -> DataFrame:
    """Write rows in ranges of their order, as many as n_bytes asks for, so that a reader skips by least and greatest.

    Also into one range rows are shuffled: were they coalesced, one task would do all that comes before.
    """
    rows.repartitionByRange(n_tasks(rows.sparkSession, n_bytes), *order).sortWithinPartitions(*order).write.mode("errorifexists").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
