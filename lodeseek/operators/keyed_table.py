"""A table of rows with keys that takes upserts and deletions as small immutable parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import new_path
from ..sources.snapshots import Snapshots, tail_to_merge, write_sorted

_SEQ, _GONE = "_seq", "_gone"


class KeyedTable:
    """Chunks, vectors or others by key, below a path.

    Each batch is one part, in as many files as its size asks for, sorted by key; a batch of ten documents writes ten
    documents' rows. Parts grow geometrically (see tail_to_merge). Readers join the newer parts, which are at most as
    large as half of the oldest one, to it, and shuffle only rows whose keys they have.
    """

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str] = ("chunk_id",), version: str = "version"):
        self.spark, self.key, self.version = spark, list(key), version
        self.snapshots = Snapshots(spark, path)

    def upsert(self, rows: DataFrame) -> int:
        return self.apply(rows)

    def delete(self, keys: DataFrame) -> int:
        return self.apply(deleted=keys)

    def apply(self, upserts: DataFrame | None = None, deleted: DataFrame | None = None) -> int:
        """Commit a batch of rows and of keys that go, and return the new version (the last one if nothing can change).

        Of rows with one key the last version counts, of equal versions the later batch's, then one by hash. A deletion
        hides what earlier batches have of a key, whatever its version; later batches may bring it back, and a key that is
        both stays as its row says. Null keys are left out. All batches have the same columns.
        """
        parts, rows = self.snapshots.parts(), None
        if upserts is not None:
            rows = upserts.dropna(subset=self.key).withColumn(_GONE, F.lit(False))
            order = [F.desc_nulls_last(self.version), F.desc(F.xxhash64(*rows.columns))]
            rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*self.key).orderBy(*order))).where("_n = 1").drop("_n")
        if deleted is not None and parts:
            schema = (rows if rows is not None else self._stored(parts[:1])).drop(_SEQ, _GONE).schema
            columns = [F.col(f.name) if f.name in self.key else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
            gone = deleted.select(*self.key).dropna().distinct()
            if rows is not None:
                gone = gone.join(rows.select(*self.key).hint("merge"), self.key, "left_anti")
            gone = gone.select(*columns).withColumn(_GONE, F.lit(True))
            rows = gone if rows is None else rows.unionByName(gone)
        return self._add(rows) if rows is not None else max(self.snapshots.versions(), default=0)

    def _add(self, rows: DataFrame) -> int:
        last = max(self.snapshots.versions(), default=0)
        rows = rows.withColumn(_SEQ, F.lit(last + 1).cast("long"))
        draft = new_path(self.spark, "batch")  # computed once, and its size is then known
        rows.write.parquet(draft)
        path = self.snapshots.new_part()
        write_sorted(self.spark.read.schema(rows.schema).parquet(draft), path, self.snapshots.bytes_of(draft), *self.key)
        self.snapshots._at(draft)[1].delete(self.snapshots._at(draft)[0], True)
        return self.snapshots.commit([*self.snapshots.parts(), {"path": path, "bytes": self.snapshots.bytes_of(path)}], last)

    def merge(self) -> int | None:
        """Merge the newest parts where they have grown; the new version, or None if all may stay."""
        parts = self.snapshots.parts()
        at = tail_to_merge([p["bytes"] for p in parts])
        if len(parts) - at < 2:
            return None
        last, tail = self.snapshots.versions()[-1], parts[at:]
        rows = self._settled(self._stored(tail), at > 0)
        path = self.snapshots.new_part()
        write_sorted(rows, path, sum(p["bytes"] for p in tail), *self.key)
        return self.snapshots.commit([*parts[:at], {"path": path, "bytes": self.snapshots.bytes_of(path)}], last)

    def _stored(self, parts: list[dict]) -> DataFrame:
        return self.spark.read.parquet(*[p["path"] for p in parts])

    def _settled(self, rows: DataFrame, with_gone: bool) -> DataFrame:
        """One row of each key, or none if it is deleted; with_gone: the last deletion too, for older parts."""
        by_key = Window.partitionBy(*self.key)
        rows = rows.withColumn("_until", F.max(F.when(F.col(_GONE), F.col(_SEQ))).over(by_key))
        order = [F.desc_nulls_last(self.version), F.desc(_SEQ)]
        alive = rows.where(~F.col(_GONE) & (F.col("_until").isNull() | (F.col(_SEQ) > F.col("_until"))))
        alive = alive.withColumn("_n", F.row_number().over(by_key.orderBy(*order))).where("_n = 1").drop("_n", "_until")
        if not with_gone:
            return alive
        return alive.unionByName(rows.where(F.col(_GONE) & (F.col(_SEQ) == F.col("_until"))).drop("_until").dropDuplicates(self.key))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one if none is given."""
        parts = self.snapshots.parts(version)
        if not parts:
            raise ValueError(f"nothing was committed to {self.snapshots.path}")
        base = self._stored(parts[:1])  # has each key once
        if len(parts) > 1:
            newer = self._stored(parts[1:])
            keys = newer.select(*self.key).distinct()
            met = base.join(keys, self.key, "left_semi").unionByName(newer)
            base = base.join(keys, self.key, "left_anti").unionByName(self._settled(met, False))
        return base.drop(_SEQ, _GONE)
