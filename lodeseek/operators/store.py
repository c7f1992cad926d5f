"""Writing: upserts, deletes, width limits, resuming, exports and file names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import present

# Widths of the vector store's string fields, and that of any other.
WIDTHS = {"chunk_id": 128, "doc_id": 32, "doi": 128, "level": 4, "chunk_type": 16, "journal": 128, "section": 128, "article_type": 128, "title_cn": 512}
OTHER_WIDTH = 256
METADATA_TITLE = "metadata_title_cn"


def upsert(base: DataFrame, updates: DataFrame, key: Sequence[str] = ("chunk_id",), version: str = "version") -> DataFrame:
    """The last version of each key over both; of equal versions the update, then the greatest row, wins."""
    both = base.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in both.columns if c != "_new"]
    best = both.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(version, "_new", F.xxhash64(*columns))).alias("r"))
    return best.select("r.*")


def limited(rows: DataFrame, widths: Mapping[str, int] = WIDTHS, other: int = OTHER_WIDTH) -> DataFrame:
    """Rows for the vector store: those with content, strings cut to their width, the embedding and lists as they are.

    A title from the metadata (metadata_title_cn), where there is one, is the title.
    """
    keep = rows.where(present(F.col("content")).isNotNull())
    if METADATA_TITLE in keep.columns:
        keep = keep.withColumn("title_cn", vector_title(F.col(METADATA_TITLE), F.col("title_cn"))).drop(METADATA_TITLE)
    cut = [F.substring(F.coalesce(c, F.lit("")), 1, widths.get(c, other)).alias(c) if kind == "string" and c != "content" else F.col(c) for c, kind in keep.dtypes]
    return keep.select(*cut)


def vector_title(metadata_title: Column, title: Column) -> Column:
    return F.coalesce(present(metadata_title), title)


def delete(rows: DataFrame, tasks: DataFrame, step: str, key: str = "doc_id") -> DataFrame:
    """rows without documents of deleted tasks (index_doc_id, steps map): only where the step is done and names a target."""
    gone = tasks.where((F.col("steps")[step]["status"] == "done") & present(F.col("steps")[step]["target"]).isNotNull()).select(F.col("index_doc_id").alias(key)).distinct()
    return rows.join(gone.hint("merge"), key, "left_anti")


def pending(ids: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What isn't completed yet; an id counts as completed only once its batch was written."""
    return ids.join(done.select(key).distinct(), key, "left_anti")


def export_outcomes(files: DataFrame, exported: DataFrame) -> DataFrame:
    """(outcome, n): no_uuid, exists, or uploaded, for chunk files (md5, uuid)."""
    there = exported.select("uuid").distinct().withColumn("_there", F.lit(True))
    rows = files.join(there, "uuid", "left")
    outcome = F.when(present(F.col("uuid")).isNull(), "no_uuid").when(F.col("_there"), "exists").otherwise("uploaded")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def export(files: DataFrame, path: str) -> DataFrame:
    """Append the chunk files (md5, uuid, ...) that aren't there yet to a folder of JSON rows; returns export_outcomes.

    A file without uuid isn't written; of rows with one uuid a single one is, though each counts as uploaded. Running it
    again writes nothing.
    """
    spark = files.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    exported = spark.read.schema("uuid string").json(path) if there else spark.createDataFrame([], "uuid string")
    outcomes = export_outcomes(files, exported).collect()  # three rows at most
    fresh = files.where(present(F.col("uuid")).isNotNull()).join(exported.distinct().hint("merge"), "uuid", "left_anti").dropDuplicates(["uuid"])
    fresh.write.mode("append").json(path)
    return spark.createDataFrame(outcomes, "outcome string, n long")


def output_name(uuid: Column, doc_id: Column, md5: Column) -> Column:
    stem = F.coalesce(present(uuid), F.concat_ws("_", doc_id.cast("string"), F.substring(md5, 1, 8)))
    return F.concat(stem, F.lit(".json"))


def with_image_links(text: Column, prefix: Column, md5: Column) -> Column:
    """![alt](images/f) with the store's address in front."""
    marked = F.regexp_replace(text, "(!\\[[^\\]]*\\]\\()images/", "$1\u0000images/")
    return F.replace(marked, F.lit("\u0000"), F.concat(prefix, F.lit("/"), md5, F.lit("/")))


def split_valid(rows: DataFrame, column: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose JSON parses, with it as `parsed`, and the others for quarantine; a bad row ends nothing."""
    bad = "_corrupt_record"
    read = rows.withColumn("parsed", F.from_json(column, f"{schema}, {bad} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}))
    is_bad = F.col("parsed").isNull() | F.col(f"parsed.{bad}").isNotNull()
    return read.where(~is_bad), read.where(is_bad).drop("parsed")
