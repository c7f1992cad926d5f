"""Token counts as rollups maintained by deltas: additive totals by source, language and tokenizer version.

A store is a folder with, for each committed batch, signed document rows, the sums of these by group, and a marker that
is written last. A batch without its marker counts as never written and is replaced when it runs again; a batch with
one isn't applied again. Totals are the sums of the committed groups, so they never need the documents. Signed rows lie
in folders by a hash of the document, and a batch reads only those that its changes touch; compact() merges batches.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, read_table, stored, text_or_empty

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenizer pattern that belongs to the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that are encoded at a time; a longer text is cut before blanks, where its tokens never join.
PIECE = 100_000

KEY = ["doc_id", "version"]
GROUP = ["source", "lang", "version"]
SIGNED = "doc_id long, source string, lang string, version string, n_docs long, n_tokens long"
#: Folders of signed rows; a batch writes a file to each that it touches.
BUCKETS = 64
#: Batches after which they are merged, once they are as large as what was merged before.
MANY_BATCHES = 8
MARK = "_COMMITTED"
CHANGES = "seq long, op string, doc_id long, source string, lang string, version string, n_tokens long"


def pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PIECE:
        to = text.rfind(" ", at + 1, at + PIECE)
        while to > at and not (text[to - 1].isalnum() and text[to + 1].isalpha()):
            to = text.rfind(" ", at + 1, to)
        if to <= at:
            break
        yield text[at:to]
        at = to
    yield text[at:]


def with_bpe_tokens(docs: DataFrame, path: str = TOKENIZER, text: str = "text", column: str = "n_tokens") -> DataFrame:
    """docs with the number of byte-level BPE tokens of each whole text; null and empty texts have none."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            n = pa.array([sum(len(encoding.encode_ordinary(p)) for p in pieces(t)) if t else 0 for t in texts], pa.int64())
            kept = [i for i, c in enumerate(batch.schema.names) if c != text]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), n], names=[*(batch.schema.names[i] for i in kept), column])

    from pyspark.sql.types import LongType, StructField, StructType

    return docs.mapInArrow(run, StructType([*(f for f in docs.schema.fields if f.name != text), StructField(column, LongType())]))


def bucket(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(BUCKETS)).cast("int")


class TokenRollup:
    """The store in one folder, for one writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _marked(self, part: str) -> list[str]:
        """The names below a part that have their marker, by one listing."""
        if not self._exists(f"{self.path}/{part}"):
            return []
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}/*/{MARK}")
        found = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(p)
        return sorted(f.getPath().getParent().getName() for f in found or [])

    def _mark(self, part: str, name: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}/{name}/{MARK}")
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(p, True).close()

    def _bytes(self, names: list[str]) -> int:
        total = 0
        for name in names:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/signed/batch={name}")
            total += p.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
        return total

    def batches(self) -> list[str]:
        """Names of all committed batches, merged ones too."""
        return self._marked("commits")

    def _parts(self) -> tuple[list[str], list[str]]:
        """The newest compaction, if there is one, and the batches after it."""
        names, merged = self.batches(), self._marked("compactions")
        if not merged:
            return [], names
        done = {r[0] for r in self.spark.read.schema("batch string").parquet(f"{self.path}/compactions/{merged[-1]}").collect()}
        return merged[-1:], [b for b in names if b not in done]

    def _committed(self, part: str, schema: str) -> DataFrame:
        """Rows of the newest compaction and of the batches after it."""
        names = [x for some in self._parts() for x in some]
        paths = [f"{self.path}/{part}/batch={b}" for b in names]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{part}").parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def current(self, keys: DataFrame | None = None) -> DataFrame:
        """Signed rows summed by document and group: what each document adds now. keys: only those of these documents."""
        rows = self._committed("signed", f"{SIGNED}, bucket int")
        if keys is not None:
            touched = [r[0] for r in keys.select(bucket().alias("b")).distinct().collect()]  # at most BUCKETS
            rows = rows.where(F.col("bucket").isin(touched)).join(keys.select(*KEY).hint("merge"), KEY, "left_semi")
        rows = rows.groupBy(*KEY, "source", "lang").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return rows.where("n_docs <> 0 or n_tokens <> 0")

    def _write(self, name: str, signed: DataFrame) -> None:
        signed.withColumn("bucket", bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/signed/batch={name}")
        signed = self.spark.read.schema(f"{SIGNED}, bucket int").parquet(f"{self.path}/signed/batch={name}")
        sums = signed.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums.write.mode("overwrite").parquet(f"{self.path}/sums/batch={name}")

    def compact(self) -> None:
        """Merge the committed batches into one set of rows; a batch that was merged still isn't applied again.

        Its marker, written last, stands beside the names of the merged batches: without it the batches count as before.
        Each compaction has a name of its own, so one that dies leaves those before it whole. apply() calls it when there
        are MANY_BATCHES since the last one and they are as large as that.
        """
        names = self.batches()
        if names:
            self._write(into := f"compact-{len(names):08d}-{uuid.uuid4().hex}", self.current())
            self.spark.createDataFrame([(b,) for b in names], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/compactions/{into}")
            self._mark("compactions", into)

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch of changes (seq, op, doc_id, source, lang, version, n_tokens); False if it was committed before.

        op is insert, delete or revise; an insert of a document that is there revises it, a revision of one that isn't
        inserts it, a deletion of one that isn't there changes nothing. Of several changes of one document and version
        the last by seq counts (ties: the greatest row). Rows with a null op, doc_id or version are left out, null
        counts are 0, null sources and languages are groups of their own; other columns pass unread.
        """
        if batch in self.batches():
            return False
        last = changes.where("op in ('insert', 'delete', 'revise') and doc_id is not null and version is not null")
        last = last.groupBy(*KEY).agg(F.max(F.struct("seq", "op", "source", "lang", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))).alias("to"))
        last = stored(last, "changes")
        before = self.current(last)
        out = before.select("doc_id", "source", "lang", "version", -F.col("n_docs"), -F.col("n_tokens"))
        into = last.where("to.op <> 'delete'").select("doc_id", "to.source", "to.lang", "version", F.lit(1).cast("long"), "to.n_tokens")
        signed = out.union(into).toDF("doc_id", "source", "lang", "version", "n_docs", "n_tokens")
        self._write(batch, signed)
        self.spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{batch}")
        self._mark("commits", batch)
        merged, fresh = self._parts()
        if len(fresh) >= MANY_BATCHES and self._bytes(fresh) >= self._bytes(merged):
            self.compact()
        return True

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens) over all committed batches; groups that became empty are gone."""
        rows = self._committed("sums", "source string, lang string, version string, n_docs long, n_tokens long")
        return rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")


def counted(docs: DataFrame, op: str, seq: int, path: str = TOKENIZER) -> DataFrame:
    """Changes for documents (doc_id, source, lang, text): a row for each of two tokenizer versions."""
    words = F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    both = with_bpe_tokens(docs.withColumn("words", words), path)
    versions = F.array(F.struct(F.lit("words-1").alias("version"), F.col("words").alias("n_tokens")), F.struct(F.lit("bpe-50k-1").alias("version"), F.col("n_tokens").alias("n_tokens")))
    return both.select(F.lit(seq).cast("long").alias("seq"), F.lit(op).alias("op"), "doc_id", "source", "lang", F.inline(versions))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over all documents: all come, repeated texts go, and those with repeated lines are counted anew.

    The middle batch is sent twice, and has an effect once.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", text_or_empty("text").alias("text"))
    store = TokenRollup(spark, new_path(spark, "rollup"))
    store.apply("1-insert", counted(docs, "insert", 1))
    digest = docs.select("doc_id", F.md5("text").alias("digest"))
    first = digest.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = stored(first.select("digest", "first"), "first")
    again = stored(digest.join(first.hint("merge"), "digest").where("doc_id > first").select("doc_id"), "again")
    versions = F.explode(F.array(F.lit("words-1"), F.lit("bpe-50k-1"))).alias("version")
    gone = again.select(F.lit(2).cast("long").alias("seq"), F.lit("delete").alias("op"), "doc_id", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("lang"), versions, F.lit(0).cast("long").alias("n_tokens"))
    store.apply("2-delete", gone)
    store.apply("2-delete", gone)
    lines = F.split("text", "\n")
    revised = docs.where(F.size(F.array_distinct(lines)) < F.size(lines)).withColumn("text", F.array_join(F.array_distinct(lines), "\n"))
    revised = revised.join(again.hint("merge"), "doc_id", "left_anti")
    store.apply("3-revise", counted(revised, "revise", 3))
    return store.totals()
