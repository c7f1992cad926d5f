"""Continuous indexing: parsed documents become chunks, vectors and ledger rows as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunks, plugins
from ..operators.keyed_table import KeyedTable
from ..operators.text_segments import TextIndex

PARSED = "doc_id string, title string, text string"
FIELDS = {"content": "text", "title_cn": "text"}


def index_batch(docs: DataFrame, batch: int, out: str, make_encoder: Callable[[], plugins.Encoder] = plugins.hashing_encoder) -> None:
    """Chunk, encode and write one micro-batch; a batch that runs again replaces what it wrote before.

    Chunks and vectors are keyed tables, to which a batch adds its own rows and the deletion of what its documents had
    before; the text index gets both too; a row a document and step goes below out/steps/batch=n. An error of code that
    runs on rows leaves the batch's documents failed in the ledger, and the stream goes on.
    """
    spark = docs.sparkSession
    docs = docs.dropDuplicates(["doc_id"])
    steps, status = [], "done"
    try:
        rows = chunks.chunk_documents(docs, form="generic").withColumn("version", F.lit(batch).cast("long"))
        path = f"{out}/staged/batch={batch}"
        rows.write.mode("overwrite").parquet(path)
        rows = spark.read.parquet(path)
        steps.append("chunking")
        table, index = KeyedTable(spark, f"{out}/chunks"), TextIndex(spark, f"{out}/index", FIELDS)
        old = former(table, docs)
        index.apply(rows.withColumn("title_cn", F.col("title")), old)
        table.apply(rows, old)  # after the index, so that a batch that runs again still knows what was there
        table.merge()
        index.merge()
        steps.append("es_write")
        vectors = plugins.embed(rows, make_encoder).join(rows.select("chunk_id", "doc_id", "version").hint("merge"), "chunk_id")
        steps.append("embedding")
        stored_vectors = KeyedTable(spark, f"{out}/vectors")
        stored_vectors.apply(vectors, former(stored_vectors, docs))
        stored_vectors.merge()
        steps.append("milvus")
    except PythonException as e:  # the encoder or other code on rows; faults of Spark itself end the stream, which starts again from here
        status = f"failed: {type(e).__name__}"
    log = F.explode(F.array(*[F.struct(F.lit(s).alias("step"), F.lit("done").alias("status")) for s in steps], F.struct(F.lit("ready").alias("step"), F.lit(status).alias("status")))).alias("s")
    docs.select("doc_id", log).select("doc_id", "s.*", F.lit(batch).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{out}/steps/batch_{batch}")


def former(table: KeyedTable, docs: DataFrame) -> DataFrame | None:
    """(chunk_id) of what the table has of these documents."""
    if not table.snapshots.versions():
        return None
    return table.read().join(docs.select("doc_id").distinct(), "doc_id", "left_semi").select("chunk_id")


def start(spark: SparkSession, folder: str, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Follow a folder of JSON files of parsed documents."""
    docs = spark.readStream.schema(PARSED).json(folder)
    return docs.writeStream.foreachBatch(lambda df, n: index_batch(df, n, out, **options)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
