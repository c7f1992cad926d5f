"""Files as tables: documents with their metadata, parsed texts with side inputs, chunk files, and event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import base_name, stem

# Field names of metadata files, side files, chunk files, poll results and answer events.
META = T.StructType([T.StructField(c, T.StringType()) for c in ("article_id", "journal", "source", "doi", "section", "article_type", "title_cn", "title_en", "authors_cn", "abstract_cn", "keywords_cn", "keywords_en")])
CONTENT_LIST = "array<array<struct<type:string,content:struct<table_caption:array<struct<content:string>>,table_footnote:array<struct<content:string>>>>>>"
CHUNK_FILE = "doc_id string, md5 string, uuid string, total_chunks int, chunks array<struct<chunk_id:string,doc_id:string,level:string,chunk_type:string,title:string,title_cn:string,journal:string,doi:string,heading_stack:array<string>,content:string,html_body:string>>"
POLL = "batch_id string, data_id string, file_name string, state string, err_msg string, ts timestamp"
ANSWER = "t string, k string, s string, title string, summary string, elapsed_ms bigint, c string, id string, source string, snippet string, doc_id string, relevance double, message string"


def document_files(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, path, length, md5) of the PDF files anywhere below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(folder)
    return files.select(stem(F.col("path")).alias("stem"), "path", "length", F.md5("content").alias("md5"))


def metadata_files(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, META) of the JSON files; missing strings are empty, a file that can't be read has all of them empty."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json", recursiveFileLookup=True)
    rows = files.select(stem(F.col("_metadata.file_path")).alias("stem"), F.from_json("value", META).alias("m"))
    return rows.select("stem", *[F.coalesce(f"m.{c}", F.lit("")).alias(c) for c in META.names])


def paired(documents: DataFrame, metadata: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with metadata of the same stem, and the documents that have none."""
    return documents.join(metadata, "stem"), documents.join(metadata.select("stem"), "stem", "left_anti")


def parsed_documents(spark: SparkSession, folder: str, metadata: str | None = None) -> DataFrame:
    """(md5, text, pages, META, uuid): {md5}/full.md is required; *_content_list_v2.json beside it and metadata are not.

    metadata: the folder whose {md5}/*.json are the metadata, the first by name of each; where it isn't given, meta.json
    in the document's own folder is. Bytes that aren't UTF-8 become replacement characters; uuid comes from the side
    file's name.
    """
    read = lambda glob, of=folder: spark.read.text(of, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
    owner = F.regexp_extract("_metadata.file_path", "([^/]+)/[^/]+$", 1).alias("md5")
    texts = read("full.md").select(owner, F.col("value").alias("text"))
    side = read("*_content_list_v2.json").select(owner, F.from_json("value", CONTENT_LIST).alias("pages"), F.regexp_extract("_metadata.file_path", "([^/]+)_content_list_v2\\.json$", 1).alias("uuid"))
    side = side.groupBy("md5").agg(F.max_by("pages", "uuid").alias("pages"), F.max("uuid").alias("uuid"))
    meta = read("*.json", metadata) if metadata else read("meta.json")
    meta = meta.select(owner, F.col("_metadata.file_path").alias("at"), F.from_json("value", META).alias("m")).groupBy("md5").agg(F.min_by("m", "at").alias("m"))
    out = texts.join(side, "md5", "left").join(meta, "md5", "left")
    return out.select("md5", "text", "pages", *[F.coalesce(f"m.{c}", F.lit("")).alias(c) for c in META.names], F.coalesce("uuid", F.lit("")).alias("uuid"))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of all files below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "length")


def parsed_ids(objects: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct first path segments, sorted; a limit only where one is asked for."""
    ids = objects.select(F.split("path", "/")[0].alias("md5")).distinct().orderBy("md5")
    return ids.limit(limit) if limit else ids


def folder_inventory(objects: DataFrame) -> DataFrame:
    """(bucket, n_folders, n_objects): distinct first path segments of each bucket."""
    return objects.groupBy("bucket").agg(F.count_distinct(F.split("path", "/")[0]).alias("n_folders"), F.count("*").alias("n_objects"))


def chunk_files(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of all chunk files but checkpoints, a row each with the file's md5 and uuid."""
    files = spark.read.schema(CHUNK_FILE).option("multiLine", True).option("pathGlobFilter", "[!.]*.json").json(folder)
    return files.select("md5", "uuid", F.explode("chunks").alias("c")).select("md5", "uuid", "c.*")


# Images of a parsed bundle by extension, in lower case only; all else but full.md is plain bytes.
IMAGES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "gif": "image/gif", "bmp": "image/bmp"}
FULL_MD, FULL_MD_TYPE, BYTES_TYPE = "full.md", "text/markdown", "application/octet-stream"


def bundle_members(members: DataFrame) -> DataFrame:
    """members (bundle, seq, path) with name, kind (full_md, image, other, superseded) and content_type; folders go.

    Of several full.md of a bundle the last by seq counts, the others are superseded.
    """
    name = base_name(F.col("path"))
    ext = F.substring_index(name, ".", -1)
    types = F.create_map(*[F.lit(x) for kv in IMAGES.items() for x in kv])
    rows = members.where(~F.col("path").endswith("/") & (F.col("path") != "")).withColumn("name", name)
    last = F.max(F.when(F.col("name") == FULL_MD, F.col("seq"))).over(Window.partitionBy("bundle"))
    kind = F.when(F.col("name") == FULL_MD, F.when(F.col("seq") < last, "superseded").otherwise("full_md")).when(F.col("name").contains(".") & ext.isin(list(IMAGES)), "image").otherwise("other")
    rows = rows.withColumn("kind", kind)
    return rows.withColumn("content_type", F.when(F.col("kind") == "image", types[ext]).when(F.col("name") == FULL_MD, FULL_MD_TYPE).otherwise(BYTES_TYPE))


def store_chunks(chunks: DataFrame, path: str) -> None:
    """Write chunks into folders by level, each sorted by document in ranges, so that a catalogue reads one folder."""
    chunks.repartitionByRange("level", "doc_id").sortWithinPartitions("level", "doc_id").write.mode("overwrite").partitionBy("level").parquet(path)


def chunk_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(md5, doc_id, title_cn, journal) of the papers in a stored chunk table: its rows of level L0, whose folder alone is read."""
    return spark.read.parquet(path).where("level = 'L0'").select("md5", "doc_id", "title_cn", "journal")


def poll_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of poll results from JSON files; the file's name stands in for a missing id, rows without either go."""
    rows = spark.readStream.schema(POLL).json(folder)
    return rows.withColumn("data_id", F.coalesce(F.nullif("data_id", F.lit("")), "file_name")).where("data_id is not null and state is not null")


def answer_events(text: DataFrame) -> DataFrame:
    """Events from log lines (message_id, seq, value): those after `data: ` that are JSON objects with a kind t."""
    rows = text.where(F.col("value").startswith("data: ")).select("message_id", "seq", F.from_json(F.substring("value", 7, 2**31 - 1), ANSWER).alias("e"))
    return rows.where("e.t is not null").select("message_id", "seq", "e.*")
