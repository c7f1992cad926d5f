"""Queries over stores, the task ledger and its event logs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger, store
from ..sources import files
from ..sources.shared import new_path
from ..sources.tables import table
from ..streaming import folds


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task for each document: labelled good ones are parsed, bad ones failed, the others pending."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    status = F.when(F.col("quality") == 1, "parsed").when(F.col("quality") == 0, "failed").otherwise("pending")
    return docs.select(F.col("doc_id").alias("id"), F.md5("text").alias("md5"), F.when(F.col("lang") != "es", F.col("source")).alias("kb_id"), status.alias("status"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 60).alias("created_at"), F.concat("source", F.lit("/"), "doc_id").alias("raw_path"), F.concat(F.lit("b"), F.floor(F.col("doc_id") / 10).cast("string")).alias("batch_id"))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parsed text for each English document, and a PDF for each of src1."""
    docs = table(spark, sf_dir, "documents")
    texts = docs.where("lang = 'en'").select(F.col("lang").alias("bucket"), F.concat(F.md5("text"), F.lit("/full.md")).alias("path"))
    return texts.union(docs.where("source = 'src1'").select("lang", F.concat(F.md5("text"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".PDF"))))


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.lit(0).alias("version"), F.md5("text").alias("content"))
    return base, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"), F.col("quality").alias("version"), F.concat(F.lit("label "), F.col("toxic").cast("string")).alias("content"))


def chunk_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.upsert(*_versions(spark, sf_dir))


def index_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    step = F.struct(F.when(F.col("quality") == 1, "done").otherwise("failed").alias("status"), F.when(F.col("toxic") == 1, "chunks").otherwise("").alias("target"))
    gone = labels.select(F.col("doc_id").alias("index_doc_id"), F.create_map(F.lit("es_write"), step).alias("steps"))
    return store.delete(table(spark, sf_dir, "documents").select("doc_id", "lang"), gone, "es_write")


def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.pending(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


def vector_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("text").alias("content"), F.md5("text").alias("doc_id"), F.col("text").alias("title_cn"), F.when(F.col("lang") == "en", F.substring_index("text", "\n", 1)).alias("metadata_title_cn"), F.col("text").alias("level"), F.col("text").alias("summary"), F.col("doc_id").alias("n"))
    return store.limited(rows).select("n", "doc_id", "title_cn", "level", "summary")


def image_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("![fig "), F.col("doc_id").cast("string"), F.lit("](images/a.png) "), F.col("text"), F.lit(" ![x](http://images/b)"))
    return table(spark, sf_dir, "documents").select("doc_id", store.with_image_links(text, F.lit("/parsed"), F.md5("text")).alias("text"))


def export_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.md5("text").alias("md5"), F.when(F.col("lang") != "fr", F.concat(F.lit("u"), "doc_id")).alias("uuid"))
    return store.export_outcomes(rows, table(spark, sf_dir, "labels").select(F.concat(F.lit("u"), "doc_id").alias("uuid")))


def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    uuid = F.when(F.col("lang") == "en", F.concat(F.lit("u"), "doc_id")).otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", store.output_name(uuid, F.col("doc_id"), F.md5("text")).alias("name"))


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' JSON, with that of errors broken off."""
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "error", F.substring("props", 1, 5)).otherwise(F.col("props")).alias("props"))
    good, bad = store.split_valid(rows, "props", "k bigint")
    return good.select("event_id", F.lit(True).alias("valid"), F.col("parsed.k").alias("k")).union(bad.select("event_id", F.lit(False), F.lit(None).cast("long")))


def bundle_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles of ten documents, whose members' names follow from language and source."""
    docs = table(spark, sf_dir, "documents")
    ext = F.when(F.col("source") == "src0", ".bmp").when(F.col("source") == "src1", ".PNG").when(F.col("source") == "src2", ".svg").when(F.col("source") == "src3", ".jpeg").otherwise(".png")
    name = F.when(F.col("lang") == "en", "full.md").when(F.col("lang") == "fr", F.concat("source", ext)).when(F.col("lang") == "de", F.concat("source", F.lit(".json"))).otherwise(F.concat(F.lit("."), "source"))
    members = docs.select(F.floor(F.col("doc_id") / 10).alias("bundle"), F.col("doc_id").alias("seq"), F.concat(F.lit("out/"), "doc_id", F.lit("/"), name).alias("path"))
    return files.bundle_members(members).groupBy("kind", "content_type").agg(F.count("*").alias("n"), F.count_distinct("name").alias("n_names"))


def folder_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.folder_inventory(objects(spark, sf_dir))


def parsed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.parsed_ids(objects(spark, sf_dir))


def dedup_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents again as files to ingest; the ledger knows those that are labelled."""
    known = tasks(spark, sf_dir).where("status <> 'pending'").groupBy("md5").agg(F.max("status").alias("status"), F.max("kb_id").alias("kb_id"))
    docs = table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("md5")).agg(F.max(F.when(F.col("lang") == "de", F.lit("kb-new"))).alias("kb_id"))
    return ledger.decisions(docs, known, objects(spark, sf_dir).select(F.substring_index("path", "/", 1).alias("md5")))


def folder_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = tasks(spark, sf_dir).groupBy("md5").agg(F.max("status").alias("status"), F.max("kb_id").alias("kb_id")).withColumn("status", F.when(F.col("status") == "pending", "processing").otherwise(F.col("status")))
    docs = table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("md5")).agg(F.lit(None).cast("string").alias("kb_id"))
    rows = ledger.decisions(docs, known, objects(spark, sf_dir).select(F.substring_index("path", "/", 1).alias("md5")), skip_processing=True)
    return rows.groupBy("decision").agg(F.count("*").alias("n"))


def _allocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("quota_day"), F.col("doc_id").cast("string").alias("md5"), (F.length("text") / 100 + 1).cast("long").alias("pages"))
    keys = rows.select("quota_day").distinct().select("quota_day", F.explode(F.array(F.lit("key-a"), F.lit("key-b"))).alias("key"), F.lit(ledger.PAGES_A_DAY).alias("remaining"))
    return ledger.allocate(rows, keys)


def quota_alloc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.batches(_allocated(spark, sf_dir)).select("quota_day", "md5", "pages", "key", "batch")


def batch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("quota_day"), F.col("lang").alias("key"), F.length("text").cast("long").alias("pages"), F.col("doc_id").cast("string").alias("md5"))
    return ledger.batches(rows).groupBy("quota_day", "key", "batch").agg(F.count("*").alias("n"), F.sum("pages").alias("pages"))


def quota_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.quota_report(table(spark, sf_dir, "documents").select(F.col("source").alias("day"), F.col("lang").alias("key"), F.floor(F.length("text") / 100).alias("pages")))


def ledger_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "documents").select(F.md5("text").alias("md5"), "doc_id", F.when(F.col("lang") == "en", F.col("text")).otherwise("").alias("title_cn"))
    return ledger.backfill(papers, tasks(spark, sf_dir).where("status <> 'pending'"), objects(spark, sf_dir))


def catalogue_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ledger_backfill, from a stored chunk table that has a row of level L0 and one of L1 for each line of a document."""
    docs = table(spark, sf_dir, "documents").withColumn("md5", F.md5("text"))
    title = F.when(F.col("lang") == "en", F.col("text")).otherwise("").alias("title_cn")
    papers = docs.select("md5", "doc_id", title, F.col("source").alias("journal"), F.lit("L0").alias("level"), F.substring("text", 1, 200).alias("content"))
    lines = docs.select("md5", "doc_id", F.lit("").alias("title_cn"), F.col("source").alias("journal"), F.lit("L1").alias("level"), F.explode(F.split("text", "\n")).alias("content"))
    path = new_path(spark, "catalogue")
    files.store_chunks(papers.unionByName(lines), path)
    return ledger.backfill(files.chunk_catalogue(spark, path), tasks(spark, sf_dir).where("status <> 'pending'"), objects(spark, sf_dir))


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.status_counts(tasks(spark, sf_dir))


def consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.consistency(tasks(spark, sf_dir), objects(spark, sf_dir)).select("id", "md5", "lost", "created_at")


def orphan_adoption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.adopt(tasks(spark, sf_dir), "default").groupBy("kb_id").agg(F.count("*").alias("n"))


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as the steps of a document."""
    names = {"signup": "upload", "view": "mineru", "click": "chunking", "purchase": "embedding", "error": "es_write"}
    step = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("event_type")]
    status = F.when(F.col("value") < 20, "failed").when(F.col("value") < 60, "running").otherwise("done")
    return folds.step_states(table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), step.alias("step"), status.alias("status"), "ts", F.col("event_id").alias("seq")))


def step_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir).select("doc_id", *[F.col("steps")[s]["status"].alias(s) for s in ledger.STEPS[:5]])


def retry_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger.retry_plan(_steps(spark, sf_dir).withColumnRenamed("doc_id", "id"))
    return rows.select("id", "from_step", "new_status", F.array_join(F.map_values("new_steps"), ",").alias("new_steps"))


def step_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = F.map_concat("steps", F.create_map(F.lit("milvus"), F.col("steps")["es_write"]))
    return _steps(spark, sf_dir).select("doc_id", ledger.rolled_up(full).alias("state"))


def path_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = tasks(spark, sf_dir).where("status = 'parsed'")
    papers = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"))
    wanted = papers.select(F.col("doc_id").cast("string").alias("key")).union(papers.select("md5")).union(papers.select(F.concat(F.lit("b"), F.floor(F.col("doc_id") / 10).cast("string"))))
    wanted = wanted.union(papers.select(F.substring("md5", 1, 8)))
    return ledger.resolve_paths(wanted, known, objects(spark, sf_dir), papers)


def batch_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("batch_id"), F.md5("text").alias("md5"))
    errors = table(spark, sf_dir, "events").select(F.concat(F.lit("src"), F.col("user_id").cast("string")).alias("batch_id"), F.concat(F.when(F.col("event_type") == "error", "Token 过期: ").when(F.col("event_type") == "signup", "HTTP 404 找不到任务 ").when(F.col("event_type") == "view", "Token expired, not found: ").otherwise("quota: "), F.col("props")).alias("message"))
    return ledger.batch_failures(rows, errors)


def task_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day of a user as a task: a purchase is done, an error failed, all else under way."""
    state = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("running")
    rows = table(spark, sf_dir, "events").select(F.concat_ws("-", "user_id", F.to_date("ts")).alias("md5"), state.alias("state"), F.col("props").alias("err_msg"), "ts", F.col("event_id").alias("seq"))
    return folds.task_states(rows, 6 * 3600).select("md5", "status", "error_msg", "at")


def changelog_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_type") != "signup", (F.col("user_id") % 7).cast("string")).alias("kb_id"), F.when(F.col("event_type") == "error", "doc_deleted").otherwise("doc_update").alias("type"), F.col("user_id").alias("doc_id"), F.struct("value", "event_type").alias("doc"))
    return folds.documents(folds.for_subscribers(rows)).select("kb_id", "doc_id", "seq", F.col("doc.value").alias("value"), F.col("doc.event_type").alias("event_type"))


def answer_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as the events of one answer."""
    t = F.create_map(*[F.lit(x) for x in ("view", "text", "click", "step", "purchase", "cite", "error", "text", "signup", "done")])[F.col("event_type")]
    value = F.concat(F.lit("data: "), F.to_json(F.struct(t.alias("t"), F.when(F.col("event_type") == "click", F.concat(F.lit("k"), F.floor("value") % 3)).alias("k"), F.when(F.col("value") > 50, "done").otherwise("running").alias("s"), F.concat(F.floor("value").cast("string"), F.lit(" ")).alias("c"))))
    rows = files.answer_events(table(spark, sf_dir, "events").select(F.col("user_id").alias("message_id"), F.col("event_id").alias("seq"), value.alias("value")))
    return folds.answers(rows).select("message_id", "content", "n_citations", "status", F.array_join(F.transform(F.map_entries("steps"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("steps"))


QUERIES = {f.__name__: f for f in (
    chunk_upsert, index_delete, resume_pending, vector_truncate, image_links, export_outcomes, output_names, quarantine, bundle_kinds, folder_inventory, parsed_ids,
    dedup_decision, folder_decision, quota_alloc, batch_sizes, quota_report, ledger_backfill, catalogue_backfill, status_counts, consistency, orphan_adoption, step_fold, retry_plan, step_rollup,
    path_resolution, batch_failures, task_state, changelog_fold, answer_fold,
)}

_TASKS = """
t as (select d.doc_id as id, md5(text) as md5, case when lang <> 'es' then source end as kb_id, case quality when 1 then 'parsed' when 0 then 'failed' else 'pending' end as status,
        to_timestamp(1700000000 + d.doc_id * 60) at time zone 'UTC' as created_at, source || '/' || d.doc_id as raw_path, 'b' || (d.doc_id // 10) as batch_id from documents d left join labels l on l.doc_id = d.doc_id),
o as (select lang as bucket, md5(text) || '/full.md' as path from documents where lang = 'en' union all select lang, md5(text) || '/' || doc_id || '.PDF' from documents where source = 'src1')"""
_STEPS_SQL = """
ev as (select user_id as doc_id, case event_type when 'signup' then 'upload' when 'view' then 'mineru' when 'click' then 'chunking' when 'purchase' then 'embedding' else 'es_write' end as step,
         case when value < 20 then 'failed' when value < 60 then 'running' else 'done' end as status, ts, event_id from events),
la as (select doc_id, step, arg_max(status, (ts, event_id)) as status from ev group by all),
st as (select doc_id, max(status) filter (step = 'upload') as upload, max(status) filter (step = 'mineru') as mineru, max(status) filter (step = 'chunking') as chunking, max(status) filter (step = 'embedding') as embedding, max(status) filter (step = 'es_write') as es_write from la group by doc_id)"""

_BACKFILL = f"""with {_TASKS}, p as (select md5(text) as md5, min(doc_id) as doc_id, arg_min(case when lang = 'en' then text else '' end, doc_id) as title from documents group by 1),
        f as (select string_split(path, '/')[1] as md5, min(path) as path from o where lower(path) like '%.pdf' group by 1)
        select p.md5, doc_id, case when title <> '' then title else '文献-' || doc_id end as original_name, coalesce(path, 'preloaded/' || p.md5) as raw_path, path is not null as has_pdf from p left join f on f.md5 = p.md5 where p.md5 not in (select md5 from t where status <> 'pending')"""

ORACLES = {
    "chunk_upsert": "select d.doc_id as chunk_id, coalesce(l.quality, 0) as version, case when l.doc_id is not null then 'label ' || toxic else md5(text) end as content from documents d left join labels l on l.doc_id = d.doc_id",
    "index_delete": "select doc_id, lang from documents where doc_id not in (select doc_id from labels where quality = 1 and toxic = 1)",
    "resume_pending": "select doc_id, source from documents where doc_id not in (select doc_id from labels)",
    "vector_truncate": "select doc_id as n, md5(text) as doc_id, substr(case when lang = 'en' and string_split(text, chr(10))[1] <> '' then string_split(text, chr(10))[1] else text end, 1, 512) as title_cn, substr(text, 1, 4) as level, substr(text, 1, 256) as summary from documents where text <> ''",
    "image_links": "select doc_id, '![fig ' || doc_id || '](/parsed/' || md5(text) || '/images/a.png) ' || text || ' ![x](http://images/b)' as text from documents",
    "export_outcomes": "select case when lang = 'fr' then 'no_uuid' when doc_id in (select doc_id from labels) then 'exists' else 'uploaded' end as outcome, count(*) as n from documents group by 1",
    "output_names": "select doc_id, case when lang = 'en' then 'u' || doc_id else doc_id || '_' || substr(md5(text), 1, 8) end || '.json' as name from documents",
    "quarantine": "select event_id, event_type <> 'error' as valid, case when event_type <> 'error' then (props->>'k')::bigint end as k from events",
    "bundle_kinds": r"""with m as (select doc_id // 10 as bundle, doc_id, case lang when 'en' then 'full.md' when 'fr' then source || case source when 'src0' then '.bmp' when 'src1' then '.PNG' when 'src2' then '.svg' when 'src3' then '.jpeg' else '.png' end when 'de' then source || '.json' else '.' || source end as name from documents),
        k as (select *, case when name = 'full.md' then case when doc_id = max(doc_id) filter (name = 'full.md') over (partition by bundle) then 'full_md' else 'superseded' end when regexp_matches(name, '\.(jpg|jpeg|png|webp|gif|bmp)$') then 'image' else 'other' end as kind from m)
        select kind, case when name = 'full.md' then 'text/markdown' when kind = 'image' then case when name like '%.bmp' then 'image/bmp' when name like '%.jpeg' then 'image/jpeg' else 'image/png' end else 'application/octet-stream' end as content_type, count(*) as n, count(distinct name) as n_names from k group by 1, 2""",
    "folder_inventory": f"with {_TASKS} select bucket, count(distinct string_split(path, '/')[1]) as n_folders, count(*) as n_objects from o group by bucket",
    "parsed_ids": f"with {_TASKS} select distinct string_split(path, '/')[1] as md5 from o",
    "dedup_decision": f"""with {_TASKS}, k as (select md5, max(status) as status, max(kb_id) as kb_id from t where status <> 'pending' group by md5), a as (select distinct string_split(path, '/')[1] as md5 from o),
        d as (select md5(text) as md5, max(case when lang = 'de' then 'kb-new' end) as kb_id from documents group by 1)
        select d.md5, d.kb_id, case when k.md5 is null then 'new' when status = 'parsed' and a.md5 is not null then 'skip' else 'reset' end as decision, coalesce(d.kb_id, k.kb_id) as task_kb from d left join k on k.md5 = d.md5 left join a on a.md5 = d.md5""",
    "folder_decision": f"""with {_TASKS}, k as (select md5, max(status) as status from t group by md5), a as (select distinct string_split(path, '/')[1] as md5 from o)
        select case when status = 'pending' or (status = 'parsed' and a.md5 is not null) then 'skip' else 'reset' end as decision, count(*) as n from k left join a on a.md5 = k.md5 group by 1""",
    "batch_sizes": "with b as (select source as quota_day, lang as key, length(text) as pages, ((row_number() over (partition by source, lang order by length(text) desc, doc_id::varchar) - 1) // 10)::int as batch from documents) select quota_day, key, batch, count(*) as n, sum(pages)::bigint as pages from b group by all",
    "quota_alloc": """with recursive f as (select *, row_number() over (partition by d order by pages desc, md5) as r from (select source as d, doc_id::varchar as md5, length(text) // 100 + 1 as pages from documents)),
        a as (select distinct d, 0::bigint as r, '' as md5, 0::bigint as pages, 1000::bigint as one, 1000::bigint as two, null::varchar as key from f
              union all select d, r, md5, pages, case when pick = 'key-a' then one - pages else one end, case when pick = 'key-b' then two - pages else two end, pick
              from (select f.*, one, two, case when one >= f.pages and (two < f.pages or one <= two) then 'key-a' when two >= f.pages then 'key-b' end as pick from a join f on f.d = a.d and f.r = a.r + 1))
        select d as quota_day, md5, pages, key, ((row_number() over (partition by d, key order by pages desc, md5) - 1) // 10)::int as batch from a where r > 0 and key is not null""",
    "quota_report": "with u as (select source as day, lang as key, sum(length(text) // 100)::bigint as used from documents group by all) select day, key, used, greatest(0, 1000 - used)::bigint as remaining, greatest(0, 1000 - used) < 1 as exhausted from u",
    "ledger_backfill": _BACKFILL,
    "catalogue_backfill": _BACKFILL,
    "status_counts": f"with {_TASKS}, n as (select unnest(range(6))::int as place, unnest(['pending', 'processing', 'parsed', 'indexing', 'ready', 'failed']) as status) select place, n.status, count(t.id) as n from n left join t on t.status = n.status group by all",
    "consistency": f"with {_TASKS} select id, md5, md5 not in (select string_split(path, '/')[1] from o where path like '%/full.md') as lost, created_at from t where status = 'parsed'",
    "orphan_adoption": "select case when lang <> 'es' then source else 'default' end as kb_id, count(*) as n from documents group by 1",
    "step_fold": f"with {_STEPS_SQL} select * from st",
    "retry_plan": f"""with {_STEPS_SQL}, f as (select doc_id as id, case when coalesce(upload, '') <> 'done' then 1 when coalesce(mineru, '') <> 'done' then 2 when coalesce(chunking, '') <> 'done' then 3 when coalesce(embedding, '') <> 'done' then 4 when coalesce(es_write, '') <> 'done' then 5 else 6 end as k from st)
        select id, ['upload', 'mineru', 'chunking', 'embedding', 'es_write', 'milvus'][k] as from_step, case when k <= 2 then 'pending' else 'parsed' end as new_status,
               array_to_string(list_transform(range(1, 7), lambda i: case when i >= k then 'pending' else 'done' end), ',') as new_steps from f""",
    "step_rollup": f"""with {_STEPS_SQL} select doc_id, case when 'failed' in (chunking, embedding, es_write) then 'failed' when 'running' in (chunking, embedding, es_write) then 'running' when chunking = 'done' and embedding = 'done' and es_write = 'done' then 'done' end as state
        from (select doc_id, coalesce(chunking, '') as chunking, coalesce(embedding, '') as embedding, coalesce(es_write, '') as es_write from st)""",
    "path_resolution": f"""with {_TASKS}, p as (select doc_id, md5(text) as md5 from documents), k as (select * from t where status = 'parsed'),
        w as (select doc_id::varchar as key from p union select md5 from p union select 'b' || (doc_id // 10) from p union select left(md5, 8) from p),
        x as (select w.key, arg_min(raw_path, id) as p from w join k on starts_with(k.md5, w.key) and length(w.key) < 32 group by 1),
        i as (select id::varchar as key, raw_path as p from k), m as (select md5 as key, arg_min(raw_path, id) as p from k group by 1), b as (select batch_id as key, arg_min(raw_path, id) as p from k group by 1),
        ob as (select string_split(path, '/')[1] as key, min(path) as p from o group by 1), pa as (select doc_id::varchar as key, ob.p from p join ob on ob.key = p.md5)
        select w.key, coalesce(i.p, m.p, x.p, b.p, ob.p, pa.p) as path, case when i.p is not null then 'by_id' when m.p is not null then 'by_md5' when x.p is not null then 'by_prefix' when b.p is not null then 'by_batch_id' when ob.p is not null then 'by_object' when pa.p is not null then 'by_paper' end as via
        from w left join i on i.key = w.key left join m on m.key = w.key left join x on x.key = w.key left join b on b.key = w.key left join ob on ob.key = w.key left join pa on pa.key = w.key""",
    "batch_failures": """with e as (select 'src' || user_id as batch_id, min(case event_type when 'error' then 'Token 过期: ' else 'HTTP 404 找不到任务 ' end || props) as error_msg from events where event_type in ('error', 'signup') group by 1)
        select source as batch_id, md5(text) as md5, 'failed' as status, error_msg from documents join e on e.batch_id = source""",
    "task_state": """with r as (select user_id || '-' || ts::date as md5, case event_type when 'purchase' then 'done' when 'error' then 'failed' else 'running' end as state, props, ts, event_id from events),
        f as (select md5, min(ts) as t0, max(ts) as last from r group by md5),
        z as (select md5, arg_min(state, (ts, event_id)) as state, arg_min(props, (ts, event_id)) as props, min(ts) as ts from r where state <> 'running' group by md5),
        j as (select f.md5, t0, last, z.state, z.props, z.ts, z.ts is not null and z.ts <= t0 + interval 6 hour as ok, last > t0 + interval 6 hour as over from f left join z on z.md5 = f.md5)
        select md5, case when ok and state = 'done' then 'parsed' when ok or over then 'failed' else 'processing' end as status, case when ok and state = 'failed' then props when not ok and over then 'timeout' end as error_msg, case when ok then ts when over then t0 + interval 6 hour else last end as at from j""",
    "changelog_fold": "with r as (select *, (user_id % 7)::varchar as kb_id from events where event_type <> 'signup'), l as (select kb_id, user_id as doc_id, max(event_id) as seq from r group by all) select l.kb_id, doc_id, seq, value, event_type from l join r on r.event_id = seq where event_type <> 'error'",
    "answer_fold": """with r as (select user_id as message_id, event_id, event_type, floor(value)::bigint as v, value from events),
        s as (select message_id, 'k' || (v % 3) as k, case when arg_max(value, event_id) > 50 then 'completed' else 'running' end as s from r where event_type = 'click' group by all),
        m as (select message_id, string_agg(k || '=' || s, ',' order by k) as steps from s group by 1)
        select r.message_id, coalesce(string_agg(v || ' ', '' order by event_id) filter (event_type in ('view', 'error')), '') as content, count(*) filter (event_type = 'purchase') as n_citations,
               case when count(*) filter (event_type = 'signup') > 0 then 'done' else 'streaming' end as status, any_value(steps) as steps from r left join m on m.message_id = r.message_id group by 1""",
}
