"""The ledger of document tasks: de-duplication, quotas, back-fill, consistency, retries and paths."""

from __future__ import annotations

from bisect import bisect_left, insort
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import present

# States in their order of display, steps in their order, and limits of the external service.
STATUSES = ["pending", "processing", "parsed", "indexing", "ready", "failed"]
STEPS = ["upload", "mineru", "chunking", "embedding", "es_write", "milvus"]
INDEX_STEPS = ["chunking", "embedding", "es_write", "milvus"]
PAGES_A_DAY, FILES_A_BATCH = 1000, 10
DEFAULT_TITLE, PRELOADED = "文献-", "preloaded/"


def decisions(files: DataFrame, ledger: DataFrame, assets: DataFrame, skip_processing: bool = False) -> DataFrame:
    """files (md5, kb_id) with decision new, skip or reset, and the knowledge base the task gets.

    A parsed task whose asset is there is skipped, and with skip_processing one that is under way too; identical files
    of one run are one.
    """
    known = ledger.select("md5", "status", F.col("kb_id").alias("_kb"))
    there = assets.select("md5").distinct().withColumn("_asset", F.lit(True))
    rows = files.dropDuplicates(["md5"]).join(known, "md5", "left").join(there, "md5", "left")
    skip = F.col("status").isin("parsed", "ready") & F.coalesce("_asset", F.lit(False))
    if skip_processing:
        skip = skip | (F.col("status") == "processing")
    out = rows.withColumn("decision", F.when(F.col("status").isNull(), "new").when(skip, "skip").otherwise("reset"))
    return out.select(*files.columns, "decision", F.coalesce("kb_id", "_kb").alias("task_kb"))


def allocate(files: DataFrame, keys: DataFrame, by: str = "quota_day") -> DataFrame:
    """(by, md5, pages, key): best fit of files to keys, each day or tenant on its own.

    Files in descending order of pages get the key with the least sufficient remainder, the first on ties, or null.
    Of files with equal pages those that get a key come first by md5, and no more than the day's whole remainder
    divided by their pages: only so many are gathered to be fitted, the others get null. A file of less than a page counts
    as one of one page; files of unknown pages get null.
    """
    kind = files.schema[by].dataType.simpleString()
    totals = keys.groupBy(F.col(by).alias("_by")).agg(F.sum(F.greatest("remaining", F.lit(0))).alias("_total"))
    order = F.struct(F.col("md5").isNull(), "md5")
    rows = files.select(by, "md5", F.when(F.col("pages") < 1, 1).otherwise(F.col("pages")).cast("bigint").alias("pages"))
    able = rows.join(totals.hint("merge"), F.col(by).eqNullSafe(F.col("_by"))).where("pages <= _total").withColumn("_salt", F.pmod(F.xxhash64("md5"), F.lit(64)))
    limit = F.floor(F.col("_total") / F.col("pages"))
    for spread in (["_salt"], []):  # first within 64 parts of a hot group, so that no task sorts the whole of it
        able = able.withColumn("_rank", F.rank().over(Window.partitionBy(by, "pages", *spread).orderBy(order))).where(F.col("_rank") <= limit)
    last = able.groupBy(F.col(by).alias("_by"), F.col("pages").alias("_pages")).agg(F.max(order).alias("_last"))
    beyond = F.col("_last").isNull() | (order > F.col("_last"))
    others = rows.join(last.hint("merge"), F.col(by).eqNullSafe(F.col("_by")) & (F.col("pages") == F.col("_pages")), "left").where(beyond)

    def fit(files: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        keys = keys.sort_values("key")
        names = list(keys["key"])
        left = sorted((int(r), i) for i, r in enumerate(keys["remaining"]))  # so the least sufficient is found by a search
        got = []
        files = files.sort_values(["pages", "md5"], ascending=[False, True])
        for n in files["pages"]:
            at = bisect_left(left, (int(n), -1))
            if at == len(left):
                got.append(None)
                continue
            r, i = left.pop(at)
            insort(left, (r - int(n), i))
            got.append(names[i])
        return files.assign(key=pd.Series(got, files.index, object))[[by, "md5", "pages", "key"]].astype({by: object, "md5": object})

    fitted = able.select(by, "md5", "pages").groupBy(by).cogroup(keys.select(F.col(by).alias("_by"), "key", "remaining").groupBy("_by")).applyInPandas(fit, f"{by} {kind}, md5 string, pages bigint, key string")
    return fitted.union(others.select(by, "md5", "pages", F.lit(None).cast("string").alias("key")))


def batches(allocated: DataFrame, by: str = "quota_day", size: int = FILES_A_BATCH) -> DataFrame:
    """allocated with batch: consecutive groups of files of one key."""
    order = Window.partitionBy(by, "key").orderBy(F.desc("pages"), "md5")
    return allocated.where("key is not null").withColumn("batch", F.floor((F.row_number().over(order) - 1) / size).cast("int"))


def quota_report(used: DataFrame, limit: int = PAGES_A_DAY) -> DataFrame:
    """(day, key, used, remaining, exhausted) from usage rows (day, key, pages); each day begins anew."""
    total = used.groupBy("day", "key").agg(F.sum("pages").alias("used"))
    left = F.greatest(F.lit(0), F.lit(limit) - F.col("used"))
    return total.select("day", "key", "used", left.alias("remaining"), (left < 1).alias("exhausted"))


def backfill(papers: DataFrame, tasks: DataFrame, objects: DataFrame) -> DataFrame:
    """New tasks (md5, doc_id, original_name, raw_path, has_pdf) for papers that have none.

    One for each md5, the first by doc_id; blank ids go; the first PDF of its folder is the path.
    """
    fresh = papers.where(present(F.trim("md5")).isNotNull()).join(tasks.select("md5"), "md5", "left_anti")
    first = fresh.groupBy("md5").agg(F.min_by(F.struct("doc_id", "title_cn"), "doc_id").alias("p")).select("md5", "p.*")
    pdfs = objects.where(F.lower("path").endswith(".pdf")).groupBy(F.split("path", "/")[0].alias("md5")).agg(F.min("path").alias("_path"))
    out = first.join(pdfs, "md5", "left")
    return out.select("md5", "doc_id", F.coalesce(present(F.col("title_cn")), F.concat(F.lit(DEFAULT_TITLE), F.col("doc_id").cast("string"))).alias("original_name"), F.coalesce("_path", F.concat(F.lit(PRELOADED), "md5")).alias("raw_path"), F.col("_path").isNotNull().alias("has_pdf"))


def status_counts(tasks: DataFrame) -> DataFrame:
    """(place, status, n): all states in order of display, 0 where there is no task."""
    names = tasks.sparkSession.createDataFrame([(i, s) for i, s in enumerate(STATUSES)], "place int, status string")
    counts = tasks.groupBy("status").agg(F.count("*").alias("n"))
    return F.broadcast(names).join(counts, "status", "left").select("place", "status", F.coalesce("n", F.lit(0)).alias("n"))


def consistency(tasks: DataFrame, objects: DataFrame) -> DataFrame:
    """Parsed tasks with lost: whether their full.md is missing."""
    texts = objects.where(F.col("path").endswith("/full.md")).select(F.split("path", "/")[0].alias("md5")).distinct().withColumn("_there", F.lit(True))
    return tasks.where("status in ('parsed', 'ready')").join(texts, "md5", "left").withColumn("lost", F.col("_there").isNull()).drop("_there")


def adopt(tasks: DataFrame, default_kb: str) -> DataFrame:
    return tasks.withColumn("kb_id", F.coalesce("kb_id", F.lit(default_kb)))


def retry_plan(tasks: DataFrame) -> DataFrame:
    """tasks (id, steps map of step to struct with status) with from_step, new_status and new_steps.

    The first step that isn't done and all later ones become pending; without such a step all three are null.
    """
    done = lambda s: F.coalesce(F.col("steps")[s]["status"] == "done", F.lit(False))
    order = F.array(*[F.lit(s) for s in STEPS])
    first = F.coalesce(*[F.when(~done(s), F.lit(s)) for s in STEPS])
    later = F.array_position(order, F.col("from_step"))
    steps = F.map_from_arrays(order, F.array(*[F.when(later <= i + 1, F.lit("pending")).otherwise(F.lit("done")) for i in range(len(STEPS))]))
    out = tasks.withColumn("from_step", first)
    return out.withColumn("new_status", F.when(F.col("from_step").isin("upload", "mineru"), "pending").when(F.col("from_step").isNotNull(), "parsed")).withColumn("new_steps", F.when(F.col("from_step").isNotNull(), steps))


def rolled_up(steps: Column) -> Column:
    """One state of the four indexing steps, or null."""
    states = F.array(*[steps[s]["status"] for s in INDEX_STEPS])
    some = lambda v: F.exists(states, lambda x: F.coalesce(x == v, F.lit(False)))
    return F.when(some("failed"), "failed").when(some("running"), "running").when(F.forall(states, lambda x: F.coalesce(x == "done", F.lit(False))), "done")


def resolve_paths(wanted: DataFrame, tasks: DataFrame, objects: DataFrame, papers: DataFrame) -> DataFrame:
    """(key, path, via): a task's raw path by id, md5, the beginning of its md5 or batch, else the first object below the key, else below the paper's md5.

    Of several tasks that a key fits the one with the least id counts.
    """
    first = lambda c: tasks.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("key")).agg(F.min_by("raw_path", "id").alias(f"by_{c}"))
    below = objects.groupBy(F.split("path", "/")[0].alias("key")).agg(F.min("path").alias("by_object"))
    via_paper = papers.select(F.col("doc_id").cast("string").alias("key"), "md5").join(below.select(F.col("key").alias("md5"), F.col("by_object").alias("by_paper")), "md5").groupBy("key").agg(F.min("by_paper").alias("by_paper"))
    out = wanted.select("key").distinct()
    lengths = [r[0] for r in out.select(F.length("key").alias("n")).where("n between 1 and 31").distinct().orderBy("n").collect()]  # at most 31
    begins = tasks.where("md5 is not null").select("id", "raw_path", F.explode(F.transform(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: F.substring("md5", F.lit(1), n))).alias("key"))
    begins = begins.groupBy("key").agg(F.min_by("raw_path", "id").alias("by_prefix"))
    ways = ["by_id", "by_md5", "by_prefix", "by_batch_id", "by_object", "by_paper"]
    for t in (first("id"), first("md5"), begins, first("batch_id"), below, via_paper):
        out = out.join(t.hint("merge"), "key", "left")
    return out.select("key", F.coalesce(*ways).alias("path"), F.coalesce(*[F.when(F.col(w).isNotNull(), F.lit(w)) for w in ways]).alias("via"))


# Parts of messages that say a batch can't be continued.
FATAL = ["找不到任务", "没有权限", "Token 错误", "Token 过期"]


def batch_failures(batches: DataFrame, errors: DataFrame) -> DataFrame:
    """(batch_id, md5, status, error_msg): a fatal error of a batch fails each of its documents, which are rows (batch_id, md5)."""
    is_fatal = reduce(lambda x, y: x | y, [F.col("message").contains(m) for m in FATAL])
    fatal = errors.where(is_fatal).groupBy("batch_id").agg(F.min("message").alias("error_msg"))
    return batches.select("batch_id", "md5").join(fatal.hint("merge"), "batch_id").withColumn("status", F.lit("failed")).select("batch_id", "md5", "status", "error_msg")
