"""Reports over conversations, knowledge bases and users, for all of them at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cut, present
from .ranking import top_k

# Sizes of pages and windows.
CONVERSATIONS, DOCUMENTS, MOST_MESSAGES, ANSWER_HISTORY, REWRITE_HISTORY, REWRITE_CHARS, TITLE_CHARS, RENAMED_CHARS = 50, 200, 200, 20, 4, 300, 30, 50
DEFAULT_TITLE = "新对话"


def conversation_list(conversations: DataFrame, messages: DataFrame, most: int = CONVERSATIONS) -> DataFrame:
    """Each user's newest conversations (conv_id, user_id, updated_at) with their number of messages."""
    n = messages.groupBy("conv_id").agg(F.count("*").alias("n_messages"))
    rows = top_k(conversations, most, ("user_id",), [F.desc("updated_at"), F.asc("conv_id")])
    return rows.join(n, "conv_id", "left").withColumn("n_messages", F.coalesce("n_messages", F.lit(0)))


def message_page(messages: DataFrame, cursors: DataFrame, n: int = 50) -> DataFrame:
    """The newest n messages (conv_id, ord, created_at) of each conversation before its cursor (conv_id, before), ascending by place.

    A cursor that is no timestamp is as none; n is held between 1 and MOST_MESSAGES.
    """
    n = min(max(n, 1), MOST_MESSAGES)
    rows = messages.join(cursors.select("conv_id", F.try_to_timestamp("before").alias("_before")), "conv_id", "left")
    rows = rows.where(F.col("_before").isNull() | (F.col("created_at") < F.col("_before"))).drop("_before")
    newest = top_k(rows, n, ("conv_id",), [F.desc("created_at"), F.desc("ord")], "_back")
    return newest.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("_back")))).drop("_back")


def history_windows(messages: DataFrame) -> DataFrame:
    """messages (conv_id, ord, role, content) with n_history and rewrite_history, both without the message itself.

    The answer sees up to 20 before it; the rewrite the last 4, each cut to 300 characters behind its role.
    """
    by_ord = Window.partitionBy("conv_id").orderBy("ord")
    line = F.concat("role", F.lit(": "), F.substring("content", 1, REWRITE_CHARS))
    few = F.collect_list(F.struct("ord", line.alias("line"))).over(by_ord.rowsBetween(-REWRITE_HISTORY, -1))
    return messages.withColumns({
        "n_history": F.count("*").over(by_ord.rowsBetween(-ANSWER_HISTORY, -1)),
        "history": F.collect_list(F.struct("role", "content")).over(by_ord.rowsBetween(-ANSWER_HISTORY, -1)),
        "rewrite_history": F.array_join(F.transform(F.array_sort(few), lambda x: x["line"]), "\n"),
    })


def kb_overview(bases: DataFrame, tasks: DataFrame) -> DataFrame:
    """bases (kb_id, created_at) with doc_count and has_ready_docs, which counts parsed tasks."""
    n = tasks.groupBy("kb_id").agg(F.count("*").alias("doc_count"), (F.count_if(F.col("status") == "parsed") > 0).alias("has_ready_docs"))
    out = bases.join(n, "kb_id", "left")
    return out.withColumns({"doc_count": F.coalesce("doc_count", F.lit(0)), "has_ready_docs": F.coalesce("has_ready_docs", F.lit(False))})


def kb_documents(tasks: DataFrame, most: int = DOCUMENTS) -> DataFrame:
    """The newest tasks of each knowledge base."""
    return top_k(tasks.where("kb_id is not null"), most, ("kb_id",), [F.desc("created_at"), F.asc("id")])


def user_list(users: DataFrame) -> DataFrame:
    return users.orderBy("created_at", "id")


def taken_names(new: DataFrame, existing: DataFrame, name: str) -> DataFrame:
    """(name, n, exists): names of new rows that repeat among themselves or exist already."""
    there = existing.select(name).distinct().withColumn("exists", F.lit(True))
    rows = new.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n")).join(there, name, "left")
    return rows.withColumn("exists", F.coalesce("exists", F.lit(False))).where("n > 1 or exists")


def without_users(users: DataFrame, conversations: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What stays when users (id) are deleted: their conversations go, and with these their messages."""
    ids = gone.select(F.col("id").alias("user_id")).distinct()
    kept = conversations.join(ids, "user_id", "left_anti")
    lost = conversations.join(ids, "user_id", "left_semi").select("conv_id").distinct()
    return users.join(ids.withColumnRenamed("user_id", "id"), "id", "left_anti"), kept, messages.join(lost, "conv_id", "left_anti")


def without_bases(tasks: DataFrame, gone: DataFrame) -> DataFrame:
    """tasks, with no knowledge base where theirs (kb_id) is deleted."""
    ids = gone.select("kb_id").distinct().withColumn("_gone", F.lit(True))
    return tasks.join(ids, "kb_id", "left").withColumn("kb_id", F.when(F.col("_gone").isNull(), F.col("kb_id"))).drop("_gone").select(*tasks.columns)


def first_title(text: Column) -> Column:
    return cut(text, TITLE_CHARS)


def renamed_title(text: Column) -> Column:
    return F.coalesce(present(F.substring(F.trim(text), 1, RENAMED_CHARS)), F.lit(DEFAULT_TITLE))


def lookup(tasks: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    return tasks.join(wanted.select(key).distinct(), key, "left_semi")
