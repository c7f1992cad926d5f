"""Folds of event logs: the state of tasks, steps, documents and answers, each of a batch; their streams are in tasks and states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ["done", "failed"]


def task_states(events: DataFrame, timeout_s: int = 1200, now=None) -> DataFrame:
    """(md5, status, error_msg, at) from poll events (md5, state, err_msg, ts, seq): the batch twin of the stream.

    The first terminal event decides and later ones are ignored, but one later than timeout_s after the first event
    comes too late: the task has failed by timeout. Without a terminal event it is pending until now is that late.
    """
    first = F.min("ts")
    end = F.min(F.when(F.col("state").isin(TERMINAL), F.struct("ts", "seq", "state", "err_msg")))
    rows = events.groupBy("md5").agg(first.alias("t0"), end.alias("end"), F.max("ts").alias("last"))
    limit = F.col("t0") + F.make_dt_interval(secs=F.lit(timeout_s))
    in_time = F.col("end").isNotNull() & (F.col("end.ts") <= limit)
    late = ~in_time & (F.coalesce(F.lit(now).cast("timestamp"), F.col("last")) > limit)
    status = F.when(in_time & (F.col("end.state") == "done"), "parsed").when(in_time, "failed").when(late, "failed").otherwise("processing")
    error = F.when(in_time & (F.col("end.state") == "failed"), F.coalesce("end.err_msg", F.lit(""))).when(late, "timeout")
    return rows.select("md5", status.alias("status"), error.alias("error_msg"), F.when(in_time, F.col("end.ts")).when(late, limit).otherwise(F.col("last")).alias("at"))


def late_rows(events: DataFrame, delay_s: int) -> DataFrame:
    """(batch, n_late) of events (ts, batch): those of a micro-batch that are delay_s or more behind the latest before the one that it follows.

    Batches without such have no row. This is what a stream with that watermark drops: a watermark moves when a
    micro-batch ends, and holds for the rows of the one after the next.
    """
    latest = events.groupBy("batch").agg(F.max("ts").alias("ts"))  # a row a micro-batch
    before = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -2)
    marks = latest.select("batch", (F.max("ts").over(before) - F.make_dt_interval(secs=F.lit(delay_s))).alias("mark"))
    found = events.join(marks.hint("merge"), "batch").where(F.unix_millis("ts") <= F.unix_millis("mark"))
    return found.groupBy("batch").agg(F.count("*").alias("n_late"))


def step_states(events: DataFrame) -> DataFrame:
    """(doc_id, steps): the latest status of each step (doc_id, step, status, ts, seq) as a map."""
    latest = events.groupBy("doc_id", "step").agg(F.max_by(F.struct("status", "ts"), F.struct("ts", "seq")).alias("s"))
    return latest.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("step", "s")))).alias("steps"))


def documents(changes: DataFrame) -> DataFrame:
    """(kb_id, doc_id, doc, seq): the last update of each document (seq, kb_id, type, doc_id, doc) that no deletion follows."""
    last = changes.groupBy("kb_id", "doc_id").agg(F.max_by(F.struct("type", "doc", "seq"), "seq").alias("c"))
    return last.where("c.type = 'doc_update'").select("kb_id", "doc_id", "c.doc", "c.seq")


def answers(events: DataFrame) -> DataFrame:
    """(message_id, content, steps, n_citations, status) of answer events (message_id, seq, t, k, s, c, id, message).

    Texts join in order; of each step the last state counts, and a done one is completed; an error ends with its
    message, else a done event completes the answer, else it is still streaming.
    """
    rows = events.groupBy("message_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("t") == "text", F.struct("seq", "c")))), lambda x: F.coalesce(x["c"], F.lit(""))), "").alias("content"),
        F.count_if(F.col("t") == "cite").alias("n_citations"), F.max_by(F.when(F.col("t") == "error", F.col("message")), F.when(F.col("t") == "error", F.col("seq"))).alias("error"),
        F.count_if(F.col("t") == "error").alias("_errors"), F.count_if(F.col("t") == "done").alias("_done"),
    )
    steps = events.where("t = 'step'").groupBy("message_id", "k").agg(F.max_by("s", "seq").alias("s"))
    steps = steps.groupBy("message_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", F.when(F.col("s") == "done", "completed").otherwise(F.col("s")))))).alias("steps"))
    status = F.when(F.col("_errors") > 0, "error").when(F.col("_done") > 0, "done").otherwise("streaming")
    return rows.join(steps, "message_id", "left").select("message_id", "content", "steps", "n_citations", status.alias("status"), "error")


def for_subscribers(events: DataFrame) -> DataFrame:
    """Events that go out: those of a knowledge base; sinks partition by it."""
    return events.where("kb_id is not null")


#: Parts that the updates of one knowledge base are dealt to; each subscription meets them all.
SPREAD = 8


def delivered(updates: DataFrame, spans: DataFrame, piece_s: int = 60, late: str | None = None) -> DataFrame:
    """(session_id, kb_id, seq, ts, and the other columns of updates): each update to each session that listens then.

    updates: kb_id, seq, ts and others. spans: pieces (session_id, kb_id, from_ts, to_ts) of the times between a session's
    connection and its end, at most piece_s long and not over one another; a piece has from_ts and hasn't to_ts in it.
    On streams, late is how far either may be behind its watermark; rows then come once, and later ones are left out. An
    update of a knowledge base that very many follow makes as many rows, in SPREAD parts.
    """
    u = for_subscribers(updates).withColumn("_part", F.pmod(F.xxhash64("seq"), F.lit(SPREAD)).cast("int"))
    s = spans.where("kb_id is not null and session_id is not null and from_ts < to_ts").select("session_id", F.col("kb_id").alias("_kb"), "from_ts", "to_ts", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_in"))
    if late is not None:
        u, s = u.withWatermark("ts", late), s.withWatermark("to_ts", late)
    then = (F.col("ts") >= F.col("from_ts")) & (F.col("ts") < F.col("to_ts")) & (F.col("ts") >= F.col("to_ts") - F.make_dt_interval(secs=F.lit(piece_s)))
    both = u.join(s.hint("merge"), (F.col("kb_id") == F.col("_kb")) & (F.col("_part") == F.col("_in")) & then)
    return both.select("session_id", *updates.columns)
