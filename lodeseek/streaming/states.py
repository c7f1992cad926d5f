"""Folds of event logs as streams with state by key; each is, row by row, what its batch twin in folds gives."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.keyed_table import KeyedTable

#: at: microseconds, which compare alike wherever they come from.
STEPS = T.StructField("steps", T.MapType(T.StringType(), T.StructType([T.StructField("status", T.StringType()), T.StructField("at", T.LongType())])))
EVENT = "t string, k string, s string, c string, message string"
ANSWER = "n_citations bigint, status string, error string, next_seq bigint, timer bigint"


class StepState(StatefulProcessor):
    """The latest status of each step of a document, from a ledger that was there before and from events."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.steps = handle.getMapState("steps", "step string", "status string, at bigint, seq bigint")

    def _add(self, step: str, status: str, at: int, seq: int) -> bool:
        old = self.steps.getValue((step,)) if self.steps.containsKey((step,)) else None
        if old is not None and (old[1], old[2]) > (at, seq):
            return False
        self.steps.updateValue((step,), (status, at, seq))
        return True

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        for step, s in dict(initialState.steps or ()).items():
            self._add(step, s["status"], s["at"], -1)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if any([self._add(r.step, r.status, r.at, r.seq) for r in rows]):
            yield Row(doc_id=key[0], steps={k[0]: Row(status=v[0], at=v[1]) for k, v in sorted(self.steps.iterator())})

    def close(self) -> None:
        pass


def step_stream(events: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """A stream of (doc_id, steps), a row for each document whose steps changed in a micro-batch, as folds.step_states.

    events: (doc_id, step, status, ts, seq), in any order and repeated. ledger: (doc_id, steps) of what came before,
    which is the state that the stream starts from; at equal times the stream's event counts. Documents without events
    have no row: the ledger with the stream's rows in place of its own is the state of all.
    """
    out = T.StructType([events.schema["doc_id"], STEPS])
    before = None
    if ledger is not None:
        before = ledger.select("doc_id", F.transform_values("steps", lambda k, v: F.struct(v["status"].alias("status"), F.unix_micros(v["ts"]).alias("at"))).alias("steps")).groupBy("doc_id")
    rows = events.where("doc_id is not null and step is not null and ts is not null")
    rows = rows.select("doc_id", "step", "status", F.unix_micros("ts").alias("at"), F.col("seq").cast("long").alias("seq"))
    found = rows.groupBy("doc_id").transformWithState(StepState(), out, "Update", "None", before)
    return found.select("doc_id", F.transform_values("steps", lambda k, v: F.struct(v["status"].alias("status"), F.timestamp_micros(v["at"]).alias("ts"))).alias("steps"))


class ChangeState(StatefulProcessor):
    """The number of the last change of a document; a later one is passed on, an earlier one that comes late isn't."""

    def __init__(self, ttl_s: int):
        self.ttl_s = ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq bigint", self.ttl_s * 1000)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest = max(rows, key=lambda r: r.seq)
        if not self.last.exists() or newest.seq > self.last.get()[0]:
            self.last.update((newest.seq,))
            gone = newest.type != "doc_update"
            yield Row(kb_id=key[0], doc_id=key[1], seq=newest.seq, deleted=gone, doc=None if gone else newest.doc)

    def close(self) -> None:
        pass


def change_stream(changes: DataFrame, ttl_s: int = 7 * 86_400) -> DataFrame:
    """A stream of (kb_id, doc_id, seq, deleted, doc) from changes (seq, kb_id, type, doc_id, doc): at most one row for each
    document and micro-batch, its last change so far, as a tombstone without doc where that is a deletion.

    State is one number a document, kept for ttl_s after its last change; of events that come later than that, one that
    is older than the last change passes too. That time is the clock's, for which Spark runs micro-batches without data
    too; with a trigger that ends, turn off spark.sql.streaming.noDataMicroBatches.enabled.
    """
    out = T.StructType([changes.schema["kb_id"], changes.schema["doc_id"], T.StructField("seq", T.LongType()), T.StructField("deleted", T.BooleanType()), changes.schema["doc"]])
    rows = changes.where("doc_id is not null and seq is not null").withColumn("seq", F.col("seq").cast("long"))
    return rows.groupBy("kb_id", "doc_id").transformWithState(ChangeState(ttl_s), out, "Update", "ProcessingTime")


def keep_documents(table: KeyedTable):
    """A function for foreachBatch that applies a change_stream's micro-batches to a table by (kb_id, doc_id) with version seq.

    The table then has what folds.documents gives for all changes so far. A micro-batch that runs again changes nothing.
    """

    def apply(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        table.apply(batch.where("not deleted").drop("deleted"), batch.where("deleted").select("kb_id", "doc_id"))
        table.merge()
        batch.unpersist()

    return apply


class AnswerState(StatefulProcessor):
    """An answer as far as its events have come without a gap, and those beyond the gap; a timer ends the waiting."""

    def __init__(self, idle_s: int, first_seq: int):
        self.idle_ms, self.first_seq = idle_s * 1000, first_seq

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.answer = handle.getValueState("answer", ANSWER)
        self.texts = handle.getListState("texts", "c string")
        self.steps = handle.getMapState("steps", "k string", "s string")
        self.waiting = handle.getMapState("waiting", "seq bigint", EVENT)
        self.closed = handle.getValueState("closed", "at bigint")

    def _taken(self, a: dict, e: tuple) -> None:
        t, k, s, c, message = e
        if t == "text":
            self.texts.appendValue((c or "",))
        elif t == "step":
            if k is not None:
                self.steps.updateValue((k,), (s,))
        elif t == "cite":
            a["n_citations"] += 1
        elif t == "error":
            a["status"], a["error"] = "error", message
        elif t == "done" and a["status"] != "error":
            a["status"] = "done"

    def _row(self, key, a: dict, closed: bool) -> Row:
        steps = {k[0]: "completed" if v[0] == "done" else v[0] for k, v in sorted(self.steps.iterator())} or None
        return Row(message_id=key[0], content="".join(c for (c,) in self.texts.get()), steps=steps, n_citations=a["n_citations"], status=a["status"], error=a["error"], closed=closed)

    def _close(self, key, a: dict, at: int) -> Row:
        row = self._row(key, a, True)
        for state in (self.answer, self.texts, self.steps, self.waiting):
            state.clear()
        self.closed.update((at,))
        return row

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if self.closed.exists():
            return
        fresh = dict(n_citations=0, status="streaming", error=None, next_seq=self.first_seq, timer=None)
        a = dict(zip(fresh, self.answer.get(), strict=True)) if self.answer.exists() else fresh
        latest = 0
        for r in rows:
            latest = max(latest, int(r.ts.timestamp() * 1000))
            if r.seq >= a["next_seq"] and not self.waiting.containsKey((r.seq,)):
                self.waiting.updateValue((r.seq,), (r.t, r.k, r.s, r.c, r.message))
        while self.waiting.containsKey((a["next_seq"],)):
            self._taken(a, self.waiting.getValue((a["next_seq"],)))
            self.waiting.removeKey((a["next_seq"],))
            a["next_seq"] += 1
        until = latest + self.idle_ms
        if a["timer"] is None or until > a["timer"]:
            if a["timer"] is not None:
                self.handle.deleteTimer(a["timer"])
            self.handle.registerTimer(until)
            a["timer"] = until
        self.answer.update(tuple(a[c] for c in fresh))
        yield self._row(key, a, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """No event for a while: what waits is taken over the gaps, and the answer is closed."""
        if self.answer.exists():
            a = dict(zip(("n_citations", "status", "error", "next_seq", "timer"), self.answer.get(), strict=True))
            for _, e in sorted(self.waiting.iterator()):
                self._taken(a, e)
            yield self._close(key, a, a["timer"])

    def close(self) -> None:
        pass


def answer_stream(events: DataFrame, idle_s: int = 600, delay: str = "1 minute", first_seq: int = 0) -> DataFrame:
    """A stream of (message_id, content, steps, n_citations, status, error, closed), a row for each message that has events in
    a micro-batch, as folds.answers gives it for its events without a gap; and when none has come for idle_s (in event
    time, by ts) a last row with all that came, closed.

    events: (message_id, seq, ts, t, k, s, c, message), numbered from first_seq on, in any order and repeated. Events of
    closed messages, and such as are later than `delay` behind the watermark, are left out.
    """
    out = T.StructType([
        events.schema["message_id"], T.StructField("content", T.StringType()), T.StructField("steps", T.MapType(T.StringType(), T.StringType())),
        T.StructField("n_citations", T.LongType()), T.StructField("status", T.StringType()), T.StructField("error", T.StringType()), T.StructField("closed", T.BooleanType()),
    ])
    rows = events.select("message_id", F.col("seq").cast("long").alias("seq"), "ts", "t", "k", "s", "c", "message").where("message_id is not null and seq is not null and t is not null")
    return rows.withWatermark("ts", delay).groupBy("message_id").transformWithState(AnswerState(idle_s, first_seq), out, "Update", "EventTime")
