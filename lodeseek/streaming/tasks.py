"""The state of tasks as a stream, with a timer for those that never end."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .folds import TERMINAL

OUT = "md5 string, status string, error_msg string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class TaskState(StatefulProcessor):
    """One row when a task ends: parsed, failed, or failed by timeout; what comes after is ignored."""

    def __init__(self, timeout_s: int):
        self.timeout_s = timeout_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.status = handle.getValueState("status", "status string, deadline_ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "seq"])
        status, deadline = self.status.get() if self.status.exists() else (None, None)
        if status in ("parsed", "failed"):
            return
        if deadline is None:
            deadline = int(events["ts"].iloc[0].timestamp() * 1000) + self.timeout_s * 1000
            self.handle.registerTimer(deadline)
        for e in events.itertuples():
            if e.state in TERMINAL and int(e.ts.timestamp() * 1000) <= deadline:
                status = "parsed" if e.state == "done" else "failed"
                self.status.update((status, deadline))
                self.handle.deleteTimer(deadline)
                yield pd.DataFrame({"md5": [key[0]], "status": [status], "error_msg": [None if status == "parsed" else (e.err_msg or "")]})
                return
        self.status.update(("processing", deadline))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.status.exists() and self.status.get()[0] == "processing":
            self.status.update(("failed", self.status.get()[1]))
            yield pd.DataFrame({"md5": [key[0]], "status": ["failed"], "error_msg": ["timeout"]})

    def close(self) -> None:
        pass


def task_state_stream(events: DataFrame, timeout_s: int = 1200, delay: str = "10 minutes") -> DataFrame:
    """A stream of (md5, status, error_msg) from one of poll events (md5, state, err_msg, ts, seq).

    Timers run in event time behind a watermark; events later than `delay` behind it are dropped, and LateRows counts them. Needs the RocksDB
    state store (spark.sql.streaming.stateStore.providerClass).
    """
    marked = events.withWatermark("ts", delay)
    marked = marked.dropDuplicatesWithinWatermark(["md5", "seq"])
    return marked.groupBy("md5").transformWithStateInPandas(TaskState(timeout_s), OUT, "Update", "eventTime")


class LateRows(StreamingQueryListener):
    """Counts the rows that streams drop because they are behind the watermark; for spark.streams.addListener."""

    def __init__(self):
        self.counts: list[tuple[str, int, str, int]] = []
        self._upto: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        for o in p.stateOperators:
            if o.numRowsDroppedByWatermark:
                self.counts.append((str(p.id), p.batchId, o.operatorName, o.numRowsDroppedByWatermark))
        self._upto[str(p.runId)] = max(p.batchId, self._upto.get(str(p.runId), -1))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def upto(self, run: str) -> int:
        """The last micro-batch of a run that was told of; -1 if none was."""
        return self._upto.get(run, -1)

    def table(self, spark: SparkSession) -> DataFrame:
        """(query, batch, operator, n_late): a row for each micro-batch and operator that dropped any."""
        return spark.createDataFrame(self.counts, "query string, batch bigint, operator string, n_late bigint")


def deadline(first: dt.datetime, timeout_s: int = 1200) -> dt.datetime:
    return first + dt.timedelta(seconds=timeout_s)
