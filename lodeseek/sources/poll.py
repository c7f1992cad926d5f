"""A stream of what a service says of batches of files, asked in rounds; for any client.

An offset is the number of a round. What a round asks for is noted when it is planned, and each group of batches is asked
by a task, which notes the answers in the shared folder before it passes them on. A round that is read again, after a
lost executor or a restart, gives the same rows without asking again.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "round bigint, batch_id string, data_id string, state string, err_msg string, at bigint"


class Client(Protocol):
    def batches(self) -> list[str]:
        """The batches that are under way."""

    def poll(self, batch_id: str) -> list[dict]:
        """What the service says of each file of a batch: data_id or file_name, state, err_msg."""


class Notes:
    """JSON files in a folder that all machines see, by any path that Arrow's file systems take."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.fs, self.path = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def read(self, name: str):
        try:
            with self.fs.open_input_stream(f"{self.path}/{name}") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def write(self, name: str, value) -> None:
        """In place when it is whole; of two that write the same note one stays."""
        draft = f"{self.path}/drafts-{time.monotonic_ns()}-{name.replace('/', '-')}"
        self.fs.create_dir(f"{self.path}/{name}".rsplit("/", 1)[0])
        with self.fs.open_output_stream(draft) as f:
            f.write(json.dumps(value).encode())
        self.fs.move(draft, f"{self.path}/{name}")

    def rounds(self) -> list[int]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(self.path, allow_not_found=True))
        return sorted(int(f.base_name) for f in found if f.type == fs.FileType.Directory and f.base_name.isdigit())

    def drop(self, number: int) -> None:
        self.fs.delete_dir(f"{self.path}/{number:010d}")


@dataclass
class Group(InputPartition):
    """Batches that one task asks for, in the rounds after `start` up to `end`."""

    number: int
    start: int
    end: int


class PollReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.path = dict(options), options["log"]
        self.group, self.interval = int(options.get("batchesPerTask", "20")), float(options.get("seconds", "5"))
        self.asked_at, self.number = 0.0, 0

    def _make(self) -> Client:
        module, name = self.options["client"].split(":")
        return getattr(importlib.import_module(module), name)(self.options)

    def initialOffset(self) -> dict:
        return {"round": 0}

    def latestOffset(self) -> dict:
        """The next round when the interval is over, and is planned with it: which batches it asks for."""
        notes = Notes(self.path)
        self.number = max([self.number, *notes.rounds()])
        if time.time() - self.asked_at >= self.interval:
            self.asked_at = time.time()
            batches = sorted(set(self._make().batches()))
            self.number += 1
            notes.write(f"{self.number:010d}/batches.json", [batches[i : i + self.group] for i in range(0, len(batches), self.group)])
        return {"round": self.number}

    def partitions(self, start: dict, end: dict) -> list[Group]:
        notes = Notes(self.path)
        rounds = range(start["round"] + 1, end["round"] + 1)
        most = max((len(notes.read(f"{r:010d}/batches.json") or []) for r in rounds), default=0)
        return [Group(i, start["round"], end["round"]) for i in range(most)]

    def read(self, partition: Group) -> Iterator[tuple]:
        notes, client = Notes(self.path), None
        for r in range(partition.start + 1, partition.end + 1):
            groups = notes.read(f"{r:010d}/batches.json") or []
            if partition.number >= len(groups):
                continue
            name = f"{r:010d}/group-{partition.number:06d}.json"
            rows = notes.read(name)
            if rows is None:
                client = client or self._make()
                now = int(time.time() * 1e6)
                rows = [[r, b, x.get("data_id") or x.get("file_name"), x.get("state"), x.get("err_msg"), now] for b in groups[partition.number] for x in client.poll(b)]
                notes.write(name, rows)
            yield from map(tuple, rows)

    def commit(self, end: dict) -> None:
        """Rounds before the last one that was read to its end are not read again."""
        notes = Notes(self.path)
        for r in notes.rounds():
            if r < end["round"]:
                notes.drop(r)


class PollSource(DataSource):
    """Options: client (`module:function` that makes a Client of all options, on any machine), log (a shared folder of this stream's own),
    batchesPerTask, seconds (between rounds at least)."""

    @classmethod
    def name(cls) -> str:
        return "poll"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> PollReader:
        return PollReader(self.options)


def polled(spark: SparkSession, client: str, log: str, **options: object) -> DataFrame:
    """A stream of (md5, state, err_msg, ts, seq, batch_id), as task_state_stream takes it; rows without an id or state go."""
    spark.dataSource.register(PollSource)
    rows = spark.readStream.format("poll").options(client=client, log=log, **options).load()
    rows = rows.where("data_id <> '' and state is not null")
    return rows.select(F.col("data_id").alias("md5"), "state", "err_msg", F.timestamp_micros("at").alias("ts"), F.col("round").alias("seq"), "batch_id")
