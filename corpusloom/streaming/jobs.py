"""Structured Streaming: job state from an event stream, watermarked windows, watched folders, and control of running work."""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import UTC, date, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from corpusloom.operators.jobs import EVENT

EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Events as they arrive as Parquet files in a folder."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def tumbling(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; events later than the watermark are dropped."""
    w = F.window("ts", width).alias("w")
    counts = events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    w = F.session_window("ts", gap).alias("w")
    return events.withWatermark("ts", late).groupBy(w, "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def file_states(events: DataFrame) -> DataFrame:
    """The state of each file by its last event: an aggregation whose state is one row a file."""
    last = F.struct("ts", "event_id")
    return events.groupBy("user_id").agg(F.max_by("event_type", last).alias("status"), F.max(last).alias("at"), F.count("*").alias("events"), F.sum("value").alias("seconds"))


def fold_into(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keep the states of all files in a Parquet table: each micro-batch's states replace those of its files.

    A batch writes a new version beside the old one and is found by its number, so a repeated batch changes nothing.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return file_states(events).writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folded(spark: SparkSession, target: str) -> DataFrame:
    """The latest state of every file from the table that fold_into() keeps."""
    rows = spark.read.parquet(target)
    return rows.groupBy("user_id").agg(F.max_by(F.struct("status", "events", "seconds"), "batch").alias("s")).select("user_id", "s.*")


def watch_folder(spark: SparkSession, folder: str, handle: Callable[[DataFrame, int], None], checkpoint: str, pattern: str = "*") -> StreamingQuery:
    """Hand new files (path, modificationTime, length, content) of a folder to handle, one batch at a time; each file once."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# -- events of jobs: append, subscribe, state


def append_events(events: DataFrame, folder: str) -> None:
    """Add events (operators.jobs.EVENT) to a folder that subscribers read; a batch is seen whole or not at all."""
    events.write.mode("append").parquet(folder)


def job_events(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Events of jobs as they are appended."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def subscribe(spark: SparkSession, folder: str, handle: Callable[[DataFrame, int], None], checkpoint: str, since: int = -1) -> StreamingQuery:
    """Hand a subscriber the events after since, first those that are there, then new ones.  A handler that fails stops nobody else."""

    def safely(batch: DataFrame, number: int) -> None:
        try:
            handle(batch.filter(F.col("seq") > since).orderBy("job", "seq"), number)
        except Exception as failure:  # a subscriber's own fault
            logging.getLogger(__name__).warning("subscriber failed on batch %s: %s", number, failure)

    return job_events(spark, folder).writeStream.foreachBatch(safely).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


STATE = "job string, index int, status string, reason string, seconds double, pages int, engine string, changes long"


def _applied(state: dict, event) -> dict:
    """A file's state after one more event."""
    kind = event.type
    if kind == "file_started":
        state.update(status="running", pages=int(event.pages) if pd.notna(event.pages) else 0)
    elif kind == "page_done":
        state.update(engine=event.engine if isinstance(event.engine, str) else state["engine"], changes=state["changes"] + (int(event.changes) if pd.notna(event.changes) else 0))
    elif kind == "file_done":
        told = event.reason if isinstance(event.reason, str) and event.reason else None
        state["reason"] = told or (None if event.status == "ok" else state["reason"])
        if isinstance(event.status, str):
            state["status"] = event.status
        if pd.notna(event.seconds):
            state["seconds"] = round(float(event.seconds), 2)
    return state


def state_stream(events: DataFrame) -> DataFrame:
    """The state of every file after each batch of its events, as operators.jobs.file_states() has it for all events.

    Events of a batch are applied by seq; what arrives in a later batch comes after what came before.
    """
    fields = ("status", "reason", "seconds", "pages", "engine", "changes")

    def step(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = dict(zip(fields, held.get, strict=True)) if held.exists else {"status": "queued", "reason": None, "seconds": None, "pages": None, "engine": None, "changes": 0}
        rows = pd.concat(list(parts)).sort_values("seq")
        for event in rows.itertuples():
            state = _applied(state, event)
        held.update(tuple(state[f] for f in fields))
        yield pd.DataFrame([(*key, *(state[f] for f in fields))], columns=["job", "index", *fields])

    kept = STATE.split(", ", 2)[2]
    return events.filter("index is not null").groupBy("job", "index").applyInPandasWithState(step, STATE, kept, "update", "NoTimeout")


# -- watched folders, several of them


@dataclass
class Sync:
    """A folder that is watched: what happens with its new files, and whether it is on."""

    folder: str
    handle: Callable[[DataFrame, int], None]
    checkpoint: str
    pattern: str = "*"
    enabled: bool = True


class Syncs:
    """Watched folders by name.  A folder's batches run one after the other; its files are handed over once, also after a restart."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.listed: dict[str, Sync] = {}
        self.running: dict[str, StreamingQuery] = {}
        self.runs: list[tuple[str, datetime, int]] = []

    def put(self, name: str, sync: Sync) -> None:
        """Add a folder, or change one in place: it is stopped, and started again if it is enabled and was running."""
        was_running = name in self.running
        self.stop(name)
        self.listed[name] = sync
        if was_running and sync.enabled:
            self.start(name)

    def remove(self, name: str) -> None:
        self.stop(name)
        self.listed.pop(name, None)

    def start(self, name: str) -> None:
        sync = self.listed[name]
        query = self.running.get(name)
        if sync.enabled and not (query and query.isActive):
            self.running[name] = watch_folder(self.spark, sync.folder, self._recorded(name, sync.handle), sync.checkpoint, sync.pattern)

    def _recorded(self, name: str, handle: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        def run(batch: DataFrame, number: int) -> None:
            handle(batch, number)
            self.runs.append((name, datetime.now(UTC), batch.count()))

        return run

    def start_all(self) -> None:
        for name in self.listed:
            self.start(name)

    def wait(self) -> None:
        for query in list(self.running.values()):
            query.awaitTermination()

    def stop(self, name: str) -> None:
        query = self.running.pop(name, None)
        if query and query.isActive:
            query.stop()

    def stop_all(self) -> None:
        for name in list(self.running):
            self.stop(name)

    def counts(self, day: date | None = None) -> dict[str, int]:
        """Files handed over by folder, all of them or those of a day."""
        out: dict[str, int] = {}
        for name, at, n in self.runs:
            if day is None or at.date() == day:
                out[name] = out.get(name, 0) + n
        return out


# -- control of running work


class Cancelled(Exception):
    """The work was cancelled."""


class Control:
    """Pause, resume and cancel work that runs in steps; cancelling also interrupts the Spark jobs of the step."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.tag = spark, f"work-{name}"
        self._go, self._cancelled = threading.Event(), threading.Event()
        self._go.set()
        self.skipped: set[object] = set()

    def pause(self) -> None:
        self._go.clear()

    def resume(self) -> None:
        self._go.set()

    def cancel(self) -> None:
        self._cancelled.set()
        self._go.set()
        self.spark.interruptTag(self.tag)

    def skip(self, step: object) -> None:
        """Leave one step out that has not begun."""
        self.skipped.add(step)

    def run(self, steps: dict[object, Callable[[], object]]) -> dict[object, tuple[str, object]]:
        """Outcome of each step: ('ok', result), ('failed', error) or ('cancelled', None); a failed step stops no other."""
        out: dict[object, tuple[str, object]] = {}
        self.spark.addTag(self.tag)
        try:
            for name, step in steps.items():
                self._go.wait()
                if self._cancelled.is_set() or name in self.skipped:
                    out[name] = ("cancelled", None)
                    continue
                try:
                    out[name] = ("ok", step())
                except Exception as failure:
                    out[name] = ("cancelled", None) if self._cancelled.is_set() else ("failed", failure)
        finally:
            self.spark.removeTag(self.tag)
        return out


class Remembered:
    """A value that is computed again when it is older than so many seconds."""

    def __init__(self, compute: Callable[[], object], seconds: float, clock: Callable[[], float] = time.monotonic):
        self.compute, self.seconds, self.clock = compute, seconds, clock
        self._held: tuple[float, object] | None = None
        self._lock = threading.Lock()

    def get(self) -> object:
        with self._lock:
            now = self.clock()
            if self._held is None or now - self._held[0] >= self.seconds:
                self._held = (now, self.compute())
            return self._held[1]

    def forget(self) -> None:
        self._held = None


class Spans:
    """Times of nested stretches of a run, as rows (source, span, parent, name, ms) for operators.summaries."""

    def __init__(self, source: str, clock: Callable[[], float] = time.perf_counter):
        self.source, self.clock = source, clock
        self.rows: list[tuple[str, int, int | None, str, float]] = []
        self._open: list[int] = []
        self._next = 0

    @contextmanager
    def span(self, name: str) -> Iterator[None]:
        mine, parent, began = self._next, self._open[-1] if self._open else None, self.clock()
        self._next += 1
        self._open.append(mine)
        try:
            yield
        finally:
            self._open.pop()
            self.rows.append((self.source, mine, parent, name, (self.clock() - began) * 1000.0))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "source string, span long, parent long, name string, ms double")
