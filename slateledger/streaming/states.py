"""Stateful streams: the state of every job with a deadline, and a training trigger that fires once at a time.

Both keep their state by key in the stream's own state store, so that a restart from the checkpoint goes on where the
stream stopped. What they keep of a key is of fixed size, and they don't depend on the order of a batch's rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from slateledger.shipping import ship
from slateledger.streaming.jobs import STATES

FINAL = ("complete", "failed")
STATE = "us long, status string, percent int, message string"  # times in microseconds
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ready(spark: SparkSession) -> None:
    """Executors get the package, and the session its stream manager, which finds state stores for batches, too."""
    ship(spark)
    _ = spark.streams.active


def further(a: tuple | None, b: tuple) -> tuple:
    """Of two states (time, status, percent, message) of a job the one that holds: the earliest final one; without such
    the latest, of equal times the further one."""
    if a is None:
        return b
    if (a[1] in FINAL) != (b[1] in FINAL):
        return a if a[1] in FINAL else b
    rank = lambda s: (s[0], STATES.index(s[1]), s[2] if s[2] is not None else -1, s[3] or "")
    return min(a, b, key=rank) if a[1] in FINAL else max(a, b, key=rank)


class JobStates(StatefulProcessor):
    """queued, processing, complete or failed by job; a job that stays unfinished for `limit` milliseconds of event time
    after its last event fails. States that aren't known are left out."""

    def __init__(self, limit: int | None):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = tuple(self.state.get()) if self.state.exists() else None
        new = held
        for r in rows:
            if r.status in STATES:
                new = further(new, (r.us, r.status, r.percent, r.message))
        if new is not None and new != held:
            self.state.update(new)
            yield self.row(key, new)
        if self.limit is not None and new is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if new[1] not in FINAL:
                self.handle.registerTimer(new[0] // 1000 + self.limit)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = tuple(self.state.get()) if self.state.exists() else None
        if held is not None and held[1] not in FINAL:
            new = (expiredTimerInfo.getExpiryTimeInMs() * 1000, "failed", held[2], "timed out")
            self.state.update(new)
            yield self.row(key, new)

    @staticmethod
    def row(key, s: tuple) -> Row:
        return Row(job_id=key[0], us=s[0], status=s[1], percent=s[2], message=s[3])

    def close(self) -> None:
        pass


def job_states(events: DataFrame, limit: int | None = None, late: str = "10 minutes") -> DataFrame:
    """events (job_id, ts, status, percent, message), batch or stream, to each job's state whenever it changes. With a
    limit (milliseconds, streams only) jobs that nothing is heard of fail when the watermark passes their deadline. Events
    without a time are left out."""
    ready(events.sparkSession)
    timed = limit is not None
    src = events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    src = src.withWatermark("ts", late) if timed else src
    got = src.where("us is not null").groupBy("job_id").transformWithState(JobStates(limit), f"job_id {events.schema['job_id'].dataType.simpleString()}, {STATE}", "Update", "EventTime" if timed else "None")
    return got.select("job_id", F.timestamp_micros("us").cast(events.schema["ts"].dataType).alias("ts"), "status", "percent", "message")


class Trigger(StatefulProcessor):
    """Counts files; at every multiple of `every` a training is due, which starts if none is running. A batch's ends of
    trainings come before its files; of several multiples in a batch the first one starts, the others find it running."""

    def __init__(self, every: int):
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("count", "files long, running boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before, running = tuple(self.state.get()) if self.state.exists() else (0, False)
        new, ended = 0, False
        for r in rows:
            new, ended = new + r.files, ended or r.ended
        running = running and not ended
        for at in range((before // self.every + 1) * self.every, before + new + 1, self.every):
            yield Row(name=key[0], count=at, started=not running)
            running = True
        self.state.update((before + new, running))

    def close(self) -> None:
        pass


def triggers(events: DataFrame, every: int = 5) -> DataFrame:
    """events (name, kind: file or done), batch or stream, to (name, count, started) at every `every`-th file of a
    training set. Each task adds up its own rows first, so that a set's counter gets a row a task, not a row a file."""
    ready(events.sparkSession)

    def added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, list] = {}
        for f in frames:
            for name, own in f.groupby("name", dropna=False):
                held = total.setdefault(name, [0, False])
                held[0] += int((own["kind"] == "file").sum())
                held[1] |= bool((own["kind"] == "done").any())
        if total:
            yield pd.DataFrame([(k, n, e) for k, (n, e) in total.items()], columns=["name", "files", "ended"])

    partial = events.select(F.col("name").cast("string").alias("name"), F.col("kind").cast("string").alias("kind")).mapInPandas(added, "name string, files long, ended boolean")
    return partial.groupBy("name").transformWithState(Trigger(every), "name string, count long, started boolean", "Update", "None")
