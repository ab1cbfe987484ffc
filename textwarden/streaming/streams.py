"""Structured Streaming forms of operators on events. Each runs over what is there and ends, so batch results hold for it."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs the stream until nothing is left, to Parquet in the folder (exactly once), and reads that.

    In update mode each trigger adds the changed rows, with its number in `batch`.
    """
    path = f"{folder}/out"
    to = stream.writeStream.option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        query = to.format("parquet").option("path", path).start()
    else:
        # A trigger that runs again writes its own part again: its folder is replaced.
        query = to.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")).start()
    query.awaitTermination()
    spark = stream.sparkSession
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(path)
    return spark.read.option("basePath", path).schema(stream.schema.add("batch", "long")).parquet(path)


def first_answers(stream: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """The first event (ts, event_id) of each key by time: the state holds one for each key, and the last trigger's word counts."""
    first = stream.groupBy(*keys).agg(F.min(F.struct("ts", "event_id")).alias("first"))
    rows = drained(first, folder, "update")
    return rows.groupBy(*keys).agg(F.max_by("first", "batch").alias("first")).select(*keys, F.col("first.event_id").alias("event_id"))


def counted(stream: DataFrame, keys: list[str], folder: str, size: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts of events by key and window of time; the watermark drops the state of windows that are over by `delay`."""
    counts = stream.withWatermark("ts", delay).groupBy(F.window("ts", size).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    rows = drained(counts.select(*keys, F.col("w.start").alias("start"), "n"), folder, "update")
    return rows.groupBy(*keys, "start").agg(F.max_by("n", "batch").alias("n"))


#: Keeps list states and timers; it writes to the checkpoint folder that the query is given.
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
Event = tuple[int, int, bool, bool]  # event_id, microseconds, failed, ok


def judge(events: list[Event], failures: list[int], limit: int, span: int) -> tuple[list[int], list[int]]:
    """Ids of the failures among events that are the limit-th or later within `span` up to them, and the times of failures that count from now on.

    failures: those that count so far. Events of one time are one step: a success clears what was before, then its failures count together.
    """
    out, held = [], sorted(failures)
    for at, group in groupby(sorted(events, key=lambda e: (e[1], e[0])), key=lambda e: e[1]):
        same = list(group)
        held = [] if any(e[3] for e in same) else [t for t in held if t > at - span]
        failed = [e[0] for e in same if e[2]]
        held += [at] * len(failed)
        if len(held) >= limit:
            out += failed
    return out, held


class Throttle(StatefulProcessor):
    """Of each user: the events that later ones may still come before, and the times of the failures that count.

    Events wait until the watermark has passed them and are then judged in the order of their times, so that the order of arrival doesn't matter; what
    comes later than that is dropped. A user's failures go with a success or when `span` is over, by a timer: users without recent
    failures hold no state, so the state is bounded by the events of `span` and of the watermark's delay.
    """

    def __init__(self, limit: int, span: int):
        self.limit, self.span = limit, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "event_id long, us long, failed boolean, ok boolean")
        self.failures = handle.getListState("failures", "us long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        new = [e for part in rows for e in zip(part["event_id"].tolist(), part["us"].tolist(), part["failed"].tolist(), part["ok"].tolist(), strict=True) if e[1] // 1000 > now]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(e[1] for e in new) // 1000)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = [tuple(e) for e in self.waiting.get()] if self.waiting.exists() else []
        failures = [t for (t,) in self.failures.get()] if self.failures.exists() else []
        blocked, failures = judge([e for e in waiting if e[1] // 1000 <= now], failures, self.limit, self.span)
        later = [e for e in waiting if e[1] // 1000 > now]
        failures = [t for t in failures if t > now * 1000 - self.span]
        for state, values, due in ((self.waiting, later, min((e[1] // 1000 for e in later), default=0)), (self.failures, [(t,) for t in failures], (max(failures, default=0) + self.span) // 1000 + 1)):
            if values:
                state.put(values)
                self.handle.registerTimer(due)
            else:
                state.clear()
        yield pd.DataFrame({"user_id": [key[0]] * len(blocked), "event_id": blocked}).astype("int64")

    def close(self) -> None:
        pass


def throttled(events: DataFrame, folder: str, limit: int, seconds: int, delay: str = "0 seconds") -> DataFrame:
    """user_id, event_id of the failures among events (user_id, event_id, ts, failed, ok) that are the limit-th or later of their user in the seconds
    up to them, since the last success. delay: how much later than others an event may arrive."""
    spark = events.sparkSession
    rows = events.withWatermark("ts", delay).select("user_id", "event_id", "ts", F.unix_micros("ts").alias("us"), "failed", "ok")
    blocked = rows.groupBy("user_id").transformWithStateInPandas(Throttle(limit, seconds * 1_000_000), "user_id long, event_id long", "append", "eventTime")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    try:
        return drained(blocked, folder)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def new_folder(spark: SparkSession) -> str:
    """A folder below spark.checkpoint.dir, which driver and executors share; a local one if all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "/tmp/textwarden-streams"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"
