"""Retention as a stateful stream: each workspace keeps its newest events within an age, a number and a size of bytes."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = "workspace string, event_id long, ts timestamp, size long"
CHANGES = "workspace string, event_id long, ts long, size long, kept boolean"


def keep_newest(events: list[tuple[int, int, int]], horizon: tuple[int, int], newest: int, age: int, most: int, most_bytes: int) -> tuple[list[tuple[int, int, int]], tuple[int, int]]:
    """(kept, horizon) of distinct events (time, id, size): the newest ones within all limits, and the last event that was not.

    What follows an event in time only grows, so an event that has gone would go again whatever comes: nothing up to the
    horizon is looked at any more, and the result does not depend on the order in which events arrive.
    """
    kept, used = [], 0
    for at, number, size in sorted(set(events), reverse=True):
        used += size
        if (at, number) <= horizon or at < newest - age or len(kept) >= most or used > most_bytes:
            return kept, max(horizon, (at, number))
        kept.append((at, number, size))
    return kept, horizon


class Retention(StatefulProcessor):
    """A workspace's kept events, its horizon and its newest time. Gives out what came to be kept and what no longer is."""

    def __init__(self, age: int, most: int, most_bytes: int):
        self.age, self.most, self.most_bytes = age, most, most_bytes

    def init(self, handle) -> None:
        self.events = handle.getListState("events", "ts long, event_id long, size long")
        self.limits = handle.getValueState("limits", "ts long, event_id long, newest long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = [tuple(map(int, x)) for x in self.events.get()] if self.events.exists() else []
        at, number, newest = map(int, self.limits.get()) if self.limits.exists() else (-(1 << 62), -(1 << 62), -(1 << 62))
        events = list(before)
        for part in rows:
            events += zip(map(int, part["ts"]), map(int, part["event_id"]), map(int, part["size"]))
            newest = max(newest, *map(int, part["ts"]))
            # a group may come in many parts: no more than the limits is held between them
            events, (at, number) = keep_newest(events, (at, number), newest, self.age, self.most, self.most_bytes)
        self.events.put(events) if events else self.events.clear()
        self.limits.update((at, number, newest))
        was, now = set(before), set(events)
        changes = [(*x, True) for x in events if x not in was] + [(*x, False) for x in before if x not in now]
        yield pd.DataFrame({"workspace": [key[0]] * len(changes), "event_id": [x[1] for x in changes], "ts": [x[0] for x in changes], "size": [x[2] for x in changes], "kept": [x[3] for x in changes]})

    def close(self) -> None:
        pass


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str):
    """Settings for what is started inside; the caller's come back after."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def changes(events: DataFrame, age: str, most: int, most_bytes: int) -> DataFrame:
    """The stream of changes (workspace, event_id, ts in microseconds, size, kept) of a stream of events (COLUMNS)."""
    if most < 1 or most_bytes < 1:
        raise ValueError("limits are one or more")
    micros = int(pd.Timedelta(age) / pd.Timedelta(microseconds=1))
    rows = events.select("workspace", "event_id", F.unix_micros("ts").alias("ts"), "size")
    return rows.groupBy("workspace").transformWithStateInPandas(Retention(micros, most, most_bytes), CHANGES, "Append", "None")


def start(events: DataFrame, folder: str, age: str, most: int, most_bytes: int, partitions: int | None = None) -> StreamingQuery:
    """Runs the retention of a stream of events over all that is there, from where it stopped the last time.

    A batch's changes are one folder under its number; a batch that is run again writes the same folder again, so nothing counts
    twice. partitions: of the state, fixed by the first start.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    values = {"spark.sql.streaming.stateStore.providerClass": ROCKS}
    if partitions:
        values["spark.sql.shuffle.partitions"] = str(partitions)
    with settings(events.sparkSession, **values):
        out = changes(events, age, most, most_bytes).writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint")
        return out.foreachBatch(write).trigger(availableNow=True).start()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """(workspace, event_id, ts, size) of what is kept: what came to be kept and did not go. An event never comes back."""
    log = spark.read.schema(CHANGES).parquet(f"{folder}/changes")
    gone = log.filter("not kept").select("workspace", "event_id", "ts")
    return log.filter("kept").join(gone, ["workspace", "event_id", "ts"], "left_anti").select("workspace", "event_id", F.timestamp_micros("ts").alias("ts"), "size")


def retained_each(events: DataFrame, age: str, most: int, most_bytes: int) -> DataFrame:
    """The same of a table (COLUMNS): each limit holds for a prefix of a workspace's events, newest first."""
    newest_first = Window.partitionBy("workspace").orderBy(F.desc("ts"), F.desc("event_id"))
    run = events.distinct().withColumns({"_n": F.row_number().over(newest_first), "_used": F.sum("size").over(newest_first.rowsBetween(Window.unboundedPreceding, 0)), "_newest": F.max("ts").over(Window.partitionBy("workspace"))})
    young = F.unix_micros("ts") >= F.unix_micros("_newest") - int(pd.Timedelta(age) / pd.Timedelta(microseconds=1))
    return run.filter((F.col("_n") <= most) & (F.col("_used") <= most_bytes) & young).select(*events.columns)
