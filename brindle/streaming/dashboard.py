"""The dashboard's stream: buckets over a stream of events, a numbered frame for every change, and replay by cursor."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brindle.operators.audit import buckets
from brindle.sources import store


class Frames:
    """Frames in a folder, one file each, numbered without gaps; the oldest go beyond a number and a size.

    A frame is written once under its number, so a restarted stream finds the last one and goes on from it.
    """

    def __init__(self, spark: SparkSession, folder: str, most_frames: int = 64, most_bytes: int = 4 << 20):
        self.spark, self.folder, self.most_frames, self.most_bytes = spark, folder.rstrip("/"), most_frames, most_bytes

    def numbers(self) -> list[int]:
        fs, at = store.file_system(self.spark, self.folder)
        if not fs.exists(at):
            return []
        return sorted(int(m[1]) for s in fs.listStatus(at) if (m := re.fullmatch(r"frame-(\d+)", s.getPath().getName())))

    def read(self, number: int) -> dict:
        return json.loads(store.read_bytes(self.spark, f"{self.folder}/frame-{number:012d}"))

    def add(self, rows: list[tuple]) -> int | None:
        """The new frame's number, or None where nothing changed."""
        known = self.numbers()
        rows = [list(r) for r in rows]
        if known and self.read(known[-1])["rows"] == rows:
            return None
        number = known[-1] + 1 if known else 1
        store.write_new(self.spark, f"{self.folder}/frame-{number:012d}", json.dumps({"sequence": number, "rows": rows}).encode())
        self.trim()
        return number

    def trim(self) -> None:
        fs, _ = store.file_system(self.spark, self.folder)
        path = lambda n: self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/frame-{n:012d}")
        known = self.numbers()
        sizes = {n: fs.getFileStatus(path(n)).getLen() for n in known}
        while len(known) > 1 and (len(known) > self.most_frames or sum(sizes[n] for n in known) > self.most_bytes):
            fs.delete(path(known.pop(0)), False)

    def next(self, cursor: int | None) -> tuple[str | None, dict | None, int | None]:
        """(event, frame, cursor): the first frame after the cursor; `reset_required` with the newest where the way there is gone."""
        known = self.numbers()
        if not known:
            return None, None, cursor
        newest = known[-1]
        if cursor is None:
            return "snapshot", self.read(newest), newest
        if cursor > newest or cursor + 1 < known[0]:
            return "reset_required", self.read(newest), newest
        later = [n for n in known if n > cursor]
        return ("snapshot", self.read(later[0]), later[0]) if later else (None, None, cursor)


def bucket_stream(events: DataFrame, checkpoint: str, frames: Frames, keys: tuple[str, ...] = ("event_type",)) -> StreamingQuery:
    """Keeps buckets over a stream of events and adds a frame whenever they differ from the last one, also after a restart.

    The buckets are as many as there are kinds of events, so a batch is a few rows.
    """

    def emit(batch: DataFrame, batch_id: int) -> None:
        frames.add(sorted(map(tuple, batch.collect())))

    return buckets(events, keys).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(emit).trigger(availableNow=True).start()


def late_buckets(events: DataFrame, delay: str, width: str) -> DataFrame:
    """Extension: buckets by window of event time; what is later than the delay is left out."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events"))
