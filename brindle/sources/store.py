"""Tables that are written and read again: staged steps of a query, keyed generations, and the pointer to the current one."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where a local session has none (tests), a folder of our own."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "brindle-shared")
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


def write_new(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a file that must not be there yet: first under a name of its own, then renamed, so no reader sees part of it."""
    fs, at = file_system(spark, path)
    own = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    if fs.exists(at):
        raise FileExistsError(path)
    out = fs.create(own, False)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    if fs.exists(at) or not fs.rename(own, at):
        fs.delete(own, False)
        raise FileExistsError(path)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    fs, at = file_system(spark, path)
    stream = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


class Busy(RuntimeError):
    """Another writer holds the store."""


class Store:
    """Generations of tables below one root, per workspace: written aside, counted, then made current by one small file.

    Pointers are numbered files that are never overwritten; the highest whole one is current. So a reader sees the old or the new generation, and a
    writer that dies leaves at most a folder that nothing points to. One writer at a time: the holder's name is in a lock
    file that is made only where none is.
    """

    def __init__(self, spark: SparkSession, root: str, workspace: str):
        if not re.fullmatch(r"[A-Za-z0-9_-]{1,128}", workspace):
            raise ValueError("a workspace is named by letters, digits, - and _")
        self.spark, self.root = spark, f"{root.rstrip('/')}/workspace={workspace}"

    def lock(self, holder: str) -> None:
        try:
            write_new(self.spark, f"{self.root}/writer.lock", holder.encode())
        except FileExistsError:
            raise Busy(read_bytes(self.spark, f"{self.root}/writer.lock").decode()) from None

    def unlock(self) -> None:
        fs, at = file_system(self.spark, f"{self.root}/writer.lock")
        fs.delete(at, False)

    def pointers(self) -> list[int]:
        fs, at = file_system(self.spark, f"{self.root}/current")
        if not fs.exists(at):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit())

    def current(self) -> str | None:
        """The snapshot id of the current generation."""
        known = self.pointers()
        return read_bytes(self.spark, f"{self.root}/current/{known[-1]}").decode() if known else None

    def promote(self, snapshot: str, tables: dict[str, DataFrame | Callable], holder: str = "promote", partitioned: dict[str, list[str]] | None = None) -> None:
        """Write the tables as a generation and make it current. Rows are counted while they are written, and again as they lie there, before the pointer moves.

        A table may be a function of a reader of those written before it. partitioned: the columns by which a table's files lie in folders.
        """
        if not re.fullmatch(r"[A-Za-z0-9:_-]{1,128}", snapshot):
            raise ValueError("malformed snapshot id")
        self.lock(holder)
        try:
            folder = f"{self.root}/generations/{snapshot.replace(':', '_')}-{uuid.uuid4().hex}"
            for name, df in tables.items():
                if not isinstance(df, DataFrame):
                    df = df(lambda t: self.spark.read.parquet(f"{folder}/{t}"))
                seen = Observation()
                df.observe(seen, F.count(F.lit(1)).alias("n")).write.partitionBy(*(partitioned or {}).get(name, [])).parquet(f"{folder}/{name}")
                if self.spark.read.schema(df.schema).parquet(f"{folder}/{name}").count() != seen.get["n"]:
                    raise RuntimeError(f"the table {name} changed while it was written")
            known = self.pointers()
            write_new(self.spark, f"{self.root}/current/{known[-1] + 1 if known else 1}", f"{snapshot}\n{folder}".encode())
        finally:
            self.unlock()

    def read(self, name: str, snapshot: str | None = None) -> DataFrame:
        """A table of the current generation; a snapshot id that is not the current one is stale."""
        known = self.current()
        if known is None:
            raise FileNotFoundError(f"no generation of {self.root}")
        have, folder = known.split("\n")
        if snapshot is not None and snapshot != have:
            raise ValueError("stale snapshot")
        return self.spark.read.parquet(f"{folder}/{name}")

    def verify(self) -> bool:
        """Whether the pointer names a generation that is there."""
        known = self.current()
        return known is None or ("\n" in known and exists(self.spark, known.split("\n")[1]))

    def purge(self, holder: str = "purge") -> bool:
        """Delete this workspace and no other; whether there was one."""
        if not exists(self.spark, self.root):
            return False
        self.lock(holder)
        fs, at = file_system(self.spark, self.root)
        return fs.delete(at, True)


def export_handoff(spark: SparkSession, packet_json: str, folder: str, name: str) -> dict:
    """Write a packet's canonical bytes to a new file; a receipt with its size and hash. Never overwrites."""
    data = packet_json.encode()
    write_new(spark, f"{folder.rstrip('/')}/{name}.json", data)
    row = spark.range(1).select(F.sha2(F.lit(data), 256).alias("h")).first()
    return {"path": f"{folder.rstrip('/')}/{name}.json", "bytes": len(data), "sha256": row["h"]}
