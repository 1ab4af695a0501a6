"""Shared pieces of the training-data operators: staging, text columns, hot keys, components."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A key with at least one in HOT_SHARE of all rows is hot: at most HOT_SHARE keys can be, at any size.
HOT_SHARE = 4096

#: Rows of two longs and little else that may be broadcast, some 60 MB of them; more rows are shuffled.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where a local session has none (tests), a folder of our own."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "brindle-shared")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage and survives lost executors.

    The finished write's shuffle files are then free to go, so the JVM is asked to collect them.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_at = path
    return staged


def discard(*staged: DataFrame) -> None:
    """Deletes what stage wrote, once nothing reads it any more."""
    for df in staged:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with as many underscores before it as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what one Arrow batch of whole texts can weigh."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def text_of(col: str | Column = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def remainder(col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % modulus


def keep_ids(rows: DataFrame, ids: DataFrame, id_col: str, n_ids: int | None = None) -> DataFrame:
    """Semi-join on an id: ids are broadcast up to BROADCAST_ROWS, else both sides are shuffled, without sorting texts."""
    n = ids.count() if n_ids is None else n_ids
    ids = ids.select(F.col(id_col).alias("_keep_id"))
    ids = F.broadcast(ids) if n <= BROADCAST_ROWS else ids.hint("shuffle_hash")
    return rows.join(ids, rows[id_col].eqNullSafe(ids["_keep_id"]), "left_semi")


def keep_rows(docs: DataFrame, keys: DataFrame, id_col: str, text_hash: Column) -> DataFrame:
    """The rows of docs whose (id, text_hash) is in keys, with all their columns.

    keys: distinct (id, h, again); where again holds, one of the rows stays. keys are broadcast up to BROADCAST_ROWS, else
    both sides are shuffled, without sorting texts.
    """
    keys = stage(keys.select("id", "h", "again"), "kept-rows")
    kid, kh, again = (free_name(docs, c) for c in ("kept_id", "kept_h", "kept_again"))
    table = keys.toDF(kid, kh, again)
    table = F.broadcast(table) if keys.count() <= BROADCAST_ROWS else table.hint("shuffle_hash")
    out = docs.join(table, docs[id_col].eqNullSafe(F.col(kid)) & (text_hash == F.col(kh)))
    if keys.filter("again").isEmpty():
        return out.select(*docs.columns)
    repeated = out.filter(F.col(again)).dropDuplicates([kid, kh])
    return out.filter(~F.col(again)).select(*docs.columns).unionByName(repeated.select(*docs.columns))


def join_by_class(rows: DataFrame, classes: DataFrame, key: str, size_col: str, total: int) -> DataFrame:
    """Inner join of rows to their class on key, safe where one class holds a large share of the rows.

    classes has one row per key and its number of rows in size_col. Classes of at least total / HOT_SHARE rows
    (HOT_SHARE of them at most, whatever the input) are broadcast; the rest is joined by shuffle.
    """
    hot = F.col(size_col) * HOT_SHARE >= F.lit(total)
    big = classes.filter(hot)
    small = classes.filter(~hot)
    out = [c for c in rows.columns] + [c for c in classes.columns if c != key]
    one = rows.join(F.broadcast(big), key).select(*out)
    rest = rows.join(F.broadcast(big.select(key)), key, "left_anti").join(small, key).select(*out)
    return one.unionByName(rest)


def edges_mark(edges: DataFrame) -> tuple:
    """Number of edges (u, v) and the sum of their hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, name: str, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): staged rows (node, component), component the smallest node reachable.

    Alternating large-star and small-star rounds, each staged; ends when a round leaves the edges as they were, and raises
    where that takes more than most_rounds. Every node of edges has a row. A star's centre is found by a map-side-combined
    minimum and given back to a hub's edges by broadcast, so hubs do not skew; up to BROADCAST_ROWS edges are one small
    shuffle even where all are one hub's.
    """
    both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    first = now = stage(both, f"{name}-edges")
    mark = edges_mark(now)
    for _ in range(most_rounds):
        # large star: neighbours larger than u point to the smallest of u and its neighbours
        nb = now.select("u", "v").union(now.select(F.col("v"), F.col("u"))).toDF("u", "v").filter("u <> v")
        least = nb.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("degree"))
        given = nb.join(least, "u") if mark[0] <= BROADCAST_ROWS else join_by_class(nb, least, "u", "degree", 2 * mark[0])
        large = given.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        # small star: u and its smaller neighbours point to the smallest of them
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_min, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_min.toDF("u", "v"))
        before, now = now, stage(small.filter("u <> v").distinct(), f"{name}-round")
        if before is not first:
            discard(before)
        was, mark = mark, edges_mark(now)
        if was == mark:
            break
    else:
        raise RuntimeError(f"components of {name} are not settled after {most_rounds} rounds")
    nodes = first.select("u").union(first.select("v")).toDF("node").distinct()
    found = now.groupBy("u").agg(F.min("v").alias("component"))
    out = stage(nodes.join(found, nodes["node"] == found["u"], "left").select("node", F.coalesce("component", "node").alias("component")), f"{name}-components")
    discard(first, now)
    return out


def misra_gries(keys: DataFrame, key: str, k: int) -> DataFrame:
    """Mergeable heavy-hitter summary: rows (key, estimate) with count - n / (k + 1) <= estimate <= count.

    Each task keeps k counters; the tasks' counters are summed by key. Nulls are not counted.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for value in batch.column(0).value_counts():
                if (x := value["values"].as_py()) is not None:
                    held[x] = held.get(x, 0) + value["counts"].as_py()
            if len(held) > 4 * k:
                held = shrink(held, k)
        held = shrink(held, k)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), batch_type), pa.array(list(held.values()), pa.int64())], ["key", "n"])

    batch_type = pa.binary() if dict(keys.dtypes)[key] == "binary" else pa.string()
    kind = "binary" if batch_type == pa.binary() else "string"
    parts = keys.select(key).mapInArrow(task, f"key {kind}, n long")
    return parts.groupBy(F.col("key").alias(key)).agg(F.sum("n").alias("estimate"))


def shrink(held: dict, k: int) -> dict:
    """Misra-Gries reduction of any number of counters to k: the (k + 1)-th largest count is taken from all."""
    if len(held) <= k:
        return held
    cut = sorted(held.values(), reverse=True)[k]
    return {x: n - cut for x, n in held.items() if n > cut}
