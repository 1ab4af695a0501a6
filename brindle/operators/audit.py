"""Audit log: valid events, retention by age, number and bytes, dashboard buckets, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import is_json
from brindle.operators.admission import SHA, valid_timestamp

#: Bytes of an event, of a snapshot, and events that a read gives at most; rows that go at once when bytes run over.
MOST_EVENT, MOST_SNAPSHOT, MOST_READ, TRIM = 65_536, 524_288, 10_000, 100
IDENTIFIER = r"^[a-z]+_[A-Za-z0-9_-]{8,128}$"


def event_problem() -> Column:
    """What is wrong with an event, or null; columns event_id, request_id, occurred_at, workspace, snapshot, decision, duration, engine."""
    optional = lambda c: F.col(c).isNull() | F.col(c).rlike(SHA)
    checks = (
        ("event_id", F.col("event_id").rlike(IDENTIFIER)),
        ("request_id", F.col("request_id").rlike(IDENTIFIER)),
        ("occurred_at", valid_timestamp(F.col("occurred_at"))),
        ("decision", F.col("decision").rlike(SHA)),
        ("workspace", optional("workspace")),
        ("snapshot", optional("snapshot")),
        ("duration", F.col("duration").rlike(r"^(0|[1-9][0-9]{0,18})$")),
        ("engine", F.col("engine").rlike(r"^[0-9]*\.[0-9]*\.[0-9]*$")),
    )
    out = F.lit(None).cast("string")
    for name, holds in reversed(checks):
        out = F.when(~F.coalesce(holds, F.lit(False)), name).otherwise(out)
    return out


def retained(stored: DataFrame, new: DataFrame, cutoff: str, most: int) -> DataFrame:
    """The log after an append: stored events before the cutoff go first, then all but the newest `most` of what is there."""
    kept = stored.filter(F.col("ts") >= F.lit(cutoff).cast("timestamp")).unionByName(new)
    return kept.orderBy(F.desc("ts"), F.desc("event_id")).limit(most)


def append(stored: DataFrame, new: DataFrame, cutoff: str, most: int, most_bytes: int, size: Column) -> DataFrame:
    """`retained`, then by bytes; an event whose id is there already is an error of the caller's."""
    after = retained(stored, new, cutoff, most)
    twice = after.groupBy("event_id").agg(F.count("*").alias("n")).filter("n > 1").select("event_id", F.raise_error(F.lit("an event comes twice")).alias("e"))
    return trimmed_to(after.join(twice.filter("e is null").select("event_id"), "event_id", "left_anti"), size, most_bytes)


def trimmed_to(events: DataFrame, size: Column, most_bytes: int) -> DataFrame:
    """The newest events within most_bytes: the oldest go, TRIM at a time, until the rest fits.

    Events are counted by blocks of TRIM from the oldest; only the blocks' sums meet in one task.
    """
    ranged = events.withColumn("_size", size.cast("long")).repartitionByRange("ts", "event_id").withColumn("_part", F.spark_partition_id())
    placed = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy("ts", "event_id")))
    starts = ranged.groupBy("_part").agg(F.count("*").alias("c")).withColumn("_start", F.sum("c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("_part", F.coalesce("_start", F.lit(0)).alias("_start"))
    numbered = placed.join(F.broadcast(starts), "_part").withColumn("_block", F.floor((F.col("_start") + F.col("_n") - 1) / TRIM))
    blocks = numbered.groupBy("_block").agg(F.sum("_size").alias("b")).withColumn("_from", F.sum("b").over(Window.orderBy(F.desc("_block"))))
    keep = blocks.filter(F.col("_from") <= most_bytes).select("_block")
    return numbered.join(F.broadcast(keep), "_block", "left_semi").drop("_size", "_part", "_n", "_start", "_block")


def recent(events: DataFrame, most: int, payload: Column | None = None, schema: str | None = None) -> DataFrame:
    """The newest events, first the newest; where a payload is given, `unavailable` marks rows whose payload is too large or cannot be read."""
    if not 1 <= most <= MOST_READ:
        raise ValueError(f"a read gives between one and {MOST_READ} events")
    newest = events.orderBy(F.desc("ts"), F.desc("event_id")).limit(most)
    if payload is None:
        return newest
    return newest.withColumn("unavailable", (F.octet_length(payload) > MOST_EVENT) | ~is_json(payload) | F.from_json(payload, schema).isNull())


def purged(events: DataFrame, workspace: str) -> DataFrame:
    """The log without one workspace's events; those of no workspace stay."""
    return events.filter(~F.col("workspace").eqNullSafe(F.lit(workspace)))


def buckets(events: DataFrame, keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Events and their time by key; an overflow raises, as sums are exact or none."""
    return events.groupBy(*keys).agg(F.count("*").alias("events"), F.sum(F.floor("value")).cast("long").alias("duration_ms"))


def nearest_rank(events: DataFrame) -> DataFrame:
    """Per type the lower median, the 95th percentile and the maximum, all by nearest rank.

    Equal values are counted before the shuffle, and only (type, value, count) is ordered.
    """
    counts = events.groupBy("event_type", "value").agg(F.count("*").alias("c"))
    order = Window.partitionBy("event_type").orderBy("value")
    run = counts.withColumns({"upto": F.sum("c").over(order), "n": F.sum("c").over(Window.partitionBy("event_type"))})
    at = lambda r: F.min(F.when(F.col("upto") >= r, F.col("value")))
    return run.groupBy("event_type").agg(at(F.floor((F.col("n") - 1) / 2) + 1).alias("p50"), at(F.ceil(F.col("n") * 95 / 100)).alias("p95"), F.max("value").alias("max"))


def labels(events: DataFrame, salt: str) -> DataFrame:
    """Events without identities: a keyed label stands for the workspace."""
    return events.select("event_id", F.substring(F.sha2(F.concat(F.lit(salt), F.col("user_id").cast("string")), 256), 1, 16).alias("workspace"), "event_type")


def bounded_snapshot(records: DataFrame, order: list, most: int = MOST_READ, most_bytes: int = MOST_SNAPSHOT, envelope: int = 256) -> DataFrame:
    """The newest records that fit a snapshot as JSON, with how many of those read had to be left out."""
    first = records.orderBy(*order).limit(most)
    size = F.octet_length(F.to_json(F.struct(*records.columns))).cast("long") + 1
    run = first.withColumn("_used", F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) + envelope)
    return run.withColumn("left_out", F.sum((F.col("_used") > most_bytes).cast("long")).over(Window.partitionBy())).filter(F.col("_used") <= most_bytes).drop("_used")
