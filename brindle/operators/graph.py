"""Rollup per directory, unique names, span containment, turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.intervals import enclosing


def directory_rollup(files: DataFrame) -> DataFrame:
    """(directory, files) for every ancestor directory of `path`, `.` for the whole tree. Counts combine map-side."""
    parts = F.split("path", "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    above = F.when(F.size(parts) > 1, F.concat(F.array(F.lit(".")), steps)).otherwise(F.array(F.lit(".")))
    return files.select(F.explode(above).alias("directory")).groupBy("directory").agg(F.count("*").alias("files"))


def unique_names(nodes: DataFrame) -> DataFrame:
    """(name, target, resolution): the one node of a name, or ambiguous."""
    named = nodes.groupBy("name").agg(F.count("*").alias("n"), F.min("node").alias("first"))
    return named.select("name", F.when(F.col("n") == 1, F.col("first")).alias("target"), F.when(F.col("n") == 1, "resolved").otherwise("ambiguous").alias("resolution"))


def smallest_enclosing(spans: DataFrame, outer: DataFrame, most: int) -> DataFrame:
    """For each (path, start, end) the smallest [lo, hi) of the path that holds it, of at most `most` bytes, then the first."""
    return enclosing(spans, outer, most)


def outermost(spans: DataFrame) -> DataFrame:
    """Spans (path, lo, hi) that no earlier span of the path reaches past."""
    reach = F.max("hi").over(Window.partitionBy("path").orderBy("lo", F.desc("hi")).rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("reach", reach).filter("reach is null or hi > reach").drop("reach")


def round_robin(items: DataFrame, group: str, order: str) -> DataFrame:
    """Adds `turn`: the item's place within its group; ordering by (turn, group) takes one of each group per pass."""
    return items.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(order)).cast("long"))
