"""Running totals over all rows of a table: sums inside sorted ranges, and offsets of the ranges. No task holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.sources.store import staged


def running(rows: DataFrame, order: list, value: Column, as_: str) -> DataFrame:
    """rows with as_: the sum of value up to and with each row in the order of `order`, which must be total.

    Rows are dealt to ranges of the order; a range's offset is the sum over the ranges before it, one number a range.
    """
    ranged = rows.withColumn("_value", value).repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranged = staged(ranged, "ranges")
    sums = ranged.groupBy("_part").agg(F.sum("_value").alias("_sum"))
    # one row a range: as many as there are partitions, whatever the table's size
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    inside = F.sum("_value").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.join(F.broadcast(offsets), "_part").withColumn(as_, (F.col("_before") + inside)).drop("_part", "_value", "_before")


def numbered(rows: DataFrame, order: list, as_: str) -> DataFrame:
    """rows with their place, from 1."""
    return running(rows, order, F.lit(1).cast("long"), as_)
