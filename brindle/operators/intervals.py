"""Joins of places to the intervals around them, by bins of the intervals' own size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.sources.store import staged


def bits(n: Column) -> Column:
    """Binary digits of a number, none for zero."""
    return F.when(n > 0, F.length(F.bin(n))).otherwise(0)


def enclosing(spans: DataFrame, outer: DataFrame, most: int | None, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """(keys, start, end, lo, hi): for each distinct span the smallest [lo, hi] around it, of at most `most` bytes (None: of any size), then the first.

    An interval lies in at most two bins of the least power of two that is no shorter; a span looks into one bin of each
    size. So spans meet intervals near them, not all of their file. Without a bound the sizes are those that occur.
    """
    if most is not None and most < 0:
        raise ValueError("an interval has no negative size")
    size = F.col("hi") - F.col("lo")
    kept = outer.select(*keys, "lo", "hi").distinct().filter(size >= 0 if most is None else (size >= 0) & (size <= most))
    level = bits(F.greatest(size - 1, F.lit(0).cast("long"))).cast("int")
    bins = F.array_distinct(F.array(F.expr("shiftright(lo, level)"), F.expr("shiftright(hi, level)")))
    dealt = kept.withColumn("level", level).withColumn("bin", F.explode(bins))
    if most is None:
        dealt = staged(dealt, "intervals")
        # sizes differ by their digits: at most 64 numbers
        levels = F.array(*(F.lit(r["level"]) for r in dealt.select("level").distinct().orderBy("level").collect())).cast("array<int>")
    else:
        levels = F.sequence(F.lit(0), F.lit(max(most - 1, 0).bit_length()))
    looked = spans.select(*keys, "start", "end").distinct().withColumn("level", F.explode(levels)).withColumn("bin", F.expr("shiftright(start, level)"))
    inside = looked.join(dealt, [*keys, "level", "bin"]).filter("lo <= start and end <= hi")
    best = inside.groupBy(*keys, "start", "end").agg(F.min(F.struct((F.col("hi") - F.col("lo")).alias("n"), "lo", "hi")).alias("b"))
    return best.select(*keys, "start", "end", "b.lo", "b.hi")
