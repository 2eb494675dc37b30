"""Working days between two dates per key, both ends counted.

The original computes this as a band join (every calendar day between order
and dispatch day, minus holidays and the weekly off day) followed by
``count(distinct day)`` per key.  A band join is a nested-loop join in Spark.
Here it is rewritten as equi joins:

1. calendar -> dense day table with a running count of working days ``cum``
   (one row per day: its size is bounded by the calendar span, so it is
   broadcast);
2. intervals per key are merged into islands (overlapping day ranges), so that
   days covered by several intervals are counted once, as ``count(distinct)``
   does;
3. an island ``[s, e]`` holds ``cum(e) - cum(s - 1)`` working days: both
   ends looked up in one broadcast equi join, then summed with signs.

Keys whose total is 0 are dropped, exactly as the inner band join drops them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def working_day_index(calendar: DataFrame, dt: str, is_working: Column) -> DataFrame:
    """Dense ``(day, cum)`` table covering ``[min(dt) - 1, max(dt)]``.

    Dates missing from the source calendar count as non-working; a date listed
    more than once is working if any of its rows is.
    """
    flags = calendar.where(F.col(dt).isNotNull()).groupBy(F.col(dt).alias("day")).agg(
        F.max(F.when(is_working, 1).otherwise(0)).alias("w"))
    span = flags.agg(F.date_sub(F.min("day"), 1).alias("lo"), F.max("day").alias("hi"))
    dense = span.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    # One row per calendar day: a window without partitioning is bounded by the
    # number of days in the calendar, not by the fact data.
    running = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (dense.join(F.broadcast(flags), "day", "left")
            .select("day", F.sum(F.coalesce("w", F.lit(0))).over(running).cast("long").alias("cum")))


def merge_intervals(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Union of day ranges per key as disjoint islands ``(key, s, e)``.

    Intervals with the same start are reduced to the longest first (a
    map-side-combined aggregation), so the per-key window sees at most one row
    per distinct start day, however many rows share the key.
    """
    iv = (intervals.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) >= F.col(start)))
          .groupBy(key, F.col(start).alias("s")).agg(F.max(end).alias("e")))
    w = Window.partitionBy(key).orderBy("s")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    iv = iv.withColumn("_new", F.when(reach.isNull() | (F.col("s") > reach), 1).otherwise(0))
    iv = iv.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return iv.groupBy(key, "_island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_island")


def working_days(intervals: DataFrame, key: str, start: str, end: str,
                 calendar: DataFrame, dt: str, is_working: Column,
                 out: str = "days") -> DataFrame:
    """``(key, out)``: distinct working days covered by each key's intervals."""
    index = working_day_index(calendar, dt, is_working)
    # The index bounds as scalar subqueries (evaluated once, no join): days
    # outside the calendar are clamped to its ends, where the count is 0
    # before it and the full total after it.
    lo = index.agg(F.min("day")).scalar()
    hi = index.agg(F.max("day")).scalar()

    def clamp(c: Column) -> Column:
        return F.least(F.greatest(c, lo), hi)

    # Both ends of an island in one lookup: cum(e) counts +1, cum(s - 1) counts -1.
    ends = (merge_intervals(intervals, key, start, end)
            .select(key, F.explode(F.array(
                F.struct(clamp(F.col("e")).alias("day"), F.lit(1).alias("sign")),
                F.struct(clamp(F.date_sub("s", 1)).alias("day"), F.lit(-1).alias("sign")))).alias("_end"))
            .select(key, "_end.day", "_end.sign"))
    counted = ends.join(F.broadcast(index), "day")
    return (counted.groupBy(key).agg(F.sum(F.col("cum") * F.col("sign")).alias(out))
            .where(F.col(out) > 0))
