"""Items that are live from a start month on.

The original joins items to months with ``start_month <= month`` (a theta join: nested
loop in Spark) and then counts per month and group.  ``running_live`` gives the same
numbers without a row for each item and month: an item changes its group's counts once,
in the first reporting month that isn't before its start, and every month's value is the
running sum of the changes up to it.  The cost is items + groups x months.

``expand_months`` makes the rows themselves, for callers that want them.

Months are ``yyyy-MM`` text and compared as text, as in the original, so a blank start is
before every month and a NULL start never live.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reporting_months(months: DataFrame, month_col: str, cutoff_month: str) -> Column:
    """The months up to the cut-off, ascending, as one array (a scalar subquery over the
    month dimension: one entry per calendar month, so its size is bounded)."""
    dim = months.where(F.col(month_col).isNotNull() & (F.col(month_col) <= F.lit(cutoff_month)))
    return dim.agg(F.sort_array(F.collect_set(month_col))).scalar()


def first_month(listed: Column, start: Column) -> Column:
    """Place in ``listed`` (ascending) of the first month that isn't before ``start``; one
    more than its size when there is none, NULL for a NULL start."""
    return F.array_position(F.sort_array(F.array_union(listed, F.array(start))), start).cast("int")


def expand_months(items: DataFrame, start_month_col: str, months: DataFrame, month_col: str,
                  cutoff_month: str, out_col: str) -> DataFrame:
    """``items`` x months in ``months[month_col]`` with
    ``items[start_month_col] <= month <= cutoff_month``."""
    listed = reporting_months(months, month_col, cutoff_month)
    due = F.slice(listed, first_month(listed, F.col(start_month_col)), F.size(listed))
    return items.withColumn("_due", due).withColumn(out_col, F.explode("_due")).drop("_due")


def running_live(items: DataFrame, start_month_col: str, months: DataFrame, month_col: str, cutoff_month: str,
                 out_col: str, group_cols: Sequence[str], id_col: str, distinct_name: str,
                 avgs: Mapping[str, str], monthly: DataFrame, monthly_month: str, monthly_id: str,
                 sums: Mapping[str, str]) -> DataFrame:
    """Per group and month with a live item: ``distinct_name`` = distinct non-NULL
    ``id_col`` of the live items, each of ``avgs`` (out -> item column) over the live
    rows, and each of ``sums`` (out -> column of ``monthly``) over the live rows' values
    of that month (0 when there is none).

    ``items`` may repeat an id within a group, with several starts; every row counts in
    averages and sums, the id once.  ``monthly`` has one row per (month, id).
    """
    keys = list(group_cols)
    listed = reporting_months(months, month_col, cutoff_month)
    staged = items.withColumn("_at", first_month(listed, F.col(start_month_col)))
    per_item = staged.where(F.col("_at") <= F.size(listed)).groupBy(*keys, id_col, "_at").agg(
        F.count(F.lit(1)).alias("_rows"),
        *[a for n, c in avgs.items() for a in (F.sum(c).alias(f"_s_{n}"), F.count(c).alias(f"_n_{n}"))])
    # An id enters its group once, with its first start.
    first = F.min("_at").over(Window.partitionBy(*keys, id_col))
    per_item = per_item.withColumn("_ids", F.when(F.col(id_col).isNotNull() & (F.col("_at") == first), 1).otherwise(0))

    # Entries of an item's start: the change itself, and a value for each month sold since
    # (one per month at most, so they travel as an array).
    changes = ["_ids", *[f"_{k}_{n}" for n in avgs for k in "sn"]]
    types = {v: monthly.schema[c].dataType for v, c in sums.items()}
    by_id = (monthly.withColumn("_at", F.array_position(listed, F.col(monthly_month)).cast("int")).where("_at > 0")
             .groupBy(F.col(monthly_id).alias(id_col))
             .agg(F.collect_list(F.struct(F.col("_at").alias("at"), F.lit(False).alias("change"),
                                          *[F.col(c).alias(v) for v, c in sums.items()])).alias("_sold")))
    change = F.array(F.struct(F.col("_at").alias("at"), F.lit(True).alias("change"),
                              *[F.lit(None).cast(t).alias(v) for v, t in types.items()]))
    sold = F.filter("_sold", lambda s: s["at"] >= F.col("_at"))
    entries = (per_item.join(by_id, id_col, "left")
               .select(*keys, "_rows", *changes, F.concat(change, F.coalesce(sold, F.array())).alias("_entries"))
               .select(*keys, "_rows", *changes, F.explode("_entries").alias("_e")))
    steps = entries.groupBy(*keys, F.col("_e.at").alias("_at")).agg(
        *[F.sum(F.when(F.col("_e.change"), F.col(c))).alias(c) for c in changes],
        *[F.sum(F.col(f"_e.{v}") * F.col("_rows")).alias(v) for v in sums])

    # Running sums over the months in which a group changes or sells (one row per month at
    # most); a month between two of them has the values of the earlier one.
    by_month = Window.partitionBy(*keys).orderBy("_at")
    so_far = by_month.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = steps.select(*keys, "_at", F.lead("_at").over(by_month).alias("_next"), *sums,
                        *[F.sum(c).over(so_far).alias(c) for c in changes])
    until = F.sequence(F.col("_at"), F.coalesce(F.col("_next") - 1, F.size(listed)))
    rows = runs.withColumn("_months", until).withColumn("_k", F.explode("_months")).withColumn(out_col, F.element_at(listed, F.col("_k")))
    return rows.select(
        *keys, out_col, F.col("_ids").alias(distinct_name),
        *[F.try_divide(F.col(f"_s_{n}").cast("double"), F.col(f"_n_{n}").cast("double")).alias(n) for n in avgs],
        *[F.coalesce(F.when(F.col("_k") == F.col("_at"), F.col(v)), F.lit(0)).alias(v) for v in sums])
