"""Rebuild the mart's months that a change of the inputs touches, and no others.

A mart row depends on more than its own line: its order's claims, ranks and totals, and
its customer's first completed month.  So a change spreads from a line to the lines of its
order, from a claim to the lines of its order, and from a customer's new first month
to all of the customer's lines.  ``affected_months`` follows these three paths over
narrow rows (keys, dates and a row hash); ``rebuild_months`` computes the mart from the
lines of the orders that have a line in those months.  The other sheets (listing,
calendar, pincodes, catalogue, sub-categories) must be unchanged: a new version of those
needs the full run.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendorlytics.plans import sales

PHONE = "BillingAddressPhone"
_KEYS = (sales.ORDER, PHONE, "OrderDate")


def difference(old: DataFrame, new: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns of the rows that stand more often in one version than in the other
    (NULLs equal).  Rows are told apart by 128 bits of hash over all columns, so only keys
    and hashes are exchanged."""
    columns = [F.col(f"`{c}`") for c in sorted(new.columns)]

    def signed(df: DataFrame, sign: int) -> DataFrame:
        return df.select(*keep, F.xxhash64(*columns).alias("_h1"), F.xxhash64(F.lit(1), *columns).alias("_h2"),
                         F.lit(sign).alias("_sign"))

    both = signed(old, -1).unionByName(signed(new, 1))
    return both.groupBy(*keep, "_h1", "_h2").agg(F.sum("_sign").alias("_n")).where("_n <> 0").select(*keep)


def affected_months(old_lines: DataFrame, new_lines: DataFrame, old_claims: DataFrame, new_claims: DataFrame,
                    calendar: DataFrame) -> DataFrame:
    """``Month``: the mart months whose rows may differ between the two versions of the
    typed sales lines and the return claims (NULL: dates that the calendar lacks)."""
    changed = difference(old_lines, new_lines, _KEYS)
    claims = difference(old_claims, new_claims, ["Order Number"])
    lines = old_lines.select(*_KEYS).unionByName(new_lines.select(*_KEYS))

    orders = changed.select(sales.ORDER).unionByName(claims.select(F.col("Order Number").alias(sales.ORDER))) \
        .where(F.col(sales.ORDER).isNotNull()).distinct()
    phones = changed.select(PHONE).where(F.col(PHONE).isNotNull()).distinct()
    before, after = (sales.first_order_month(x.join(phones, PHONE, "left_semi")).withColumnRenamed("FirstOrderMonth", n)
                     for x, n in ((old_lines, "_before"), (new_lines, "_after")))
    moved = before.join(after, PHONE, "full").where(~F.col("_before").eqNullSafe(F.col("_after"))).select(PHONE)

    dates = [changed, lines.join(orders, sales.ORDER, "left_semi"), lines.join(moved, PHONE, "left_semi")]
    touched = reduce(DataFrame.unionByName, [d.select("OrderDate") for d in dates]).distinct()
    days = calendar.select(F.col("dt").alias("OrderDate"), F.col("mnt_no").alias("Month"))
    return touched.join(days, "OrderDate", "left").select("Month").distinct()


def in_months(df: DataFrame, column: str, months: Sequence[str | None]) -> DataFrame:
    known = [m for m in months if m is not None]
    wanted = F.col(column).isin(*known) if known else F.lit(False)
    return df.where(wanted | F.col(column).isNull()) if None in months else df.where(wanted)


def rebuild_months(lines: DataFrame, claims: DataFrame, listing: DataFrame, calendar: DataFrame, pincodes: DataFrame,
                   skus: DataFrame, subcat_map: DataFrame, months: Sequence[str | None],
                   tie_break: Sequence[str] | None = None, heavy: Mapping[str, Sequence] | None = None) -> DataFrame:
    """The rows of ``aggregate_mart(mart_lines(...))`` in ``months``, from the lines of the
    orders that have a line there (customers' first months are those of all lines)."""
    days = calendar.select(F.col("dt").alias("OrderDate"), F.col("mnt_no").alias("_month"))
    inside = in_months(lines.select(sales.ORDER, "OrderDate").join(days, "OrderDate", "left"), "_month", months)
    orders = inside.where(F.col(sales.ORDER).isNotNull()).select(sales.ORDER).distinct()
    dates = inside.where(F.col(sales.ORDER).isNull()).select("OrderDate").distinct()
    without = lines.where(F.col(sales.ORDER).isNull())
    needed = lines.join(orders, sales.ORDER, "left_semi").unionByName(
        without.alias("l").join(dates.alias("d"), F.col("l.OrderDate").eqNullSafe(F.col("d.OrderDate")), "left_semi"))
    known = claims.join(orders.withColumnRenamed(sales.ORDER, "Order Number"), "Order Number", "left_semi")
    rows = sales.mart_lines(needed, known, listing, calendar, pincodes, skus, subcat_map, tie_break, heavy,
                            first=sales.first_order_month(lines))
    return sales.aggregate_mart(in_months(rows, "Month", months))
