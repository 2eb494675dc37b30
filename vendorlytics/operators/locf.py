"""Last observation carried forward along a global row order.

A window ordered over the whole table has no partition key, so Spark runs it
in one task.  Prefix scan in levels instead:

1. cut the position into blocks of ``block_size`` and fill inside each block
   (one window partition per block, bounded size);
2. per block keep its last non-NULL value: the summary of level 1;
3. cut the summary into blocks of ``fan_out`` rows, carry inside each, and keep the last
   non-NULL value per such block: the summary of the next level, and so on;
4. a value still NULL takes what its block's level carried, else what the level above did.

No window partition holds more than ``block_size`` rows of the table or ``fan_out`` rows
of a summary, however large the table: the top level is one partition, and a position that
it can't hold (``block_size * fan_out ** levels`` or more) is an error, not a wrong fill.

Leading NULLs (nothing before them) stay NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def locf(df: DataFrame, order_col: str, value_col: str, block_size: int = 1_000_000, fan_out: int = 4096,
         levels: int = 2) -> DataFrame:
    """``df`` with NULLs of ``value_col`` filled; ``order_col`` holds unique positions
    from 0 up to ``block_size * fan_out ** levels`` (1.7 * 10^13 by default)."""
    block = F.floor(F.col(order_col) / F.lit(block_size)).cast("long")
    staged = df.withColumn("_block", block)
    inside = Window.partitionBy("_block").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    staged = staged.withColumn("_filled", F.last(value_col, ignorenulls=True).over(inside))
    out = staged.join(_carried(_last_of(staged, "_block", value_col, order_col), fan_out, levels), "_block", "left")
    return (out.withColumn(value_col, F.coalesce("_filled", "_carried"))
            .drop("_block", "_filled", "_carried"))


def _last_of(df: DataFrame, block: str, value: str, position: str) -> DataFrame:
    """One row per block: its last non-NULL value (NULL when it has none)."""
    return df.groupBy(block).agg(
        F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(position))).alias("_last"))


def _carried(summary: DataFrame, fan_out: int, levels: int) -> DataFrame:
    """``(_block, _carried)`` of a summary ``(_block, _last)``: the last non-NULL value of
    all blocks before each one."""
    group = F.floor(F.col("_block") / F.lit(fan_out)).cast("long")
    if levels == 1:  # the top: every block belongs to group 0
        beyond = F.raise_error(F.lit("position beyond block_size * fan_out ** levels")).cast("long")
        group = F.when((group == 0) | group.isNull(), group).otherwise(beyond)
    rows = summary.withColumn("_group", group)
    before = Window.partitionBy("_group").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    within = rows.select("_block", "_group", F.last("_last", ignorenulls=True).over(before).alias("_within"))
    if levels == 1:
        return within.select("_block", F.col("_within").alias("_carried"))
    above = _carried(_last_of(rows, "_group", "_last", "_block").withColumnRenamed("_group", "_block"), fan_out, levels - 1)
    above = above.select(F.col("_block").alias("_group"), F.col("_carried").alias("_above"))
    return within.join(above, "_group", "left").select("_block", F.coalesce("_within", "_above").alias("_carried"))
