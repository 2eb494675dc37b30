"""Joins that may not change the grain of their left side.

``summed`` brings the many side to one row per key; ``join_one`` joins a side that is
claimed to have one row per key and fails, with the key, where it hasn't.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summed(df: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """One row per key: NULL-skipping totals (map-side combined, so a key with a third of
    the rows is spread over the tasks that read it).  NULL keys match nothing and go."""
    known = df.dropna(subset=list(keys))
    return known.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def join_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join that keeps the number of left rows.  The proof is part of the plan: the
    right side is grouped by its keys (free where ``summed`` made it) and a key with a second
    row raises an error when the rows are computed."""
    values = [c for c in right.columns if c not in keys]
    once = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *[F.first(c).alias(c) for c in values])
    text = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
    fault = F.raise_error(F.concat(F.lit("several rows for key "), text)).cast("boolean")
    proved = once.where(F.when(F.col("_rows") > 1, fault).otherwise(F.lit(True))).drop("_rows")
    return left.join(proved, list(keys), "left")
