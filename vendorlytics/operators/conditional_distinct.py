"""Several ``count(distinct case when p then id end)`` in one aggregation.

Spark plans several distinct aggregates with an ``Expand`` that multiplies the
input once per distinct expression.  Two ordinary aggregations give the same
numbers: first per (group, id) the flag ``max(p)`` and the partial sums, then
per group ``sum(flag)``.  Both stages combine map-side, so a group holding a
third of all rows is still split over many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def conditional_distinct_counts(df: DataFrame, group_cols: Sequence[str], id_col: str,
                                conditions: Mapping[str, Column],
                                sums: Mapping[str, Column] | None = None,
                                avgs: Mapping[str, Column] | None = None,
                                distinct_name: str | None = None) -> DataFrame:
    """Per group: one distinct count of ``id_col`` per condition (NULL ids and
    NULL/false conditions are not counted), optional plain sums and averages
    over all rows (NULL ids included), and ``distinct_name`` = ``count(distinct id)``.
    """
    sums = dict(sums or {})
    avgs = dict(avgs or {})
    keys = [*group_cols, id_col]
    stage1 = [F.max(F.when(c, 1).otherwise(0)).alias(f"_f_{n}") for n, c in conditions.items()]
    stage1 += [F.sum(c).alias(f"_s_{n}") for n, c in sums.items()]
    for n, c in avgs.items():
        stage1 += [F.sum(c).alias(f"_as_{n}"), F.count(c).alias(f"_ac_{n}")]
    per_id = df.groupBy(*keys).agg(*stage1) if stage1 else df.select(*keys).distinct()

    has_id = F.col(id_col).isNotNull()
    stage2 = [F.coalesce(F.sum(F.when(has_id, F.col(f"_f_{n}"))), F.lit(0)).cast("long").alias(n)
              for n in conditions]
    if distinct_name:
        stage2.append(F.count(id_col).alias(distinct_name))
    stage2 += [F.sum(f"_s_{n}").alias(n) for n in sums]
    stage2 += [F.try_divide(F.sum(f"_as_{n}").cast("double"), F.sum(f"_ac_{n}").cast("double")).alias(n)
               for n in avgs]
    return per_id.groupBy(*group_cols).agg(*stage2)
