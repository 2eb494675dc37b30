"""A table that several branches of one plan read.

Spark computes an exchange once for all branches that have the very same one.  Branches that
read different columns don't: the optimizer takes the columns that a branch doesn't read out of
everything below, which makes each branch's exchanges its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared(df: DataFrame, beside: str | None = None) -> DataFrame:
    """``df`` with all its columns kept for every reader: they come out of a generator of one
    row each, whose input can't be pruned and through which no filter passes, so that
    readers of different columns have the same exchanges below it.

    ``beside`` names a column that the rows stand by: it goes past the generator, so the
    planner still knows that they do."""
    packed = [f"`{c}`" for c in df.columns if c != beside]
    out = df.select(*([beside] if beside else []), F.inline(F.array(F.struct(*packed))))
    return out.select(*[f"`{c}`" for c in df.columns])
