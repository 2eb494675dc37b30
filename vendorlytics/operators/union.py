"""Set union with SQL ``UNION`` semantics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_distinct(frames: Sequence[DataFrame], names: Sequence[str] | None = None,
                   types: Sequence[str] | None = None) -> DataFrame:
    """``A UNION B UNION ...``: positional, names from the first input (or
    ``names``), each column cast to ``types`` when given so that e.g. numeric
    and text ids compare as one value, then duplicates (NULLs equal) removed.
    ``distinct`` runs as a map-side-combined hash aggregation."""
    names = list(names or frames[0].columns)

    def shape(df: DataFrame) -> DataFrame:
        cols = [F.col(f"`{c}`") for c in df.columns]
        if types:
            cols = [c.cast(t) for c, t in zip(cols, types)]
        return df.select(*[c.alias(n) for c, n in zip(cols, names)])

    return reduce(lambda a, b: a.union(b), [shape(f) for f in frames]).distinct()
