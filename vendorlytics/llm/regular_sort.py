"""Exact ranks by parallel sorting with regular sampling.

Every run (a partition, sorted where it lies) gives keys at regular distances; the
sorted samples give splitters at regular distances; rows go to the segment between
two splitters, where they are merged; the sums of the segments before give each
segment its first rank.  With p segments and a sample for every n / p^2 rows, no
segment holds more than about 2n / p rows, whatever the order of the input.

Only samples (at most 2 p^2 keys), splitters and segment sizes reach the driver, p
being at most ``MOST``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vendorlytics.llm.storage import stored
from vendorlytics.llm.text import tidied

MOST = 512


def segments_for(n: int, partitions: int) -> int:
    """p: no more than the session's shuffle partitions, and so few that the
    samples are a small part (a sixteenth) of the rows."""
    return max(1, min(partitions, MOST, int(n ** 0.5) // 4))


def sample_keys(rows: DataFrame, keys: Sequence[str], p: int, n: int) -> list[np.ndarray]:
    """Keys at regular distances of every locally sorted run, sorted together."""
    step = max(1, n // (p * p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            first = (step // 2 - seen) % step
            seen += batch.num_rows
            if first < batch.num_rows:
                yield batch.take(pa.array(np.arange(first, batch.num_rows, step)))

    runs = rows.select(*keys).coalesce(p).sortWithinPartitions(*keys)
    taken = runs.mapInArrow(tidied(run), runs.schema).toArrow()
    columns = [taken.column(k).to_numpy() for k in keys]
    order = np.lexsort(columns[::-1])
    return [c[order] for c in columns]


def splitters(samples: list[np.ndarray], p: int) -> list[np.ndarray]:
    """p - 1 of the sorted samples, at regular distances."""
    n = len(samples[0])
    at = np.unique(np.arange(1, p) * n // p) if n else np.zeros(0, np.int64)
    return [c[at] for c in samples]


def place(keys: list[np.ndarray], splits: list[np.ndarray]) -> np.ndarray:
    """Segment of each key: the number of splitters that are not above it."""
    m = len(splits[0])
    order = np.lexsort([np.concatenate([s, k]) for s, k in zip(splits, keys)][::-1])
    out = np.empty(len(order), np.int32)
    out[order] = np.cumsum(order < m)
    return out[m:]


def first_ranks(rows: DataFrame, keys: Sequence[str], limit: int, n: int, rank: str = "rank") -> DataFrame:
    """``rows`` with ``rank``: 1, 2, 3 ... in ascending order of ``keys`` for the
    ``limit`` first, null for the others.

    ``rows`` is a stored table of n rows; ``keys`` are long columns, without nulls
    and together unique.  Segments that lie wholly beyond ``limit`` aren't exchanged.
    """
    if not n or limit <= 0:
        return rows.withColumn(rank, F.lit(None).cast("long"))
    p = segments_for(n, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    splits = splitters(sample_keys(rows, keys, p, n), p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = place([batch.column(k).to_numpy() for k in keys], splits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], [*batch.schema.names, "segment"])

    schema = rows.select("*", F.lit(0).alias("segment")).schema
    dealt = stored(rows.mapInArrow(tidied(run), schema), "segments")
    sizes = dict(dealt.groupBy("segment").count().collect())
    before, at = [], 0
    for segment in range(max(sizes) + 1):
        before.append(at)
        at += sizes.get(segment, 0)
    reached = sum(b < limit for b in before)
    within = F.row_number().over(Window.partitionBy("segment").orderBy(*keys))
    offset = F.element_at(F.array(*[F.lit(b).cast("long") for b in before[:reached]]), F.col("segment") + 1)
    ranked = dealt.where(F.col("segment") < reached).withColumn(rank, within + offset) \
        .withColumn(rank, F.when(F.col(rank) <= limit, F.col(rank)))
    rest = dealt.where(F.col("segment") >= reached).withColumn(rank, F.lit(None).cast("long"))
    return ranked.unionByName(rest).drop("segment")
