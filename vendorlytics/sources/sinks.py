"""Sinks: overwrite-mode parquet tables (facts partitioned by month) and a
tab-separated export with a header and empty strings for NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite",
                only_partitions: bool = False) -> None:
    """Full recompute: the whole table is replaced.  With ``partition_by`` (e.g. a
    month column) readers of one month prune the others.  ``only_partitions``
    replaces the partitions present in ``df`` and keeps the others (a run over
    part of the period)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.option("partitionOverwriteMode", "dynamic" if only_partitions else "static").partitionBy(*partition_by)
    w.parquet(path)


def write_tsv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Tab-separated text: header row, NULL as empty string, no row names.

    ``single_file`` writes one part file (one header); use it only for results
    whose size is bounded independently of the input (e.g. one row per vendor),
    never for fact-sized output."""
    if single_file:  # an exchange: only the write is one task, not the stages before it
        df = df.repartition(1)
    (df.write.mode("overwrite").option("sep", "\t").option("header", "true")
     .option("nullValue", "").option("emptyValue", "").csv(path))
