"""Typed reading of text tables that sets unreadable rows apart instead of ending the job.

A row is rejected when one of its cells holds text that its declared type can't; blank
cells are NULL.  Rejected rows keep their text and the names of the faulty columns.  A
share of rejected rows above a limit is an error, raised after the one pass that writes
both kinds, so that the rejects can be looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vendorlytics.sources.readers import SHEET_TIMESTAMP_FORMAT


def typed(name: str, dtype: T.DataType) -> Column:
    """A text cell as ``dtype``; NULL when it is blank or can't be read."""
    text = F.col(f"`{name}`")
    if isinstance(dtype, T.StringType):
        return text
    if isinstance(dtype, T.TimestampType):
        return F.coalesce(F.try_to_timestamp(text, F.lit(SHEET_TIMESTAMP_FORMAT)), F.try_to_timestamp(text))
    return F.trim(text).try_cast(dtype)


def faults(schema: T.StructType) -> Column:
    """The faulty cells of a text row: array of (column, text)."""
    cells = []
    for f in schema.fields:
        if not isinstance(f.dataType, T.StringType):
            text = F.col(f"`{f.name}`")
            bad = (F.trim(text) != "") & typed(f.name, f.dataType).isNull()
            cells.append(F.when(bad, F.struct(F.lit(f.name).alias("column"), text.alias("text"))))
    return F.filter(F.array(*cells), lambda c: c.isNotNull())


def staged(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Every row: its typed columns, ``faults``, its text as JSON where it is rejected, and
    ``rejected``.

    The faults come out of an ``explode`` of one element: as a generated column they are
    computed once a row, and a filter on them stays above it.  As a plain column the filter
    would be rewritten in terms of every column's own expression, whose inferred constraints
    double with each column (2^25 of them for the sales sheet, all in the driver)."""
    read = raw.withColumn("_faults", F.explode(F.array(faults(schema))))
    bad = F.size("_faults") > 0
    return read.select(
        *[typed(f.name, f.dataType).alias(f.name) for f in schema.fields], "_faults",
        F.when(bad, F.to_json(F.struct(*[F.col(f"`{f.name}`") for f in schema.fields]))).alias("_text"),
        bad.alias("rejected"))


def split_rejects(raw: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows in declared types, rejected rows as ``text`` and ``faults``)."""
    rows = staged(raw, schema)
    return (rows.where(~F.col("rejected")).select(*[f"`{f.name}`" for f in schema.fields]),
            rows.where("rejected").select(F.col("_text").alias("text"), F.col("_faults").alias("faults")))


def ingest(raw: DataFrame, schema: T.StructType, path: str, max_share: float = 0.001) -> tuple[DataFrame, DataFrame]:
    """``split_rejects`` written to ``path`` in one pass and read back.  Raises ValueError
    when more than ``max_share`` of the rows are rejected."""
    seen = Observation()
    rows = staged(raw, schema).observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("rejected")).alias("rejected"))
    rows.write.mode("overwrite").partitionBy("rejected").parquet(path)
    found = seen.get
    if found["rejected"] > max_share * found["rows"]:
        raise ValueError(f"{found['rejected']} of {found['rows']} rows can't be read (limit {max_share:g}); see {path}/rejected=true")
    back = raw.sparkSession.read.schema(staged(raw, schema).schema).parquet(path)
    return (back.where(~F.col("rejected")).select(*[f"`{f.name}`" for f in schema.fields]),
            back.where("rejected").select(F.col("_text").alias("text"), F.col("_faults").alias("faults")))
