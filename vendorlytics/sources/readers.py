"""Readers: files (parquet, CSV) and JDBC tables, cast to declared schemas.

Casting is a projection, so column pruning and filter pushdown still reach
the scan (``PushedFilters`` / ``ReadSchema`` in ``explain``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vendorlytics.plans.lazy import Datasets
from vendorlytics.sources import schemas

# Day-first timestamp text of the sales sheet export (fixed value).
SHEET_TIMESTAMP_FORMAT = "dd/MM/yyyy HH:mm:ss"


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the declared columns (case-insensitive match) cast to their
    declared types; a missing column is an error, extra columns are dropped."""
    present = {c.lower(): c for c in df.columns}
    cols = []
    for f in schema.fields:
        src = present.get(f.name.lower())
        if src is None:
            raise ValueError(f"input is missing column {f.name!r}")
        cols.append(F.col(f"`{src}`").cast(f.dataType).alias(f.name))
    return df.select(*cols)


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
               options: Mapping[str, str] | None = None) -> DataFrame:
    """One exported sheet or table (a file or a directory of files)."""
    reader = spark.read.options(**dict(options or {}))
    if fmt == "csv":
        # Text is read as text and cast, never type-guessed.
        text = T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema.fields])
        df = reader.option("header", "true").schema(text).csv(path)
    else:
        df = reader.format(fmt).load(path)
    return conform(df, schema)


def sheet_timestamp(name: str) -> Column:
    """Timestamp of a text column; text that is neither blank nor a timestamp fails
    the job with the column's name and the text."""
    text = F.col(name)
    unreadable = F.raise_error(F.concat(F.lit(f"unreadable timestamp in {name}: "), text)).cast("timestamp")
    return F.when(F.trim(text) != "", F.coalesce(
        F.try_to_timestamp(text, F.lit(SHEET_TIMESTAMP_FORMAT)), F.try_to_timestamp(text), unreadable))


def read_sales_sheet(spark: SparkSession, path: str, fmt: str = "csv",
                     options: Mapping[str, str] | None = None) -> DataFrame:
    """The raw sales sheet with its original headers, cut to the 35 used
    columns and renamed (D1's projection), then cast to ``SALES_ITEMS``."""
    reader = spark.read.options(**dict(options or {}))
    raw = reader.option("header", "true").csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    renamed = raw.select(*[F.col(f"`{src}`").alias(dst) for src, dst in schemas.SALES_SHEET_COLUMNS])
    # Text timestamps: the export's day-first pattern, else ISO; blank is NULL, anything else is an error.
    text_ts = {f.name for f in schemas.SALES_ITEMS.fields if isinstance(f.dataType, T.TimestampType)
               and isinstance(renamed.schema[f.name].dataType, T.StringType)}
    renamed = renamed.withColumns({c: sheet_timestamp(c) for c in sorted(text_ts)})
    return conform(renamed, schemas.SALES_ITEMS)


def read_jdbc_table(spark: SparkSession, table: str, schema: T.StructType, options: Mapping[str, str],
                    partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
                    num_partitions: int | None = None) -> DataFrame:
    """A whole database table (``SELECT *``), read in parallel ranges of a
    numeric column when given.  Connection options (url, user, password,
    driver) come from the caller; none are stored here.  Joins and
    aggregations then run in Spark, not in the database."""
    reader = spark.read.format("jdbc").options(**dict(options)).option("dbtable", table)
    if partition_column:
        reader = (reader.option("partitionColumn", partition_column).option("lowerBound", str(lower))
                  .option("upperBound", str(upper)).option("numPartitions", str(num_partitions)))
    return conform(reader.load(), schema)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def text_bounds(sample: Sequence[str | None], parts: int) -> list[str]:
    """At most ``parts - 1`` distinct cut values, at regular places of a sorted sample of a
    text key (e.g. one page of its index)."""
    known = sorted(k for k in sample if k is not None)
    return sorted({known[i * len(known) // parts] for i in range(1, parts)} - {known[0]}) if known else []


def text_predicates(column: str, bounds: Sequence[str], quote: str = '"') -> list[str]:
    """One WHERE condition per range of a text key.  Every key meets exactly one of them,
    NULL the first, whatever the database's collation: each bound closes one range and opens
    the next under the same comparison, and bounds are re-ordered by nobody."""
    name = quote + column.replace(quote, quote * 2) + quote
    if not bounds:
        return ["1 = 1"]
    cuts = [_quoted(b) for b in bounds]
    first = f"({name} < {cuts[0]} OR {name} IS NULL)"
    last = " AND ".join(f"{name} >= {c}" for c in cuts)
    middle = [" AND ".join([*(f"{name} >= {c}" for c in cuts[:i]), f"{name} < {cuts[i]}"]) for i in range(1, len(cuts))]
    return [first, *middle, last]


def read_jdbc_by_text(spark: SparkSession, table: str, schema: T.StructType, options: Mapping[str, str], column: str,
                      bounds: Sequence[str], quote: str = '"') -> DataFrame:
    """A whole table whose key is text, one connection per range of ``text_predicates``."""
    more = dict(options)
    url = more.pop("url")
    return conform(spark.read.jdbc(url, table, predicates=text_predicates(column, bounds, quote), properties=more), schema)


def read_jdbc_query(spark: SparkSession, query: str, options: Mapping[str, str]) -> DataFrame:
    """A query run by the database (its result read back in one stream).
    Prefer ``read_jdbc_table`` + Spark joins for anything large."""
    return spark.read.format("jdbc").options(**dict(options)).option("query", query).load()


def read_tables(spark: SparkSession, base: str, tables: Mapping[str, T.StructType],
                fmt: str = "parquet") -> Datasets:
    """``{name: read_table(base/name)}`` for a set of declared tables; each
    table is opened (files listed, footers read) only when first used."""
    d = Datasets()
    for name, schema in tables.items():
        d.define(name, lambda n=name, sc=schema: read_table(spark, f"{base.rstrip('/')}/{n}", sc, fmt))
    return d
