"""Every registered query against its DuckDB oracle on the smallest scale
factor (the driver repeats this at sf0.01)."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from vendorlytics import catalog, oracle

VIEWS = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for v in VIEWS:
        con.execute(f"CREATE VIEW {v} AS SELECT * FROM read_parquet('{SF_SMALL}/{v}.parquet')")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return repr(v)
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


def _bag(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in records)


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(oracle.ORACLE)
    assert set(catalog.queries()) <= set(entry.queries()) and set(oracle.ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("key", sorted(catalog.queries()))
def test_query_matches_oracle(spark, duck, key):
    df = catalog.queries()[key](spark, SF_SMALL)
    res = duck.execute(oracle.ORACLE[key])
    o_cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(o_cols)
    assert _bag(df.columns, [tuple(r) for r in df.collect()]) == _bag(o_cols, res.fetchall())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "SKUCountScore" in df.columns


@pytest.mark.parametrize("key", ["order_extract", "vendor_scorecard", "carrier_union"])
def test_results_do_not_depend_on_session_time_zone(spark, duck, key):
    """Timestamps are shifted by a fixed offset, never by the session zone."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        df = entry.queries()[key](spark, SF_SMALL)
        got = _bag(df.columns, [tuple(r) for r in df.collect()])
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
        spark.catalog.clearCache()
    res = duck.execute(entry.oracle_sql()[key])
    assert got == _bag([d[0] for d in res.description], res.fetchall())
