import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from vendorlytics import params as P
from vendorlytics.functions import expr
from vendorlytics.functions.expr import band, bucket, elapsed_months, ilike, month_start, safe_div, shift_minutes


def test_safe_div_null_on_zero(spark):
    df = spark.createDataFrame([(1, 0), (1, 4), (None, 2), (3, None)], "a int, b int")
    got = [r[0] for r in df.select(safe_div("a", "b")).collect()]
    assert got == [None, 0.25, None, None]


def test_elapsed_months_whole_months(spark):
    df = spark.createDataFrame([(dt.date(2023, 3, 1), dt.date(2022, 11, 30)), (dt.date(2023, 1, 31), dt.date(2023, 1, 1))],
                               "e date, s date")
    assert [r[0] for r in df.select(elapsed_months("e", "s")).collect()] == [4, 0]


def test_scores_total_function(spark):
    # every input, NULL included, maps to a band; boundaries follow the rule order
    vals = [None, 0.0, 0.049, 0.05, 0.0999, 0.1, 5.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(band("x", P.RETURN_BANDS)).collect()]
    assert got == [0, 2, 2, 1, 1, 0, 0]
    d = spark.createDataFrame([(v,) for v in (None, 1.0, 1.5, 2.0, 2.5)], "x double")
    assert [r[0] for r in d.select(band("x", P.DISPATCH_BANDS)).collect()] == [0, 2, 1, 1, 0]


def test_order_value_buckets(spark):
    df = spark.createDataFrame([(None,), (999.99,), (1000.0,), (3999.0,), (4000.0,)], "v double")
    got = [r[0] for r in df.select(bucket("v", P.AOV_BUCKETS, P.AOV_TOP_LABEL)).collect()]
    assert got == [None, "<1K", "1K to 2K", "3K to 4K", "4K+"]


def test_like_ignores_case(spark):
    df = spark.createDataFrame([("x-rp1",), ("X-RP2",), ("plain",), (None,)], "o string")
    assert [r[0] for r in df.select(ilike("o", "%-RP%")).collect()] == [True, True, False, None]


def test_local_month_shift_crosses_month(spark):
    df = spark.createDataFrame([(dt.datetime(2023, 9, 30, 20, 0),), (dt.datetime(2023, 9, 30, 18, 29),)],
                               "ts timestamp_ntz")
    got = [r[0] for r in df.select(F.date_format(shift_minutes("ts", 330), "yyyy-MM")).collect()]
    assert got == ["2023-10", "2023-09"]


def test_month_start_null_stays_null(spark):
    df = spark.createDataFrame([("2023-06",), (None,)], "m string")
    assert [r[0] for r in df.select(month_start("m")).collect()] == [dt.date(2023, 6, 1), None]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_money_sums_have_no_ceiling_below_the_type(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        rows = [(1, Decimal(9 * 10**11))] * 20 + [(2, Decimal(9 * 10**12)), (2, Decimal(1))]
        df = spark.createDataFrame(rows, "g int, v decimal(24,6)")
        got = {r.g: (r.a, r.b) for r in df.groupBy("g").agg(
            expr.exact_sum("v", df.schema["v"].dataType).alias("a"), F.sum("v").alias("b")).collect()}
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    assert got[1] == (Decimal(18 * 10**12),) * 2 and got[2] == (Decimal(9 * 10**12 + 1),) * 2
