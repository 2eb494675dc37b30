"""The batch jobs end to end on the smallest test data: inputs written as
declared tables, outputs written and read back."""

import os
import tempfile

from vendorlytics.catalog_params import TEST_PNL, TEST_ROS, TEST_SCORECARD, TEST_SOURCING
from vendorlytics.plans import jobs
from vendorlytics.plans.marketplace import build_marketplace
from vendorlytics.session import checkpoint_dir
from vendorlytics.sources import readers, schemas, sinks
from vendorlytics.sources.proxies import sales_tables, scorecard_tables
from vendorlytics.sources.testdata import DriverTables

from conftest import SF_SMALL


def _stage(spark, tables, decl, base):
    for name, schema in decl.items():
        sinks.write_table(readers.conform(tables[name], schema), f"{base}/{name}")


def test_marketplace_job_writes_all_outputs(spark):
    work = tempfile.mkdtemp(prefix="vl-job-")
    _stage(spark, sales_tables(DriverTables(spark, SF_SMALL)), schemas.SPREADSHEET_TABLES, f"{work}/in")
    paths = jobs.run_marketplace(spark, f"{work}/in", f"{work}/out", ros=TEST_ROS, pnl_params=TEST_PNL,
                                 src=TEST_SOURCING)
    assert set(paths) == set(jobs.MARKETPLACE_OUTPUTS)
    counts = {k: spark.read.parquet(v).count() for k, v in paths.items()}
    assert counts["uc_mod"] > 0 and counts["PnL"] > 0 and counts["sourcing"] > 0 and counts["facility_map"] > 0


def test_scorecard_job_writes_tsv(spark):
    work = tempfile.mkdtemp(prefix="vl-job-")
    _stage(spark, scorecard_tables(DriverTables(spark, SF_SMALL)), schemas.DATABASE_TABLES, f"{work}/in")
    out = jobs.run_scorecard(spark, f"{work}/in", f"{work}/card", p=TEST_SCORECARD)
    files = [f for f in os.listdir(out) if f.endswith(".csv")]
    assert len(files) == 1
    lines = open(os.path.join(out, files[0])).read().splitlines()
    assert lines[0].split("\t")[:3] == ["order_mnt", "display_name", "avg_stock"] and len(lines) > 1


def _bag(df):
    cols = sorted(df.columns)
    return sorted(tuple(str(r[c]) for c in cols) for r in df.collect())


def test_outputs_equal_the_datasets_and_a_rerun_over_fewer_months_replaces_them(spark):
    work = tempfile.mkdtemp(prefix="vl-job-")
    tables = sales_tables(DriverTables(spark, SF_SMALL))
    _stage(spark, tables, schemas.SPREADSHEET_TABLES, f"{work}/in")
    args = dict(ros=TEST_ROS, pnl_params=TEST_PNL, src=TEST_SOURCING)
    jobs.run_marketplace(spark, f"{work}/in", f"{work}/out", **args)
    early = spark.read.parquet(f"{work}/in/sales_items").where("OrderDate < '1998-06-01'")
    for name in schemas.SPREADSHEET_TABLES:
        df = early if name == "sales_items" else spark.read.parquet(f"{work}/in/{name}")
        sinks.write_table(df, f"{work}/less/{name}")
    again = jobs.run_marketplace(spark, f"{work}/less", f"{work}/out", **args)
    fresh = jobs.run_marketplace(spark, f"{work}/less", f"{work}/fresh", **args)
    d = build_marketplace(readers.read_tables(spark, f"{work}/less", schemas.SPREADSHEET_TABLES),
                          TEST_ROS, TEST_PNL, TEST_SOURCING)
    for name in jobs.MARKETPLACE_OUTPUTS:
        assert _bag(spark.read.parquet(again[name])) == _bag(spark.read.parquet(fresh[name])), name
    for name, dataset in (("uc_mod", "sales_mart"), ("cat_1", "active_listing"), ("ship_chrg", "shipping_ledger"),
                          ("PnL", "pnl_month_facility"), ("sourcing", "sourcing_report")):
        written = spark.read.parquet(again[name])
        assert sorted(written.columns) == sorted(d[dataset].columns)
        assert _bag(written) == _bag(d[dataset]), name


def test_scorecard_job_leaves_no_extract_behind(spark):
    work = tempfile.mkdtemp(prefix="vl-job-")
    _stage(spark, scorecard_tables(DriverTables(spark, SF_SMALL)), schemas.DATABASE_TABLES, f"{work}/in")
    jobs.run_scorecard(spark, f"{work}/in", f"{work}/card", p=TEST_SCORECARD)
    left = os.listdir(checkpoint_dir(spark).removeprefix("file:"))
    assert not [x for x in left if x.startswith("vendorlytics-scorecard-")]


def _changed_inputs(spark, base, work):
    """A later state of the inputs: late returns, new and corrected lines, a customer's first
    order cancelled, and a month whose lines are all gone."""
    from pyspark.sql import functions as F

    lines = spark.read.parquet(f"{base}/sales_items")
    returns = spark.read.parquet(f"{base}/returns")
    late = returns.where(F.col("Order Number").isNotNull() & (F.pmod(F.xxhash64("Order Number"), F.lit(40)) == 0))
    first = lines.where("BillingAddressPhone IS NOT NULL").groupBy("BillingAddressPhone").agg(F.min("OrderDate").alias("d")) \
        .orderBy("BillingAddressPhone").limit(3)
    firsts = [(r.BillingAddressPhone, r.d) for r in first.collect()]
    gone = lines.agg(F.min(F.date_format("OrderDate", "yyyy-MM"))).first()[0]
    cancelled = F.lit(False)
    for phone, day in firsts:
        cancelled = cancelled | ((F.col("BillingAddressPhone") == phone) & (F.col("OrderDate") == F.lit(day)))
    old = lines.where(~F.col("SaleOrderItemCode").endswith("77"))  # these come only with the later state
    new = lines.where(F.date_format("OrderDate", "yyyy-MM") != gone).withColumn(
        "SaleOrderStatus", F.when(cancelled, "CANCELLED").otherwise(F.col("SaleOrderStatus")))
    for name in schemas.SPREADSHEET_TABLES:
        df = spark.read.parquet(f"{base}/{name}")
        sinks.write_table({"sales_items": old, "returns": returns.exceptAll(late)}.get(name, df), f"{work}/before/{name}")
        sinks.write_table({"sales_items": new}.get(name, df), f"{work}/after/{name}")
    return gone


def test_update_equals_the_full_run_and_rebuilds_the_touched_months(spark):
    work = tempfile.mkdtemp(prefix="vl-job-")
    _stage(spark, sales_tables(DriverTables(spark, SF_SMALL)), schemas.SPREADSHEET_TABLES, f"{work}/in")
    gone = _changed_inputs(spark, f"{work}/in", work)
    args = dict(ros=TEST_ROS, pnl_params=TEST_PNL, src=TEST_SOURCING)
    paths = jobs.run_marketplace(spark, f"{work}/before", f"{work}/out", **args)
    was = {x for x in os.listdir(paths["uc_mod"]) if x.startswith("Month=")}
    kept = {m: sorted(os.listdir(f"{paths['uc_mod']}/{m}")) for m in was}
    months = jobs.run_marketplace_update(spark, f"{work}/after", f"{work}/before", f"{work}/out", **args)
    fresh = jobs.run_marketplace(spark, f"{work}/after", f"{work}/fresh", **args)
    for name in jobs.MARKETPLACE_OUTPUTS:
        assert _bag(spark.read.parquet(paths[name])) == _bag(spark.read.parquet(fresh[name])), name
    assert gone in months and f"Month={gone}" not in os.listdir(paths["uc_mod"])
    untouched = {m for m in was if m.removeprefix("Month=") not in months}
    assert untouched and len(months) < len(was)
    assert {m: sorted(os.listdir(f"{paths['uc_mod']}/{m}")) for m in untouched} == {m: kept[m] for m in untouched}
    assert jobs.run_marketplace_update(spark, f"{work}/after", f"{work}/after", f"{work}/out", **args) == []
