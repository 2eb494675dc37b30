"""Properties over the smallest test data."""

from pyspark.sql import functions as F

from vendorlytics.catalog_params import TEST_PNL, TEST_ROS, TEST_SOURCING
from vendorlytics.plans.marketplace import build_marketplace
from vendorlytics.sources.proxies import sales_tables
from vendorlytics.sources.testdata import DriverTables

from conftest import SF_SMALL


def _marketplace(spark):
    return build_marketplace(sales_tables(DriverTables(spark, SF_SMALL)), TEST_ROS, TEST_PNL, TEST_SOURCING)


def test_allocation_count_identity(spark):
    """Per (order, SKU): returned lines after allocation = max(min(Q, n), m),
    with Q the claimed quantity (0 without a claim), n the lines and m the
    lines already returned before allocation."""
    d = _marketplace(spark)
    claims = d["return_claims"].select(F.col("Order Number").alias("DisplayOrderCode"),
                                       F.col("SKU").alias("SellerSKU"), "TOT_QNT")
    per_group = (d["allocated"].groupBy("DisplayOrderCode", "SellerSKU").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("OrderStatusMod") == -1, 1).otherwise(0)).alias("m"),
        F.sum(F.when(F.col("AllocatedStatus") == -1, 1).otherwise(0)).alias("after"))
        .join(claims, ["DisplayOrderCode", "SellerSKU"], "left"))
    q = F.coalesce(F.col("TOT_QNT"), F.lit(0))
    bad = per_group.where(F.col("after") != F.greatest(F.least(q, F.col("n")), F.col("m")))
    assert per_group.count() > 0 and bad.count() == 0
    assert per_group.where(F.col("TOT_QNT").isNotNull() & (F.col("n") > 1)).count() > 0


def test_pnl_facilities_sum_to_ungrouped_total(spark):
    d = _marketplace(spark)
    by_facility = d["pnl_month_facility"].groupBy("Month").agg(
        F.sum("ListingPrice").alias("lp"), F.sum("CODCost").alias("cod"), F.sum("Tax1").alias("t1"))
    lines = d["pnl_cost_lines"]
    total = lines.groupBy("Month").agg(
        F.sum("LP").alias("lp"), F.sum("CODCost").alias("cod"),
        F.sum(F.when(F.col("OrderStatus") == 0,
                     (F.col("LP") - F.col("Discount") + F.col("CODCharges"))
                     - F.try_divide((F.col("LP") - F.col("Discount") - F.col("CODCharges")).cast("double"),
                                    1 + F.col("Tax").cast("double") / 100).cast("decimal(38,6)"))
              .otherwise(F.lit(0))).alias("t1"))
    a = {r["Month"]: (r["lp"], r["cod"], r["t1"]) for r in by_facility.collect()}
    b = {r["Month"]: (r["lp"], r["cod"], r["t1"]) for r in total.collect()}
    assert a and a.keys() == b.keys()
    for m in a:
        assert a[m][0] == b[m][0] and a[m][1] == b[m][1] and a[m][2] == b[m][2]


def test_mart_rows_and_measures_preserved(spark):
    """The 33-key grouping only merges identical dimension tuples: measures
    summed over the mart equal those summed over its lines."""
    d = _marketplace(spark)
    cols = ["SellingPrice", "ListingPrice", "UnitsSold", "Tax"]
    a = d["sales_mart"].agg(*[F.sum(c).alias(c) for c in cols]).collect()[0]
    b = d["mart_lines"].agg(*[F.sum(c).alias(c) for c in cols]).collect()[0]
    assert all(a[c] == b[c] for c in cols)
