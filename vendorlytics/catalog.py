"""Registered check queries: one per dataset/operator, each ``(spark, sf_dir)
-> DataFrame`` over the driver's test tables via ``sources.proxies``.

``for_check`` brings results to the types the DuckDB oracle produces: exact
decimals -> DOUBLE (the conversion is deterministic in both engines), dates
-> ISO text, small integers -> BIGINT.  Doubles are compared as they are:
every double is computed by the same IEEE operations in both engines (exact
decimal sums cast to double, then one division).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vendorlytics.catalog_params import TEST_PNL, TEST_ROS, TEST_SCORECARD, TEST_SOURCING
from vendorlytics.plans import sales, scorecard, shipping
from vendorlytics.plans.marketplace import build_marketplace
from vendorlytics.plans.sales import lifecycle_status
from vendorlytics.sources.proxies import sales_items_text, sales_tables, scorecard_tables
from vendorlytics.sources.rejects import split_rejects
from vendorlytics.sources.schemas import SALES_ITEMS
from vendorlytics.sources.testdata import DriverTables


def for_check(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, T.DecimalType):
            c = c.cast("double")
        elif isinstance(t, T.FloatType):
            c = c.cast("double")
        elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _scorecard(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return scorecard.build_scorecard(scorecard_tables(DriverTables(spark, sf_dir)), TEST_SCORECARD)


def _pick(builder: Callable[[SparkSession, str], dict[str, DataFrame]], name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return for_check(builder(spark, sf_dir)[name])
    run.__name__ = name
    return run


def _marketplace(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    t = sales_tables(DriverTables(spark, sf_dir))
    d = build_marketplace(t, TEST_ROS, TEST_PNL, TEST_SOURCING, share_lines=True)
    projected = ("SaleOrderItemCode", "DisplayOrderCode", "SellerSKU", "UnitsSold", "ListingPrice")
    d.define("return_allocation", lambda: d["allocated"].select(
        *projected, "OrderStatusMod", "AllocatedStatus", "ClaimReason"))
    d.define("lifecycle_status", lambda: d["allocated"].select(*projected, lifecycle_status().alias("OrderStatus")))
    d.define("sales_ingest", lambda: d["sales"])
    d.define("locf_fill", lambda: sales.clean_catalogue(t["catalogue"]).select(
        "pos", "Handle", "Variant SKU", "Type", "Vendor"))

    def rejects() -> DataFrame:
        _, bad = split_rejects(sales_items_text(t["sales_items"]), SALES_ITEMS)
        code = F.get_json_object("text", "$.SaleOrderItemCode")
        return bad.select(code.alias("SaleOrderItemCode"), F.explode("faults").alias("_f")).select(
            "SaleOrderItemCode", F.col("_f.column").alias("Column"), F.col("_f.text").alias("Text"))

    d.define("sales_rejects", rejects)

    def normalised() -> DataFrame:
        parts = [shipping.normalise_charges(t[f"carrier_{c.lower()}"], cols).withColumn("Carrier", F.lit(c))
                 for c, cols in (("A", shipping.CARRIER_A), ("B", shipping.CARRIER_B), ("C", shipping.CARRIER_C))]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    d.define("carrier_normalise", normalised)
    return d


MARKETPLACE_KEYS = ("sales_ingest", "sales_rejects", "locf_fill", "sku_catalogue", "return_claims", "return_allocation",
                    "lifecycle_status", "first_order_month", "order_totals", "sales_mart", "rate_of_sale",
                    "category_revenue", "active_listing", "launch_month_revenue", "carrier_normalise",
                    "carrier_union", "shipment_facts", "shipping_ledger", "facility_dim", "pnl_lines",
                    "pnl_cost_lines", "pnl_cost_lines_by_awb", "pnl_month_facility", "material_clean", "product_header",
                    "catalogue_segments", "catalogue_union", "monthly_sku_sales", "sourcing_report")

SCORECARD_KEYS = ("order_extract", "order_extract_items", "working_days", "vendor_dispatch", "vendor_quality", "vendor_ratings",
                  "vendor_assortment", "vendor_spine", "vendor_scorecard")


@lru_cache(maxsize=1)
def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for k in SCORECARD_KEYS:
        q[k] = _pick(_scorecard, k)
    for k in MARKETPLACE_KEYS:
        q[k] = _pick(_marketplace, k)
    return q
