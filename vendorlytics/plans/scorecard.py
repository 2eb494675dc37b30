"""Vendor scorecard (database pipeline): order extract -> working days to
dispatch -> monthly dispatch and quality measures, ratings, assortment ->
banded scorecard.

Inputs are the operational tables (orders, order_items, product_variants,
products, suppliers, return_items, returns, shipping_order_items,
shipping_packages, product_reviews, calendar_h) as DataFrames, read with
``sources.readers`` from files or JDBC.  All joins and aggregations run in
Spark; nothing is pushed to, or pulled through, a single database session.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vendorlytics import params as P
from vendorlytics.functions.expr import band, first_match, month_text, safe_div, shift_minutes, sum_money
from vendorlytics.operators.conditional_distinct import conditional_distinct_counts
from vendorlytics.operators.prefilter import may_match
from vendorlytics.operators.shared import shared
from vendorlytics.operators.union import union_distinct
from vendorlytics.operators.working_days import working_days
from vendorlytics.plans.lazy import Datasets

MONTH_KEYS = ["order_mnt", "display_name"]


def _utc_bounds(p: P.ScorecardParams) -> tuple[str, str]:
    """Local-month period -> half-open UTC range, so the filter reaches the scan
    as two bounds on ``created_at`` instead of a function of it."""
    lo = datetime.strptime(p.month_from + "-01", "%Y-%m-%d")
    hi = datetime.strptime(p.month_to + "-01", "%Y-%m-%d")
    hi = (hi.replace(day=28) + timedelta(days=4)).replace(day=1)
    off = timedelta(minutes=p.tz_offset_minutes)
    return (lo - off).strftime("%Y-%m-%d %H:%M:%S"), (hi - off).strftime("%Y-%m-%d %H:%M:%S")


def _first_link(links: DataFrame, id_col: str, out: str) -> DataFrame:
    """``links`` with a flag on each item's first link by id."""
    turn = F.row_number().over(Window.partitionBy("_item_id").orderBy(F.col(id_col).asc_nulls_last()))
    return links.withColumn(out, turn == 1)


def order_extract(orders: DataFrame, order_items: DataFrame, product_variants: DataFrame,
                  products: DataFrame, suppliers: DataFrame, return_items: DataFrame,
                  returns: DataFrame, shipping_order_items: DataFrame, shipping_packages: DataFrame,
                  p: P.ScorecardParams = P.ScorecardParams(), dedupe_items: bool = False) -> DataFrame:
    """Order-item extract at (month, day, dispatch day, order, vendor,
    tracking no., mistake flag, reason, status) grain with summed LP and CP.

    The month's orders meet their items first; what follows is as small as the
    period: the item's links to returns and packages, then those tables by their
    own ids.  Items of other orders, their links and what these lead to are left out
    before the exchanges (``may_match``).  The vendor chain (variant -> product -> supplier) is joined among
    itself.  Left-join soft-delete predicates are applied to the right side before
    the join (same result).
    """
    off = p.tz_offset_minutes
    lo, hi = _utc_bounds(p)
    ts_type = orders.schema["created_at"].dataType
    o = (orders.where(F.col("deleted_at").isNull()
                      & (F.col("created_at") >= F.lit(lo).cast(ts_type))
                      & (F.col("created_at") < F.lit(hi).cast(ts_type)))
         .select(F.col("id").alias("_order_id"), "order_number", "status",
                 shift_minutes("created_at", off).alias("_local")))
    oi = order_items.select(F.col("id").alias("_item_id"), F.col("order_id").alias("_order_id"),
                            F.col("product_variant_id").alias("_variant_id"), "variant_price", "quantity",
                            "variant_inventory_cost_price")
    oi = may_match(oi, "_order_id", o)

    s = suppliers.where(F.col("deleted_at").isNull()).select(F.col("id").alias("_supplier_id"), "display_name")
    pr = products.where(F.col("deleted_at").isNull()).select(F.col("id").alias("_product_id"),
                                                             F.col("supplier_id").alias("_supplier_id"))
    variant_vendor = (product_variants.where(F.col("deleted_at").isNull())
                      .select(F.col("id").alias("_variant_id"), F.col("product_id").alias("_product_id"))
                      .join(pr, "_product_id", "left").join(s, "_supplier_id", "left")
                      .select("_variant_id", "display_name"))

    r = returns.select(F.col("id").alias("_return_id"), "manufacturer_mistake",
                       F.col("reason").alias("return_reason"), "shipment_tracking_status")
    item_returns = return_items.select(F.col("order_item_id").alias("_item_id"),
                                       F.col("return_id").alias("_return_id"), F.lit(True).alias("_has_return"))
    sp = shipping_packages.select(F.col("id").alias("_package_id"), "dispatched_at",
                                  "tracking_number", "courier_status")
    item_packages = shipping_order_items.select(F.col("order_item_id").alias("_item_id"),
                                                F.col("shipping_package_id").alias("_package_id"))

    item_returns, item_packages = (may_match(links, "_item_id", oi) for links in (item_returns, item_packages))
    r, sp = may_match(r, "_return_id", item_returns), may_match(sp, "_package_id", item_packages)
    lp = F.col("variant_price") * F.col("quantity")
    cp = F.col("variant_inventory_cost_price") * F.col("quantity")
    if dedupe_items:
        item_returns = _first_link(item_returns, "_return_id", "_first_return")
        item_packages = _first_link(item_packages, "_package_id", "_first_package")
        once = F.coalesce("_first_return", F.lit(True)) & F.coalesce("_first_package", F.lit(True))
        lp, cp = F.when(once, lp), F.when(once, cp)

    # The return links meet their returns first: few and narrow rows, and the items, most of
    # them without a return, need no exchange by return id (all NULLs in one task).
    fact = (oi.join(o, "_order_id", "inner")
            .join(variant_vendor, "_variant_id", "left")
            .join(item_returns.join(r, "_return_id", "left"), "_item_id", "left")
            .join(item_packages, "_item_id", "left")
            .join(sp, "_package_id", "left"))

    status = first_match([
        (F.col("status") == P.DB_STATUS_CANCELLED, P.DB_STATUS_CANCELLED),
        (F.col("shipment_tracking_status") == P.DB_TRACKING_RTO, P.DB_STATUS_RTO),
        (F.col("_has_return"), P.DB_STATUS_RETURN),
        (F.upper("courier_status").isin(*P.DB_DELIVERED_COURIER_STATUSES), P.DB_STATUS_DELIVERED),
    ], F.col("status"))
    mistake = F.when(F.col("manufacturer_mistake"), P.YES).when(~F.col("manufacturer_mistake"), P.NO)
    rows = fact.select(
                month_text("_local").alias("order_mnt"),
                F.to_date("_local").alias("order_dt"),
                F.to_date(shift_minutes("dispatched_at", off)).alias("dispatch_dt"),
                F.col("order_number").alias("order_no"),
                "display_name", "tracking_number",
                mistake.alias("manufacturer_mistake"),
                "return_reason",
                status.alias("order_status"),
                lp.alias("_lp"), cp.alias("_cp"))
    return (rows.groupBy("order_mnt", "order_dt", "dispatch_dt", "order_no", "display_name", "tracking_number",
                         "manufacturer_mistake", "return_reason", "order_status")
            .agg(sum_money(rows, "_lp").alias("lp"), sum_money(rows, "_cp").alias("cp")))


def dispatch_working_days(extract: DataFrame, calendar: DataFrame,
                          p: P.ScorecardParams = P.ScorecardParams()) -> DataFrame:
    """Distinct working days from order day to dispatch day, both
    counted, per tracking number; numbers with none are absent."""
    working = (F.col("holiday_flag") == 0) & (F.col("day") != p.weekly_off_day)
    return working_days(extract.select("tracking_number", "order_dt", "dispatch_dt"),
                        "tracking_number", "order_dt", "dispatch_dt", calendar, "dt", working,
                        out="days_to_dispatch")


def vendor_dispatch(extract: DataFrame, days: DataFrame) -> DataFrame:
    """Shipments and average working days to dispatch per (month, vendor).

    The average is over extract rows (a shipment with several rows weighs
    more), as in the original.  Rows are first counted per (month, vendor,
    tracking no.), so the join to ``days`` carries one row per shipment.
    """
    per_shipment = extract.groupBy(*MONTH_KEYS, "tracking_number").agg(F.count(F.lit(1)).alias("_rows"))
    joined = per_shipment.join(days, "tracking_number", "left")
    d = F.col("days_to_dispatch")
    return joined.groupBy(*MONTH_KEYS).agg(
        F.count("tracking_number").alias("shipments"),
        F.try_divide(F.sum(d * F.col("_rows")).cast("double"),
                     F.sum(F.when(d.isNotNull(), F.col("_rows"))).cast("double")).alias("avg_days_to_dispatch"))


def vendor_quality(extract: DataFrame) -> DataFrame:
    """Distinct-order counts of defective, wrong-dispatch, customer
    returns, returns and RTOs, all orders, and LP/CP sums per (month, vendor)."""
    mistake = F.col("manufacturer_mistake")
    reason = F.col("return_reason")
    status = F.col("order_status")
    return conditional_distinct_counts(
        extract, MONTH_KEYS, "order_no",
        conditions={
            "defective_returns": (mistake == P.YES) & (reason == P.DB_REASON_DAMAGED),
            "wrong_dispatch": (mistake == P.YES) & (reason == P.DB_REASON_WRONG),
            "customer_returns": (status == P.DB_STATUS_RETURN) & (mistake != P.YES),
            "total_returns": status == P.DB_STATUS_RETURN,
            "total_rtos": status == P.DB_STATUS_RTO,
        },
        sums={"lp": F.col("lp"), "cp": F.col("cp")},
        distinct_name="total_orders",
    ).select(*MONTH_KEYS, "defective_returns", "wrong_dispatch", "customer_returns", "total_returns",
             "total_rtos", "total_orders", "lp", "cp")


def _variant_vendor(product_variants: DataFrame, products: DataFrame, suppliers: DataFrame) -> DataFrame:
    p = products.select(F.col("id").alias("_pid"), F.col("supplier_id").alias("_sid"), "published_at")
    s = suppliers.select(F.col("id").alias("_sid"), "display_name")
    return (product_variants.select(F.col("product_id").alias("_vpid"), "sku", "inventory_quantity")
            .join(p, F.col("_vpid") == F.col("_pid"), "left")
            .join(s, "_sid", "left"))


def vendor_ratings(product_variants: DataFrame, products: DataFrame, suppliers: DataFrame,
                   product_reviews: DataFrame) -> DataFrame:
    """Number and total of ratings per vendor, every review counted once
    per variant of its product (as the original join does).

    Reviews are aggregated per product before the join (map-side combined, so a
    product holding a third of all reviews is not one task), then multiplied by
    the product's variant count: same totals, no fan-out of the review rows.
    """
    per_product = product_reviews.groupBy(F.col("product_id").alias("_pid")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("rating").alias("_sum"))
    variants = (_variant_vendor(product_variants, products, suppliers)
                .where(F.col("_pid").isNotNull())
                .groupBy("_pid", "display_name").agg(F.count(F.lit(1)).alias("_variants")))
    joined = variants.join(per_product, "_pid", "inner")
    return joined.groupBy("display_name").agg(
        F.sum(F.col("_n") * F.col("_variants")).alias("no_of_rating"),
        F.sum(F.col("_sum") * F.col("_variants")).alias("total_rating"))


def vendor_assortment(product_variants: DataFrame, products: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Distinct SKUs, distinct in-stock SKUs and average stock per vendor
    over published products (two-stage, no ``Expand``)."""
    rows = _variant_vendor(product_variants, products, suppliers).where(F.col("published_at").isNotNull())
    return conditional_distinct_counts(
        rows, ["display_name"], "sku",
        conditions={"is_skus": F.col("inventory_quantity") > 0},
        avgs={"avg_stock": F.col("inventory_quantity")},
        distinct_name="tot_skus",
    ).select("display_name", "tot_skus", "is_skus", "avg_stock")


def vendor_spine(dispatch: DataFrame, assortment: DataFrame, ratings: DataFrame,
                 quality: DataFrame) -> DataFrame:
    """Every vendor name seen in any of the four tables (UNION)."""
    return union_distinct([d.select("display_name") for d in (dispatch, assortment, ratings, quality)])


def vendor_scorecard(quality: DataFrame, assortment: DataFrame, dispatch: DataFrame, ratings: DataFrame,
                     p: P.ScorecardParams = P.ScorecardParams()) -> DataFrame:
    """Per (month, vendor) with orders: stock, orders, dispatch days,
    out-of-stock %, return %, ratings, LP, SKUs, take rate and seven banded
    scores (unmatched or NULL -> 0).  NULL vendor names never match.  Vendors with
    orders are those of ``quality``, so the spine of all names isn't needed."""
    q = quality.where((F.col("total_orders") > 0) & F.col("display_name").isNotNull())
    base = (q.join(assortment, "display_name", "left")
            .join(dispatch, MONTH_KEYS, "left")
            .join(ratings, "display_name", "left"))
    oos = 1 - safe_div("is_skus", "tot_skus")
    ret = safe_div("total_returns", "total_orders")
    bad = safe_div(F.col("defective_returns") + F.col("wrong_dispatch"), "total_orders")
    rating = safe_div("total_rating", "no_of_rating")
    take = 1 - safe_div("cp", "lp")
    return base.select(
        "order_mnt", "display_name", "avg_stock", "total_orders", "avg_days_to_dispatch",
        oos.alias("oos_perc"), ret.alias("return_perc"), "no_of_rating", "lp", "tot_skus",
        take.alias("take_rate"),
        band("tot_skus", p.sku_count_bands).alias("SKUCountScore"),
        band("avg_stock", p.inventory_bands).alias("InvtScore"),
        band("total_orders", p.order_bands).alias("OrderScore"),
        band("avg_days_to_dispatch", p.dispatch_bands).alias("DispScore"),
        band(oos, p.oos_bands).alias("OOSScore"),
        band(bad, p.return_bands).alias("RetScore"),
        band(rating, p.rating_bands).alias("RatScore"),
    )


def build_scorecard(t: dict[str, DataFrame], p: P.ScorecardParams = P.ScorecardParams(),
                    persist: bool = False) -> Datasets:
    """The whole database pipeline from the eleven operational tables, each
    dataset built on first access.  The extract feeds three datasets, which read it
    through ``shared``: its exchanges are written once for all that a query needs.  With
    ``persist`` the extract itself is computed once."""
    d = Datasets(persist)
    d.define("order_extract", lambda: order_extract(
        t["orders"], t["order_items"], t["product_variants"], t["products"], t["suppliers"], t["return_items"],
        t["returns"], t["shipping_order_items"], t["shipping_packages"], p), shared=True)
    d.define("order_extract_items", lambda: order_extract(
        t["orders"], t["order_items"], t["product_variants"], t["products"], t["suppliers"], t["return_items"],
        t["returns"], t["shipping_order_items"], t["shipping_packages"], p, dedupe_items=True))
    d.define("whole_extract", lambda: shared(d["order_extract"]))
    d.define("working_days", lambda: dispatch_working_days(d["whole_extract"], t["calendar_h"], p))
    d.define("vendor_dispatch", lambda: vendor_dispatch(d["whole_extract"], d["working_days"]))
    d.define("vendor_quality", lambda: vendor_quality(d["whole_extract"]))
    d.define("vendor_ratings", lambda: vendor_ratings(t["product_variants"], t["products"], t["suppliers"],
                                                      t["product_reviews"]))
    d.define("vendor_assortment", lambda: vendor_assortment(t["product_variants"], t["products"], t["suppliers"]))
    d.define("vendor_spine", lambda: vendor_spine(d["vendor_dispatch"], d["vendor_assortment"],
                                                  d["vendor_ratings"], d["vendor_quality"]))
    d.define("vendor_scorecard", lambda: vendor_scorecard(d["vendor_quality"], d["vendor_assortment"],
                                                          d["vendor_dispatch"], d["vendor_ratings"], p))
    return d
