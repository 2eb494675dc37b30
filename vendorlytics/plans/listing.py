"""Rate of sale (D12), monthly category revenue (D13), active listings
and revenue by launch month (D15), all read from the sales mart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendorlytics import params as P
from vendorlytics.functions.expr import ilike, safe_div, sum_money

ROS_KEYS = ("ItemSKUCode", "Facility", "UC_Category", "SubCat", "Category", "Department", "ProductName")


def rate_of_sale(mart: DataFrame, inventory: DataFrame, p: P.RateOfSaleParams = P.RateOfSaleParams(),
                 order_dates: DataFrame | None = None) -> DataFrame:
    """Units per day and revenue at risk over the trailing window, with
    stock on hand.

    The window end is the latest order date (or ``p.as_of``), a scalar
    subquery: the whole computation stays one plan and nothing is collected
    by the caller.  Stock is summed per SKU before the join.

    ``order_dates`` (any frame with the lines' ``OrderDate``, e.g. the ingested
    sales) gives the same latest date from a one-column scan; otherwise the
    subquery would have to recompute the grouped mart.
    """
    dates = mart if order_dates is None else order_dates
    hi = F.to_date(F.lit(p.as_of)) if p.as_of else dates.agg(F.max("OrderDate")).scalar()
    window = mart.where(F.col("OrderDate").between(F.date_sub(hi, p.window_days), hi))
    # Per-line price per unit as an exact decimal, so the average does not
    # depend on the order of addition.
    unit_price = safe_div("SellingPrice", "UnitsSold").cast("decimal(38,10)")
    ros = window.groupBy(*ROS_KEYS).agg(
        (F.sum("UnitsSold") / F.lit(p.divisor)).alias("ROS"),
        (F.try_divide(F.sum(unit_price).cast("double"), F.count(unit_price).cast("double"))
         * F.sum("UnitsSold")).alias("RevLoss"))
    soh = inventory.groupBy(F.col("Item SkuCode").alias("ItemSKUCode")).agg(F.sum("Inventory").alias("SOH"))
    return ros.join(soh, "ItemSKUCode", "left").select(*ROS_KEYS, "ROS", "RevLoss", "SOH")


def category_revenue(mart: DataFrame, calendar: DataFrame) -> DataFrame:
    """Completed revenue per (channel product, category, order month)."""
    cal = calendar.select(F.col("dt").alias("OrderDate"), F.col("mnt_no").alias("Order_Month"))
    return (mart.where(F.col("OrderStatus") == P.STATUS_COMPLETE)
            .join(cal, "OrderDate", "left")
            .groupBy(F.col("ChannelProductID").alias("ChannelProductId"), "Category", "Order_Month")
            .agg(sum_money(mart, "SellingPrice").alias("Revenue")))


def _active(listing: DataFrame) -> DataFrame:
    # The original's LIKE ignores case; there is no wildcard, so this is a
    # case-insensitive equality.
    return listing.where(ilike("ListingStatus", P.LISTING_ACTIVE_PATTERN))


def active_listing(listing: DataFrame, item_master_2: DataFrame, calendar: DataFrame,
                   uc_cat: DataFrame, catalogue: DataFrame) -> DataFrame:
    """D14 (``cat_1``): active listings with brand, category, type, launch
    month, stock flag and lifetime completed revenue (0 when none).  Duplicate
    catalogue SKUs fan out, as in the original."""
    im2 = item_master_2.select(F.col("Product Code").alias("SKU Code"), "Category Name")
    cal = calendar.select(F.col("dt").alias("Created"), F.col("mnt_no").alias("Create_Month"))
    rev = uc_cat.groupBy(F.col("ChannelProductId").alias("Channel Product Id")).agg(F.sum("Revenue").alias("_rev"))
    cat = catalogue.select(F.col("Variant SKU").alias("Seller SKU on Channel"),
                           F.col("Vendor").alias("Brand"), F.col("Type").alias("SubCategory"))
    j = (_active(listing).join(im2, "SKU Code", "left").join(cal, "Created", "left")
         .join(rev, "Channel Product Id", "left").join(cat, "Seller SKU on Channel", "left"))
    return j.select(
        "SKU Code", "Brand", F.col("Category Name").alias("Category"), "SubCategory", "Create_Month",
        F.when(F.col("Last Inventory Update") > 0, P.FLAG_IN_STOCK).otherwise(P.FLAG_OOS).alias("Instock_Flag"),
        F.coalesce("_rev", F.lit(0)).alias("Revenue"))


def launch_month_revenue(uc_cat: DataFrame, listing: DataFrame, calendar: DataFrame,
                         item_master_2: DataFrame, catalogue: DataFrame) -> DataFrame:
    """D15 (``cat_2``): completed revenue by order month, category, type, brand
    and launch month of the active listing (inner join to listings)."""
    lst = _active(listing).select(F.col("Channel Product Id").alias("ChannelProductId"), "Created",
                                  "SKU Code", "Seller SKU on Channel")
    cal = calendar.select(F.col("dt").alias("Created"), F.col("mnt_no").alias("Launch_Month"))
    im2 = item_master_2.select(F.col("Product Code").alias("SKU Code")).withColumn("_im2", F.lit(1))
    cat = catalogue.select(F.col("Variant SKU").alias("Seller SKU on Channel"),
                           F.col("Type").alias("SubCategory"), F.col("Vendor").alias("Brand"))
    j = (uc_cat.join(lst, "ChannelProductId", "inner").join(cal, "Created", "left")
         .join(im2, "SKU Code", "left").join(cat, "Seller SKU on Channel", "left"))
    return (j.groupBy("Order_Month", "Category", "SubCategory", "Brand", "Launch_Month")
            .agg(F.sum("Revenue").alias("Revenue")))
