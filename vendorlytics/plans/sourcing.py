"""Sourcing report (D24-D29): catalogue attributes, six catalogue segments
and their union, monthly SKU sales, and live-SKU counts, prices and sales by
month and attribute group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vendorlytics import params as P
from vendorlytics.functions.expr import ilike, strip_chars, sum_money, typed_null
from vendorlytics.operators.live_periods import running_live

MATERIAL_FIELD = "Metafield: my_fields.material [list.single_line_text_field]"
THREAD_COUNT_FIELD = "Metafield: custom.thread_count [number_integer]"
SEGMENT_COLUMNS = ("VariantSKU", "Vendor", "SubCategory", "Size", "CreateMonth", "Material", "TC", "SP", "CP")
SEGMENTS = ("Bedsheets", "Dohar", "Cushions", "Lamps", "Clocks", "Wall")


def prepare_metafields(metafields: DataFrame) -> DataFrame:
    """Creation timestamp text cut to its month (``yyyy-MM``)."""
    return metafields.withColumn("Created At", F.substring("Created At", 1, 7))


def material_attributes(metafields: DataFrame) -> DataFrame:
    """Distinct (ID, Material, TC) with a material or a thread count;
    brackets and quotes are removed from the material list afterwards."""
    return (metafields.select("ID", F.col(f"`{MATERIAL_FIELD}`").alias("Material"), F.col(f"`{THREAD_COUNT_FIELD}`").alias("TC"))
            .where(F.col("Material").isNotNull() | F.col("TC").isNotNull())
            .distinct()
            .withColumn("Material", strip_chars("Material", '[]"')))


def product_headers(catalogue: DataFrame) -> DataFrame:
    """Distinct (Handle, Vendor, Type) with a vendor or a type."""
    return (catalogue.where((F.length("Vendor") > 0) | (F.length("Type") > 0))
            .select("Handle", "Vendor", "Type").distinct())


def _segment_rows(catalogue: DataFrame, metafields: DataFrame, attributes: DataFrame,
                  headers: DataFrame) -> DataFrame:
    """Every (segment, row) pair, from one pass over the catalogue.

    The six segment queries of the original share their joins; here the joins
    run once and each row emits one struct per segment it qualifies for.
    Multiplicities differ from six separate joins only by exact duplicates,
    which the per-segment ``DISTINCT`` removes anyway.
    """
    meta = metafields.select(F.col("Variant SKU").alias("_msku"), F.col("ID").alias("_mid"),
                             F.col("Created At").alias("CreateMonth"))
    attrs = attributes.select(F.col("ID").alias("_mid"), "Material", "TC")
    beds = (headers.where(F.col("Type") == P.SEGMENT_BEDSHEETS_TYPE)
            .select(F.col("Handle").alias("_h"), F.col("Vendor").alias("_hvendor"), F.col("Type").alias("_htype")))
    base = (catalogue.select(F.col("Variant SKU").alias("VariantSKU"), "Handle", "Vendor", "Type",
                             F.col("Option1 Value").alias("_size"), F.col("Variant Price").alias("SP"),
                             F.col("Cost per item").alias("CP"))
            .join(meta, F.col("VariantSKU") == F.col("_msku"), "left")
            .join(attrs, "_mid", "left")
            .join(beds, F.col("Handle") == F.col("_h"), "left"))

    t = F.col("Type")
    up = F.upper(t)
    no_tc = typed_null("int")
    no_size = typed_null("string")

    def seg(name: str, cond: Column, vendor: Column, sub: Column, size: Column, tc: Column) -> Column:
        return F.when(cond, F.struct(F.lit(name).alias("Segment"), vendor.alias("Vendor"),
                                     sub.alias("SubCategory"), size.alias("Size"), tc.cast("int").alias("TC")))

    wall = ~t.isin(*P.SEGMENT_REMAINDER_EXCLUDED_TYPES)
    for pattern in P.SEGMENT_REMAINDER_EXCLUDED_PATTERNS:
        wall = wall & ~up.like(pattern)
    gsm_size = F.when(ilike("_size", P.SEGMENT_GSM_PATTERN), P.SEGMENT_GSM_SIZE).otherwise(F.col("_size"))
    picks = F.array(
        seg("Bedsheets", F.col("_htype").isNotNull(), F.col("_hvendor"), F.col("_htype"), F.col("_size"), F.col("TC")),
        seg("Dohar", t.isin(*P.SEGMENT_DOHAR_TYPES), F.col("Vendor"), t, gsm_size, no_tc),
        seg("Cushions", ilike(t, P.SEGMENT_CUSHION_PATTERN), F.col("Vendor"), t, F.col("_size"), no_tc),
        seg("Lamps", up.like(P.SEGMENT_LAMP_PATTERN), F.col("Vendor"), t, no_size, no_tc),
        seg("Clocks", up.like(P.SEGMENT_CLOCK_PATTERN), F.col("Vendor"), t, no_size, no_tc),
        seg("Wall", wall, F.col("Vendor"), t, no_size, no_tc))
    rows = (base.select("VariantSKU", "CreateMonth", "Material", "SP", "CP", F.explode(picks).alias("_s"))
            .where(F.col("_s").isNotNull()))
    return rows.select("_s.Segment", "VariantSKU", "_s.Vendor", "_s.SubCategory", "_s.Size", "CreateMonth",
                       "Material", "_s.TC", "SP", "CP")


def catalogue_segments(catalogue: DataFrame, metafields: DataFrame, attributes: DataFrame,
                       headers: DataFrame) -> DataFrame:
    """The six segments, each de-duplicated, labelled by ``Segment``."""
    return _segment_rows(catalogue, metafields, attributes, headers).distinct()


def textiles(catalogue: DataFrame, metafields: DataFrame, attributes: DataFrame, headers: DataFrame) -> DataFrame:
    """``UNION`` of the six segments (rows equal in all nine columns
    collapse, whatever segment they came from)."""
    return _segment_rows(catalogue, metafields, attributes, headers).select(*SEGMENT_COLUMNS).distinct()


def monthly_sku_sales(mart: DataFrame) -> DataFrame:
    """Completed units and listing price per (month, seller SKU)."""
    return (mart.where(F.col("OrderStatus") == P.STATUS_COMPLETE)
            .groupBy(F.col("Month").alias("ReportMonth"), "SellerSKU")
            .agg(F.sum("UnitsSold").alias("UnitsSold"), sum_money(mart, "ListingPrice").alias("ListingPrice")))


def sourcing_report(textile: DataFrame, calendar: DataFrame, monthly_sales: DataFrame, subcat_map: DataFrame,
                    p: P.SourcingParams = P.SourcingParams()) -> DataFrame:
    """Per report month (every calendar month from the SKU's creation
    month to the cut-off) and attribute group: live SKUs, average selling and
    cost price, units and listing price sold that month; groups without a
    department are dropped.  Running sums over months: no row per SKU and month."""
    sub = subcat_map.where(F.col("Dep").isNotNull()).select(F.col("SubCat").alias("SubCategory"), "Dep")
    report = running_live(
        textile.join(sub, "SubCategory", "inner"), "CreateMonth", calendar, "mnt_no", p.cutoff_month, "ReportMonth",
        group_cols=("SubCategory", "Vendor", "Size", "Material", "TC", "Dep"), id_col="VariantSKU",
        distinct_name="SKUCount", avgs={"AvgSP": "SP", "AvgCP": "CP"},
        monthly=monthly_sales, monthly_month="ReportMonth", monthly_id="SellerSKU",
        sums={"UnitsSold": "UnitsSold", "ListingPrice": "ListingPrice"})
    return report.select("ReportMonth", "SubCategory", "Vendor", "Size", "Material", "TC", "SKUCount", "AvgSP",
                         "AvgCP", "UnitsSold", "ListingPrice", "Dep")
