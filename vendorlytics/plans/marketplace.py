"""The spreadsheet pipeline end to end: thirteen input tables -> the sales
mart and every table derived from it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from vendorlytics import params as P
from vendorlytics.operators.shared import shared
from vendorlytics.plans import listing, pnl, sales, shipping, sourcing
from vendorlytics.plans.lazy import Datasets

OUTPUTS = ("sales", "catalogue", "sku_catalogue", "return_claims", "allocated", "first_order_month",
           "order_totals", "mart_lines", "sales_mart", "rate_of_sale", "category_revenue", "active_listing",
           "launch_month_revenue", "carrier_union", "shipment_facts", "shipping_ledger", "facility_dim",
           "pnl_lines", "pnl_cost_lines", "pnl_month_facility", "metafields", "material_clean",
           "product_header", "catalogue_segments", "catalogue_union", "monthly_sku_sales", "sourcing_report")


def build_marketplace(t: dict[str, DataFrame], ros: P.RateOfSaleParams = P.RateOfSaleParams(),
                      pnl_params: P.PnlParams = P.PnlParams(), src: P.SourcingParams = P.SourcingParams(),
                      tie_break: Sequence[str] | None = None, persist: bool = False,
                      heavy: Mapping[str, Sequence] | None = None, share_lines: bool = False) -> Datasets:
    """All datasets as lazy DataFrames, each built on first access.  With
    ``persist`` the cleaned catalogue (read by three datasets) is computed
    once.  The wide sales tables are not persisted: measured at sf0.1, building
    the in-memory cache of forty columns costs more than recomputing them; a
    job that writes several outputs writes the mart and reads it back instead
    (see ``plans.jobs``).

    ``share_lines`` is for sales items that are themselves made by joins: where one dataset
    reads them whole and by a few columns too, both read them through ``shared``, so that
    the joins' exchanges are written once.  From a file each reads its columns instead."""
    d = Datasets(persist)
    d.define("sales", lambda: sales.ingest_sales(t["sales_items"]))
    d.define("catalogue", lambda: sales.clean_catalogue(t["catalogue"]), shared=True)
    d.define("sku_catalogue", lambda: sales.sku_catalogue(d["catalogue"]))
    d.define("return_claims", lambda: sales.return_claims(t["returns"]))
    d.define("allocated", lambda: sales.allocate_returns(d["sales"], d["return_claims"], tie_break, heavy))
    # First month and order totals use no allocation column: read the lines.
    d.define("first_order_month", lambda: sales.first_order_month(d["sales"]))
    d.define("order_totals", lambda: sales.order_totals(d["sales"]))

    d.define("whole_sales", lambda: sales.ingest_sales(shared(t["sales_items"], sales.ORDER)) if share_lines else d["sales"])

    def mart(build, cohorts: bool, lines: str = "sales", **options) -> DataFrame:
        return build(d[lines], d["return_claims"], t["listing_master"], t["calendar"], t["pincodes"],
                     d["sku_catalogue"], t["subcat_map"], tie_break, heavy, cohorts=cohorts, **options)

    d.define("mart_lines", lambda: mart(sales.mart_lines, True))
    d.define("sales_mart", lambda: mart(sales.sales_mart, True, "whole_sales"))
    # For datasets that don't read the customers' first months: the same rows without that lookup.
    d.define("plain_lines", lambda: mart(sales.mart_lines, False))
    d.define("complete_lines", lambda: mart(sales.mart_lines, False, completed=True))
    d.define("plain_mart", lambda: mart(sales.sales_mart, False))

    # Latest order date from the lines (every line is in the mart with its date).
    d.define("rate_of_sale", lambda: listing.rate_of_sale(d["plain_mart"], t["inventory"], ros, d["sales"]))
    # Sums over coarser keys read the mart's rows before its grouping (same sums).
    d.define("category_revenue", lambda: listing.category_revenue(d["complete_lines"], t["calendar"]))
    d.define("active_listing", lambda: listing.active_listing(
        t["listing_master"], t["item_master_2"], t["calendar"], d["category_revenue"], d["catalogue"]))
    d.define("launch_month_revenue", lambda: listing.launch_month_revenue(
        d["category_revenue"], t["listing_master"], t["calendar"], t["item_master_2"], d["catalogue"]))

    d.define("carrier_union", lambda: shipping.carrier_union(t["carrier_a"], t["carrier_b"], t["carrier_c"]))
    d.define("shipment_facts", lambda: shipping.shipment_facts(d["plain_lines"]))
    d.define("shipping_ledger", lambda: shipping.shipping_ledger(d["carrier_union"], d["shipment_facts"]))
    d.define("facility_dim", lambda: shipping.facility_dim(d["shipment_facts"]))

    d.define("pnl_lines", lambda: pnl.pnl_lines(d["plain_mart"], pnl_params))
    d.define("pnl_whole_lines", lambda: pnl.pnl_lines(mart(sales.sales_mart, False, "whole_sales"), pnl_params))
    # P&L needs the ledger's charges and how often each stands there, not its facts: the mart is built once.
    d.define("parcel_charges", lambda: shipping.parcel_charges(
        d["carrier_union"], shipping.parcels(d["whole_sales"], t["pincodes"])))
    d.define("pnl_cost_lines", lambda: pnl.pnl_cost_lines(d["pnl_whole_lines"], d["parcel_charges"], pnl_params))
    d.define("pnl_cost_lines_by_awb", lambda: pnl.pnl_cost_lines(d["pnl_lines"], d["carrier_union"], pnl_params, one_charge=True))
    d.define("pnl_month_facility", lambda: pnl.pnl_month_facility(d["pnl_cost_lines"], pnl_params))

    d.define("metafields", lambda: sourcing.prepare_metafields(t["metafields"]))
    d.define("material_clean", lambda: sourcing.material_attributes(d["metafields"]))
    d.define("product_header", lambda: sourcing.product_headers(d["catalogue"]))
    d.define("catalogue_segments", lambda: sourcing.catalogue_segments(
        d["catalogue"], d["metafields"], d["material_clean"], d["product_header"]))
    d.define("catalogue_union", lambda: sourcing.textiles(
        d["catalogue"], d["metafields"], d["material_clean"], d["product_header"]))
    d.define("monthly_sku_sales", lambda: sourcing.monthly_sku_sales(d["complete_lines"]))
    d.define("sourcing_report", lambda: sourcing.sourcing_report(
        d["catalogue_union"], t["calendar"], d["monthly_sku_sales"], t["subcat_map"], src))
    return d
