"""Batch jobs: read the declared input tables, build the datasets, write the
outputs (full recompute, overwrite).

    python -m vendorlytics.plans.jobs marketplace --input BASE --output OUT
    python -m vendorlytics.plans.jobs update --input NEW --previous BASE --output OUT
    python -m vendorlytics.plans.jobs scorecard --input BASE --output OUT --month 2023-10

The sales mart feeds five outputs.  It is written first and read back, which
both avoids recomputing it and cuts the lineage: if an executor is lost later,
the rest of the job restarts from the written mart, not from the raw inputs.
"""

from __future__ import annotations

import argparse
import uuid

from pyspark.sql import SparkSession

from vendorlytics import params as P
from vendorlytics.operators.heavy import heavy_keys
from vendorlytics.plans import listing, pnl, recompute, scorecard, shipping, sourcing
from vendorlytics.plans.marketplace import build_marketplace
from vendorlytics.session import build_session, checkpoint_dir
from vendorlytics.sources import readers, schemas, sinks

# Output table names of the spreadsheet pipeline (fixed values).
MARKETPLACE_OUTPUTS = ("uc_mod", "ros", "PnL", "ship_chrg", "sourcing", "cat_1", "cat_2", "calendar",
                       "facility_map")
# Keys of the sales lines that may be heavy: order, SKU, phone, pincode.
HEAVY_COLUMNS = ("DisplayOrderCode", "SellerSKU", "BillingAddressPhone", "ShippingAddressPincode")
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def run_marketplace(spark: SparkSession, input_base: str, output_base: str, fmt: str = "parquet",
                    ros: P.RateOfSaleParams = P.RateOfSaleParams(), pnl_params: P.PnlParams = P.PnlParams(),
                    src: P.SourcingParams = P.SourcingParams()) -> dict[str, str]:
    t = readers.read_tables(spark, input_base, schemas.SPREADSHEET_TABLES, fmt)
    d = build_marketplace(t, ros, pnl_params, src, heavy=heavy_keys(t["sales_items"], HEAVY_COLUMNS))
    out = output_base.rstrip("/")
    paths = {name: f"{out}/{name}" for name in MARKETPLACE_OUTPUTS}

    sinks.write_table(d["sales_mart"], paths["uc_mod"], partition_by=("Month",))
    _write_derived(spark, t, d, paths, ros, pnl_params, src)
    return paths


def run_marketplace_update(spark: SparkSession, input_base: str, previous_base: str, output_base: str, fmt: str = "parquet",
                           ros: P.RateOfSaleParams = P.RateOfSaleParams(), pnl_params: P.PnlParams = P.PnlParams(),
                           src: P.SourcingParams = P.SourcingParams()) -> list[str | None]:
    """Bring the outputs of a run over ``previous_base`` up to date with ``input_base``, where
    only sales lines and returns differ.  Of the mart, only the months that the change touches
    are computed and replaced (``plans.recompute``); the tables derived from it are small
    and written anew.  Returns the months rebuilt (one entry per calendar month at most)."""
    t = readers.read_tables(spark, input_base, schemas.SPREADSHEET_TABLES, fmt)
    before = readers.read_tables(spark, previous_base, schemas.SPREADSHEET_TABLES, fmt)
    heavy = heavy_keys(t["sales_items"], HEAVY_COLUMNS)
    d, old = build_marketplace(t, ros, pnl_params, src, heavy=heavy), build_marketplace(before, ros, pnl_params, src)
    out = output_base.rstrip("/")
    paths = {name: f"{out}/{name}" for name in MARKETPLACE_OUTPUTS}
    months = [r.Month for r in recompute.affected_months(
        old["sales"], d["sales"], old["return_claims"], d["return_claims"], t["calendar"]).collect()]
    if months:
        rebuilt = recompute.rebuild_months(d["sales"], d["return_claims"], t["listing_master"], t["calendar"], t["pincodes"],
                                           d["sku_catalogue"], t["subcat_map"], months, heavy=heavy)
        # Computed once into a folder of its own: its partitions tell which months are empty now.
        stage = f"{checkpoint_dir(spark)}/vendorlytics-months-{uuid.uuid4().hex}/uc_mod"
        sinks.write_table(rebuilt, stage, partition_by=("Month",))
        staged = spark.read.schema(rebuilt.schema).parquet(stage)
        left = {r.Month for r in staged.select("Month").distinct().collect()}
        sinks.write_table(staged, paths["uc_mod"], partition_by=("Month",), only_partitions=True)
        for month in set(months) - left:
            _delete(spark, f"{paths['uc_mod']}/Month={month if month is not None else NULL_PARTITION}")
        _delete(spark, stage.rpartition("/")[0])
        _write_derived(spark, t, d, paths, ros, pnl_params, src)
    return sorted(months, key=lambda m: (m is not None, m))


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _write_derived(spark: SparkSession, t, d, paths: dict[str, str], ros: P.RateOfSaleParams, pnl_params: P.PnlParams,
                   src: P.SourcingParams) -> None:
    """The outputs that follow from the written mart and the sheets."""
    mart = spark.read.schema(d["sales_mart"].schema).parquet(paths["uc_mod"])
    cal = t["calendar"]
    catalogue = d["catalogue"]
    uc_cat = listing.category_revenue(mart, cal)
    facts = shipping.shipment_facts(mart)
    ledger = shipping.shipping_ledger(shipping.carrier_union(t["carrier_a"], t["carrier_b"], t["carrier_c"]), facts)
    sinks.write_table(listing.rate_of_sale(mart, t["inventory"], ros), paths["ros"])
    sinks.write_table(ledger, paths["ship_chrg"])
    charges = spark.read.parquet(paths["ship_chrg"])
    lines = pnl.pnl_cost_lines(pnl.pnl_lines(mart, pnl_params), charges, pnl_params)
    sinks.write_table(pnl.pnl_month_facility(lines, pnl_params), paths["PnL"])
    meta = sourcing.prepare_metafields(t["metafields"])
    attrs = sourcing.material_attributes(meta)
    headers = sourcing.product_headers(catalogue)
    textile = sourcing.textiles(catalogue, meta, attrs, headers)
    sinks.write_table(sourcing.sourcing_report(textile, cal, sourcing.monthly_sku_sales(mart), t["subcat_map"], src),
                      paths["sourcing"])
    sinks.write_table(listing.active_listing(t["listing_master"], t["item_master_2"], cal, uc_cat, catalogue),
                      paths["cat_1"])
    sinks.write_table(listing.launch_month_revenue(uc_cat, t["listing_master"], cal, t["item_master_2"], catalogue),
                      paths["cat_2"])
    sinks.write_table(cal, paths["calendar"])
    sinks.write_table(shipping.facility_dim(facts), paths["facility_map"])


def run_scorecard(spark: SparkSession, input_base: str, output_path: str, fmt: str = "parquet",
                  p: P.ScorecardParams = P.ScorecardParams(), work_path: str | None = None) -> str:
    """The extract (nine-table join) feeds four datasets: it is written once
    (month-partitioned) to ``work_path``, by default a fresh folder under the
    cluster's shared ``spark.checkpoint.dir`` that is removed at the end, and read
    back, so it is computed once and later stages restart from it if an executor
    is lost."""
    t = readers.read_tables(spark, input_base, schemas.DATABASE_TABLES, fmt)
    extract_path = work_path or f"{checkpoint_dir(spark)}/vendorlytics-scorecard-{uuid.uuid4().hex}/extract"
    sinks.write_table(scorecard.order_extract(
        t["orders"], t["order_items"], t["product_variants"], t["products"], t["suppliers"], t["return_items"],
        t["returns"], t["shipping_order_items"], t["shipping_packages"], p), extract_path, partition_by=("order_mnt",))
    extract = spark.read.parquet(extract_path)
    days = scorecard.dispatch_working_days(extract, t["calendar_h"], p)
    dispatch = scorecard.vendor_dispatch(extract, days)
    quality = scorecard.vendor_quality(extract)
    ratings = scorecard.vendor_ratings(t["product_variants"], t["products"], t["suppliers"], t["product_reviews"])
    assortment = scorecard.vendor_assortment(t["product_variants"], t["products"], t["suppliers"])
    card = scorecard.vendor_scorecard(quality, assortment, dispatch, ratings, p)
    if p.month_from == p.month_to:  # the original's columns; several months need theirs to tell rows apart
        card = card.drop("order_mnt")
    # One row per (month, vendor): bounded by the vendor count, one file.
    sinks.write_tsv(card, output_path, single_file=True)
    if work_path is None:
        _delete(spark, extract_path.rpartition("/")[0])
    return output_path


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="vendorlytics")
    ap.add_argument("job", choices=("marketplace", "update", "scorecard"))
    ap.add_argument("--previous", help="update: the inputs of the run whose output is brought up to date")
    ap.add_argument("--input", required=True)
    ap.add_argument("--output", required=True)
    ap.add_argument("--format", default="parquet")
    ap.add_argument("--month", help="scorecard report month yyyy-MM (default: parameter default)")
    args = ap.parse_args(argv)
    # Master, executors and partition sizing come from the cluster submission.
    spark = build_session(app=f"vendorlytics-{args.job}")
    if args.job == "marketplace":
        run_marketplace(spark, args.input, args.output, args.format)
    elif args.job == "update":
        if not args.previous:
            ap.error("update needs --previous")
        run_marketplace_update(spark, args.input, args.previous, args.output, args.format)
    else:
        p = P.ScorecardParams(month_from=args.month, month_to=args.month) if args.month else P.ScorecardParams()
        run_scorecard(spark, args.input, args.output, args.format, p)


if __name__ == "__main__":
    main()
