"""Hand-made domain fixtures with the real column names; expected rows written
from the formulas, one case per semantics-register row where practical."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from vendorlytics.params import ScorecardParams
from vendorlytics.plans import pnl, sales, scorecard
from vendorlytics.sources import schemas

from conftest import rows

TS = dt.datetime


def _df(spark, schema, data):
    return spark.createDataFrame(data, schema)


def scorecard_fixture(spark):
    p = ScorecardParams(month_from="2023-10", month_to="2023-10")
    t = {
        "orders": _df(spark, schemas.ORDERS, [
            (1, TS(2023, 10, 2, 4, 0), "A1", "confirmed", None),
            (2, TS(2023, 9, 30, 19, 0), "A2", "confirmed", None),   # 00:30 on 1 Oct local -> in October
            (3, TS(2023, 10, 5, 4, 0), "A3", "cancelled", None),
            (4, TS(2023, 10, 6, 4, 0), "A4", "confirmed", TS(2023, 10, 7)),  # soft-deleted
            (5, TS(2023, 9, 30, 18, 0), "A5", "confirmed", None),   # 23:30 on 30 Sep local -> September
            (6, TS(2023, 10, 8, 4, 0), "A6", "confirmed", None),
        ]),
        "order_items": _df(spark, schemas.ORDER_ITEMS, [
            (11, 1, 100, Decimal("100"), 2, Decimal("60")),
            (12, 2, 100, Decimal("50"), 1, Decimal("40")),
            (13, 3, 101, Decimal("80"), 1, Decimal("10")),
            (14, 4, 101, Decimal("80"), 1, Decimal("10")),
            (15, 5, 101, Decimal("80"), 1, Decimal("10")),
            (16, 6, 102, Decimal("0"), 1, Decimal("0")),
        ]),
        "product_variants": _df(spark, schemas.PRODUCT_VARIANTS, [
            (100, 10, "S1", 5, None), (101, 10, "S2", 0, None), (102, 11, "S3", 60, None), (103, 12, "S4", 1, None)]),
        "products": _df(spark, schemas.PRODUCTS, [
            (10, 1, TS(2020, 1, 1), None), (11, 2, TS(2020, 1, 1), None), (12, 3, TS(2020, 1, 1), None)]),
        "suppliers": _df(spark, schemas.SUPPLIERS, [(1, "V1", None), (2, "V2", None), (3, "ReviewsOnly", None)]),
        "return_items": _df(spark, schemas.RETURN_ITEMS, [(11, 900), (11, 901)]),  # item in two returns
        "returns": _df(spark, schemas.DB_RETURNS, [
            (900, True, "Received damaged products", "RETURN_COMPLETED"),
            (901, None, "Changed my mind", "RETURN_COMPLETED")]),
        "shipping_order_items": _df(spark, schemas.SHIPPING_ORDER_ITEMS, [(11, 7), (12, 8), (16, 9)]),
        "shipping_packages": _df(spark, schemas.SHIPPING_PACKAGES, [
            (7, TS(2023, 10, 4, 4, 0), "T7", "delivered"),
            (8, TS(2023, 9, 30, 19, 30), "T8", "dispatched"),      # same local day as the order: 1 Oct (Sunday)
            (9, TS(2023, 10, 9, 4, 0), "T9", "DL-Shipment Delivered")]),
        "product_reviews": _df(spark, schemas.PRODUCT_REVIEWS, [(10, 5), (10, 4), (12, 3)]),
        "calendar_h": _df(spark, schemas.CALENDAR_H, [
            (dt.date(2023, 10, d), 1 if d == 2 else 0, dt.date(2023, 10, d).isoweekday()) for d in range(1, 11)]),
    }
    return scorecard.build_scorecard(t, p)


def test_scorecard_extract_and_edges(spark):
    d = scorecard_fixture(spark)
    ex = {r["order_no"]: r for r in d["order_extract"].collect()}
    assert set(ex) == {"A1", "A2", "A3", "A6"}           # deleted order and September order excluded
    assert ex["A2"]["order_mnt"] == "2023-10"            # 330-minute shift moves it into October
    a1 = d["order_extract"].where("order_no = 'A1'").collect()
    assert len(a1) == 2 and {r["manufacturer_mistake"] for r in a1} == {"Yes", None}
    assert all(r["lp"] == Decimal("200") for r in a1)    # item fans out per return row (kept)
    assert ex["A3"]["order_status"] == "cancelled" and ex["A6"]["order_status"] == "delivered"
    days = dict(rows(d["working_days"], "tracking_number", "days_to_dispatch"))
    # 2 Oct (holiday) .. 4 Oct -> 3, 4 Oct = 2 days; T8: Sunday only -> absent; T9: 8 Oct (Sun) .. 9 Oct -> 1
    assert days == {"T7": 2, "T9": 1}


def test_scorecard_scores_and_nulls(spark):
    d = scorecard_fixture(spark)
    card = {r["display_name"]: r for r in d["vendor_scorecard"].collect()}
    assert set(card) == {"V1", "V2"}                     # reviews-only vendor has no orders -> dropped
    v1, v2 = card["V1"], card["V2"]
    assert v1["total_orders"] == 3 and v1["tot_skus"] == 2 and v1["avg_stock"] == 2.5
    assert v1["oos_perc"] == 0.5 and v1["OOSScore"] == 0
    assert v1["no_of_rating"] == 4                       # 2 reviews x 2 variants of product 10
    assert v1["RatScore"] == 2                           # 18 / 4 = 4.5
    assert v2["take_rate"] is None                       # lp = 0 -> NULL, not an error
    assert v2["avg_days_to_dispatch"] == 1.0 and v2["DispScore"] == 2
    q = {r["display_name"]: r for r in d["vendor_quality"].collect()}
    assert q["V1"]["defective_returns"] == 1 and q["V1"]["total_returns"] == 1
    assert q["V1"]["customer_returns"] == 0              # NULL mistake flag is not "not Yes"


def test_lifecycle_ladder_order(spark):
    cols = ["SaleOrderStatus", "SaleOrderItemStatus", "ShippingPackageStatusCode", "ReversePickupCode",
            "AllocatedStatus"]
    data = [("CANCELLED", "DELIVERED", "DELIVERED", None, 1, "Cancel"),
            ("COMPLETE", "CANCELLED", "DELIVERED", None, 1, "Cancel"),
            ("PROCESSING", "DELIVERED", "SHIPPED", None, 0, "Processing"),
            ("COMPLETE", "DELIVERED", "RETURNED", None, -1, "Return"),      # Return tested before RTO
            ("COMPLETE", "DELIVERED", "RETURNED", None, 0, "RTO"),
            ("COMPLETE", "CREATED", "SHIPPED", None, 0, "In Transit"),
            ("COMPLETE", "DISPATCHED", "DELIVERED", None, 1, "COMPLETE"),
            ("COMPLETE", "CREATED", "DELIVERED", None, 0, None)]             # unlisted combination -> NULL
    df = spark.createDataFrame(data, "a string, b string, c string, d string, e int, want string").toDF(
        *cols, "want")
    got = df.select(sales.lifecycle_status().alias("s"), "want").collect()
    assert [r["s"] for r in got] == [r["want"] for r in got]


def test_pnl_packaging_and_defaults(spark):
    mart = spark.createDataFrame([
        ("2023-06", "F1", "O1", "COD", "A1", "COMPLETE", "CUSHIONS", "X", Decimal("10"), Decimal("100"),
         Decimal("60"), Decimal("10"), Decimal("5")),
        ("2023-06", "F1", "O1", "COD", "A1", "Cancel", "BEDSHEET", "X", Decimal("10"), Decimal("100"),
         Decimal("60"), Decimal("10"), Decimal("5")),
        ("2023-06", "F1", "O2", "Prepaid", "A2", "COMPLETE", "OTHER", "DECOR", Decimal("0"), Decimal("50"),
         Decimal("30"), Decimal("0"), Decimal("0")),
        ("2023-06", "F1", "O3", "Prepaid", "A3", "COMPLETE", "OTHER", "OTHER", Decimal("0"), Decimal("20"),
         Decimal("10"), Decimal("0"), Decimal("0")),
    ], "Month string, Facility string, OrderNo string, CODFlag string, AWB string, OrderStatus string, "
       "UC_Category string, Category string, Tax decimal(18,6), ListingPrice decimal(18,6), "
       "CostPrice decimal(18,6), Discount decimal(18,6), CODCharges decimal(18,6)")
    ledger = spark.createDataFrame([("A2", Decimal("3"), Decimal("40")), ("A2", Decimal("1"), Decimal("10"))],
                                   "AWB string, CODCost decimal(18,6), ShippingCharge decimal(18,6)")
    from vendorlytics.params import PnlParams
    p = PnlParams(months=("2023-06",))
    lines = {r["OrderNo"]: r for r in pnl.pnl_lines(mart, p).collect()}
    assert lines["O1"]["PackagingCost"] == 15 and lines["O1"]["OrderStatus"] == 1   # every row counts
    assert lines["O1"]["LP"] == Decimal("100")                                     # completed rows only
    assert lines["O2"]["PackagingCost"] == 2 and lines["O3"]["PackagingCost"] is None
    cost = pnl.pnl_cost_lines(pnl.pnl_lines(mart, p), ledger, p)
    c = rows(cost, "OrderNo", "CODCost", "ShippingCost")
    assert [r[0] for r in c] == ["O1", "O2", "O2", "O3"]                          # two charge rows fan out
    o1 = c[0]
    assert o1[2] == Decimal("125")                                                 # flat shipping default
    assert abs(float(o1[1]) - (100 - 10 + 5) * 0.015 / 1.2) < 1e-6                 # COD fee net of 20% tax
    assert c[3][1] == 0                                                            # prepaid, no charge -> 0
