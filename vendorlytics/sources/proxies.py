"""Domain tables derived from the driver's TPC-H-like test tables.

The test data has no marketplace tables, so each domain table is a lazy
DataFrame derived from ``lineitem``, ``orders``, ``part``, ``supplier``,
``customer``, ``nation``, ``region`` and ``events`` by fixed rules.  The
DuckDB oracle derives the same tables with the same rules in SQL
(``vendorlytics.oracle``), and the two sides are compared at sf0.01.  The
work therefore grows with the test tables.

Money is derived with exact decimal arithmetic (``double -> decimal(12,2)``
of a two-decimal source value, then decimal products), so sums agree to the
last digit between engines.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vendorlytics.plans.lazy import Datasets
from vendorlytics.sources.testdata import DriverTables


def _div(c: Column | str, n: int) -> Column:
    """Integer division of a non-negative integer column."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c / n).cast("long")


def _money(c: str) -> Column:
    return F.col(c).cast("decimal(12,2)")


def _ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


# ---------------------------------------------------------------- scorecard

def _order_created(o: DataFrame) -> DataFrame:
    return o.withColumn("_created", F.timestamp_add("MINUTE", F.col("o_orderkey") % 1440, F.col("o_orderdate")))


def _item_id() -> Column:
    """The whole tuple: two lines of an order may share any part of it."""
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _package_id(supplier: Column | str = "l_suppkey") -> Column:
    return F.concat_ws("-", F.col("l_orderkey"), F.col(supplier) if isinstance(supplier, str) else supplier)


def scorecard_tables(t: DriverTables) -> dict[str, DataFrame]:
    L, O, PT, S, E = t["lineitem"], t["orders"], t["part"], t["supplier"], t["events"]

    orders = _order_created(O).select(
        F.col("o_orderkey").alias("id"),
        F.col("_created").alias("created_at"),
        F.concat(F.lit("SO"), F.col("o_orderkey").cast("string")).alias("order_number"),
        F.when((F.col("o_orderstatus") == "P") & (F.col("o_custkey") % 4 == 0), "cancelled")
         .when(F.col("o_orderstatus") == "F", "completed")
         .when(F.col("o_orderstatus") == "O", "processing")
         .otherwise("pending").alias("status"),
        F.when(F.col("o_orderkey") % 97 == 3, F.col("_created")).alias("deleted_at"))

    order_items = L.select(
        _item_id().alias("id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_variant_id"),
        _money("l_extendedprice").alias("variant_price"),
        (F.col("l_linenumber") % 2 + 1).cast("int").alias("quantity"),
        (_money("l_extendedprice") * (F.lit(1) - F.col("l_discount").cast("decimal(3,2)"))
         * F.lit(Decimal("0.7"))).alias("variant_inventory_cost_price"))

    product_variants = PT.select(
        F.col("p_partkey").alias("id"),
        _div("p_partkey", 2).alias("product_id"),
        F.concat(F.lit("SKU"), _div("p_partkey", 3).cast("string")).alias("sku"),
        ((F.col("p_size") - 6) * (F.col("p_partkey") % 4 + 1)).cast("int").alias("inventory_quantity"),
        F.when(F.col("p_partkey") % 53 == 5, _ts("2000-01-01 00:00:00")).alias("deleted_at"))

    prod = PT.groupBy(_div("p_partkey", 2).alias("id")).agg(F.min("p_size").alias("_size"))
    # Supplier of the product's first line (by order, line number, supplier).
    first_line = F.min(F.struct("l_orderkey", "l_linenumber", "l_suppkey"))
    vendor = L.groupBy(_div("l_partkey", 2).alias("id")).agg(first_line["l_suppkey"].alias("supplier_id"))
    products = prod.join(vendor, "id", "left").select(
        "id", "supplier_id",
        F.when(F.col("_size") % 5 != 0, _ts("2020-01-01 00:00:00")).alias("published_at"),
        F.when(F.col("id") % 41 == 7, _ts("2021-01-01 00:00:00")).alias("deleted_at"))

    suppliers = S.select(
        F.col("s_suppkey").alias("id"),
        F.when(F.col("s_suppkey") % 41 != 13, F.col("s_name")).alias("display_name"),
        F.when(F.col("s_suppkey") % 37 == 11, _ts("2021-01-01 00:00:00")).alias("deleted_at"))

    returned = L.where((F.col("l_returnflag") == "R")
                       | ((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 45)))
    second = L.where((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 49))
    return_items = returned.select(_item_id().alias("order_item_id"), _item_id().alias("return_id")).unionAll(
        second.select(_item_id().alias("order_item_id"), F.concat(_item_id(), F.lit("-2")).alias("return_id")))
    returns = returned.select(
        _item_id().alias("id"),
        F.when(F.col("l_tax") > 0.05, True).when(F.col("l_tax") < 0.02, None)
         .otherwise(False).alias("manufacturer_mistake"),
        F.when(F.col("l_linenumber") % 3 == 0, "Received damaged products")
         .when(F.col("l_linenumber") % 3 == 1, "Received wrong or incorrect products")
         .otherwise("Changed my mind").alias("reason"),
        F.when(F.col("l_returnflag") == "A", "RETURNED_TO_ORIGIN")
         .otherwise("RETURN_COMPLETED").alias("shipment_tracking_status")).unionAll(
        second.select(F.concat(_item_id(), F.lit("-2")).alias("id"), F.lit(False).alias("manufacturer_mistake"),
                      F.lit("Size issue").alias("reason"),
                      F.lit("RETURN_COMPLETED").alias("shipment_tracking_status")))

    shipped = L.where(~((F.col("l_linestatus") == "O") & (F.col("l_linenumber") >= 6)))
    shipping_order_items = shipped.select(_item_id().alias("order_item_id"),
                                          _package_id().alias("shipping_package_id"))
    # Dealt by order for both the distinct and the join.
    packs = (shipped.select("l_orderkey", F.col("l_suppkey").alias("_sk")).repartition("l_orderkey").distinct()
             .join(_order_created(O).select(F.col("o_orderkey").alias("l_orderkey"), "_created"), "l_orderkey"))
    sk = F.col("_sk")
    shipping_packages = packs.select(
        _package_id(sk).alias("id"),
        F.when(sk % 9 != 8, F.timestamp_add("MINUTE", (sk % 4) * 1440 + (sk % 7) * 60, F.col("_created")))
         .alias("dispatched_at"),
        F.concat(F.lit("AWB"), _package_id(sk)).alias("tracking_number"),
        F.when(sk % 5 == 0, "delivered").when(sk % 5 == 1, "DL-Shipment Delivered")
         .when(sk % 5 == 2, "Dispatched").when(sk % 5 == 3, "in_transit")
         .otherwise("PICKUP_PENDING").alias("courier_status"))

    product_reviews = E.select(
        F.col("user_id").alias("product_id"),
        ((F.floor("value") + F.col("user_id")) % 5 + 1).cast("int").alias("rating"))

    calendar_h = (O.select(F.to_date("o_orderdate").alias("dt")).distinct()
                  .select("dt",
                          F.when(F.dayofmonth("dt").isin(1, 15), 1).otherwise(0).alias("holiday_flag"),
                          (F.weekday("dt") + 1).alias("day")))

    return {"orders": orders, "order_items": order_items, "product_variants": product_variants,
            "products": products, "suppliers": suppliers, "return_items": return_items,
            "returns": returns, "shipping_order_items": shipping_order_items,
            "shipping_packages": shipping_packages, "product_reviews": product_reviews,
            "calendar_h": calendar_h}


# ---------------------------------------------------------------- spreadsheet pipeline

def _code(prefix: str, *cols: Column | str, sep: str = "-") -> Column:
    parts: list[Column] = [F.lit(prefix)]
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(sep))
        parts.append((F.col(c) if isinstance(c, str) else c).cast("string"))
    return F.concat(*parts)


def _days(n: Column, ts: str) -> Column:
    return F.timestamp_add("DAY", n, F.col(ts))


# UC category by the first word of the part name (fixed proxy rule).
_UC_CATEGORY = (("blue", "CUSHIONS"), ("new", "TOWEL"), ("cold", "BATH"), ("small", "BEDSHEET"),
                ("red", "THROWS"), ("large", "DIWAN Set"), ("hot", "KITCHENWARE"), ("old", "DECOR ITEMS"))
# Catalogue product type by handle number mod 12 (fixed proxy rule); slot 9 has no type.
CATALOGUE_TYPES = ("Bedsheets", "Dohars", "Comforters", "Curtains", "Cushion Covers", "Table Lamp",
                   "Wall Clock", "Wall Hooks", "Floating Shelf", None, "cushion cover", "Lamp Clock")
# Sub-category map over the catalogue types: (SubCat, Category, Dep).
SUBCAT_ROWS = (("Bedsheets", "BED", "HOME"), ("Dohars", "BED", "HOME"), ("Comforters", "BED", "HOME"),
               ("Curtains", "FURNISHING", "HOME"), ("Cushion Covers", "FURNISHING", "HOME"),
               ("Table Lamp", "DECOR", "HOME"), ("Wall Clock", "DECOR", "HOME"), ("Wall Hooks", "KITCHEN", "HOME"),
               ("Floating Shelf", "KITCHEN", None), ("cushion cover", "FURNISHING", "HOME"),
               ("Lamp Clock", "DECOR", "LIVING"))


def _case(expr: Column, pairs) -> Column:
    out = None
    for k, v in pairs:
        out = F.when(expr == k, v) if out is None else out.when(expr == k, v)
    return out


def _seller_sku(partkey: str) -> Column:
    """One SKU for each fifty parts: as many more as there are parts, and still
    repeated within orders."""
    return _code("VS", _div(partkey, 50))


def sales_tables(t: DriverTables) -> Datasets:
    """The thirteen spreadsheet-pipeline tables, each built on first use."""
    L, O, PT, S, C, N, R = (t["lineitem"], t["orders"], t["part"], t["supplier"], t["customer"],
                            t["nation"], t["region"])
    lp = _money("l_extendedprice")
    disc = lp * F.col("l_discount").cast("decimal(3,2)")
    tax = F.col("l_tax").cast("decimal(4,2)")
    shipped = ~((F.col("l_linestatus") == "O") & (F.col("l_linenumber") >= 6))
    first_word = F.element_at(F.split("p_name", " "), 1)

    def sales_items() -> DataFrame:
        # Orders meet their customers among themselves, and lines come to their orders last: two
        # exchanges of the lines, and an order's lines stand together.  They meet by the order's
        # code, so the planner sees that they stand by it.
        ordered = (O.join(C.select("c_custkey", "c_nationkey"), O.o_custkey == C.c_custkey)
                   .withColumns({"DisplayOrderCode": _code("O", "o_orderkey"), "l_orderkey": F.col("o_orderkey")}))
        j = (L.join(S.select("s_suppkey", "s_nationkey"), L.l_suppkey == S.s_suppkey)
             .join(PT.select("p_partkey", first_word.alias("_word"), "p_retailprice"), L.l_partkey == PT.p_partkey)
             .withColumn("DisplayOrderCode", _code("O", "l_orderkey")).drop("l_orderkey")
             .join(ordered, "DisplayOrderCode"))
        return j.select(
            _code("I", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("SaleOrderItemCode"),
            "DisplayOrderCode",
            F.when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 1),
                   _code("RP", "l_orderkey")).alias("ReversePickupCode"),
            (F.col("l_linenumber") % 2).cast("int").alias("COD"),
            _case(F.col("_word"), _UC_CATEGORY).alias("Category"),
            # Two nations' customers, and the parts below, have keys that no dimension row has.
            (F.col("c_nationkey") + F.when(F.col("c_nationkey") < 22, 110000).otherwise(990000)).cast("string")
            .alias("ShippingAddressPincode"),
            _code("SKU", "l_partkey").alias("ItemSKUCode"),
            F.when(F.col("l_partkey") % 17 != 3, _code("CP", "l_partkey")).otherwise(_code("CPX", "l_partkey"))
            .alias("ChannelProductId"),
            (_money("p_retailprice") * F.col("l_quantity").cast("long")).alias("MRP"),
            (lp - disc).alias("SellingPrice"),
            (lp * F.lit(Decimal("0.65"))).alias("CostPrice"),
            F.when(F.col("l_discount") >= 0.08, _code("VC", F.substring("o_orderpriority", 1, 1))).alias("VoucherCode"),
            F.col("l_quantity").cast("long").alias("UnitsSold"),
            F.col("o_orderdate").alias("OrderDate"),
            F.when(F.col("o_orderstatus") == "F", "COMPLETE")
             .when((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 7 == 0), "CANCELLED")
             .when(F.col("o_orderstatus") == "O", "COMPLETE").otherwise("PROCESSING").alias("SaleOrderStatus"),
            F.when(F.col("l_linenumber") == 7, "CANCELLED").when(F.col("l_linestatus") == "F", "DELIVERED")
             .when(F.col("l_linenumber") <= 4, "DISPATCHED").otherwise("CREATED").alias("SaleOrderItemStatus"),
            F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 25), "RETURNED")
             .when(F.col("l_returnflag") == "R", "RETURN_EXPECTED")
             .when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"), "SHIPPED")
             .when(F.col("l_linestatus") == "F", "DELIVERED").otherwise("DISPATCHED").alias("ShippingPackageStatusCode"),
            F.col("o_orderpriority").alias("ShippingProvider"),
            F.when(shipped, _days((F.col("l_suppkey") % 4).cast("int"), "o_orderdate")).alias("DispatchDate"),
            F.when(F.col("l_linestatus") == "F",
                   _days((F.col("l_suppkey") % 4 + F.col("l_partkey") % 6).cast("int"), "o_orderdate"))
             .alias("DeliveryTime"),
            F.when(shipped, (F.col("l_orderkey") * 10 + F.col("l_suppkey") % 10).cast("string")).alias("AWB"),
            F.when(F.col("s_nationkey") < 24, _code("FAC", "s_nationkey")).alias("Facility"),
            _seller_sku("l_partkey").alias("SellerSKU"),
            F.when(F.col("o_custkey") % 50 != 0, _code("+91 ", "o_custkey")).alias("BillingAddressPhone"),
            disc.alias("Discount"),
            F.when(F.col("l_linenumber") % 3 != 0, tax * 50).alias("CGST"),
            F.when(F.col("l_linenumber") % 3 == 0, tax * 100).alias("IGST"),
            F.when(F.col("l_linenumber") % 3 != 0, tax * 50).alias("SGST"),
            F.when(F.col("l_quantity") < 10, F.lit(Decimal("40.00"))).alias("ShippingCharges"),
            F.when(F.col("l_linenumber") % 2 == 1, F.lit(Decimal("25.00"))).alias("CODServiceCharges"),
            lp.alias("ListingPrice"),
            F.when(F.col("l_linenumber") == 7, "Customer changed mind").alias("CancellationReason"),
            F.when(shipped, F.col("o_orderpriority")).alias("ShippingCourier"),
            F.when(shipped, F.col("o_orderdate")).alias("ShippingPackageCreationDate"),
            F.when(F.col("l_returnflag") == "R", "Size issue").alias("ReturnReason"))

    def returns() -> DataFrame:
        return L.where(F.col("l_tax") > 0.05).select(
            F.when(F.col("l_orderkey") % 101 != 0, _code("O", "l_orderkey")).alias("Order Number"),
            _seller_sku("l_partkey").alias("SKU"),
            F.lit(1).cast("long").alias("QNT"),
            F.when(F.col("l_linenumber") % 3 == 0, "Customer Reasons")
             .when(F.col("l_linenumber") % 3 == 1, "Defective/Damaged").otherwise("Wrong Dispatch").alias("VV Reason"))

    def launch() -> DataFrame:
        return (L.join(O, L.l_orderkey == O.o_orderkey)
                  .groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.to_date(F.min("o_orderdate")).alias("_launch")))

    def parts() -> DataFrame:
        return PT.join(launch(), "p_partkey", "left")

    def listing_master() -> DataFrame:
        return parts().select(
            _code("CP", "p_partkey").alias("Channel Product Id"),
            F.col("p_name").alias("Product Name on Channel"),
            F.when(F.col("p_partkey") % 13 != 0, _code("SKU", "p_partkey")).otherwise(_code("SKUX", "p_partkey"))
            .alias("SKU Code"),
            _code("VS", "p_partkey").alias("Seller SKU on Channel"),
            F.col("_launch").alias("Created"),
            (F.col("p_size") - 10).cast("decimal(12,2)").alias("Last Inventory Update"),
            F.when(F.col("p_partkey") % 10 == 0, "INACTIVE").when(F.col("p_partkey") % 10 == 1, "active")
             .otherwise("ACTIVE").alias("ListingStatus"))

    def item_master_2() -> DataFrame:
        return PT.select(
            _code("SKU", "p_partkey").alias("Product Code"), F.col("p_type").alias("Category Name"))

    def days() -> DataFrame:
        return O.select(F.to_date("o_orderdate").alias("dt")).distinct()

    def calendar() -> DataFrame:
        return days().select(
            "dt",
            F.concat(F.year("dt").cast("string"), F.lit("-W"),
                     F.lpad(F.weekofyear("dt").cast("string"), 2, "0")).alias("wk_nm"),
            F.date_format("dt", "yyyy-MM").alias("mnt_no"))

    def pincodes() -> DataFrame:
        return (N.join(R, N.n_regionkey == R.r_regionkey)
                    .select((F.col("n_nationkey") + 110000).cast("string").alias("Pincode"),
                            F.col("r_name").alias("State"), F.col("n_name").alias("District")))


    handle = _div("p_partkey", 4)
    slot = handle % 12
    type_expr = _case(slot, [(i, v) for i, v in enumerate(CATALOGUE_TYPES) if v is not None])

    def subcat_map() -> DataFrame:
        return (PT.select(type_expr.alias("SubCat")).where(F.col("SubCat").isNotNull()).distinct()
                      .join(_subcat_dim(t), "SubCat", "inner"))

    def catalogue() -> DataFrame:
        return PT.select(
            F.col("p_partkey").alias("pos"),
            _code("h-", handle).alias("Handle"),
            F.when(F.col("p_partkey") % 11 == 0, _code("'VS", "p_partkey")).otherwise(_code("VS", "p_partkey"))
             .alias("Variant SKU"),
            F.when(F.col("p_partkey") % 4 == 0, type_expr).when(F.col("p_partkey") % 4 == 1, F.lit(""))
             .alias("Type"),
            F.when(F.col("p_partkey") % 4 == 0, F.col("p_brand")).alias("Vendor"),
            F.when(F.col("p_size") % 4 == 0, "King").when(F.col("p_size") % 4 == 1, "Queen")
             .when(F.col("p_size") % 4 == 2, "300 GSM").otherwise("Single").alias("Option1 Value"),
            _money("p_retailprice").alias("Variant Price"),
            (_money("p_retailprice") * F.lit(Decimal("0.55"))).alias("Cost per item"))

    def inventory() -> DataFrame:
        return PT.select(_code("SKU", "p_partkey").alias("Item SkuCode"),
                              F.col("p_size").cast("long").alias("Inventory")).unionAll(
            PT.where(F.col("p_partkey") % 3 == 0).select(_code("SKU", "p_partkey").alias("Item SkuCode"),
                                                          F.lit(5).cast("long").alias("Inventory")))

    def metafields() -> DataFrame:
        return parts().select(
            _code("M", handle).alias("ID"),
            F.when(F.col("p_partkey") % 9 != 4, _code("VS", "p_partkey")).otherwise(_code("VSX", "p_partkey"))
            .alias("Variant SKU"),
            # One part in 29 has a blank start: it is live in every month.
            F.when(F.col("p_partkey") % 29 == 6, "").otherwise(F.date_format("_launch", "yyyy-MM-dd HH:mm:ss"))
            .alias("Created At"),
            F.when(F.col("p_partkey") % 5 == 0, '["Cotton"]').when(F.col("p_partkey") % 5 == 1, '["Cotton","Linen"]')
             .when(F.col("p_partkey") % 5 == 2, '["Velvet"]').when(F.col("p_partkey") % 5 == 4, '["Jute","Cotton"]')
             .alias("Metafield: my_fields.material [list.single_line_text_field]"),
            F.when(F.col("p_size") > 25, F.col("p_size") * 10).cast("int")
             .alias("Metafield: custom.thread_count [number_integer]"))


    carriers: list = []

    def carrier(i: int) -> DataFrame:
        if not carriers:
            carriers.extend(_carriers(L, O))
        return carriers[i]

    d = Datasets()
    for name, maker in (("sales_items", sales_items), ("returns", returns), ("listing_master", listing_master),
                        ("item_master_2", item_master_2), ("calendar", calendar), ("pincodes", pincodes),
                        ("subcat_map", subcat_map), ("catalogue", catalogue), ("inventory", inventory),
                        ("metafields", metafields), ("carrier_a", lambda: carrier(0)),
                        ("carrier_b", lambda: carrier(1)), ("carrier_c", lambda: carrier(2))):
        d.define(name, maker)
    return d


SALES_TABLE_NAMES = ("sales_items", "returns", "listing_master", "item_master_2", "calendar", "pincodes",
                     "subcat_map", "catalogue", "inventory", "metafields", "carrier_a", "carrier_b", "carrier_c")


def _subcat_dim(t: DriverTables) -> DataFrame:
    spark = t.spark
    return spark.createDataFrame(list(SUBCAT_ROWS), "SubCat string, Category string, Dep string")


def _carriers(L: DataFrame, O: DataFrame):
    base = L.join(O.select("o_orderkey", "o_orderdate"), L.l_orderkey == O.o_orderkey).select(
        "*",
        (F.col("l_orderkey") * 10 + F.col("l_suppkey") % 10).alias("_awb"),
        F.when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 1), True).otherwise(False).alias("_rp"),
        _days((F.col("l_suppkey") % 4).cast("int"), "o_orderdate").alias("_pickup"),
        F.when(F.col("l_linenumber") % 2 == 1, (F.col("l_linenumber") + 20).cast("decimal(12,2)")).alias("_cod"),
        (F.col("l_quantity").cast("decimal(12,2)") * 3 - 30).alias("_freight"))
    order_no = F.concat(_code("O", "l_orderkey"), F.when(F.col("_rp"), F.lit("-RP1")).otherwise(F.lit("")))
    order_no_b = F.concat(_code("O", "l_orderkey"), F.when(F.col("_rp"), F.lit("-rp1")).otherwise(F.lit("")))
    a = base.where(F.col("l_suppkey") % 3 == 0).select(
        F.when(F.col("l_orderkey") % 37 == 1, F.concat(F.lit("0W"), F.col("_awb").cast("string")))
        .otherwise(F.col("_awb").cast("string")).alias("waybill_num"), order_no.alias("order_id"), F.col("_pickup").alias("pickup_date"),
        F.col("_cod").alias("charge_cod"), F.col("_freight").alias("total_amount"))
    # Carrier B also lists some of carrier A's parcels, so the union must drop them.
    b = base.where((F.col("l_suppkey") % 3 == 1)
                   | ((F.col("l_suppkey") % 3 == 0) & (F.col("l_orderkey") % 50 == 0))).select(
        F.col("_awb").cast("string").alias("AWB Number"),
        F.when(F.col("l_suppkey") % 3 == 0, order_no).otherwise(order_no_b).alias("Order Number"),
        F.col("_pickup").alias("Date, Time"), F.col("_cod").alias("Cod Charges"),
        F.col("_freight").alias("Freight Total Amount"))
    c = base.where(F.col("l_suppkey") % 3 == 2).select(
        F.col("_awb").cast("string").alias("Tracking ID"), order_no.alias("Client Order ID"),
        F.col("_pickup").alias("Pickup Date"), F.coalesce("_cod", F.lit(Decimal("0.00"))).alias("COD Charges"),
        F.col("_freight").alias("Freight Charges"))
    return a, b, c


def sales_items_text(sales_items: DataFrame) -> DataFrame:
    """The sales items as an export would give them: text, with some cells that can't be
    read and some blank ones (fixed proxy rules on the order number)."""
    order, text = F.col("DisplayOrderCode"), sales_items.select(*[F.col(c).cast("string").alias(c) for c in sales_items.columns])
    return text.withColumns({
        "UnitsSold": F.when(order.endswith("17"), F.lit("n/a")).otherwise(F.col("UnitsSold")),
        "Discount": F.when(order.endswith("3"), F.lit(" ")).when(order.endswith("71"), F.lit("1,5")).otherwise(F.col("Discount")),
        "OrderDate": F.when(order.endswith("17") & (F.col("COD") == "1"), F.lit("soon")).otherwise(F.col("OrderDate"))})
