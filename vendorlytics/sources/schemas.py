"""Declared schemas of every input table (no type inference).

Identifiers (order numbers, SKUs, AWBs, phones, pincodes) are text, money is
``decimal(24,6)`` (18 digits before the point; sums have ten more), quantities are ``bigint``/``int``, dates are ``date``.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(24, 6)
S, L, I, D, TS, B = T.StringType(), T.LongType(), T.IntegerType(), T.DateType(), T.TimestampType(), T.BooleanType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Spreadsheet pipeline (sheets exported to parquet or CSV).
SALES_ITEMS = _schema(
    ("SaleOrderItemCode", S), ("DisplayOrderCode", S), ("ReversePickupCode", S), ("COD", I), ("Category", S),
    ("ShippingAddressPincode", S), ("ItemSKUCode", S), ("ChannelProductId", S), ("MRP", MONEY),
    ("SellingPrice", MONEY), ("CostPrice", MONEY), ("VoucherCode", S), ("UnitsSold", L), ("OrderDate", TS),
    ("SaleOrderStatus", S), ("SaleOrderItemStatus", S), ("ShippingPackageStatusCode", S), ("ShippingProvider", S),
    ("DispatchDate", TS), ("DeliveryTime", TS), ("AWB", S), ("Facility", S), ("SellerSKU", S),
    ("BillingAddressPhone", S), ("Discount", MONEY), ("CGST", MONEY), ("IGST", MONEY), ("SGST", MONEY),
    ("ShippingCharges", MONEY), ("CODServiceCharges", MONEY), ("ListingPrice", MONEY),
    ("CancellationReason", S), ("ShippingCourier", S), ("ShippingPackageCreationDate", TS), ("ReturnReason", S))
RETURNS = _schema(("Order Number", S), ("SKU", S), ("QNT", L), ("VV Reason", S))
LISTING_MASTER = _schema(
    ("Channel Product Id", S), ("Product Name on Channel", S), ("SKU Code", S), ("Seller SKU on Channel", S),
    ("Created", D), ("Last Inventory Update", MONEY), ("ListingStatus", S))
ITEM_MASTER_2 = _schema(("Product Code", S), ("Category Name", S))
CALENDAR = _schema(("dt", D), ("wk_nm", S), ("mnt_no", S))
PINCODES = _schema(("Pincode", S), ("State", S), ("District", S))
SUBCAT_MAP = _schema(("SubCat", S), ("Category", S), ("Dep", S))
CATALOGUE = _schema(
    ("pos", L), ("Handle", S), ("Variant SKU", S), ("Type", S), ("Vendor", S), ("Option1 Value", S),
    ("Variant Price", MONEY), ("Cost per item", MONEY))
INVENTORY = _schema(("Item SkuCode", S), ("Inventory", L))
METAFIELDS = _schema(
    ("ID", S), ("Variant SKU", S), ("Created At", S),
    ("Metafield: my_fields.material [list.single_line_text_field]", S),
    ("Metafield: custom.thread_count [number_integer]", I))
CARRIER_A = _schema(("waybill_num", S), ("order_id", S), ("pickup_date", TS), ("charge_cod", MONEY),
                    ("total_amount", MONEY))
CARRIER_B = _schema(("AWB Number", S), ("Order Number", S), ("Date, Time", TS), ("Cod Charges", MONEY),
                    ("Freight Total Amount", MONEY))
CARRIER_C = _schema(("Tracking ID", S), ("Client Order ID", S), ("Pickup Date", TS), ("COD Charges", MONEY),
                    ("Freight Charges", MONEY))

# Database pipeline.  Ids of items, returns and packages are compared, never computed with: text.
ORDERS = _schema(("id", L), ("created_at", TS), ("order_number", S), ("status", S), ("deleted_at", TS))
ORDER_ITEMS = _schema(("id", S), ("order_id", L), ("product_variant_id", L), ("variant_price", MONEY),
                      ("quantity", I), ("variant_inventory_cost_price", MONEY))
PRODUCT_VARIANTS = _schema(("id", L), ("product_id", L), ("sku", S), ("inventory_quantity", I), ("deleted_at", TS))
PRODUCTS = _schema(("id", L), ("supplier_id", L), ("published_at", TS), ("deleted_at", TS))
SUPPLIERS = _schema(("id", L), ("display_name", S), ("deleted_at", TS))
RETURN_ITEMS = _schema(("order_item_id", S), ("return_id", S))
DB_RETURNS = _schema(("id", S), ("manufacturer_mistake", B), ("reason", S), ("shipment_tracking_status", S))
SHIPPING_ORDER_ITEMS = _schema(("order_item_id", S), ("shipping_package_id", S))
SHIPPING_PACKAGES = _schema(("id", S), ("dispatched_at", TS), ("tracking_number", S), ("courier_status", S))
PRODUCT_REVIEWS = _schema(("product_id", L), ("rating", I))
CALENDAR_H = _schema(("dt", D), ("holiday_flag", I), ("day", I))

SPREADSHEET_TABLES = {
    "sales_items": SALES_ITEMS, "returns": RETURNS, "listing_master": LISTING_MASTER,
    "item_master_2": ITEM_MASTER_2, "calendar": CALENDAR, "pincodes": PINCODES, "subcat_map": SUBCAT_MAP,
    "catalogue": CATALOGUE, "inventory": INVENTORY, "metafields": METAFIELDS, "carrier_a": CARRIER_A,
    "carrier_b": CARRIER_B, "carrier_c": CARRIER_C,
}
DATABASE_TABLES = {
    "orders": ORDERS, "order_items": ORDER_ITEMS, "product_variants": PRODUCT_VARIANTS, "products": PRODUCTS,
    "suppliers": SUPPLIERS, "return_items": RETURN_ITEMS, "returns": DB_RETURNS,
    "shipping_order_items": SHIPPING_ORDER_ITEMS, "shipping_packages": SHIPPING_PACKAGES,
    "product_reviews": PRODUCT_REVIEWS, "calendar_h": CALENDAR_H,
}

# Sales sheet as exported by the order system: original header -> column name
# used here (the original renames by position; "Packet Number" carries units
# and "Item Type EAN" carries the listing price).  Fixed values.
SALES_SHEET_COLUMNS = (
    ("Sale Order Item Code", "SaleOrderItemCode"), ("Display Order Code", "DisplayOrderCode"),
    ("Reverse Pickup Code", "ReversePickupCode"), ("COD", "COD"), ("Category", "Category"),
    ("Shipping Address Pincode", "ShippingAddressPincode"), ("Item SKU Code", "ItemSKUCode"),
    ("Channel Product Id", "ChannelProductId"), ("MRP", "MRP"), ("Selling Price", "SellingPrice"),
    ("Cost Price", "CostPrice"), ("Voucher Code", "VoucherCode"), ("Packet Number", "UnitsSold"),
    ("Order Date as dd/mm/yyyy hh:MM:ss", "OrderDate"), ("Sale Order Status", "SaleOrderStatus"),
    ("Sale Order Item Status", "SaleOrderItemStatus"), ("Cancellation Reason", "CancellationReason"),
    ("Shipping provider", "ShippingProvider"), ("Shipping Courier", "ShippingCourier"),
    ("Shipping Package Creation Date", "ShippingPackageCreationDate"),
    ("Shipping Package Status Code", "ShippingPackageStatusCode"), ("Delivery Time", "DeliveryTime"),
    ("Tracking Number", "AWB"), ("Dispatch Date", "DispatchDate"), ("Facility", "Facility"),
    ("Return Reason", "ReturnReason"), ("Seller SKU Code", "SellerSKU"),
    ("Billing Address Phone", "BillingAddressPhone"), ("Discount", "Discount"), ("CGST", "CGST"),
    ("IGST", "IGST"), ("SGST", "SGST"), ("Shipping Charges", "ShippingCharges"),
    ("COD Service Charges", "CODServiceCharges"), ("Item Type EAN", "ListingPrice"))
