"""Shipping cost ledger (D16-D20): three carrier charge sheets normalised to
one shape, unioned, and matched to shipment facts from the sales mart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendorlytics import params as P
from vendorlytics.functions.expr import ilike, sum_money
from vendorlytics.operators.union import union_distinct

CHARGE_COLUMNS = ("AWB", "OrderNo", "OrderDate", "CODCost", "ShippingCharge")

# Column maps of the three carrier sheets (fixed values): AWB, order, pickup
# timestamp, COD charge, freight charge, and whether a missing COD charge
# counts as 0 before summing.
CARRIER_A = ("waybill_num", "order_id", "pickup_date", "charge_cod", "total_amount", False)
CARRIER_B = ("AWB Number", "Order Number", "Date, Time", "Cod Charges", "Freight Total Amount", True)
CARRIER_C = ("Tracking ID", "Client Order ID", "Pickup Date", "COD Charges", "Freight Charges", False)


def normalise_charges(sheet: DataFrame, columns: tuple) -> DataFrame:
    """Charges per (AWB, order, pickup day) with positive freight.  The
    AWB is cast to text so numeric and text AWBs from different carriers
    compare as one value."""
    awb, order, ts, cod, freight, cod_default_zero = columns
    cod_col = F.coalesce(F.col(cod), F.lit(0)) if cod_default_zero else F.col(cod)
    return (sheet.groupBy(F.col(awb).cast("string").alias("AWB"), F.col(order).cast("string").alias("OrderNo"),
                          F.to_date(ts).alias("OrderDate"))
            .agg(F.sum(cod_col).alias("CODCost"), F.sum(freight).alias("ShippingCharge"))
            .where(F.col("ShippingCharge") > 0))


def carrier_union(a: DataFrame, b: DataFrame, c: DataFrame) -> DataFrame:
    """``UNION`` of the three normalised sheets (exact duplicates removed)."""
    frames = [normalise_charges(a, CARRIER_A), normalise_charges(b, CARRIER_B), normalise_charges(c, CARRIER_C)]
    return union_distinct(frames, CHARGE_COLUMNS)


def shipment_facts(mart: DataFrame) -> DataFrame:
    """Selling price per (AWB, facility, order date, provider, pincode,
    state, district)."""
    return (mart.groupBy("AWB", "Facility", "OrderDate", "ShippingProvider", "Pincode", "State", "District")
            .agg(sum_money(mart, "SellingPrice").alias("SellingPrice")))


def parcels(lines: DataFrame, pincodes: DataFrame) -> DataFrame:
    """The keys of ``shipment_facts`` alone, one row each, from the typed sales lines: none
    of them needs the mart's claims, totals or other lookups."""
    pin = pincodes.select(F.col("Pincode").alias("ShippingAddressPincode"), "State", "District")
    keys = ("AWB", "Facility", "OrderDate", "ShippingProvider", "ShippingAddressPincode")
    known = lines.where(F.col("AWB").isNotNull()).select(*keys).distinct()
    return known.join(pin, "ShippingAddressPincode", "left").distinct()


def parcel_charges(charges: DataFrame, parcel: DataFrame) -> DataFrame:
    """The ledger's rows with its charge columns only (AWB, CODCost, ShippingCharge): a
    charge once for each parcel row of its AWB, at least once."""
    rows = parcel.groupBy("AWB").agg(F.count(F.lit(1)).alias("_n"))
    times = F.sequence(F.lit(1).cast("long"), F.coalesce("_n", F.lit(1)))
    return (charges.select("AWB", "CODCost", "ShippingCharge").join(rows, "AWB", "left")
            .withColumn("_times", times).withColumn("_k", F.explode("_times")).drop("_n", "_times", "_k"))


def shipping_ledger(charges: DataFrame, facts: DataFrame) -> DataFrame:
    """Every carrier charge row with its shipment facts (a parcel with
    several fact rows fans out, as in the original) and a charge type:
    Reverse Pickup (order no. contains -RP, any case) > Internal (no facility)
    > Regular."""
    f = facts.select("AWB", "Facility", F.col("OrderDate").alias("_fact_date"), "ShippingProvider", "Pincode",
                     "State", "District", F.col("SellingPrice"))
    j = charges.join(f, "AWB", "left")
    kind = (F.when(ilike("OrderNo", P.REVERSE_PICKUP_PATTERN), P.CHARGE_REVERSE_PICKUP)
            .when(F.col("Facility").isNull(), P.CHARGE_INTERNAL).otherwise(P.CHARGE_REGULAR))
    return j.select("AWB", "OrderNo", "Facility", F.coalesce("_fact_date", "OrderDate").alias("OrderDate"),
                    "ShippingProvider", "Pincode", "State", "District", kind.alias("ShipChargeType"),
                    "CODCost", "ShippingCharge", "SellingPrice")


def facility_dim(facts: DataFrame) -> DataFrame:
    """Distinct non-NULL facilities."""
    return facts.where(F.col("Facility").isNotNull()).select("Facility").distinct()
