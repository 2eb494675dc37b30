"""Profit and loss (D21-D23): order lines per month and facility with
completed-only money, packaging cost, COD and shipping cost defaults, then
month x facility totals with two tax lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendorlytics import params as P
from vendorlytics.functions.expr import first_match
from vendorlytics.operators.grain import join_one, summed

LINE_KEYS = ("Month", "Facility", "OrderNo", "CODFlag", "AWB")
# Amounts derived by division are kept as exact decimals from the line on, so
# totals do not depend on the order of addition.
MONEY = "decimal(38,6)"


def to_money(c: F.Column) -> F.Column:
    return c.cast(MONEY)


def pnl_lines(mart: DataFrame, p: P.PnlParams = P.PnlParams()) -> DataFrame:
    """Per (month, facility, order, COD flag, AWB): 0/1 not-complete flag,
    tax, completed cost/LP/discount/COD charges, and packaging cost for every
    row whatever its status (NULL when no rule matches any row)."""
    done = F.col("OrderStatus") == P.STATUS_COMPLETE
    rules = [(F.col("UC_Category").isin(*cats), cost) for cats, cost in p.packaging_by_uc_category]
    rules += [(F.col("Category").isin(*cats), cost) for cats, cost in p.packaging_by_category]

    def completed(c: str) -> F.Column:
        return F.sum(F.when(done, F.col(c)).otherwise(F.lit(0)))

    return (mart.where(F.col("Month").isin(*p.months))
            .groupBy(*LINE_KEYS)
            .agg(F.max(F.when(done, 0).otherwise(1)).alias("OrderStatus"),
                 F.sum("Tax").alias("Tax"),
                 completed("CostPrice").alias("CostPrice"),
                 completed("ListingPrice").alias("LP"),
                 completed("Discount").alias("Discount"),
                 completed("CODCharges").alias("CODCharges"),
                 F.sum(first_match(rules)).alias("PackagingCost")))


def pnl_cost_lines(lines: DataFrame, ledger: DataFrame, p: P.PnlParams = P.PnlParams(),
                   one_charge: bool = False) -> DataFrame:
    """Lines with COD cost (carrier charge; else the COD fee rate on
    LP - discount + COD charges net of tax for COD orders; else 0 for prepaid)
    and shipping cost (carrier charge, else the flat rate).  Several charge rows
    for one AWB fan the line out, as in the original.

    ``ledger`` is the shipping ledger or any table with AWB, CODCost and ShippingCharge.
    With ``one_charge`` its rows are the carriers' charges, summed per AWB first: every
    line stays one row and meets the AWB's whole charge."""
    charges = ledger.select("AWB", F.col("CODCost").alias("_cod_cost"), F.col("ShippingCharge").alias("_ship"))
    if one_charge:
        j = join_one(lines, summed(charges, ["AWB"], ["_cod_cost", "_ship"]), ["AWB"])
    else:
        j = lines.join(charges, "AWB", "left")
    net = F.col("LP") - F.col("Discount") + F.col("CODCharges")
    # Operands narrowed so that Spark keeps the exact product (a product wider
    # than 38 digits would be rounded to 6 decimals).
    fee = net.cast("decimal(28,8)") * F.lit(p.cod_fee_rate).cast("decimal(6,4)")
    cod_cost = first_match([
        (F.col("_cod_cost").isNull() & (F.col("CODFlag") == P.CODFLAG_COD),
         to_money(F.try_divide(fee.cast("double"), 1 + F.col("Tax").cast("double") / 100))),
        (F.col("_cod_cost").isNull() & (F.col("CODFlag") == P.CODFLAG_PREPAID), F.lit(0).cast(MONEY)),
    ], F.col("_cod_cost").cast(MONEY))
    return j.select(*LINE_KEYS, "Tax", "OrderStatus", "CostPrice", "LP", "Discount", "PackagingCost",
                    "CODCharges", cod_cost.alias("CODCost"),
                    F.coalesce(F.col("_ship"), F.lit(p.flat_shipping).cast("decimal(12,2)")).alias("ShippingCost"))


def pnl_month_facility(cost_lines: DataFrame, p: P.PnlParams = P.PnlParams()) -> DataFrame:
    """Month x facility totals; Tax1 on fully completed lines only,
    Tax2 = service tax on COD + shipping cost."""
    lp, disc, cod = F.col("LP"), F.col("Discount"), F.col("CODCharges")
    tax1 = (lp - disc + cod) - to_money(F.try_divide(
        (lp - disc - cod).cast("double"), 1 + F.col("Tax").cast("double") / 100))

    def total(c: F.Column) -> F.Column:
        return F.coalesce(F.sum(c), F.lit(0))

    return cost_lines.groupBy("Month", "Facility").agg(
        total(F.col("CostPrice")).alias("CostPrice"),
        total(F.col("LP")).alias("ListingPrice"),
        total(F.col("Discount")).alias("Discount"),
        total(F.col("CODCharges")).alias("CODCharges"),
        total(F.when(F.col("OrderStatus") == 0, tax1).otherwise(F.lit(0))).alias("Tax1"),
        total(F.col("PackagingCost")).alias("PackagingCost"),
        total(F.col("CODCost")).alias("CODCost"),
        total(F.col("ShippingCost")).alias("ShippingCost"),
        # Narrowed before the product so the exact result keeps every digit.
        F.coalesce(F.sum(F.col("CODCost") + F.col("ShippingCost")).cast("decimal(28,6)")
                   * F.lit(p.service_tax_rate).cast("decimal(6,4)"), F.lit(0)).alias("Tax2"))
