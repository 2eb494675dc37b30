"""Run parameters.

Every constant that the original workload hard-codes (report month, rates,
windows, band thresholds, code lists) is a field here, with the original value
as default, so that a run is reproducible and nothing is pasted into SQL text.
"""

from __future__ import annotations

from dataclasses import dataclass

# --------------------------------------------------------------------------
# Code lists and labels that must equal the original workload's
# for identical results.  Written out plainly, in their natural order.
# --------------------------------------------------------------------------

# Sales order statuses.
ORDER_COMPLETE = "COMPLETE"
ORDER_CANCELLED = "CANCELLED"
ORDER_PROCESSING = "PROCESSING"
# Item and package statuses that mean "left the warehouse".
SHIPPED_ITEM_STATUSES = ("DISPATCHED", "DELIVERED")
SHIPPED_PACKAGE_STATUSES = ("DISPATCHED", "DELIVERED")
RTO_PACKAGE_STATUSES = ("RETURN_EXPECTED", "RETURNED")
IN_TRANSIT_PACKAGE_STATUSES = ("SHIPPED",)

# Lifecycle labels, in evaluation order (first match wins).
STATUS_CANCEL = "Cancel"
STATUS_PROCESSING = "Processing"
STATUS_RETURN = "Return"
STATUS_RTO = "RTO"
STATUS_IN_TRANSIT = "In Transit"
STATUS_COMPLETE = "COMPLETE"

# Customer-return reasons, and the order in which a claim's reason is chosen.
REASON_CUSTOMER = "Customer Reasons"
REASON_DEFECTIVE = "Defective/Damaged"
REASON_WRONG = "Wrong Dispatch"

# Order-value buckets: (upper bound exclusive, label); last label is ">= last bound".
AOV_BUCKETS = ((1000, "<1K"), (2000, "1K to 2K"), (3000, "2K to 3K"), (4000, "3K to 4K"))
AOV_TOP_LABEL = "4K+"
# Order-quantity buckets.
AOQ_ONE = "1"
AOQ_TWO = "2"
AOQ_THREE_TO_FIVE = "3 to 5"
AOQ_MORE = "5+"

# Payment flag labels.
CODFLAG_PREPAID = "Prepaid"
CODFLAG_COD = "COD"

# Shipping charge types.
CHARGE_REVERSE_PICKUP = "Reverse Pickup"
CHARGE_INTERNAL = "Internal"
CHARGE_REGULAR = "Regular"
REVERSE_PICKUP_PATTERN = "%-RP%"

# Listing stock flag.
LISTING_ACTIVE_PATTERN = "ACTIVE"
FLAG_IN_STOCK = "InStock"
FLAG_OOS = "OOS"

# Catalogue segment rules.
SEGMENT_BEDSHEETS_TYPE = "Bedsheets"
SEGMENT_DOHAR_TYPES = ("Dohars", "Comforters", "Curtains")
SEGMENT_CUSHION_PATTERN = "%Cushion Cover%"
SEGMENT_LAMP_PATTERN = "%LAMP%"
SEGMENT_CLOCK_PATTERN = "%CLOCK%"
SEGMENT_GSM_PATTERN = "%GSM%"
SEGMENT_GSM_SIZE = "King"
SEGMENT_REMAINDER_EXCLUDED_PATTERNS = ("%LAMP%", "%CLOCK%", "%HOOK%", "%SHELF%", "%CUSHION COVER%")
SEGMENT_REMAINDER_EXCLUDED_TYPES = ("Dohars", "Comforters", "Curtains", "Bedsheets")

# Scorecard (database pipeline) code values.
DB_STATUS_CANCELLED = "cancelled"
DB_STATUS_RTO = "rto"
DB_STATUS_RETURN = "return"
DB_STATUS_DELIVERED = "delivered"
DB_TRACKING_RTO = "RETURNED_TO_ORIGIN"
DB_DELIVERED_COURIER_STATUSES = ("DISPATCHED", "DELIVERED", "DL-SHIPMENT DELIVERED")
DB_REASON_DAMAGED = "Received damaged products"
DB_REASON_WRONG = "Received wrong or incorrect products"
YES = "Yes"
NO = "No"


@dataclass(frozen=True)
class Band:
    """One threshold rule: ``value <op> bound -> points``."""

    op: str  # one of "<", "<=", ">", ">="
    bound: float
    points: int


# Score bands, evaluated in order, unmatched or NULL -> 0.
SKU_COUNT_BANDS = (Band("<", 50, 0), Band("<", 100, 1), Band(">=", 100, 2))
INVENTORY_BANDS = (Band("<", 10, 0), Band("<", 50, 1), Band(">=", 50, 2))
ORDER_BANDS = (Band("<", 20, 0), Band("<", 50, 1), Band("<", 200, 2), Band(">=", 200, 3))
DISPATCH_BANDS = (Band("<=", 1, 2), Band("<=", 2, 1), Band(">", 2, 0))
OOS_BANDS = (Band("<", 0.05, 2), Band("<", 0.25, 1), Band(">=", 0.25, 0))
RETURN_BANDS = (Band("<", 0.05, 2), Band("<", 0.1, 1), Band(">=", 0.1, 0))
RATING_BANDS = (Band("<", 3, 0), Band("<=", 4, 1), Band(">", 4, 2))


@dataclass(frozen=True)
class ScorecardParams:
    """Vendor scorecard run.

    ``month_from``/``month_to`` (inclusive, ``yyyy-MM`` in local time) select
    the report period; the original workload reports one month.  Monthly
    tables are joined on (month, vendor), so a multi-month period yields one
    scorecard row per month and vendor instead of fanning out.
    """

    month_from: str = "2023-10"
    month_to: str = "2023-10"
    tz_offset_minutes: int = 330
    weekly_off_day: int = 7
    sku_count_bands: tuple = SKU_COUNT_BANDS
    inventory_bands: tuple = INVENTORY_BANDS
    order_bands: tuple = ORDER_BANDS
    dispatch_bands: tuple = DISPATCH_BANDS
    oos_bands: tuple = OOS_BANDS
    return_bands: tuple = RETURN_BANDS
    rating_bands: tuple = RATING_BANDS


@dataclass(frozen=True)
class RateOfSaleParams:
    """Rate of sale: units over ``window_days + 1`` calendar days ending at the
    latest order date, divided by ``divisor`` (the original uses 31 and 30)."""

    window_days: int = 31
    divisor: int = 30
    as_of: str | None = None  # ISO date; None = latest order date in the mart


@dataclass(frozen=True)
class PnlParams:
    months: tuple = (
        "2023-06", "2023-05", "2023-04", "2023-03", "2023-02",
        "2023-01", "2022-12", "2022-11", "2022-10", "2022-09",
    )
    cod_fee_rate: str = "0.015"
    flat_shipping: str = "125"
    service_tax_rate: str = "0.18"
    # Packaging cost per item row, first match wins.
    packaging_by_uc_category: tuple = (
        (("CUSHIONS", "TOWEL", "BATH"), 5),
        (("BEDSHEET", "THROWS", "DIWAN Set"), 10),
    )
    packaging_by_category: tuple = ((("KITCHEN", "DECOR"), 2),)


@dataclass(frozen=True)
class SourcingParams:
    """Sourcing report: report months up to and including ``cutoff_month``."""

    cutoff_month: str = "2023-06"
