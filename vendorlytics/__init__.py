"""vendorlytics: marketplace vendor-performance datasets as Spark DataFrame plans.

Every dataset is a function ``DataFrame(s) -> DataFrame`` built from public
Spark SQL primitives; nothing is collected to the driver inside a plan.

Layout
------
``sources``    declared schemas, readers (files, JDBC), sinks, test-data proxies
``functions``  Column-expression helpers (safe division, bands, month maths)
``operators``  reusable relational patterns that Spark has no single call for
               (working days, quantity-limited allocation, LOCF, live periods,
               conditional distinct counts, union by position)
``plans``      the business datasets (sales mart, rate of sale, listings,
               shipping ledger, P&L, sourcing, vendor scorecard)
"""

from vendorlytics.params import PnlParams, RateOfSaleParams, ScorecardParams, SourcingParams

__all__ = ["PnlParams", "RateOfSaleParams", "ScorecardParams", "SourcingParams"]
