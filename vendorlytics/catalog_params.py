"""Parameters used by the registered check queries on the driver's test data.

The test orders span 1995-2001 (the production defaults are 2022-2023
months), so the report periods are moved into the test data's range.
"""

from vendorlytics.params import PnlParams, RateOfSaleParams, ScorecardParams, SourcingParams

TEST_SCORECARD = ScorecardParams(month_from="1998-01", month_to="1999-12")
TEST_PNL = PnlParams(months=("1998-06", "1998-05", "1998-04", "1998-03", "1998-02",
                             "1998-01", "1997-12", "1997-11", "1997-10", "1997-09"))
TEST_ROS = RateOfSaleParams()
TEST_SOURCING = SourcingParams(cutoff_month="1998-06")
