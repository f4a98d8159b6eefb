"""Fixed parameters.

FIXED VALUES - these must equal the values used by the pipeline this engine
re-implements, or the results differ. They are the defaults of the operator
parameters; callers can override each one.

    lookback for features and metrics ...... 3 years (36 months)
    lookback of the five-year return job ... 5 years (60 months)
    minimum rows per scheme for metrics .... 30
    risk-free rate (annual, percent) ....... 6.0
    trading days per year .................. 252
    days per year for CAGR ................. 365.25
    rounding of every derived value ........ 6 decimal digits
    lag offsets (rows) ..................... day 1, week 7, month 30, 30d 30, 90d 90
    moving-average frames (rows) ........... 7, 30, 90, 200
    NAV date text format ................... day-month-year, dash separated
    weather location (lat, lon) ............ 51.5074, -0.1278
    people message greeting ................ "Hello! :)"
"""

from __future__ import annotations

import datetime as _dt

LOOKBACK_MONTHS = 36
LOOKBACK_5Y_MONTHS = 60
MIN_RECORDS_REQUIRED = 30
RISK_FREE_RATE_PCT = 6.0
TRADING_DAYS = 252
DAYS_PER_YEAR = 365.25
ROUND_DIGITS = 6

LAG_DAY = 1
LAG_WEEK = 7
LAG_MONTH = 30
LAG_30D = 30
LAG_90D = 90
MOVING_AVG_ROWS = (7, 30, 90, 200)

# ``d-M-yyyy`` accepts both ``01-02-2024`` and ``1-2-2024``.
NAV_DATE_FORMAT = "d-M-yyyy"

WEATHER_LATITUDE = 51.5074
WEATHER_LONGITUDE = -0.1278
PEOPLE_GREETING = "Hello! :)"

# Decimal precision of stored NAV-derived columns and of stored metrics.
NAV_DECIMAL = "decimal(18,6)"
METRIC_DECIMAL = "decimal(18,7)"

# The test tables end on this date; it stands in for CURRENT_DATE so results
# are reproducible (the jobs take ``as_of`` as a parameter).
TEST_AS_OF = _dt.date(2001, 11, 4)
