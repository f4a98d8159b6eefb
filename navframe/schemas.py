"""Table and payload schemas, defined once and checked before every write.

The column names are those the jobs actually emit and read back (the query
outputs are the schema). Keys are listed in ``KEYS``.
"""

from __future__ import annotations

from pyspark.sql import types as T

from navframe import params as P

_NAV = T.DecimalType(18, 6)
_METRIC = T.DecimalType(18, 7)


def _f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


SCHEMES = T.StructType(
    [
        _f("scheme_code", T.LongType(), False),
        _f("scheme_name", T.StringType()),
        _f("isin_growth", T.StringType()),
        _f("isin_div_reinvestment", T.StringType()),
        _f("created_at", T.TimestampType()),
    ]
)

RAW_NAV = T.StructType(
    [
        _f("scheme_code", T.LongType(), False),
        _f("nav_date", T.DateType(), False),
        _f("nav", _NAV),
        _f("fund_house", T.StringType()),
        _f("scheme_name", T.StringType()),
        _f("created_at", T.TimestampType()),
    ]
)

LAG_COLUMNS = ["prev_day_nav", "prev_week_nav", "prev_month_nav", "nav_30d_ago", "nav_90d_ago"]
MOVING_AVG_COLUMNS = [f"moving_avg_{n}d" for n in P.MOVING_AVG_ROWS]
RETURN_COLUMNS = [
    "daily_return_pct",
    "weekly_return_pct",
    "monthly_return_pct",
    "rolling_return_30d_pct",
    "rolling_return_90d_pct",
]

DAILY_RETURNS = T.StructType(
    [_f("scheme_code", T.LongType(), False), _f("nav_date", T.DateType(), False), _f("nav", _NAV)]
    + [_f(c, _NAV) for c in LAG_COLUMNS + MOVING_AVG_COLUMNS + RETURN_COLUMNS]
)

METRIC_COLUMNS = ["cagr_percent", "sharpe_ratio", "daily_volatility", "annualized_volatility"]

SCHEME_METRICS = T.StructType(
    [_f("scheme_code", T.LongType(), False)] + [_f(c, _METRIC) for c in METRIC_COLUMNS]
)

ENRICHED_COLUMNS = ["scheme_code", "nav_date", "nav"] + RETURN_COLUMNS + MOVING_AVG_COLUMNS + METRIC_COLUMNS

NAV_ENRICHED = T.StructType(
    [_f("scheme_code", T.LongType(), False), _f("nav_date", T.DateType(), False), _f("nav", _NAV)]
    + [_f(c, _NAV) for c in RETURN_COLUMNS + MOVING_AVG_COLUMNS]
    + [_f(c, _METRIC) for c in METRIC_COLUMNS]
)

DAILY_RETURNS_5Y = T.StructType(
    [
        _f("scheme_code", T.LongType(), False),
        _f("nav_date", T.DateType(), False),
        _f("nav", _NAV),
        _f("prev_nav", _NAV),
        _f("daily_return_pct", _NAV),
    ]
)

WEATHER = T.StructType(
    [
        _f("latitude", T.DoubleType()),
        _f("longitude", T.DoubleType()),
        _f("temperature", T.DoubleType()),
        _f("windspeed", T.DoubleType()),
        _f("winddirection", T.DoubleType()),
        _f("weathercode", T.IntegerType()),
        _f("timestamp", T.TimestampType()),
    ]
)

# ---- landed payloads -------------------------------------------------------

# Codes are read as text: a payload may carry them as JSON numbers or as
# strings, and Spark keeps a number's literal text for a string field. They
# are converted with try_cast on parse.
SCHEME_LIST_ITEM = T.StructType(
    [
        _f("schemeCode", T.StringType()),
        _f("schemeName", T.StringType()),
        _f("isinGrowth", T.StringType()),
        _f("isinDivReinvestment", T.StringType()),
    ]
)
SCHEME_LIST = T.ArrayType(SCHEME_LIST_ITEM)

NAV_DOCUMENT = T.StructType(
    [
        # the scheme code that was asked for, added when the response is landed
        _f("requested", T.StringType()),
        _f(
            "meta",
            T.StructType(
                [
                    _f("scheme_code", T.StringType()),
                    _f("fund_house", T.StringType()),
                    _f("scheme_name", T.StringType()),
                ]
            ),
        ),
        # nav is text in the payload; it is parsed to a number on ingest.
        _f("data", T.ArrayType(T.StructType([_f("date", T.StringType()), _f("nav", T.StringType())]))),
    ]
)

WEATHER_DOCUMENT = T.StructType(
    [
        _f(
            "current_weather",
            T.StructType(
                [
                    _f("temperature", T.DoubleType()),
                    _f("windspeed", T.DoubleType()),
                    _f("winddirection", T.DoubleType()),
                    _f("weathercode", T.IntegerType()),
                ]
            ),
        )
    ]
)

PEOPLE_DOCUMENT = T.StructType(
    [
        _f("number", T.IntegerType()),
        _f("people", T.ArrayType(T.StructType([_f("craft", T.StringType()), _f("name", T.StringType())]))),
    ]
)

TABLES = {
    "schemes": SCHEMES,
    "raw_nav": RAW_NAV,
    "daily_returns": DAILY_RETURNS,
    "scheme_metrics": SCHEME_METRICS,
    "nav_enriched": NAV_ENRICHED,
    "daily_returns_5y": DAILY_RETURNS_5Y,
    "weather": WEATHER,
}

KEYS = {
    "schemes": ["scheme_code"],
    "raw_nav": ["scheme_code", "nav_date"],
    "daily_returns": ["scheme_code", "nav_date"],
    "scheme_metrics": ["scheme_code"],
    "nav_enriched": ["scheme_code", "nav_date"],
    "daily_returns_5y": ["scheme_code", "nav_date"],
}


def conform(df, schema: T.StructType):
    """Select and cast ``df`` to ``schema`` (by name); missing columns raise."""
    from pyspark.sql import functions as F

    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"columns missing for schema: {missing}")
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def check(df, schema: T.StructType) -> None:
    """Raise if ``df`` does not carry exactly the names and types of ``schema``."""
    got = [(f.name, f.dataType) for f in df.schema.fields]
    want = [(f.name, f.dataType) for f in schema.fields]
    if got != want:
        raise ValueError(f"schema mismatch:\n got  {got}\n want {want}")
