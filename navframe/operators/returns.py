"""Per-scheme window features over a NAV series.

Input: a DataFrame with ``scheme_code``, ``nav_date`` and ``nav`` whose
``(scheme_code, nav_date)`` is unique. All features share one window spec
(``PARTITION BY scheme_code ORDER BY nav_date``), so Catalyst plans a single
hash exchange + sort + ``Window`` for the whole feature set. A partition holds
one scheme's history inside the lookback, which is bounded by the number of
calendar days (about 1,100 rows for three years) however large the table, so
a hot scheme cannot produce an oversized task.

Offsets count rows, not calendar days ("week" = 7 rows, "month" = 30 rows).
Moving averages are emitted from the first row on a partial frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navframe import params as P
from navframe.functions.dates import as_of_col, lookback_start
from navframe.functions.finance import pct_change

KEY = "scheme_code"
ORDER = "nav_date"


def nav_window(desc: bool = False):
    order = F.col(ORDER).desc() if desc else F.col(ORDER).asc()
    return Window.partitionBy(KEY).orderBy(order)


def lookback(nav: DataFrame, as_of=None, months: int = P.LOOKBACK_MONTHS) -> DataFrame:
    """Rows with ``nav_date >= as_of - months`` (boundary day included).

    Applied *before* the window (the first row inside the range has NULL lags);
    the predicate reaches the Parquet scan as a pushed filter. A NULL key is no
    scheme: such rows go here, below everything that reads the series, so that
    plans which use it twice can share its exchange.
    """
    return nav.filter(F.col(KEY).isNotNull() & (F.col(ORDER) >= lookback_start(as_of, months)))


def lag_columns(nav_col: str = "nav") -> dict[str, Column]:
    w = nav_window()
    lag30 = F.lag(nav_col, P.LAG_MONTH).over(w)
    return {
        "prev_day_nav": F.lag(nav_col, P.LAG_DAY).over(w),
        "prev_week_nav": F.lag(nav_col, P.LAG_WEEK).over(w),
        # the 30-row lag is one expression under two names
        "prev_month_nav": lag30,
        "nav_30d_ago": lag30,
        "nav_90d_ago": F.lag(nav_col, P.LAG_90D).over(w),
    }


def moving_average_columns(
    nav_col: str = "nav", digits: int = P.ROUND_DIGITS, exact_running_sum: bool = False
) -> dict[str, Column]:
    """Rounded averages over the last n rows (partial frames at the start).

    The frame form re-aggregates each sliding frame: O(rows x n). With
    ``exact_running_sum`` (decimal NAVs only) the n-row sum is the difference
    of two running sums, which is exact in decimal arithmetic, so the result
    is identical at O(rows): the running sum and count are incremental window
    aggregates and the n-rows-back value is a lag.
    """
    w = nav_window()
    if not exact_running_sum:
        return {
            f"moving_avg_{n}d": F.round(F.avg(nav_col).over(w.rowsBetween(-(n - 1), Window.currentRow)), digits)
            for n in P.MOVING_AVG_ROWS
        }
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = F.sum(nav_col).over(running)
    c = F.count(nav_col).over(running)
    out = {}
    for n in P.MOVING_AVG_ROWS:
        total = F.coalesce(s, F.lit(0)) - F.coalesce(F.lag(s, n).over(w), F.lit(0))
        cnt = c - F.coalesce(F.lag(c, n).over(w), F.lit(0))
        avg = (total / F.nullif(cnt, F.lit(0))).cast(_avg_type())
        out[f"moving_avg_{n}d"] = F.round(avg, digits)
    return out


def _avg_type() -> str:
    # Spark's avg of decimal(18,6) is decimal(22,10); casting the exact
    # quotient to it reproduces avg's rounding before the final round(6).
    return "decimal(22,10)"


def _is_decimal(df: DataFrame, col: str) -> bool:
    from pyspark.sql.types import DecimalType

    dt = df.schema[col].dataType
    return isinstance(dt, DecimalType) and dt.precision <= 18 and dt.scale == 6


def _keys(df: DataFrame, nav_col: str = "nav") -> list[Column]:
    return [F.col(KEY), F.col(ORDER), F.col(nav_col)]


def _windowed(base: DataFrame, with_lags: bool = True, with_mas: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """One ``Window`` node holding each distinct window expression once; the
    30-row lag is evaluated once and exposed under both of its names. ``carry``
    are columns that go along."""
    cols = [*_keys(base), *carry]
    if with_lags:
        lags = lag_columns()
        cols += [lags[n].alias(n) for n in ("prev_day_nav", "prev_week_nav", "prev_month_nav")]
        cols += [lags["nav_90d_ago"].alias("nav_90d_ago")]
    if with_mas:
        mas = moving_average_columns(exact_running_sum=_is_decimal(base, "nav"))
        cols += [c.alias(n) for n, c in mas.items()]
    w = base.select(*cols)
    if not with_lags:
        return w
    order = [KEY, ORDER, "nav", "prev_day_nav", "prev_week_nav", "prev_month_nav", "nav_30d_ago", "nav_90d_ago"]
    rest = [c for c in w.columns if c not in order]
    return w.select(*order[:6], F.col("prev_month_nav").alias("nav_30d_ago"), "nav_90d_ago", *rest)


def lag_features(nav: DataFrame, as_of=None, months: int = P.LOOKBACK_MONTHS) -> DataFrame:
    """The five lag columns on the lookback series."""
    return _windowed(lookback(nav, as_of, months), with_mas=False)


def moving_averages(nav: DataFrame, as_of=None, months: int = P.LOOKBACK_MONTHS) -> DataFrame:
    """Rounded moving averages over 7/30/90/200 rows."""
    return _windowed(lookback(nav, as_of, months), with_lags=False)


_RETURN_LAGS = {
    "daily_return_pct": P.LAG_DAY,
    "weekly_return_pct": P.LAG_WEEK,
    "monthly_return_pct": P.LAG_MONTH,
    "rolling_return_30d_pct": P.LAG_30D,
    "rolling_return_90d_pct": P.LAG_90D,
}


def single_return(nav: DataFrame, name: str, as_of=None, months: int = P.LOOKBACK_MONTHS) -> DataFrame:
    """P3 for one horizon: ``scheme_code, nav_date, nav, <name>``."""
    offset = _RETURN_LAGS[name]
    base = lookback(nav, as_of, months)
    lagged = base.select(*_keys(base), F.lag("nav", offset).over(nav_window()).alias("_prev"))
    return lagged.select(KEY, ORDER, "nav", pct_change("nav", "_prev").alias(name))


def return_features(nav: DataFrame, as_of=None, months: int = P.LOOKBACK_MONTHS) -> DataFrame:
    """The 17-column feature table (lags, moving averages, returns).

    Moving averages of a ``decimal(18,6)`` NAV, the stored type, are exact
    differences of running sums; of a double NAV they are averages of the frame.

    The lags and moving averages are evaluated once, in one ``Window`` node
    (two for decimal NAVs, where the moving averages are lags of running
    sums; both nodes share one exchange and one sort). The returns are a plain
    projection over the lag columns, so no window expression is evaluated
    twice.
    """
    return _with_returns(_windowed(lookback(nav, as_of, months)))


def new_return_features(nav: DataFrame, stored: DataFrame, as_of=None, months: int = P.LOOKBACK_MONTHS) -> DataFrame:
    """J1 for E1: the feature rows whose ``(scheme_code, nav_date)`` isn't stored.

    The stored keys are tagged on the narrow NAV rows: both go to one exchange
    on ``scheme_code``, which serves the tagging aggregate and the window. The
    wide rows are dropped by their tag, without another shuffle; a scheme's rows
    are bounded by the days in the lookback.
    """
    rows = lookback(nav, as_of, months).select(*_keys(nav), F.lit(False).alias("_stored"), F.lit(True).alias("_here"))
    keys = lookback(stored, as_of, months).select(KEY, ORDER, F.lit(None).cast(nav.schema["nav"].dataType).alias("nav"), F.lit(True).alias("_stored"), F.lit(False).alias("_here"))
    both = rows.unionByName(keys).repartition(KEY)
    tagged = both.groupBy(KEY, ORDER).agg(F.max("nav").alias("nav"), F.max("_stored").alias("_stored"), F.max("_here").alias("_here")).filter("_here")
    fresh = _windowed(tagged.drop("_here"), carry=("_stored",)).filter(~F.col("_stored")).drop("_stored")
    return _with_returns(fresh)


def _with_returns(windowed: DataFrame) -> DataFrame:
    returns = [
        pct_change("nav", "prev_day_nav").alias("daily_return_pct"),
        pct_change("nav", "prev_week_nav").alias("weekly_return_pct"),
        pct_change("nav", "prev_month_nav").alias("monthly_return_pct"),
        pct_change("nav", "nav_30d_ago").alias("rolling_return_30d_pct"),
        pct_change("nav", "nav_90d_ago").alias("rolling_return_90d_pct"),
    ]
    return windowed.select(*windowed.columns, *returns)


def daily_return_5y(nav: DataFrame, as_of=None, months: int = P.LOOKBACK_5Y_MONTHS) -> DataFrame:
    """Daily return with the lag taken over the *whole* history, rows of
    the last ``months`` kept.

    Unlike :func:`lookback`, the date filter applies after the lag, so the
    first row inside the range carries the NAV of the row before it, however
    old. Computing that without shuffling and sorting the entire history: the
    window runs over the range only, and each scheme's first row in range
    takes its previous NAV from ``max_by(nav, nav_date)`` over the older rows.
    That is a partially aggregated scan, one row per scheme, joined on the key
    (broadcast when it passes the size check). The result equals a lag over
    the full history followed by the filter.
    """
    from navframe.operators.joins import broadcast_if_small

    start = F.add_months(as_of_col(as_of), -int(months))
    nav = nav.filter(F.col(KEY).isNotNull())
    recent = nav.filter(F.col(ORDER) >= start).select(*_keys(nav))
    carry = (
        nav.filter(F.col(ORDER) < start)
        .groupBy(KEY)
        .agg(F.max_by("nav", ORDER).alias("_carry"))
    )
    x = recent.join(broadcast_if_small(carry), KEY, "left")
    w = nav_window()
    prev = F.when(F.row_number().over(w) == 1, F.col("_carry")).otherwise(F.lag("nav", 1).over(w))
    feat = x.select(*_keys(x), prev.alias("prev_nav"))
    return feat.select(*feat.columns, pct_change(F.col("nav"), F.col("prev_nav")).alias("daily_return_pct"))
