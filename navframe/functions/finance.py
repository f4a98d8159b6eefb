"""Column expressions for returns and risk metrics.

All of them are plain Catalyst expressions (no Python UDF), so they stay in
whole-stage codegen. Numeric literals are Python floats so that Spark treats
them as doubles (a SQL literal such as ``6.0/252`` would be a decimal).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from navframe import params as P


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pct_change(current, previous, digits: int = P.ROUND_DIGITS) -> Column:
    """``(current - previous) / previous * 100`` rounded, NULL when the base is
    NULL or zero (never a division error)."""
    cur, prev = _c(current), _c(previous)
    return F.when(prev.isNull() | (prev == 0), F.lit(None)).otherwise(
        F.round((cur - prev) / prev * F.lit(100), digits)
    )


def years_between(start_date, end_date, days_per_year: float = P.DAYS_PER_YEAR) -> Column:
    """Whole days between two dates divided by the year length (double)."""
    return F.datediff(_c(end_date), _c(start_date)).cast("double") / float(days_per_year)


def cagr_pct(initial_nav, final_nav, years, digits: int = P.ROUND_DIGITS) -> Column:
    """Compound annual growth in percent; NULL when ``years`` is zero."""
    yrs = _c(years)
    exponent = F.lit(1.0) / F.nullif(yrs, F.lit(0.0))
    growth = F.pow(_c(final_nav).cast("double") / _c(initial_nav).cast("double"), exponent)
    return F.round((growth - 1.0) * 100.0, digits)


def sharpe(
    avg_return,
    volatility,
    risk_free_pct: float = P.RISK_FREE_RATE_PCT,
    days: int = P.TRADING_DAYS,
    digits: int = P.ROUND_DIGITS,
) -> Column:
    """Annualised Sharpe ratio of daily percentage returns."""
    excess = _c(avg_return) - float(risk_free_pct) / float(days)
    return F.round(
        F.sqrt(F.lit(float(days))) * (excess / F.nullif(_c(volatility), F.lit(0.0))), digits
    )


def annualize(volatility, days: int = P.TRADING_DAYS, digits: int = P.ROUND_DIGITS) -> Column:
    """Annualised volatility from the unrounded daily standard deviation."""
    return F.round(_c(volatility) * F.sqrt(F.lit(float(days))), digits)
