"""Per-scheme risk metrics over the stored daily-returns table.

Input: ``daily_returns`` with at least ``scheme_code, nav_date, nav,
daily_return_pct``. The metrics read the *stored* returns, not a
recomputation, so the function takes that table as it is.

Two forms are provided:

* :func:`scheme_metrics` - the form to run: one ``groupBy(scheme_code)`` with
  conditional aggregates (count, first/last NAV by date via ``min_by`` /
  ``max_by``, mean and sample standard deviation of the daily return). It has
  no join and no window; partial aggregation runs before the shuffle, so each
  map task sends one small row per scheme whatever the skew, and when the
  input is already hash-partitioned by ``scheme_code`` (the window output of
  E1, or a bucketed table) there is no exchange at all.
* the piecewise operators (:func:`valid_schemes`, :func:`ranked_nav`,
  :func:`cagr`, :func:`sharpe_ratio`, ...) joined by :func:`join_metrics` - the
  shape of the original four-query pipeline, kept as operators in their own
  right and as the reference the fused form is tested against.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navframe import params as P
from navframe.functions.dates import lookback_start
from navframe.functions.finance import annualize, cagr_pct, sharpe, years_between
from navframe.operators.returns import nav_window

KEY = "scheme_code"


def _in_lookback(df: DataFrame, as_of, months: int) -> DataFrame:
    return df.filter(F.col("nav_date") >= lookback_start(as_of, months))


def nav_in_lookback(daily_returns: DataFrame, as_of=None, months: int = P.LOOKBACK_MONTHS) -> DataFrame:
    """F2 + F4: NAV rows inside the lookback with a non-NULL NAV."""
    return _in_lookback(daily_returns, as_of, months).filter(F.col("nav").isNotNull()).select(
        KEY, "nav_date", "nav"
    )


def valid_schemes(
    daily_returns: DataFrame,
    as_of=None,
    months: int = P.LOOKBACK_MONTHS,
    min_records: int = P.MIN_RECORDS_REQUIRED,
) -> DataFrame:
    """A2 + F8: schemes with at least ``min_records`` NAV rows in the lookback."""
    return (
        nav_in_lookback(daily_returns, as_of, months)
        .groupBy(KEY)
        .agg(F.count(F.lit(1)).alias("total_records"))
        .filter(F.col("total_records") >= min_records)
    )


def valid_scheme_nav(
    daily_returns: DataFrame,
    as_of=None,
    months: int = P.LOOKBACK_MONTHS,
    min_records: int = P.MIN_RECORDS_REQUIRED,
) -> DataFrame:
    """NAV rows of schemes that pass the minimum-history gate.

    Expressed as a partition-wide count instead of a join with
    :func:`valid_schemes`: same rows, one exchange, and the partitioning is
    shared with the row-number windows of :func:`ranked_nav`.
    """
    base = nav_in_lookback(daily_returns, as_of, months)
    n = F.count(F.lit(1)).over(_whole_scheme())
    return base.withColumn("_n", n).filter(F.col("_n") >= min_records).drop("_n")


def _whole_scheme():
    from pyspark.sql import Window

    return Window.partitionBy(KEY)


def ranked_nav(
    daily_returns: DataFrame,
    as_of=None,
    months: int = P.LOOKBACK_MONTHS,
    min_records: int = P.MIN_RECORDS_REQUIRED,
) -> DataFrame:
    """W9 + W10: row numbers from the first and from the last date."""
    base = valid_scheme_nav(daily_returns, as_of, months, min_records)
    return base.select(
        KEY,
        "nav_date",
        "nav",
        F.row_number().over(nav_window()).cast("bigint").alias("rn_start"),
        F.row_number().over(nav_window(desc=True)).cast("bigint").alias("rn_end"),
    )


def _first_last_aggs() -> list[Column]:
    # the NAV-date ordering only counts rows with a NAV (F4): rows whose NAV
    # is NULL get a NULL ordering value, which min_by / max_by skip.
    d = F.when(F.col("nav").isNotNull(), F.col("nav_date"))
    return [
        F.min(d).alias("start_date"),
        F.min_by("nav", d).alias("initial_nav"),
        F.max(d).alias("end_date"),
        F.max_by("nav", d).alias("final_nav"),
    ]


def first_last_nav(
    daily_returns: DataFrame,
    as_of=None,
    months: int = P.LOOKBACK_MONTHS,
    min_records: int = P.MIN_RECORDS_REQUIRED,
) -> DataFrame:
    """F9 + J5: first and last NAV per valid scheme, by date.

    ``min_by`` / ``max_by`` in one aggregate replace the two row-number
    filters and the self-join; the key ``(scheme_code, nav_date)`` is unique,
    so there are no ties.
    """
    return (
        nav_in_lookback(daily_returns, as_of, months)
        .groupBy(KEY)
        .agg(F.count(F.lit(1)).alias("_n"), *_first_last_aggs())
        .filter(F.col("_n") >= min_records)
        .drop("_n")
    )


def first_last_nav_ranked(
    daily_returns: DataFrame,
    as_of=None,
    months: int = P.LOOKBACK_MONTHS,
    min_records: int = P.MIN_RECORDS_REQUIRED,
) -> DataFrame:
    """The row-number + self-join form of :func:`first_last_nav` (same result)."""
    r = ranked_nav(daily_returns, as_of, months, min_records)
    start = r.filter(F.col("rn_start") == 1).select(
        KEY, F.col("nav_date").alias("start_date"), F.col("nav").alias("initial_nav")
    )
    end = r.filter(F.col("rn_end") == 1).select(
        KEY, F.col("nav_date").alias("end_date"), F.col("nav").alias("final_nav")
    )
    return start.join(end, KEY, "inner").select(KEY, "start_date", "initial_nav", "end_date", "final_nav")


def _cagr_ok(years: Column) -> Column:
    return (years > 0) & (F.col("initial_nav") > 0) & (F.col("final_nav") > 0)


def cagr(
    daily_returns: DataFrame,
    as_of=None,
    months: int = P.LOOKBACK_MONTHS,
    min_records: int = P.MIN_RECORDS_REQUIRED,
    days_per_year: float = P.DAYS_PER_YEAR,
) -> DataFrame:
    """A4: CAGR percent from the first and last NAV in the lookback."""
    fl = first_last_nav(daily_returns, as_of, months, min_records)
    years = years_between("start_date", "end_date", days_per_year)
    return fl.filter(_cagr_ok(years)).select(
        KEY, cagr_pct("initial_nav", "final_nav", years).alias("cagr_percent")
    )


def return_stats(
    daily_returns: DataFrame,
    as_of=None,
    months: int = P.LOOKBACK_MONTHS,
    min_records: int = P.MIN_RECORDS_REQUIRED,
) -> DataFrame:
    """A3: count, mean and sample standard deviation of non-NULL daily returns."""
    r = _in_lookback(daily_returns, as_of, months).filter(F.col("daily_return_pct").isNotNull())
    return (
        r.groupBy(KEY)
        .agg(
            F.count(F.lit(1)).alias("total_records"),
            F.avg("daily_return_pct").alias("avg_daily_return"),
            F.stddev_samp("daily_return_pct").alias("volatility"),
        )
        .filter(F.col("total_records") >= min_records)
    )


def sharpe_ratio(
    daily_returns: DataFrame,
    as_of=None,
    months: int = P.LOOKBACK_MONTHS,
    min_records: int = P.MIN_RECORDS_REQUIRED,
    risk_free_pct: float = P.RISK_FREE_RATE_PCT,
    trading_days: int = P.TRADING_DAYS,
) -> DataFrame:
    """A5 + F7: annualised Sharpe ratio; schemes with zero volatility drop out."""
    s = return_stats(daily_returns, as_of, months, min_records)
    return s.filter(F.col("volatility") > 0).select(
        KEY, sharpe("avg_daily_return", "volatility", risk_free_pct, trading_days).alias("sharpe_ratio")
    )


def daily_volatility(
    daily_returns: DataFrame,
    as_of=None,
    months: int = P.LOOKBACK_MONTHS,
    min_records: int = P.MIN_RECORDS_REQUIRED,
) -> DataFrame:
    """Rounded sample standard deviation of the daily return."""
    s = return_stats(daily_returns, as_of, months, min_records)
    return s.select(KEY, F.round("volatility", P.ROUND_DIGITS).alias("daily_volatility"))


def annualized_volatility(
    daily_returns: DataFrame,
    as_of=None,
    months: int = P.LOOKBACK_MONTHS,
    min_records: int = P.MIN_RECORDS_REQUIRED,
    trading_days: int = P.TRADING_DAYS,
) -> DataFrame:
    """Daily volatility x sqrt(252), rounded from the unrounded value."""
    s = return_stats(daily_returns, as_of, months, min_records)
    return s.select(KEY, annualize("volatility", trading_days).alias("annualized_volatility"))


def join_metrics(cagr_df: DataFrame, sharpe_df: DataFrame, dvol_df: DataFrame, avol_df: DataFrame) -> DataFrame:
    """CAGR as the base, the other three metrics left-joined by key (one row
    per scheme in each)."""
    return (
        cagr_df.join(sharpe_df, KEY, "left")
        .join(dvol_df, KEY, "left")
        .join(avol_df, KEY, "left")
        .select(KEY, "cagr_percent", "sharpe_ratio", "daily_volatility", "annualized_volatility")
    )


def scheme_metrics_joined(
    daily_returns: DataFrame,
    as_of=None,
    months: int = P.LOOKBACK_MONTHS,
    min_records: int = P.MIN_RECORDS_REQUIRED,
) -> DataFrame:
    """The joined form of :func:`scheme_metrics`: CAGR left-joined with the three
    ratios of one :func:`return_stats`, which is computed once."""
    stats = return_stats(daily_returns, as_of, months, min_records)
    ratios = stats.select(
        KEY,
        F.when(F.col("volatility") > 0, sharpe("avg_daily_return", "volatility")).alias("sharpe_ratio"),
        F.round("volatility", P.ROUND_DIGITS).alias("daily_volatility"),
        annualize("volatility").alias("annualized_volatility"),
    )
    return cagr(daily_returns, as_of, months, min_records).join(ratios, KEY, "left")


def scheme_metrics(
    daily_returns: DataFrame,
    as_of=None,
    months: int = P.LOOKBACK_MONTHS,
    min_records: int = P.MIN_RECORDS_REQUIRED,
    risk_free_pct: float = P.RISK_FREE_RATE_PCT,
    trading_days: int = P.TRADING_DAYS,
    days_per_year: float = P.DAYS_PER_YEAR,
) -> DataFrame:
    """E2 fused: CAGR, Sharpe, daily and annualised volatility in one aggregate.

    Gates as in the piecewise form: CAGR counts NAV rows, the other metrics
    count non-NULL returns, each with its own ``min_records`` gate; a scheme
    without a CAGR has no row at all (CAGR is the base of the join).
    """
    ret = F.col("daily_return_pct")
    agg = (
        _in_lookback(daily_returns, as_of, months)
        .groupBy(KEY)
        .agg(
            F.count("nav").alias("n_nav"),
            *_first_last_aggs(),
            F.count(ret).alias("n_ret"),
            F.avg(ret).alias("avg_ret"),
            F.stddev_samp(ret).alias("vol"),
        )
    )
    return metrics_of(agg, min_records, risk_free_pct, trading_days, days_per_year)


def metrics_of(
    agg: DataFrame,
    min_records: int = P.MIN_RECORDS_REQUIRED,
    risk_free_pct: float = P.RISK_FREE_RATE_PCT,
    trading_days: int = P.TRADING_DAYS,
    days_per_year: float = P.DAYS_PER_YEAR,
) -> DataFrame:
    """The gated metrics of one row a scheme: ``n_nav``, first and last NAV with their
    dates, ``n_ret``, ``avg_ret`` and ``vol`` (see :func:`scheme_metrics`)."""
    years = years_between("start_date", "end_date", days_per_year)
    enough_ret = F.col("n_ret") >= min_records
    return agg.filter((F.col("n_nav") >= min_records) & _cagr_ok(years)).select(
        KEY,
        cagr_pct("initial_nav", "final_nav", years).alias("cagr_percent"),
        F.when(enough_ret & (F.col("vol") > 0), sharpe("avg_ret", "vol", risk_free_pct, trading_days)).alias(
            "sharpe_ratio"
        ),
        F.when(enough_ret, F.round("vol", P.ROUND_DIGITS)).alias("daily_volatility"),
        F.when(enough_ret, annualize("vol", trading_days)).alias("annualized_volatility"),
    )
