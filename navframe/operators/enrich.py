"""The enriched NAV table (daily returns left-joined with scheme metrics)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from navframe.operators.joins import broadcast_if_small
from navframe.schemas import ENRICHED_COLUMNS

KEY = "scheme_code"


def nav_enriched(daily_returns: DataFrame, scheme_metrics: DataFrame) -> DataFrame:
    """J7 + P5: every daily-returns row with its scheme's metrics (NULL when
    the scheme has none); the five lag columns are dropped.

    ``scheme_metrics`` has one row per scheme. It is broadcast only when its
    size estimate is below the broadcast threshold; otherwise the join is a
    shuffle join on ``scheme_code`` (and when both sides already come
    hash-partitioned by ``scheme_code`` there is nothing to shuffle).
    """
    metrics = scheme_metrics.select(KEY, *[c for c in ENRICHED_COLUMNS[-4:]])
    joined = daily_returns.join(broadcast_if_small(metrics), KEY, "left")
    return joined.select(*ENRICHED_COLUMNS)


def nav_enriched_single_pass(
    daily_returns: DataFrame,
    as_of=None,
    months: int | None = None,
    min_records: int | None = None,
) -> DataFrame:
    """E2 + E3 in one pass when both come from the same daily-returns rows.

    The metric aggregates run as partition-wide window aggregates
    (``PARTITION BY scheme_code``) over the same partitioning and sort as the
    feature window, so the enriched table costs one exchange and no join, and
    the input is scanned once. Result equals
    ``nav_enriched(dr, scheme_metrics(dr))``.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from navframe import params as P
    from navframe.functions.dates import lookback_start
    from navframe.functions.finance import annualize, cagr_pct, sharpe, years_between

    months = P.LOOKBACK_MONTHS if months is None else months
    min_records = P.MIN_RECORDS_REQUIRED if min_records is None else min_records
    w = Window.partitionBy(KEY)
    in_lb = F.col("nav_date") >= lookback_start(as_of, months)
    nav = F.when(in_lb, F.col("nav"))
    ret = F.when(in_lb, F.col("daily_return_pct"))
    d = F.when(nav.isNotNull(), F.col("nav_date"))
    aggs = {
        "_n_nav": F.count(nav).over(w),
        "_start": F.min(d).over(w),
        "_end": F.max(d).over(w),
        "_first": F.min_by(nav, d).over(w),
        "_last": F.max_by(nav, d).over(w),
        "_n_ret": F.count(ret).over(w),
        "_avg": F.avg(ret).over(w),
        "_vol": F.stddev_samp(ret).over(w),
    }
    x = daily_returns.select(*ENRICHED_COLUMNS[:-4], *[c.alias(n) for n, c in aggs.items()])
    years = years_between("_start", "_end")
    has_row = (
        (F.col("_n_nav") >= min_records) & (years > 0) & (F.col("_first") > 0) & (F.col("_last") > 0)
    )
    enough = has_row & (F.col("_n_ret") >= min_records)
    return x.select(
        *ENRICHED_COLUMNS[:-4],
        F.when(has_row, cagr_pct("_first", "_last", years)).alias("cagr_percent"),
        F.when(enough & (F.col("_vol") > 0), sharpe("_avg", "_vol")).alias("sharpe_ratio"),
        F.when(enough, F.round("_vol", P.ROUND_DIGITS)).alias("daily_volatility"),
        F.when(enough, annualize("_vol")).alias("annualized_volatility"),
    )
