"""E1 for a batch of new NAV rows, from a stored tail instead of the lookback.

A feature row looks back over 199 rows at most (the longest moving average), so the
last ``TAIL_ROWS`` rows of each scheme are enough to compute the features of rows
that follow them. A batch costs its new rows and the tails, whatever the length of
the stored history.

A late row, dated no later than its scheme's stored tail, may need rows from before
the tail: its scheme is computed from the lookback, which is read for those schemes
alone. As in the full form a late NAV adds its own row; stored rows stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navframe import params as P
from navframe.functions.dates import lookback_start
from navframe.operators import returns as R

#: rows of a scheme that the features of a following row may need
TAIL_ROWS = max(*P.MOVING_AVG_ROWS, P.LAG_90D)


def tail(nav: DataFrame, rows: int = TAIL_ROWS) -> DataFrame:
    """The last ``rows`` NAVs of each scheme: ``scheme_code, nav_date, nav``."""
    newest = F.row_number().over(R.nav_window(desc=True))
    kept = nav.filter(F.col(R.KEY).isNotNull()).select(R.KEY, R.ORDER, "nav").withColumn("_newest", newest)
    return kept.filter(F.col("_newest") <= rows).drop("_newest")


def next_tail(stored: DataFrame, batch: DataFrame, rows: int = TAIL_ROWS) -> DataFrame:
    """The tail after a batch, whose keys are new."""
    columns = [R.KEY, R.ORDER, "nav"]
    return tail(stored.select(*columns).unionByName(batch.select(*columns)), rows)


def split_late(batch: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of schemes whose batch follows their tail, rows of schemes with a late
    row). A scheme without a tail follows it."""
    last = stored.groupBy(R.KEY).agg(F.max(R.ORDER).alias("_last"))
    first = batch.groupBy(R.KEY).agg(F.min(R.ORDER).alias("_first"))
    late = first.join(last, R.KEY).filter(F.col("_first") <= F.col("_last")).select(R.KEY)
    return batch.join(late, R.KEY, "left_anti"), batch.join(late, R.KEY, "left_semi")


def following_features(batch: DataFrame, stored: DataFrame, as_of=None, months: int = P.LOOKBACK_MONTHS, done: DataFrame | None = None) -> DataFrame:
    """The feature rows of a batch that follows the stored tail, but for those whose
    key is in ``done``: they are tagged on the narrow rows, in the windows' exchange, and
    the wide rows are never shuffled."""
    start = lookback_start(as_of, months)

    def rows(df: DataFrame, new: bool, here: bool) -> DataFrame:
        nav = F.col("nav") if here else F.lit(None).cast(batch.schema["nav"].dataType).alias("nav")
        return df.select(R.KEY, R.ORDER, nav, F.lit(new).alias("_new"), F.lit(here).alias("_here"))

    both = rows(stored, False, True).unionByName(rows(batch, True, True))
    if done is not None:
        both = both.unionByName(rows(done, False, False))
    both = both.filter(F.col(R.KEY).isNotNull() & (F.col(R.ORDER) >= start))
    if done is not None:
        fresh = F.min("_here") & F.max("_new")
        both = both.repartition(R.KEY).groupBy(R.KEY, R.ORDER).agg(F.max("nav").alias("nav"), fresh.alias("_new"), F.max("_here").alias("_here")).filter("_here")
    return R._with_returns(R._windowed(both.drop("_here"), carry=("_new",)).filter("_new").drop("_new"))


def late_features(late: DataFrame, nav: DataFrame, as_of=None, months: int = P.LOOKBACK_MONTHS) -> DataFrame:
    """The feature rows of a batch with late rows, from the series ``nav`` that holds
    it: the lookback of these schemes alone."""
    schemes = late.select(R.KEY).distinct()
    whole = R.return_features(nav.join(schemes, R.KEY, "left_semi"), as_of, months)
    return whole.join(late.select(R.KEY, R.ORDER), [R.KEY, R.ORDER], "left_semi")


# -- metrics from moments of months ----------------------------------------------------------


def monthly_moments(daily_returns: DataFrame) -> DataFrame:
    """Per scheme and month, what its metrics need: NAV rows with the first and last
    one, and count, mean and sum of squared deviations of the daily returns."""
    ret = F.col("daily_return_pct").cast("double")
    return daily_returns.groupBy(R.KEY, F.trunc("nav_date", "month").alias("month")).agg(
        F.count("nav").alias("n_nav"),
        F.min(F.when(F.col("nav").isNotNull(), F.struct("nav_date", "nav"))).alias("first"),
        F.max(F.when(F.col("nav").isNotNull(), F.struct("nav_date", "nav"))).alias("last"),
        F.count(ret).alias("n"),
        F.avg(ret).alias("mean"),
        (F.var_pop(ret) * F.count(ret)).alias("m2"),
    )


def total_moments(parts: str) -> Column:
    """``n``, ``mean`` and ``m2`` of an array of such parts, merged one after the other."""
    nothing = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def add(a, b):
        n, d = a["n"] + b["n"], b["mean"] - a["mean"]
        return F.struct(n.alias("n"), (a["mean"] + d * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + d * d * a["n"] * b["n"] / n).alias("m2"))

    return F.aggregate(parts, nothing, add)


def merged_moments(moments: DataFrame) -> DataFrame:
    """One row a scheme: the moments of its months, merged one after the other. A
    scheme has at most one row a month of the lookback."""
    part = F.struct("month", "n", "mean", "m2")
    merged = moments.groupBy(R.KEY).agg(
        F.sum("n_nav").alias("n_nav"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.sort_array(F.collect_list(F.when(F.col("n") > 0, part))).alias("parts"),
    )
    rows = merged.withColumn("t", total_moments("parts"))
    return rows.select(
        R.KEY,
        "n_nav",
        F.col("first.nav_date").alias("start_date"),
        F.col("first.nav").alias("initial_nav"),
        F.col("last.nav_date").alias("end_date"),
        F.col("last.nav").alias("final_nav"),
        F.col("t.n").alias("n_ret"),
        F.when(F.col("t.n") > 0, F.col("t.mean")).alias("avg_ret"),
        F.when(F.col("t.n") > 1, F.sqrt(F.col("t.m2") / (F.col("t.n") - 1))).alias("vol"),
    )


def first_whole_month(as_of=None, months: int = P.LOOKBACK_MONTHS):
    """The first month that lies wholly in the lookback."""
    start = lookback_start(as_of, months)
    month = F.trunc(start, "month")
    return F.when(month == start, month).otherwise(F.add_months(month, 1))


def metrics_from_moments(moments: DataFrame, daily_returns: DataFrame, as_of=None, months: int = P.LOOKBACK_MONTHS, **gates) -> DataFrame:
    """E2 from stored moments of months: of the daily returns only the month that the
    lookback begins in is read, if it begins inside one."""
    from navframe.operators.metrics import metrics_of

    start, whole = lookback_start(as_of, months), first_whole_month(as_of, months)
    edge = monthly_moments(daily_returns.filter((F.col("nav_date") >= start) & (F.col("nav_date") < whole)))
    return metrics_of(merged_moments(moments.filter(F.col("month") >= whole).select(*edge.columns).unionByName(edge)), **gates)
