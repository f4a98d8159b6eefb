"""Window features (E1, E6) on hand-computed micro fixtures."""

import datetime as dt
from decimal import Decimal

import pytest
from helpers import D0, series, rows_by_date
from pyspark.sql import functions as F

from navframe.operators import returns as R

AS_OF = dt.date(2024, 12, 31)


def test_single_row(spark):
    out = R.return_features(series(spark, [10.0]), AS_OF).collect()
    assert len(out) == 1
    r = out[0].asDict()
    for c in ("prev_day_nav", "prev_week_nav", "prev_month_nav", "nav_30d_ago", "nav_90d_ago"):
        assert r[c] is None
    for c in ("daily_return_pct", "weekly_return_pct", "monthly_return_pct", "rolling_return_30d_pct", "rolling_return_90d_pct"):
        assert r[c] is None
    for c in ("moving_avg_7d", "moving_avg_30d", "moving_avg_90d", "moving_avg_200d"):
        assert r[c] == 10.0


def test_zero_prev(spark):
    out = rows_by_date(R.return_features(series(spark, [10.0, 0.0, 5.0]), AS_OF))
    got = [out[D0 + dt.timedelta(days=i)]["daily_return_pct"] for i in range(3)]
    assert got == [None, -100.0, None]


def test_gap_dates_lag_counts_rows(spark):
    dates = [D0 + dt.timedelta(days=d) for d in (0, 1, 5, 6, 20, 21, 22, 40, 41)]
    navs = [float(i + 1) for i in range(9)]
    out = rows_by_date(R.return_features(series(spark, navs, dates=dates), AS_OF))
    last = out[dates[-1]]
    assert last["prev_day_nav"] == 8.0
    assert last["prev_week_nav"] == 2.0  # seven rows back, not seven days
    assert out[dates[7]]["prev_week_nav"] == 1.0
    assert out[dates[6]]["prev_week_nav"] is None


def test_moving_average_partial_frames(spark):
    navs = [float(i) for i in range(1, 11)]
    out = rows_by_date(R.return_features(series(spark, navs), AS_OF))
    assert out[D0]["moving_avg_7d"] == 1.0
    assert out[D0 + dt.timedelta(days=1)]["moving_avg_7d"] == 1.5
    # day 10: mean of 4..10
    assert out[D0 + dt.timedelta(days=9)]["moving_avg_7d"] == pytest.approx(7.0)
    assert out[D0 + dt.timedelta(days=9)]["moving_avg_30d"] == pytest.approx(5.5)


def test_rounding_six_digits(spark):
    out = rows_by_date(R.return_features(series(spark, [3.0, 4.0]), AS_OF))
    assert out[D0 + dt.timedelta(days=1)]["daily_return_pct"] == 33.333333
    assert out[D0 + dt.timedelta(days=1)]["moving_avg_7d"] == 3.5


def test_monthly_equals_rolling_30(spark):
    navs = [100.0 + (i % 7) * 1.5 + i * 0.1 for i in range(120)]
    df = R.return_features(series(spark, navs), AS_OF)
    bad = df.filter(~F.col("monthly_return_pct").eqNullSafe(F.col("rolling_return_30d_pct"))).count()
    assert bad == 0
    assert df.filter(F.col("rolling_return_90d_pct").isNotNull()).count() == 120 - 90


def test_lookback_edge_and_filter_order(spark):
    as_of = dt.date(2024, 3, 10)
    edge = dt.date(2021, 3, 10)  # as_of minus 36 months
    dates = [edge - dt.timedelta(days=1), edge, edge + dt.timedelta(days=1)]
    nav = series(spark, [10.0, 11.0, 12.1], dates=dates)
    f1 = rows_by_date(R.return_features(nav, as_of))
    assert set(f1) == {edge, edge + dt.timedelta(days=1)}  # boundary day included
    assert f1[edge]["daily_return_pct"] is None  # filter before lag
    f3 = rows_by_date(R.daily_return_5y(nav, as_of, months=36))
    assert set(f3) == {edge, edge + dt.timedelta(days=1)}
    assert f3[edge]["prev_nav"] == 10.0  # filter after lag
    assert f3[edge]["daily_return_pct"] == 10.0


def test_month_end_clamp(spark):
    as_of = dt.date(2024, 2, 29)
    dates = [dt.date(2021, 2, 27), dt.date(2021, 2, 28), dt.date(2021, 3, 1)]
    out = rows_by_date(R.lookback(series(spark, [1.0, 2.0, 3.0], dates=dates), as_of))
    assert set(out) == {dt.date(2021, 2, 28), dt.date(2021, 3, 1)}


def test_multiple_schemes_isolated(spark):
    a = series(spark, [1.0, 2.0, 3.0], code=1)
    b = series(spark, [10.0, 20.0], code=2)
    out = R.return_features(a.unionByName(b), AS_OF)
    firsts = out.filter(F.col("nav_date") == D0).collect()
    assert sorted(r["scheme_code"] for r in firsts) == [1, 2]
    assert all(r["prev_day_nav"] is None for r in firsts)


def test_decimal_nav_keeps_decimal_arithmetic(spark):
    nav = series(spark, [3.0, 4.0]).withColumn("nav", F.col("nav").cast("decimal(18,6)"))
    out = rows_by_date(R.return_features(nav, AS_OF))
    r = out[D0 + dt.timedelta(days=1)]
    assert r["daily_return_pct"] == Decimal("33.333333")
    assert r["moving_avg_7d"] == Decimal("3.5")


def test_single_window_node(spark):
    df = R.return_features(series(spark, [1.0, 2.0]), AS_OF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    windows = [ln for ln in plan.splitlines() if ln.strip().lstrip("+-: ").startswith("Window")]
    assert len(windows) == 1
