"""Scheme metrics (E2): gates, edge cases, fused == piecewise."""

import datetime as dt
import math

import pytest
from helpers import D0, series
from pyspark.sql import functions as F

from navframe.operators import metrics as M
from navframe.operators import returns as R

AS_OF = dt.date(2024, 12, 31)


def _dr(spark, navs, code=1, **kw):
    return R.return_features(series(spark, navs, code=code, **kw), AS_OF)


def _metrics(df):
    return {r["scheme_code"]: r.asDict() for r in df.collect()}


def _wavy(n, base=100.0):
    return [base * (1 + 0.01 * math.sin(i)) + i * 0.05 for i in range(n)]


def test_exactly_30_rows_cagr_only(spark):
    dr = _dr(spark, _wavy(30))
    m = _metrics(M.scheme_metrics(dr, AS_OF))
    assert set(m) == {1}
    assert m[1]["cagr_percent"] is not None
    # 30 NAV rows but only 29 returns: the other three metrics are NULL
    assert m[1]["sharpe_ratio"] is None
    assert m[1]["daily_volatility"] is None
    assert m[1]["annualized_volatility"] is None
    assert _metrics(M.scheme_metrics_joined(dr, AS_OF)) == m


def test_only_29_rows_no_metrics(spark):
    dr = _dr(spark, _wavy(29))
    assert M.scheme_metrics(dr, AS_OF).count() == 0
    assert M.valid_schemes(dr, AS_OF).count() == 0


def test_constant_nav(spark):
    dr = _dr(spark, [50.0] * 40)
    m = _metrics(M.scheme_metrics(dr, AS_OF))[1]
    assert m["cagr_percent"] == 0.0
    assert m["daily_volatility"] == 0.0
    assert m["annualized_volatility"] == 0.0
    assert m["sharpe_ratio"] is None


def test_start_equals_end_no_row(spark):
    # 30 rows of one scheme on the same date is impossible (unique key); use
    # min_records=1 with a single row to reach years == 0.
    dr = _dr(spark, [10.0])
    assert M.scheme_metrics(dr, AS_OF, min_records=1).count() == 0
    assert M.cagr(dr, AS_OF, min_records=1).count() == 0


def test_non_positive_nav_drops_scheme(spark):
    navs = _wavy(40)
    navs[0] = 0.0
    dr = _dr(spark, navs)
    assert M.scheme_metrics(dr, AS_OF).count() == 0
    assert M.scheme_metrics_joined(dr, AS_OF).count() == 0


def test_cagr_value(spark):
    # 100 -> 121 over two years of 365.25 days (731 days is 2.0014 years)
    dates = [D0 + dt.timedelta(days=i) for i in range(29)] + [D0 + dt.timedelta(days=731)]
    navs = [100.0] * 29 + [121.0]
    dr = R.return_features(series(spark, navs, dates=dates), dt.date(2026, 1, 5))
    m = _metrics(M.cagr(dr, dt.date(2026, 1, 5)))[1]
    years = 731 / 365.25
    assert m["cagr_percent"] == round(((121.0 / 100.0) ** (1 / years) - 1) * 100, 6)


def test_sharpe_and_volatility_values(spark):
    navs = _wavy(60)
    dr = _dr(spark, navs)
    rets = [(navs[i] - navs[i - 1]) / navs[i - 1] * 100 for i in range(1, 60)]
    rets = [round(r, 6) for r in rets]
    mean = sum(rets) / len(rets)
    sd = math.sqrt(sum((r - mean) ** 2 for r in rets) / (len(rets) - 1))
    m = _metrics(M.scheme_metrics(dr, AS_OF))[1]
    assert m["daily_volatility"] == pytest.approx(round(sd, 6), abs=1e-6)
    assert m["annualized_volatility"] == pytest.approx(round(sd * math.sqrt(252), 6), abs=1e-6)
    assert m["sharpe_ratio"] == pytest.approx(round(math.sqrt(252) * (mean - 6.0 / 252) / sd, 6), abs=1e-6)


def test_annualized_is_daily_times_sqrt252(spark):
    dr = _dr(spark, _wavy(80))
    m = _metrics(M.scheme_metrics(dr, AS_OF))[1]
    assert abs(m["annualized_volatility"] - m["daily_volatility"] * math.sqrt(252)) < 1e-4


def test_null_nav_rows_ignored_for_first_last(spark):
    navs = _wavy(40)
    navs[0] = None
    navs[-1] = None
    dr = series(spark, navs).withColumn("daily_return_pct", F.lit(None).cast("double"))
    fl = M.first_last_nav(dr, AS_OF).collect()[0]
    assert fl["start_date"] == D0 + dt.timedelta(days=1)
    assert fl["initial_nav"] == navs[1]
    assert fl["end_date"] == D0 + dt.timedelta(days=38)
    assert fl["final_nav"] == navs[38]
    ranked = M.first_last_nav_ranked(dr, AS_OF).collect()[0]
    assert ranked.asDict() == fl.asDict()


def test_scheme_with_returns_but_no_cagr_is_dropped(spark):
    good = _dr(spark, _wavy(40), code=1)
    bad_navs = _wavy(40)
    bad_navs[-1] = -1.0
    bad = _dr(spark, bad_navs, code=2)
    dr = good.unionByName(bad)
    assert set(_metrics(M.sharpe_ratio(dr, AS_OF))) == {1, 2}
    assert set(_metrics(M.scheme_metrics(dr, AS_OF))) == {1}


def test_fused_has_no_join_and_no_window(spark, tmp_dir):
    dr = _dr(spark, _wavy(40))
    dr.write.parquet(tmp_dir + "/dr")
    stored = spark.read.parquet(tmp_dir + "/dr")
    plan = M.scheme_metrics(stored, AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert "Window" not in plan


def test_ranked_nav_numbers(spark):
    dr = _dr(spark, _wavy(35))
    r = {x["nav_date"]: x for x in M.ranked_nav(dr, AS_OF).collect()}
    assert r[D0]["rn_start"] == 1 and r[D0]["rn_end"] == 35
    last = D0 + dt.timedelta(days=34)
    assert r[last]["rn_start"] == 35 and r[last]["rn_end"] == 1
