"""Properties over random NAV series."""

import datetime as dt
import math

from helpers import NAV_SCHEMA
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from navframe.operators import enrich as X
from navframe.operators import metrics as M
from navframe.operators import returns as R

AS_OF = dt.date(2024, 12, 31)
D0 = dt.date(2023, 1, 1)

navs = st.lists(
    st.one_of(st.floats(min_value=0.5, max_value=5000.0, allow_nan=False), st.just(0.0)), min_size=1, max_size=120
)
schemes = st.lists(navs, min_size=1, max_size=4)


def _frame(spark, series_list):
    rows = []
    for code, vals in enumerate(series_list):
        for i, v in enumerate(vals):
            rows.append((code, D0 + dt.timedelta(days=i), float(v)))
    return spark.createDataFrame(rows, NAV_SCHEMA)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(series_list=schemes)
def test_feature_properties(spark, series_list):
    nav = _frame(spark, series_list)
    dr = R.return_features(nav, AS_OF).cache()
    rows = dr.collect()
    assert len(rows) == sum(len(s) for s in series_list)
    for r in rows:
        assert r["monthly_return_pct"] == r["rolling_return_30d_pct"]
        if r["prev_day_nav"] is None:
            assert r["moving_avg_7d"] == round(r["nav"], 6)
            assert r["daily_return_pct"] is None
    sm = M.scheme_metrics(dr, AS_OF, min_records=5).cache()
    keys = [r["scheme_code"] for r in sm.collect()]
    assert len(keys) == len(set(keys))
    joined = M.scheme_metrics_joined(dr, AS_OF, min_records=5).collect()
    assert sorted(map(tuple, sm.collect())) == sorted(map(tuple, joined))
    for r in sm.collect():
        if r["daily_volatility"] is not None:
            assert abs(r["annualized_volatility"] - r["daily_volatility"] * math.sqrt(252)) <= 1e-6 * math.sqrt(252) + 1e-6 * max(
                1.0, abs(r["annualized_volatility"])
            )
    enriched = X.nav_enriched_single_pass(dr, AS_OF, min_records=5)
    assert enriched.count() == len(rows)
    via_join = X.nav_enriched(dr, sm)
    a = sorted(map(tuple, enriched.collect()), key=lambda t: (t[0], t[1]))
    b = sorted(map(tuple, via_join.collect()), key=lambda t: (t[0], t[1]))
    assert a == b
    dr.unpersist()
    sm.unpersist()


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(series_list=schemes, cut=st.integers(min_value=0, max_value=120))
def test_delta_partitions_the_features(spark, series_list, cut):
    from navframe.operators.delta import new_rows

    nav = _frame(spark, series_list)
    feats = R.return_features(nav, AS_OF)
    stored = nav.filter(F.col("nav_date") < F.lit(D0 + dt.timedelta(days=cut)))
    delta = new_rows(feats, stored, ["scheme_code", "nav_date"])
    assert delta.count() + stored.count() == feats.count()
    assert new_rows(feats, feats, ["scheme_code", "nav_date"]).count() == 0


dec_navs = st.lists(
    st.one_of(st.none(), st.decimals(min_value="0.000001", max_value="99999.999999", places=6, allow_nan=False)),
    min_size=1,
    max_size=260,
)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(vals=dec_navs)
def test_running_sum_moving_average_is_exact_for_decimals(spark, vals):
    from pyspark.sql import types as T

    schema = T.StructType(
        [
            T.StructField("scheme_code", T.LongType()),
            T.StructField("nav_date", T.DateType()),
            T.StructField("nav", T.DecimalType(18, 6)),
        ]
    )
    nav = spark.createDataFrame([(1, D0 + dt.timedelta(days=i), v) for i, v in enumerate(vals)], schema)
    frame = R.moving_average_columns(exact_running_sum=False)
    fast = R.moving_average_columns(exact_running_sum=True)
    out = nav.select("nav_date", *[frame[k].alias("f_" + k) for k in frame], *[fast[k].alias("x_" + k) for k in fast])
    for r in out.collect():
        for k in frame:
            assert r["f_" + k] == r["x_" + k], (k, r)
