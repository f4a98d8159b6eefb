"""Driver entry smoke test and plan-shape checks at the test scale."""

from conftest import SF001

import __spark_entry__ as E
from navframe.plans import catalog as C


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert len(df.columns) == 17
    assert df.count() > 0


def test_lookback_reaches_the_scan(spark):
    p = C.q_return_features(spark, SF001)._jdf.queryExecution().executedPlan().toString()
    pushed = p[p.index("PushedFilters") :]
    assert all(x in pushed for x in ("IsNotNull(l_shipdate)", "GreaterThanOrEqual(l_shipdate", "IsNotNull(l_suppkey)"))


def test_scan_reads_only_needed_columns(spark):
    df = C.q_return_features(spark, SF001)
    p = _plan(df)
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double,l_extendedprice:double,l_shipdate:timestamp_ntz>" in p


def test_five_year_returns_window_only_the_range(spark):
    # the window sees only the last five years (pushed to the scan); the rows
    # before feed one carried NAV per scheme through an aggregate, not a window
    df = C.q_daily_return_5y(spark, SF001)
    p = _plan(df)
    assert "GreaterThanOrEqual(l_shipdate,1996-11-04" in p
    assert "LessThan(l_shipdate,1996-11-04" in p
    assert "partial_max_by" in p


def test_single_pass_enriched_has_no_join(spark):
    p = _plan(C.q_nav_enriched(spark, SF001))
    assert "Join" not in p


def test_fused_metrics_reuse_window_partitioning(spark):
    p = _plan(C.CATALOG["scheme_metrics"].build(spark, SF001))
    # exchanges: two stand-in aggregates + one for the window; none for the metric aggregate
    import re

    assert len(re.findall(r"hashpartitioning\(scheme_code#\d+L, \d+\)", p)) == 1


def _partial_before_exchange(plan: str, fn: str) -> bool:
    """``partial_<fn>`` appears below (after, in the text) an Exchange."""
    i = plan.find("Exchange")
    return i >= 0 and f"partial_{fn}" in plan[i:]


def test_skew_safe_aggregates_combine_map_side(spark):
    import datetime as dt

    from pyspark.sql import functions as F

    from navframe.operators.delta import first_write_wins
    from navframe.operators.portfolio import holdings_from_positions, portfolio_daily_returns, portfolio_weights

    # one hot key with many duplicates: collapsed before the shuffle
    rows = spark.range(0, 50_000).select(
        F.lit(7).cast("bigint").alias("scheme_code"),
        F.lit(dt.date(2024, 1, 1)).alias("nav_date"),
        F.col("id").cast("double").alias("nav"),
        F.col("id").alias("pos"),
    )
    fww = first_write_wins(rows, ["scheme_code", "nav_date"], ["pos"])
    assert _partial_before_exchange(_plan(fww), "min_by")
    assert [r["nav"] for r in fww.collect()] == [0.0]

    pos = spark.range(0, 20_000).select(
        F.lit(1).cast("bigint").alias("portfolio_id"),
        (F.col("id") % 500).alias("scheme_code"),
        F.lit(1.0).alias("value"),
    )
    h = holdings_from_positions(pos)
    assert _partial_before_exchange(_plan(h), "sum")
    dr = spark.range(0, 500).select(
        F.col("id").alias("scheme_code"), F.lit(dt.date(2024, 1, 2)).alias("nav_date"), F.lit(1.0).alias("daily_return_pct")
    )
    pr = portfolio_daily_returns(portfolio_weights(h), dr, dt.date(2024, 1, 31))
    assert _partial_before_exchange(_plan(pr), "sum")
    assert pr.collect()[0]["portfolio_return_pct"] == 1.0


def _exchanges(df) -> tuple[int, int]:
    """Hash exchanges of a plan without broadcasts, computed and reused."""
    import re

    plan = _plan(df)
    made = [x for x in re.findall(r".*Exchange hashpartitioning", plan) if "Reused" not in x]
    return len(made), plan.count("ReusedExchange")


def test_shared_inputs_are_shuffled_once(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        # nav series (2 stand-ins), the window; the metrics branch reuses the window's exchange
        made, reused = _exchanges(C.CATALOG["nav_enriched_join"].build(spark, SF001))
        assert made <= 3 and reused >= 1
        made, reused = _exchanges(C.CATALOG["scheme_metrics_joined"].build(spark, SF001))
        assert made <= 4 and reused >= 1
        # the wide feature rows aren't shuffled after the window
        plan = _plan(C.CATALOG["delta_anti_join"].build(spark, SF001))
        top = plan[: plan.index("Window")]
        assert "Exchange" not in top and "Join" not in plan
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
