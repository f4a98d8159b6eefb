"""Streaming ingest and the composite pipeline over written tables."""

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from navframe import schemas as S
from navframe.operators import enrich, metrics, returns
from navframe.plans import jobs, landing
from navframe.plans.catalog import AS_OF
from navframe.sources import tables as T
from navframe.streaming.nav_ingest import start_nav_ingest

SF = "/root/testdata/sf0.001"


def _doc(code, items):
    return json.dumps(
        {"meta": {"scheme_code": code, "fund_house": "H", "scheme_name": "S"}, "data": [{"date": d, "nav": n} for d, n in items]}
    )


def test_stream_ingest_is_keyed_and_idempotent(spark, tmp_dir):
    land = os.path.join(tmp_dir, "landing")
    os.makedirs(land)
    raw = os.path.join(tmp_dir, "raw_nav")
    quarantine = os.path.join(tmp_dir, "quarantine")
    with open(os.path.join(land, "b1.json"), "w") as f:
        f.write(_doc(1, [("01-01-2024", "10"), ("02-01-2024", "11"), ("02-01-2024", "12")]) + "\n")
        f.write(_doc(2, [("01-01-2024", "bad"), ("05-01-2024", "3.5")]) + "\n")
    ckpt = os.path.join(tmp_dir, "ckpt")
    schemes = os.path.join(tmp_dir, "schemes")
    spark.createDataFrame([(1,), (2,)], "scheme_code bigint").write.parquet(schemes)
    q = start_nav_ingest(spark, land, raw, ckpt, quarantine, schemes=schemes)
    q.awaitTermination(120)
    got = {(r["scheme_code"], r["nav_date"]): r["nav"] for r in spark.read.parquet(raw).collect()}
    assert got == {
        (1, dt.date(2024, 1, 1)): 10,
        (1, dt.date(2024, 1, 2)): 11,  # first write wins
        (2, dt.date(2024, 1, 5)): 3.5,
    }
    assert spark.read.parquet(quarantine).count() == 1
    assert [f.name for f in spark.read.parquet(raw).schema.fields] == S.RAW_NAV.fieldNames()
    # a second landing with an already-stored key and a new one
    with open(os.path.join(land, "b2.json"), "w") as f:
        f.write(_doc(1, [("02-01-2024", "99"), ("03-01-2024", "13")]) + "\n")
    q = start_nav_ingest(spark, land, raw, ckpt, quarantine)
    q.awaitTermination(120)
    got = {(r["scheme_code"], r["nav_date"]): r["nav"] for r in spark.read.parquet(raw).collect()}
    assert len(got) == 4 and got[(1, dt.date(2024, 1, 2))] == 11


def test_pipeline_matches_in_memory_plan(spark, tmp_dir):
    wh = jobs.Warehouse(os.path.join(tmp_dir, "wh"))
    nav = T.load_nav(spark, SF)
    sch_land = os.path.join(tmp_dir, "schemes")
    nav_land = os.path.join(tmp_dir, "nav")
    landing.land_scheme_pages(T.read_table(spark, SF, "supplier"), sch_land)
    landing.land_nav_documents(nav, nav_land)
    jobs.run_pipeline(spark, sch_land, nav_land, wh, AS_OF)
    assert spark.read.parquet(wh.path("schemes")).count() == T.read_table(spark, SF, "supplier").count()
    assert spark.read.parquet(wh.path("raw_nav")).count() == nav.count()
    enriched = spark.read.parquet(wh.path("nav_enriched"))
    S.check(enriched, S.NAV_ENRICHED)
    dr = returns.return_features(nav, AS_OF)
    expect = enrich.nav_enriched_single_pass(dr, AS_OF)
    assert enriched.count() == expect.count() == spark.read.parquet(wh.path("daily_returns")).count()
    # decimal(18,6) storage vs double plan: equal within rounding
    j = enriched.alias("a").join(expect.alias("b"), ["scheme_code", "nav_date"])
    # NAVs are stored with 6 decimals, so compare relative differences
    def rel(c):
        a, b = F.col(f"a.{c}").cast("double"), F.col(f"b.{c}")
        return F.max(F.abs(a - b) / F.greatest(F.abs(b), F.lit(1.0))).alias(c)

    cols = ["daily_return_pct", "moving_avg_30d", "cagr_percent", "sharpe_ratio", "daily_volatility"]
    worst = j.select(*[rel(c) for c in cols]).collect()[0].asDict()
    assert all(v is not None and v < 1e-6 for v in worst.values()), worst
    # rerunning E1 on unchanged input appends nothing
    assert jobs.run_daily_returns(spark, wh, AS_OF) == 0
    # E6 returns its row count from an observed metric
    n = jobs.run_daily_return_5y(spark, wh, AS_OF)
    assert n == spark.read.parquet(wh.path("daily_returns_5y")).count() > 0
    assert jobs.run_table_count(spark, wh.path("raw_nav")).collect()[0]["total_rows"] == nav.count()
    sm = spark.read.parquet(wh.path("scheme_metrics"))
    assert sm.count() == metrics.scheme_metrics(dr, AS_OF).count()


def test_weather_load_appends_each_run(spark, tmp_dir):
    wh = jobs.Warehouse(os.path.join(tmp_dir, "wh"))
    land = os.path.join(tmp_dir, "weather")
    landing.land_weather(T.read_table(spark, SF, "events"), land)
    jobs.run_weather_load(spark, land, wh)
    jobs.run_weather_load(spark, land, wh)
    w = spark.read.parquet(wh.path("weather"))
    S.check(w, S.WEATHER)
    assert w.count() == 2 * T.read_table(spark, SF, "events").count()


def test_csv_preview_job(spark, tmp_dir):
    land = os.path.join(tmp_dir, "csv")
    landing.land_orders_csv(T.read_table(spark, SF, "orders"), land)
    schema, prev = jobs.run_csv_preview(spark, land, ["o_orderkey"], 100)
    assert "o_totalprice:string" in schema
    assert prev.count() == 100


def test_bucketed_pipeline_has_no_shuffle_and_same_result(spark, tmp_dir):
    nav = T.load_nav(spark, SF)
    sch_land = os.path.join(tmp_dir, "schemes")
    nav_land = os.path.join(tmp_dir, "nav")
    landing.land_scheme_pages(T.read_table(spark, SF, "supplier"), sch_land)
    landing.land_nav_documents(nav, nav_land)
    plain = jobs.Warehouse(os.path.join(tmp_dir, "plain"))
    buck = jobs.Warehouse(os.path.join(tmp_dir, "bucketed"), buckets=4, prefix="t_bucketed_")
    jobs.run_pipeline(spark, sch_land, nav_land, plain, AS_OF)
    jobs.run_pipeline(spark, sch_land, nav_land, buck, AS_OF)
    cols = S.NAV_ENRICHED.fieldNames()
    a = sorted(map(tuple, plain.table("nav_enriched").read(spark).select(*cols).collect()))
    b = sorted(map(tuple, buck.table("nav_enriched").read(spark).select(*cols).collect()))
    assert a == b and len(a) > 0

    def exchanges(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange")

    raw = buck.table("raw_nav").read(spark).select("scheme_code", "nav_date", "nav")
    dr = buck.table("daily_returns").read(spark)
    sm = buck.table("scheme_metrics").read(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanges(returns.return_features(raw, AS_OF)) == 0
        assert exchanges(metrics.scheme_metrics(dr, AS_OF)) == 0
        assert exchanges(enrich.nav_enriched(dr, sm)) == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_cli_runs_jobs(spark, tmp_dir):
    from navframe import cli

    land = os.path.join(tmp_dir, "nav")
    landing.land_nav_documents(T.load_nav(spark, SF), land)
    wh = os.path.join(tmp_dir, "wh")
    assert cli.main(["nav", "--nav-landing", land, "--warehouse", wh]) == 0
    assert cli.main(["daily-returns", "--warehouse", wh, "--as-of", AS_OF.isoformat()]) == 0
    assert cli.main(["metrics", "--warehouse", wh, "--as-of", AS_OF.isoformat()]) == 0
    assert cli.main(["enriched", "--warehouse", wh]) == 0
    assert spark.read.parquet(os.path.join(wh, "nav_enriched")).count() == spark.read.parquet(
        os.path.join(wh, "daily_returns")
    ).count()


def test_year_partitioned_pipeline_prunes_history(spark, tmp_dir):
    nav = T.load_nav(spark, SF)
    sch_land = os.path.join(tmp_dir, "schemes")
    nav_land = os.path.join(tmp_dir, "nav")
    landing.land_scheme_pages(T.read_table(spark, SF, "supplier"), sch_land)
    landing.land_nav_documents(nav, nav_land)
    plain = jobs.Warehouse(os.path.join(tmp_dir, "plain"))
    part = jobs.Warehouse(os.path.join(tmp_dir, "part"), buckets=4, year_partitioned=True, prefix="t_part_")
    jobs.run_pipeline(spark, sch_land, nav_land, plain, AS_OF)
    jobs.run_pipeline(spark, sch_land, nav_land, part, AS_OF)
    cols = S.NAV_ENRICHED.fieldNames()
    for t in ("nav_enriched", "scheme_metrics", "raw_nav"):
        a = sorted(map(tuple, plain.table(t).read(spark).select(*[c for c in cols if c in plain.table(t).read(spark).columns]).collect()))
        b = sorted(map(tuple, part.table(t).read(spark).select(*[c for c in cols if c in part.table(t).read(spark).columns]).collect()))
        assert a == b and len(a) > 0, t
    assert part.table("raw_nav").read(spark).columns == S.RAW_NAV.fieldNames()
    from navframe.functions.dates import lookback_start

    recent = part.table("raw_nav").read(spark, since=lookback_start(AS_OF, 36))
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(nav_year" in plan
    # rerun appends nothing; the stored side is read from the lookback years only
    assert jobs.run_daily_returns(spark, part, AS_OF) == 0


def test_nav_ingest_keeps_listed_schemes_only(spark, tmp_dir):
    wh = jobs.Warehouse(os.path.join(tmp_dir, "wh"))
    spark.createDataFrame([(1, "A", None, None)], "scheme_code bigint, scheme_name string, isin_growth string, isin_div_reinvestment string").write.parquet(wh.path("schemes"))
    land = os.path.join(tmp_dir, "nav")
    os.makedirs(land)
    with open(os.path.join(land, "a.json"), "w") as f:
        f.write(_doc(1, [("01-01-2024", "10")]) + "\n" + _doc(2, [("01-01-2024", "20")]) + "\n")
    assert jobs.run_nav_ingest(spark, land, wh) == 1
    assert [r["scheme_code"] for r in spark.read.parquet(wh.path("raw_nav")).collect()] == [1]


def test_cli_reports(spark, tmp_dir, capsys):
    from navframe import cli

    land = os.path.join(tmp_dir, "nav")
    landing.land_nav_documents(T.load_nav(spark, SF), land)
    wh = os.path.join(tmp_dir, "wh")
    assert cli.main(["nav", "--nav-landing", land, "--warehouse", wh]) == 0
    assert cli.main(["count", "--table", os.path.join(wh, "raw_nav")]) == 0
    assert cli.main(["people", "--landing", os.path.join(tmp_dir, "nothing-landed")]) == 0
    out = capsys.readouterr().out
    assert str(T.load_nav(spark, SF).count()) in out
    assert "Ye Guangfu is currently in space flying on the Tiangong! Hello! :)" in out
