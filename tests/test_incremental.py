"""E1 and E2 batch by batch and as a stream, against the full forms."""

import datetime as dt
import os
import random
from decimal import Decimal

import pytest
from helpers import series  # noqa: F401  (fixture module on the path)
from pyspark.sql import functions as F

from navframe import schemas as S
from navframe.operators import incremental, metrics, returns
from navframe.plans import jobs
from navframe.sinks import writers as W
from navframe.streaming.features import start_features

AS_OF = dt.date(2024, 6, 15)


def nav_rows(seed, n_schemes=6, days=420):
    """Series with gaps, null and zero NAVs; a new and a very short scheme."""
    rng = random.Random(seed)
    first = dt.date(2023, 5, 1)
    rows = []
    for code in range(n_schemes):
        begin = 0 if code else days - 20  # the first scheme is new
        for d in range(begin, 5 if code == 1 else days):
            if rng.random() < 0.8:
                nav = None if rng.random() < 0.01 else Decimal(rng.randrange(0, 10**7) if rng.random() < 0.99 else 0) / 10**4
                rows.append((code, first + dt.timedelta(days=d), nav))
    return rows


def raw(spark, rows):
    return spark.createDataFrame([(*r, None, None) for r in rows], "scheme_code bigint, nav_date date, nav decimal(18,6), fund_house string, scheme_name string")


def stored(spark, wh, table="daily_returns"):
    return sorted((tuple(r) for r in wh.table(table).read(spark).collect()), key=repr)


def full(spark, rows, as_of=AS_OF):
    nav = raw(spark, rows).select("scheme_code", "nav_date", "nav")
    return sorted((tuple(r) for r in S.conform(returns.return_features(nav, as_of), S.DAILY_RETURNS).collect()), key=repr)


def test_successive_batches_equal_the_full_run(spark, tmp_dir):
    rows = nav_rows(1)
    wh = jobs.Warehouse(os.path.join(tmp_dir, "wh"))
    days = sorted({r[1] for r in rows})
    cuts = [days[0], days[200], days[300], days[-10], days[-1] + dt.timedelta(days=1)]
    appended = []
    for low, high in zip(cuts, cuts[1:]):
        W.append(raw(spark, [r for r in rows if low <= r[1] < high]), wh.table("raw_nav"), S.RAW_NAV)
        appended.append(jobs.run_daily_returns_incremental(spark, wh, AS_OF))
    assert jobs.run_daily_returns_incremental(spark, wh, AS_OF) == 0  # nothing came
    assert sum(appended) == len(rows) and all(appended)
    assert stored(spark, wh) == full(spark, rows)


def test_a_batch_reads_no_lookback(spark, tmp_dir, monkeypatch):
    rows = nav_rows(2, 3)
    wh = jobs.Warehouse(os.path.join(tmp_dir, "wh"))
    cut = sorted({r[1] for r in rows})[-5]
    W.append(raw(spark, [r for r in rows if r[1] < cut]), wh.table("raw_nav"), S.RAW_NAV)
    jobs.run_daily_returns_incremental(spark, wh, AS_OF)
    W.append(raw(spark, [r for r in rows if r[1] >= cut]), wh.table("raw_nav"), S.RAW_NAV)
    plans = []
    real = W.append_new
    monkeypatch.setattr(W, "append_new", lambda s, df, *a, **k: plans.append(df._jdf.queryExecution().toString()) or real(s, df, *a, **k))
    assert jobs.run_daily_returns_incremental(spark, wh, AS_OF) == len([r for r in rows if r[1] >= cut])
    scans = [x for x in plans[0].split("\n") if "FileScan parquet" in x]
    assert scans and all("GreaterThan(created_at" in x or "daily_returns_tail" in x for x in scans)
    assert stored(spark, wh) == full(spark, rows)


def test_a_late_row_gets_its_own_features(spark, tmp_dir):
    rows = nav_rows(3, 4)
    late = [r for r in rows if r[0] == 2][-260:-258] + [r for r in rows if r[0] == 3][-3:-2]
    on_time = [r for r in rows if r not in late and r[1] < dt.date(2024, 6, 1)]
    after = [r for r in rows if r not in late and r[1] >= dt.date(2024, 6, 1)]
    wh = jobs.Warehouse(os.path.join(tmp_dir, "wh"))
    W.append(raw(spark, on_time), wh.table("raw_nav"), S.RAW_NAV)
    jobs.run_daily_returns_incremental(spark, wh, AS_OF)
    before = set(stored(spark, wh))
    W.append(raw(spark, late + after), wh.table("raw_nav"), S.RAW_NAV)
    assert jobs.run_daily_returns_incremental(spark, wh, AS_OF) == len(late + after)
    now = set(stored(spark, wh))
    assert before <= now  # stored rows stay as they were
    whole = {r[:2]: r for r in full(spark, rows)}
    assert {r[:2] for r in now} == set(whole)
    assert all(r == whole[r[:2]] for r in now - before)


def test_stored_keys_meet_narrow_rows(spark, tmp_dir, monkeypatch):
    rows = nav_rows(6, 3)
    cut = dt.date(2024, 5, 1)
    wh = jobs.Warehouse(os.path.join(tmp_dir, "wh"))
    W.append(raw(spark, [r for r in rows if r[1] < cut]), wh.table("raw_nav"), S.RAW_NAV)
    jobs.run_daily_returns_incremental(spark, wh, AS_OF)
    W.append(raw(spark, [r for r in rows if r[1] >= cut]), wh.table("raw_nav"), S.RAW_NAV)
    plans, append = [], W.append_counted

    def spied(df, *rest):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return append(df, *rest)

    monkeypatch.setattr(W, "append_counted", spied)
    assert jobs.run_daily_returns_incremental(spark, wh, AS_OF) == len([r for r in rows if r[1] >= cut])
    above = plans[0].split("Window")[0]  # the wide rows go straight to their files
    assert len(plans) == 1 and "Window" in plans[0] and "Join" not in above and "Exchange" not in above
    assert stored(spark, wh) == full(spark, rows)


def test_a_driver_that_dies_before_the_tail_is_named(spark, tmp_dir, monkeypatch):
    from navframe.sinks.versions import VersionedTable

    rows = nav_rows(4, 3)
    cut = dt.date(2024, 5, 1)
    wh = jobs.Warehouse(os.path.join(tmp_dir, "wh"))
    W.append(raw(spark, [r for r in rows if r[1] < cut]), wh.table("raw_nav"), S.RAW_NAV)
    jobs.run_daily_returns_incremental(spark, wh, AS_OF)
    W.append(raw(spark, [r for r in rows if r[1] >= cut]), wh.table("raw_nav"), S.RAW_NAV)
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "write", lambda *a: (_ for _ in ()).throw(RuntimeError("gone")))
        with pytest.raises(RuntimeError):
            jobs.run_daily_returns_incremental(spark, wh, AS_OF)
    assert jobs.run_daily_returns_incremental(spark, wh, AS_OF) == 0  # the rows are there already
    assert stored(spark, wh) == full(spark, rows)
    assert VersionedTable(wh.path("daily_returns_tail")).latest(spark)[0] == 2


@pytest.mark.parametrize("as_of", [dt.date(2024, 6, 15), dt.date(2026, 6, 1), dt.date(2026, 7, 19), dt.date(2027, 4, 30)])
def test_metrics_from_moments_as_the_lookback_moves(spark, as_of):
    nav = raw(spark, nav_rows(5, 5)).select("scheme_code", "nav_date", "nav")
    dr = returns.return_features(nav, AS_OF)
    made = incremental.metrics_from_moments(incremental.monthly_moments(dr), dr, as_of)
    want = {r["scheme_code"]: r for r in metrics.scheme_metrics(dr, as_of).collect()}
    got = {r["scheme_code"]: r for r in made.collect()}
    assert got.keys() == want.keys()
    for code, row in want.items():
        for c in S.METRIC_COLUMNS:
            assert (got[code][c] is None) == (row[c] is None)
            assert row[c] is None or abs(float(got[code][c]) - float(row[c])) <= 1.1e-6


def test_moments_read_two_raw_months_at_most(spark, tmp_dir):
    rows = nav_rows(6, 3)
    wh = jobs.Warehouse(os.path.join(tmp_dir, "wh"))
    W.append(raw(spark, rows), wh.table("raw_nav"), S.RAW_NAV)
    jobs.run_daily_returns_incremental(spark, wh, AS_OF)
    for as_of in (AS_OF, dt.date(2026, 6, 20)):
        jobs.run_scheme_metrics_incremental(spark, wh, as_of)
        want = {r["scheme_code"]: r for r in metrics.scheme_metrics(wh.table("daily_returns").read(spark), as_of).collect()}
        got = {r["scheme_code"]: r for r in wh.table("scheme_metrics").read(spark).collect()}
        assert got.keys() == want.keys() and all(abs(float(got[c]["cagr_percent"]) - float(r["cagr_percent"])) < 1e-5 for c, r in want.items())
    moments = spark.read.parquet(wh.path("return_moments"))
    dr = wh.table("daily_returns").read(spark)
    plan = incremental.metrics_from_moments(moments, dr, dt.date(2026, 6, 20))._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.split("\n") if "FileScan parquet" in x and "daily_return_pct" in x)
    assert "GreaterThanOrEqual(nav_date,2023-06-20)" in scan and "LessThan(nav_date,2023-07-01)" in scan
    months = [x for x in plan.split("\n") if "FileScan parquet" in x and "month" in x]
    assert months and all("PartitionFilters: [isnotnull(month" in x for x in months)


@pytest.mark.parametrize("n_files", [1, 3])
def test_streamed_features_equal_the_batch(spark, tmp_dir, n_files):
    rows = nav_rows(7, 3, 260)
    land, out, ckpt = (os.path.join(tmp_dir, x) for x in ("raw_nav", "out", "ckpt"))
    days = sorted({r[1] for r in rows})
    cuts = [days[0], *[days[len(days) * i // n_files] for i in range(1, n_files)], days[-1] + dt.timedelta(days=1)]
    since = dt.date(2021, 6, 15)
    for low, high in zip(cuts, cuts[1:]):  # a run for each file: state is restored from the checkpoint
        part = raw(spark, [r for r in rows if low <= r[1] < high]).withColumn("created_at", F.current_timestamp())
        part.coalesce(1).write.mode("append").parquet(land)
        start_features(spark, land, out, ckpt, since).awaitTermination(240)
    got = sorted((tuple(r) for r in spark.read.parquet(out).collect()), key=repr)
    assert got == full(spark, rows)


def test_late_and_repeated_rows_of_the_stream():
    import pandas as pd

    from navframe.streaming.features import _advance

    class State:
        def __init__(self):
            self.value = None

        exists = property(lambda self: self.value is not None)
        get = property(lambda self: self.value)

        def update(self, value):
            self.value = value

    state = State()
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    batch = lambda *r: pd.DataFrame([(1, day(i), Decimal(v)) for i, v in r], columns=["scheme_code", "nav_date", "nav"])
    first = pd.concat(_advance((1,), iter([batch((0, 1), (4, 5), (2, 3))]), state))
    assert [(r.nav_date, r.prev_day_nav) for r in first.itertuples()] == [(day(0), None), (day(2), 1), (day(4), 3)]
    second = pd.concat(_advance((1,), iter([batch((3, 4), (2, 99), (5, 6))]), state))
    # the late day 3 sees day 2; the repeated day 2 is ignored; day 5 follows
    assert [(r.nav_date, r.prev_day_nav, r.sum_7, r.count_7) for r in second.itertuples()] == [(day(3), 3, 8, 3), (day(5), 5, 19, 5)]
