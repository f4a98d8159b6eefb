"""Command line for the jobs: ``python -m navframe.cli <job> [options]``.

Each job reads its inputs from landed files / the warehouse folder and writes
its output table there (see :mod:`navframe.plans.jobs`). Spark settings
(master, memory, checkpoint dir) come from ``spark-submit`` / the
environment as usual.
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from pyspark.errors import AnalysisException

from navframe.operators.joins import estimated_size_bytes
from navframe.plans import jobs
from navframe.session import apply_cluster_settings, get_session
from navframe.sinks.table import ABSENT

JOBS = [
    "create-tables",
    "pipeline",
    "schemes",
    "nav",
    "daily-returns",
    "metrics",
    "enriched",
    "returns-5y",
    "weather",
    "count",
    "csv-preview",
    "people",
    "stream-nav",
]


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="navframe", description=__doc__.splitlines()[0])
    p.add_argument("job", choices=JOBS)
    p.add_argument("--warehouse", help="root folder of the pipeline tables")
    p.add_argument("--buckets", type=int, default=None, help="bucket keyed tables by scheme_code")
    p.add_argument("--year-partitioned", action="store_true", help="partition dated tables by year")
    p.add_argument("--scheme-landing", help="folder of landed scheme-list pages")
    p.add_argument("--nav-landing", help="folder of landed NAV documents (JSON Lines)")
    p.add_argument("--landing", help="folder of landed files for weather / people / csv jobs")
    p.add_argument("--table", help="table folder for the count job")
    p.add_argument("--as-of", type=dt.date.fromisoformat, default=None, help="reference date (default: today)")
    p.add_argument("--order-by", default=None, help="comma-separated preview order")
    p.add_argument("--rows", type=int, default=100, help="preview rows")
    p.add_argument("--checkpoint", default=None, help="checkpoint folder of the stream (default: in the warehouse)")
    p.add_argument("--input-bytes", type=int, default=None, help="size of the inputs, for the shuffle width (default: looked up)")
    p.add_argument("--master", default=None, help="only for local runs")
    return p


def _landed_bytes(spark, path: str) -> int:
    try:
        return estimated_size_bytes(spark.read.text(path)) or 0
    except AnalysisException as e:
        if e.getCondition() not in ABSENT:
            raise
        return 0


def _input_bytes(spark, a, wh) -> int:
    """Bytes of the landed files and stored tables that the job may read. What
    is absent counts nothing; the job itself says what an absent input means."""
    total = 0
    for path in (a.scheme_landing, a.nav_landing, a.landing):
        if path:
            total += _landed_bytes(spark, path)
    for name in ("raw_nav", "daily_returns") if wh else ():
        if wh.table(name).exists(spark):
            total += estimated_size_bytes(spark.read.parquet(wh.path(name))) or 0
    return total


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = get_session(a.master, app_name=f"navframe-{a.job}")
    wh = jobs.Warehouse(a.warehouse, buckets=a.buckets, year_partitioned=a.year_partitioned) if a.warehouse else None
    apply_cluster_settings(spark, a.input_bytes if a.input_bytes is not None else _input_bytes(spark, a, wh))
    if a.job == "create-tables":
        print(", ".join(jobs.create_tables(spark, wh)))
    elif a.job == "pipeline":
        jobs.run_pipeline(spark, a.scheme_landing, a.nav_landing, wh, a.as_of)
    elif a.job == "schemes":
        jobs.run_scheme_ingest(spark, a.scheme_landing, wh)
    elif a.job == "nav":
        jobs.run_nav_ingest(spark, a.nav_landing, wh)
    elif a.job == "daily-returns":
        jobs.run_daily_returns(spark, wh, a.as_of)
    elif a.job == "metrics":
        jobs.run_scheme_metrics(spark, wh, a.as_of)
    elif a.job == "enriched":
        jobs.run_nav_enriched(spark, wh)
    elif a.job == "returns-5y":
        print(jobs.run_daily_return_5y(spark, wh, a.as_of))
    elif a.job == "weather":
        jobs.run_weather_load(spark, a.landing, wh)
    elif a.job == "count":
        jobs.run_table_count(spark, a.table).show()
    elif a.job == "csv-preview":
        order = a.order_by.split(",") if a.order_by else []
        schema, prev = jobs.run_csv_preview(spark, a.landing, order, a.rows)
        print(schema)
        prev.show(a.rows, truncate=False)
    elif a.job == "people":
        jobs.run_people_report(spark, a.landing).show(truncate=False)
    elif a.job == "stream-nav":
        from navframe.streaming.nav_ingest import start_nav_ingest

        start_nav_ingest(
            spark,
            a.nav_landing,
            wh.table("raw_nav"),
            a.checkpoint or wh.path("_streams/nav_ingest"),
            wh.path("raw_nav_quarantine"),
            wh.path("nav_documents_corrupt"),
            schemes=wh.table("schemes") if wh.table("schemes").exists(spark) else None,
        ).awaitTermination()
    return 0


if __name__ == "__main__":
    sys.exit(main())
