"""Composite jobs (E1-E10) over tables at rest.

Each job reads its input tables, runs one Spark plan and writes its output
table, so every stage boundary is a written table in a shared folder: it cuts
the lineage, lets a later job (or a retry after a lost executor) restart from
the written data, and lets each job be scheduled on its own. Keyed NAV tables
are written sorted by ``(scheme_code, nav_date)`` within files.

Order of the weekly chain: schemes (E4) -> NAV (E5) -> daily returns (E1) ->
scheme metrics (E2) -> enriched NAV (E3); see :func:`run_pipeline`.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from zlib import crc32

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from navframe import params as P
from navframe import schemas as S
from navframe.functions.dates import lookback_start
from navframe.operators import enrich, incremental, ingest, metrics, returns
from navframe.operators.delta import new_rows
from navframe.operators.joins import broadcast_if_small
from navframe.sinks import writers as W
from navframe.sinks.table import Table, keyed_table
from navframe.sinks.versions import VersionedTable
from navframe.sources import csv as CSV
from navframe.sources import json_docs as J
from navframe.sources.views import count_rows


@dataclass(frozen=True)
class Warehouse:
    """The pipeline tables under one root folder.

    With ``buckets`` set, keyed tables are catalog tables (names prefixed by
    ``prefix``) bucketed by ``scheme_code`` with that many buckets and sorted
    by their key, so E1-E3 run without any shuffle; otherwise they are plain
    Parquet folders sorted by key within files.
    """

    root: str
    buckets: int | None = None
    year_partitioned: bool = False
    prefix: str = "navframe_"

    def path(self, table: str) -> str:
        return os.path.join(self.root, table)

    def table(self, table: str) -> Table:
        keys = S.KEYS.get(table)
        if keys is None:
            return Table(path=self.path(table))
        # the folder is part of the name: two warehouses never share an entry
        name = f"{self.prefix}{table}_{crc32(self.path(table).encode()):08x}" if self.buckets else None
        return keyed_table(
            self.path(table), keys, name=name, buckets=self.buckets, year_partitioned=self.year_partitioned
        )


def _read(spark: SparkSession, wh: Warehouse, table: str, since=None) -> DataFrame:
    return wh.table(table).read(spark, since=since)


def create_tables(spark: SparkSession, wh: Warehouse) -> list[str]:
    """K5: create the pipeline tables that don't exist yet, empty and with their
    schemas; returns the names of those created. Stored tables stay as they are."""
    made = []
    for name, schema in S.TABLES.items():
        table = wh.table(name)
        if not table.exists(spark):
            table.write(spark.createDataFrame([], schema), "overwrite")
            made.append(name)
    return made


#: rejected pages and scheme items are told apart by where they stand and what they hold
PAGE_KEYS = ["listing", "page", J.CORRUPT]
SCHEME_ITEM_KEYS = ["listing", "page", "pos", "item"]


def _keep_rejected(spark: SparkSession, rows: DataFrame, target, place: list[str]) -> int:
    """Rejected rows, each kept once by its lasting place."""
    return W.append_new(spark, rows, target, place, order=["block", "line"])


def run_scheme_ingest(spark: SparkSession, landing: str, wh: Warehouse) -> int:
    """Landed scheme-list pages -> new rows appended to ``schemes``;
    returns the number appended. Pages that don't parse go to
    ``scheme_pages_corrupt``, items without a valid code to ``schemes_quarantine``."""
    pages = J.read_scheme_pages(spark, landing)
    W.append_new(spark, J.corrupt_scheme_pages(pages), wh.path("scheme_pages_corrupt"), PAGE_KEYS)
    W.append_new(spark, J.quarantined_schemes(pages), wh.path("schemes_quarantine"), SCHEME_ITEM_KEYS)
    return W.append_new(
        spark, J.parse_scheme_list(pages), wh.table("schemes"), ingest.SCHEME_KEYS, order=ingest.SCHEME_ORDER, schema=S.SCHEMES
    )


def ingest_nav_documents(
    spark: SparkSession, docs: DataFrame, raw_nav, quarantine, corrupt, schemes: DataFrame | None, strict: bool = False
) -> int:
    """Parsed NAV documents -> new rows of ``raw_nav``; returns their number.

    Malformed documents go to ``corrupt`` (in strict mode they are written there,
    then the batch fails). Rows whose date or NAV does not parse go to
    ``quarantine``. Both are keyed by their lasting place in the landed files, so a
    repeated batch, or one with more files, adds nothing twice. With ``schemes`` only NAVs of listed
    schemes are kept (a left-semi join, broadcast when it passes the size check).
    """
    # parsed once, used by up to three writes; lost partitions are re-read
    # from the landed files
    docs = docs.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if corrupt is not None:
            _keep_rejected(spark, J.corrupt_documents(docs), corrupt, J.DOCUMENT_PLACE)
        valid, bad = J.split_quarantine(J.explode_nav_documents(docs, strict=strict))
        if schemes is not None:
            valid = valid.join(broadcast_if_small(schemes.select("scheme_code")), "scheme_code", "left_semi")
        if not strict and quarantine is not None:
            _keep_rejected(spark, bad, quarantine, J.ITEM_PLACE)
        return W.append_new(spark, valid, raw_nav, ingest.NAV_KEYS, order=ingest.NAV_ORDER, schema=S.RAW_NAV)
    finally:
        docs.unpersist()


def run_nav_ingest(
    spark: SparkSession, landing: str, wh: Warehouse, strict: bool = False, known_schemes_only: bool = True
) -> int:
    """E5: landed NAV documents -> new rows appended to ``raw_nav``, see
    :func:`ingest_nav_documents`. With ``known_schemes_only`` (and a stored
    ``schemes`` table) only NAVs of listed schemes are kept, as NAV histories are
    fetched for listed schemes only."""
    table = wh.table("schemes")
    schemes = table.read(spark) if known_schemes_only and table.exists(spark) else None
    return ingest_nav_documents(
        spark,
        J.read_nav_documents(spark, landing),
        wh.table("raw_nav"),
        wh.path("raw_nav_quarantine"),
        wh.path("nav_documents_corrupt"),
        schemes,
        strict,
    )


def run_daily_returns(spark: SparkSession, wh: Warehouse, as_of=None) -> int:
    """Features over the lookback, appended for keys not stored yet;
    returns the number appended. Stored keys are tagged on the narrow NAV rows
    before the window, so the wide rows are never shuffled."""
    start = lookback_start(as_of, P.LOOKBACK_MONTHS)
    nav = _read(spark, wh, "raw_nav", since=start).select("scheme_code", "nav_date", "nav")
    target = wh.table("daily_returns")
    if target.exists(spark):
        stored = target.read(spark, since=start).select("scheme_code", "nav_date")
        feats = returns.new_return_features(nav, stored, as_of)
    else:
        feats = returns.return_features(nav, as_of)
    return W.append_counted(feats, target, S.DAILY_RETURNS)


def run_daily_returns_incremental(spark: SparkSession, wh: Warehouse, as_of=None) -> int:
    """E1 at the cost of the rows ingested since the last run; returns the number
    appended.

    The tail of each scheme is stored with the time up to which ``raw_nav`` rows are
    in it; a run takes the rows created later (older files are skipped by their
    statistics on ``created_at``). The first run computes the whole lookback. Rows are
    appended by key before the new tail is named, so a run that died in between is
    repeated without doubling rows. One ingest runs at a time.
    """
    state = VersionedTable(wh.path("daily_returns_tail"))
    last = state.latest(spark)
    raw = _read(spark, wh, "raw_nav").select("scheme_code", "nav_date", "nav", "created_at")
    fresh = raw.filter(F.col("created_at") > F.lit(last[1])) if last else raw
    seen, oldest = fresh.agg(F.max("created_at"), F.min("nav_date")).first()
    if seen is None:
        return 0
    if last is None:
        appended = run_daily_returns(spark, wh, as_of)
        state.write(incremental.tail(returns.lookback(raw, as_of)), seen)
        return appended
    tail = state.read(spark)
    following, late = incremental.split_late(fresh.filter(F.col("scheme_code").isNotNull()), tail)
    target = wh.table("daily_returns")
    done = None
    if target.exists(spark):
        done = target.read(spark, since=oldest).select("scheme_code", "nav_date").filter(F.col("nav_date") >= F.lit(oldest).cast("date"))
    feats = incremental.following_features(following, tail, as_of, done=done)
    if not late.isEmpty():
        since = lookback_start(as_of, P.LOOKBACK_MONTHS)
        nav = _read(spark, wh, "raw_nav", since=since).select("scheme_code", "nav_date", "nav")
        late = late if done is None else new_rows(late, done, ["scheme_code", "nav_date"])
        feats = feats.unionByName(incremental.late_features(late, nav, as_of))
    appended = W.append_counted(feats, target, S.DAILY_RETURNS)
    state.write(incremental.next_tail(tail, fresh), seen)
    return appended


def run_scheme_metrics_incremental(spark: SparkSession, wh: Warehouse, as_of=None, since=None) -> None:
    """E2 from the stored moments of months. The months from ``since`` on (a date;
    default: the last stored month, which may have grown) are taken from the daily
    returns anew, and the month that the lookback begins in; no other is read."""
    path = wh.path("return_moments")
    stored = Table(path=path)
    if stored.exists(spark):
        months = stored.read(spark)
        since = since or months.agg(F.max("month")).first()[0]
        returns_ = _read(spark, wh, "daily_returns", since=since)
        grown = returns_.filter(F.col("nav_date") >= F.trunc(F.lit(since).cast("date"), "month"))
    else:
        since_all = lookback_start(as_of, P.LOOKBACK_MONTHS)
        grown = _read(spark, wh, "daily_returns", since=since_all).filter(F.col("nav_date") >= F.trunc(since_all, "month"))
    made = incremental.monthly_moments(grown).repartition("month")
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    months = spark.read.schema(made.schema).parquet(path)
    edge = _read(spark, wh, "daily_returns", since=lookback_start(as_of, P.LOOKBACK_MONTHS))
    W.overwrite(incremental.metrics_from_moments(months, edge, as_of), wh.table("scheme_metrics"), S.SCHEME_METRICS)


def run_scheme_metrics(spark: SparkSession, wh: Warehouse, as_of=None) -> None:
    """Fused metrics over the stored daily returns, table overwritten."""
    dr = _read(spark, wh, "daily_returns", since=lookback_start(as_of, P.LOOKBACK_MONTHS))
    W.overwrite(metrics.scheme_metrics(dr, as_of), wh.table("scheme_metrics"), S.SCHEME_METRICS)


def run_nav_enriched(spark: SparkSession, wh: Warehouse) -> None:
    """Stored daily returns left-joined with stored metrics, overwritten."""
    dr = _read(spark, wh, "daily_returns")
    sm = _read(spark, wh, "scheme_metrics")
    W.overwrite(enrich.nav_enriched(dr, sm), wh.table("nav_enriched"), S.NAV_ENRICHED)


def run_daily_return_5y(spark: SparkSession, wh: Warehouse, as_of=None) -> int:
    """Five-year daily returns overwritten; returns the row count, taken
    from an observed metric of the write itself (no second pass)."""
    raw = _read(spark, wh, "raw_nav").select("scheme_code", "nav_date", "nav")
    out = returns.daily_return_5y(raw, as_of)
    obs = Observation("daily_return_5y")
    out = out.observe(obs, F.count(F.lit(1)).alias("rows"))
    W.overwrite(out, wh.table("daily_returns_5y"), S.DAILY_RETURNS_5Y)
    return int(obs.get["rows"])


def run_weather_load(spark: SparkSession, landing: str, wh: Warehouse) -> None:
    """Weather objects appended with a load timestamp (no de-duplication:
    every run adds its rows). Lines that are no weather object are kept once in
    ``weather_corrupt``."""
    docs = J.read_weather(spark, landing)
    _keep_rejected(spark, J.corrupt_documents(docs), wh.path("weather_corrupt"), J.DOCUMENT_PLACE)
    flat = J.flatten_weather(docs).withColumn("timestamp", F.current_timestamp())
    W.append(flat, wh.path("weather"), S.WEATHER)


def run_table_count(spark: SparkSession, path: str) -> DataFrame:
    """``COUNT(*)`` of a table through a temp view and SQL."""
    return count_rows(spark, spark.read.parquet(path), "source_table")


def run_csv_preview(spark: SparkSession, path: str, order_by: list[str], n: int = 100) -> tuple[str, DataFrame]:
    """Schema text and the first ``n`` rows in a stated order."""
    df = CSV.read_csv(spark, path)
    return df.schema.simpleString(), CSV.preview(df, order_by, n)


def run_people_report(spark: SparkSession, landing: str | None, greeting: str = P.PEOPLE_GREETING) -> DataFrame:
    """One message per person (built-in list when nothing is landed). A
    malformed document stops the report."""
    return J.people_messages(J.read_people(spark, landing), greeting, strict=True)


def run_pipeline(spark: SparkSession, scheme_landing: str, nav_landing: str, wh: Warehouse, as_of=None) -> None:
    """The weekly chain E4 -> E5 -> E1 -> E2 -> E3."""
    run_scheme_ingest(spark, scheme_landing, wh)
    run_nav_ingest(spark, nav_landing, wh)
    run_daily_returns(spark, wh, as_of)
    run_scheme_metrics(spark, wh, as_of)
    run_nav_enriched(spark, wh)
