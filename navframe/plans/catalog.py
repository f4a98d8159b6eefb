"""Query catalogue: name -> (Spark builder, DuckDB oracle SQL).

Each Spark builder takes ``(spark, sf_dir)`` and returns a DataFrame over the
whole test tables. The oracle SQL states the operator's definition for DuckDB
over the same Parquet files (tables registered as views).
Column names and types are aligned on both sides (``bigint``, ``double``,
``date``, ``varchar``).
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navframe import params as P
from navframe import schemas as S
from navframe.functions.dates import format_day_first, parse_day_first
from navframe.operators import asof as AJ
from navframe.operators import enrich as X
from navframe.operators import ingest as I
from navframe.operators import metrics as M
from navframe.operators import names as N
from navframe.operators import portfolio as PF
from navframe.operators import quantiles as QT
from navframe.operators import retrieval as RT
from navframe.operators import returns as R
from navframe.operators import sequences as SQ
from navframe.plans import jobs
from navframe.plans import landing as L
from navframe.session import shared_dir
from navframe.sinks import writers as W
from navframe.sinks.ranged import RangedTable
from navframe.sinks.table import keyed_table
from navframe.sources import csv as CSV
from navframe.sources import json_docs as J
from navframe.sources import tables as T
from navframe.sources.views import count_rows

AS_OF = P.TEST_AS_OF
AS_OF_SQL = f"DATE '{AS_OF.isoformat()}'"


def _since(months: int) -> str:
    return f"CAST({AS_OF_SQL} - INTERVAL {months} MONTH AS DATE)"


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doc: str = ""


CATALOG: dict[str, Query] = {}


def register(name: str, sql: str | None, doc: str = ""):
    def deco(fn):
        CATALOG[name] = Query(fn, sql, doc)
        return fn

    return deco


# ---------------------------------------------------------------------------
# SQL fragments shared by the oracle statements
# ---------------------------------------------------------------------------

RAW_NAV_CTE = f"raw_nav AS ({T.NAV_SERIES_SQL})"
NAV_BASE_CTE = (
    f"recent AS (SELECT * FROM raw_nav WHERE scheme_code IS NOT NULL AND nav_date >= {_since(P.LOOKBACK_MONTHS)})"
)
# one window per scheme, by date; every lag and average names it
BY_DATE_SQL = "WINDOW by_date AS (PARTITION BY scheme_code ORDER BY nav_date)"


def _back_sql(rows: int) -> str:
    return f"LAG(nav, {rows}) OVER by_date"


def _ma_sql(n: int, avg: str = "AVG(nav)") -> str:
    return f"ROUND({avg} OVER (by_date ROWS {n - 1} PRECEDING), 6) AS moving_avg_{n}d"


def _pct_sql(prev: str, name: str) -> str:
    return f"ROUND((nav - {prev}) / NULLIF({prev}, 0) * 100, 6) AS {name}"


LAG_ROWS = {"prev_day_nav": 1, "prev_week_nav": 7, "prev_month_nav": 30, "nav_30d_ago": 30, "nav_90d_ago": 90}
LAGS_SQL = ", ".join(f"{_back_sql(rows)} AS {name}" for name, rows in LAG_ROWS.items())
MAS_SQL = ", ".join(_ma_sql(n) for n in P.MOVING_AVG_ROWS)
RETURN_OF = {
    "daily_return_pct": "prev_day_nav",
    "weekly_return_pct": "prev_week_nav",
    "monthly_return_pct": "prev_month_nav",
    "rolling_return_30d_pct": "nav_30d_ago",
    "rolling_return_90d_pct": "nav_90d_ago",
}
RETS_SQL = ", ".join(_pct_sql(prev, name) for name, prev in RETURN_OF.items())
FEATURES_CTE = (
    f"daily_returns AS (SELECT *, {RETS_SQL} FROM "
    f"(SELECT scheme_code, nav_date, nav, {LAGS_SQL}, {MAS_SQL} FROM recent {BY_DATE_SQL}))"
)
DAILY_RETURNS_WITH = f"WITH {RAW_NAV_CTE}, {NAV_BASE_CTE}, {FEATURES_CTE}"


# ---------------------------------------------------------------------------
# Returns (E1, E6 and their pieces)
# ---------------------------------------------------------------------------


def _nav(spark, sf_dir):
    return T.load_nav(spark, sf_dir)


@register(
    "lookback_3y",
    f"WITH {RAW_NAV_CTE}, {NAV_BASE_CTE} SELECT * FROM recent",
    "F1: NAV rows inside the three-year lookback",
)
def q_lookback_3y(spark, sf_dir):
    return R.lookback(_nav(spark, sf_dir), AS_OF)


_SINGLE_RETURNS = {
    "daily_return": ("daily_return_pct", 1),
    "weekly_return": ("weekly_return_pct", 7),
    "monthly_return": ("monthly_return_pct", 30),
    "rolling_return_30d": ("rolling_return_30d_pct", 30),
    "rolling_return_90d": ("rolling_return_90d_pct", 90),
}


def _single_return_query(name: str, col: str, lag: int):
    sql = (
        f"WITH {RAW_NAV_CTE}, {NAV_BASE_CTE}, "
        f"with_base AS (SELECT *, {_back_sql(lag)} AS base FROM recent {BY_DATE_SQL}) "
        f"SELECT scheme_code, nav_date, nav, {_pct_sql('base', col)} FROM with_base"
    )

    @register(name, sql, f"P3: {col} (lag {lag} rows) after the lookback")
    def _q(spark, sf_dir):
        return R.single_return(_nav(spark, sf_dir), col, AS_OF)

    return _q


for _n, (_c, _l) in _SINGLE_RETURNS.items():
    _single_return_query(_n, _c, _l)


@register(
    "lag_features",
    f"WITH {RAW_NAV_CTE}, {NAV_BASE_CTE} SELECT scheme_code, nav_date, nav, {LAGS_SQL} FROM recent {BY_DATE_SQL}",
    "W1-W4: lags of 1/7/30/30/90 rows",
)
def q_lag_features(spark, sf_dir):
    return R.lag_features(_nav(spark, sf_dir), AS_OF)


@register(
    "moving_averages",
    f"WITH {RAW_NAV_CTE}, {NAV_BASE_CTE} SELECT scheme_code, nav_date, nav, {MAS_SQL} FROM recent {BY_DATE_SQL}",
    "W5-W8: rounded moving averages over 7/30/90/200 rows",
)
def q_moving_averages(spark, sf_dir):
    return R.moving_averages(_nav(spark, sf_dir), AS_OF)


@register(
    "return_features",
    f"{DAILY_RETURNS_WITH} SELECT * FROM daily_returns",
    "E1/P4: the 17-column daily-returns feature table",
)
def q_return_features(spark, sf_dir):
    return R.return_features(_nav(spark, sf_dir), AS_OF)


@register(
    "daily_return_5y",
    f"WITH {RAW_NAV_CTE}, "
    f"all_dates AS (SELECT *, {_back_sql(1)} AS prev_nav FROM raw_nav WHERE scheme_code IS NOT NULL {BY_DATE_SQL}) "
    f"SELECT *, {_pct_sql('prev_nav', 'daily_return_pct')} "
    f"FROM all_dates WHERE nav_date >= {_since(P.LOOKBACK_5Y_MONTHS)}",
    "E6/F3: lag over the full history, then the five-year filter",
)
def q_daily_return_5y(spark, sf_dir):
    return R.daily_return_5y(_nav(spark, sf_dir), AS_OF)


# ---------------------------------------------------------------------------
# Metrics (E2) over the stored daily returns, enrichment (E3), delta
#
# The metric queries run on the mixed stand-in (long supplier histories that
# pass the 30-row gate plus short customer histories that fail it).
# ---------------------------------------------------------------------------


MIXED_NAV_CTE = f"raw_nav AS ({T.MIXED_NAV_SERIES_SQL})"
MIXED_DR_WITH = f"WITH {MIXED_NAV_CTE}, {NAV_BASE_CTE}, {FEATURES_CTE}"
SINCE_3Y = _since(P.LOOKBACK_MONTHS)

METRIC_CTES = f"""
summary AS (
  SELECT scheme_code,
         COUNT(nav) AS n_nav,
         MIN(nav_date) FILTER (nav IS NOT NULL) AS start_date,
         MAX(nav_date) FILTER (nav IS NOT NULL) AS end_date,
         ARG_MIN(nav, nav_date) FILTER (nav IS NOT NULL) AS initial_nav,
         ARG_MAX(nav, nav_date) FILTER (nav IS NOT NULL) AS final_nav,
         COUNT(daily_return_pct) AS n_ret,
         AVG(daily_return_pct) AS mean_ret,
         STDDEV_SAMP(daily_return_pct) AS sd_ret
  FROM daily_returns WHERE nav_date >= {SINCE_3Y} GROUP BY scheme_code),
ratios AS (
  SELECT scheme_code, n_nav, n_ret, sd_ret, mean_ret,
         (end_date - start_date) / 365.25 AS years,
         final_nav / initial_nav AS growth,
         initial_nav > 0 AND final_nav > 0 AS positive,
         (mean_ret - 6.0::DOUBLE / 252) / NULLIF(sd_ret, 0) * SQRT(252) AS sharpe,
         sd_ret * SQRT(252) AS yearly
  FROM summary),
metrics_t AS (
  SELECT scheme_code,
         ROUND((growth ** (1 / NULLIF(years, 0)) - 1) * 100, 6) AS cagr_percent,
         CASE WHEN n_ret >= 30 AND sd_ret > 0 THEN ROUND(sharpe, 6) END AS sharpe_ratio,
         CASE WHEN n_ret >= 30 THEN ROUND(sd_ret, 6) END AS daily_volatility,
         CASE WHEN n_ret >= 30 THEN ROUND(yearly, 6) END AS annualized_volatility
  FROM ratios WHERE n_nav >= 30 AND years > 0 AND positive)
"""
METRICS_WITH = f"{MIXED_DR_WITH}, {METRIC_CTES}"


def _mixed_daily_returns(spark, sf_dir):
    return R.return_features(T.load_mixed_nav(spark, sf_dir), AS_OF)


def _metric_query(name: str, sql_body: str, fn, doc: str):
    @register(name, f"{METRICS_WITH} {sql_body}", doc)
    def _q(spark, sf_dir):
        return fn(_mixed_daily_returns(spark, sf_dir), AS_OF)

    return _q


_metric_query("valid_schemes", "SELECT scheme_code, n_nav AS total_records FROM summary WHERE n_nav >= 30", M.valid_schemes, "A2/F8: schemes with >= 30 NAV rows")
_metric_query(
    "valid_scheme_nav",
    f"SELECT scheme_code, nav_date, nav FROM daily_returns WHERE nav IS NOT NULL AND nav_date >= {SINCE_3Y} "
    "QUALIFY COUNT(*) OVER (PARTITION BY scheme_code) >= 30",
    M.valid_scheme_nav,
    "J4: NAV rows of schemes passing the gate",
)
_metric_query(
    "ranked_nav",
    f"SELECT scheme_code, nav_date, nav, ROW_NUMBER() OVER by_date AS rn_start, "
    f"COUNT(*) OVER whole - ROW_NUMBER() OVER by_date + 1 AS rn_end FROM daily_returns "
    f"WHERE nav IS NOT NULL AND nav_date >= {SINCE_3Y} "
    f"{BY_DATE_SQL}, whole AS (PARTITION BY scheme_code) QUALIFY COUNT(*) OVER whole >= 30",
    M.ranked_nav,
    "W9/W10: row numbers asc/desc",
)
_metric_query(
    "first_last_nav",
    "SELECT scheme_code, start_date, initial_nav, end_date, final_nav FROM summary WHERE n_nav >= 30",
    M.first_last_nav,
    "F9/J5: first and last NAV",
)
_metric_query("cagr", "SELECT scheme_code, cagr_percent FROM metrics_t", M.cagr, "A4: CAGR percent")


def _return_stats_rounded(dr, as_of):
    # Unrounded mean / stddev depend on float summation order, which differs
    # between engines in the last bits; the catalogue compares them at the
    # 6-digit precision every derived value is stored with.
    s = M.return_stats(dr, as_of)
    return s.select(
        "scheme_code",
        "total_records",
        F.round("avg_daily_return", 6).alias("avg_daily_return"),
        F.round("volatility", 6).alias("volatility"),
    )


_metric_query(
    "return_stats",
    "SELECT scheme_code, n_ret AS total_records, ROUND(mean_ret, 6) AS avg_daily_return, "
    "ROUND(sd_ret, 6) AS volatility FROM summary WHERE n_ret >= 30",
    _return_stats_rounded,
    "A3: count/avg/stddev of non-NULL daily returns",
)
_metric_query(
    "sharpe_ratio",
    "SELECT scheme_code, ROUND(sharpe, 6) AS sharpe_ratio FROM ratios WHERE n_ret >= 30 AND sd_ret > 0",
    M.sharpe_ratio,
    "A5: Sharpe ratio",
)
_metric_query(
    "daily_volatility",
    "SELECT scheme_code, ROUND(sd_ret, 6) AS daily_volatility FROM ratios WHERE n_ret >= 30",
    M.daily_volatility,
    "A6: daily volatility",
)
_metric_query(
    "annualized_volatility",
    "SELECT scheme_code, ROUND(yearly, 6) AS annualized_volatility FROM ratios WHERE n_ret >= 30",
    M.annualized_volatility,
    "A7: annualised volatility",
)
_metric_query("scheme_metrics", "SELECT * FROM metrics_t", M.scheme_metrics, "E2: fused metrics table")
_metric_query(
    "scheme_metrics_joined",
    "SELECT * FROM metrics_t",
    M.scheme_metrics_joined,
    "J6: the four metrics joined (CAGR base, three left joins)",
)

ENRICHED_SELECT = (
    f"SELECT * EXCLUDE ({', '.join(LAG_ROWS)}) FROM daily_returns LEFT JOIN metrics_t USING (scheme_code)"
)


@register("nav_enriched", f"{METRICS_WITH} {ENRICHED_SELECT}", "E3/P5: enriched NAV table, single pass")
def q_nav_enriched(spark, sf_dir):
    return X.nav_enriched_single_pass(_mixed_daily_returns(spark, sf_dir), AS_OF)


@register("nav_enriched_join", f"{METRICS_WITH} {ENRICHED_SELECT}", "J7: daily returns left join metrics table")
def q_nav_enriched_join(spark, sf_dir):
    dr = _mixed_daily_returns(spark, sf_dir)
    return X.nav_enriched(dr, M.scheme_metrics(dr, AS_OF))


# Stored keys for the delta: the stand-in rows before this date.
DELTA_CUTOFF = "2001-01-01"


@register(
    "delta_anti_join",
    f"{DAILY_RETURNS_WITH} SELECT * FROM daily_returns ANTI JOIN "
    f"(SELECT scheme_code, nav_date FROM raw_nav WHERE nav_date < DATE '{DELTA_CUTOFF}') USING (scheme_code, nav_date)",
    "J1: feature rows whose key is not stored yet",
)
def q_delta_anti_join(spark, sf_dir):
    nav = _nav(spark, sf_dir)
    stored = nav.filter(F.col("nav_date") < F.lit(DELTA_CUTOFF).cast("date"))
    return R.new_return_features(nav, stored, AS_OF)


@register(
    "total_rows",
    f"WITH {RAW_NAV_CTE} SELECT COUNT(*) AS total_rows FROM raw_nav",
    "S10/A1/A8: temp view + SQL count",
)
def q_total_rows(spark, sf_dir):
    return count_rows(spark, _nav(spark, sf_dir), "source_table")


# ---------------------------------------------------------------------------
# The stored type: decimal(18,6) NAVs. The SQL works on whole millionths
# (HUGEINT), so both sides are exact.
# ---------------------------------------------------------------------------

DECIMAL_NAV_CTE = (
    "raw_nav AS (SELECT l_suppkey AS scheme_code, CAST(l_shipdate AS DATE) AS nav_date, "
    "CAST(ROUND(MAX(l_extendedprice), 2) AS DECIMAL(18,6)) AS nav FROM lineitem GROUP BY 1, 2)"
)


def _millionths_sql(x: str) -> str:
    return f"CAST(CAST({x} AS DECIMAL(18,0)) * CAST(0.000001 AS DECIMAL(7,6)) AS DECIMAL(18,6))"


def _exact_ma_sql(n: int) -> str:
    # the average to ten digits, half up, as the stored type has it; then to six
    frame = f"(by_date ROWS {n - 1} PRECEDING)"
    ten = f"(20000 * SUM(m) OVER {frame} + COUNT(*) OVER {frame}) // (2 * COUNT(*) OVER {frame})"
    return f"{_millionths_sql(f'({ten} + 5000) // 10000')} AS moving_avg_{n}d"


def _exact_pct_sql(back: int, name: str) -> str:
    base = f"LAG(m, {back}) OVER by_date"
    exact = f"(2 * ABS(m - {base}) * 100000000 + {base}) // NULLIF(2 * {base}, 0) * SIGN(m - {base})"
    return f"{_millionths_sql(exact)} AS {name}"


DECIMAL_FEATURES_CTE = (
    "whole AS (SELECT *, CAST(nav * 1000000 AS HUGEINT) AS m FROM recent), "
    f"daily_returns AS (SELECT scheme_code, nav_date, nav, {LAGS_SQL}, "
    f"{', '.join(_exact_ma_sql(n) for n in P.MOVING_AVG_ROWS)}, "
    f"{', '.join(_exact_pct_sql(LAG_ROWS[prev], name) for name, prev in RETURN_OF.items())} FROM whole {BY_DATE_SQL})"
)
DECIMAL_DR_WITH = f"WITH {DECIMAL_NAV_CTE}, {NAV_BASE_CTE}, {DECIMAL_FEATURES_CTE}"


def _decimal_nav(spark, sf_dir):
    li = T.read_table(spark, sf_dir, "lineitem")
    keyed = li.groupBy(F.col("l_suppkey").alias("scheme_code"), F.col("l_shipdate").cast("date").alias("nav_date"))
    return keyed.agg(F.round(F.max("l_extendedprice"), 2).cast(P.NAV_DECIMAL).alias("nav"))


@register(
    "return_features_decimal",
    f"{DECIMAL_DR_WITH} SELECT * FROM daily_returns",
    "E1/P4 on the stored type: exact running sums and returns",
)
def q_return_features_decimal(spark, sf_dir):
    return S.conform(R.return_features(_decimal_nav(spark, sf_dir), AS_OF), S.DAILY_RETURNS)


@register(
    "scheme_metrics_decimal",
    f"{DECIMAL_DR_WITH.replace('daily_returns AS', 'exact AS')}, daily_returns AS (SELECT scheme_code, nav_date, "
    f"CAST(nav AS DOUBLE) AS nav, CAST(daily_return_pct AS DOUBLE) AS daily_return_pct FROM exact), {METRIC_CTES} "
    "SELECT * FROM metrics_t",
    "E2 on the stored type",
)
def q_scheme_metrics_decimal(spark, sf_dir):
    return M.scheme_metrics(q_return_features_decimal(spark, sf_dir), AS_OF)


@register(
    "nav_json_explode_decimal",
    f"WITH {DECIMAL_NAV_CTE} SELECT scheme_code, nav_date, nav FROM raw_nav",
    "S6: NAV text -> decimal(18,6), the stored type",
)
def q_nav_json_explode_decimal(spark, sf_dir):
    path = _landed(spark, sf_dir, "nav_documents_decimal", lambda p: L.land_nav_documents(_decimal_nav(spark, sf_dir), p))
    return J.explode_nav_documents(J.read_nav_documents(spark, path)).select("scheme_code", "nav_date", "nav")


@register(
    "sequence_features",
    f"{DAILY_RETURNS_WITH}, past AS (SELECT scheme_code, nav_date, daily_return_pct AS target, "
    "LIST(daily_return_pct) OVER (PARTITION BY scheme_code ORDER BY nav_date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS x "
    "FROM daily_returns WHERE daily_return_pct IS NOT NULL) "
    f"SELECT scheme_code, nav_date, target, {', '.join(f'x[{i}] AS x{i}' for i in range(1, 11))} FROM past WHERE len(x) = 10",
    "B8: the ten returns before each return",
)
def q_sequence_features(spark, sf_dir):
    found = SQ.sequence_features(R.return_features(_nav(spark, sf_dir), AS_OF), 10)
    return found.select("scheme_code", "nav_date", "target", *[F.col("sequence")[i].alias(f"x{i + 1}") for i in range(10)])


@register(
    "document_chunks",
    "WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM documents), "
    "c AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 40, 1), 160)) AS start_word FROM d WHERE len(w) > 0) "
    "SELECT doc_id, start_word // 160 AS chunk_no, start_word, least(len(w) - start_word, 200) AS n_words, "
    "array_to_string(w[start_word + 1:start_word + 200], ' ') AS chunk FROM c",
    "B10: overlapping word chunks of whole texts",
)
def q_document_chunks(spark, sf_dir):
    return SQ.document_chunks(T.read_table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------------------
# Ingest (E4, E5) and sources (S4-S8) over landed files derived from the
# tables, sinks (K1, K2), preview (O2), sort (O1)
# ---------------------------------------------------------------------------


# Schemes already stored before the listing is ingested (fixture choice).
STORED_SCHEME_MAX_ACCTBAL = 1000.0


_LANDED: dict[tuple[str, str, str], str] = {}


def _still_there(path: str) -> bool:
    if path.startswith("file:"):
        path = path[len("file:") :]
    if "://" in path:  # a cluster file system: written earlier by this application
        return True
    return os.path.exists(path)


def _landed(spark, sf_dir, name, write) -> str:
    """Land a payload derived from the tables once per application and table
    folder (files in the shared folder); later calls read the same files."""
    try:
        app = spark.sparkContext.applicationId
    except Exception:  # pragma: no cover - Spark Connect
        app = "connect"
    key = (app, sf_dir, name)
    path = _LANDED.get(key)
    if path is None or not _still_there(path):
        path = shared_dir(spark, "landing", name, unique=True)
        write(path)
        _LANDED[key] = path
    return path


def _parsed_schemes(spark, sf_dir):
    path = _landed(spark, sf_dir, "schemes", lambda p: L.land_scheme_pages(T.read_table(spark, sf_dir, "supplier"), p))
    return J.parse_scheme_list(J.read_scheme_pages(spark, path))


SCHEME_ITEMS_CTE = (
    "items AS (SELECT s_suppkey AS scheme_code, s_name AS scheme_name, "
    "'INF' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || 'G' AS isin_growth, "
    "CASE WHEN s_acctbal >= 0 THEN 'INF' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || 'R' END "
    "AS isin_div_reinvestment, s_acctbal FROM supplier)"
)
SCHEME_COLS = "scheme_code, scheme_name, isin_growth, isin_div_reinvestment"


@register(
    "scheme_list_parse",
    f"WITH {SCHEME_ITEMS_CTE} SELECT {SCHEME_COLS} FROM items UNION ALL "
    f"SELECT scheme_code, lower(scheme_name) AS scheme_name, isin_growth, isin_div_reinvestment "
    f"FROM items WHERE s_acctbal > {L.RELIST_MIN_ACCTBAL}",
    "S5/P1: landed scheme-list pages -> snake_case rows (missing key -> NULL)",
)
def q_scheme_list_parse(spark, sf_dir):
    return _parsed_schemes(spark, sf_dir).select(*SCHEME_COLS.split(", "))


@register(
    "new_schemes",
    f"WITH {SCHEME_ITEMS_CTE} SELECT {SCHEME_COLS} FROM items i WHERE NOT EXISTS "
    f"(SELECT 1 FROM supplier s WHERE s.s_acctbal < {STORED_SCHEME_MAX_ACCTBAL} AND s.s_suppkey = i.scheme_code)",
    "E4/K3/J2: first listing wins, stored codes skipped",
)
def q_new_schemes(spark, sf_dir):
    stored = (
        T.read_table(spark, sf_dir, "supplier")
        .filter(F.col("s_acctbal") < STORED_SCHEME_MAX_ACCTBAL)
        .select(F.col("s_suppkey").alias("scheme_code"))
    )
    return I.new_schemes(_parsed_schemes(spark, sf_dir), stored)


@register(
    "schemes_sorted",
    f"WITH {SCHEME_ITEMS_CTE} SELECT {SCHEME_COLS} FROM items ORDER BY scheme_code",
    "O1: distinct schemes ordered by code",
)
def q_schemes_sorted(spark, sf_dir):
    return I.distinct_schemes(_parsed_schemes(spark, sf_dir)).orderBy("scheme_code")


@register(
    "scheme_pages_corrupt",
    f"SELECT DISTINCT CAST(1 AS BIGINT) AS listing, s_suppkey // {L.PAGE_SIZE} AS page FROM supplier "
    f"WHERE s_acctbal > {L.RELIST_MIN_ACCTBAL}",
    "S5: pages that broke off go to quarantine",
)
def q_scheme_pages_corrupt(spark, sf_dir):
    path = _landed(
        spark, sf_dir, "schemes_broken", lambda p: L.land_scheme_pages(T.read_table(spark, sf_dir, "supplier"), p, broken=True)
    )
    bad = J.corrupt_scheme_pages(J.read_scheme_pages(spark, path))
    return bad.select(F.col("listing").cast("bigint").alias("listing"), F.col("page").cast("bigint").alias("page"))


def _nav_docs(spark, sf_dir, name, **options):
    path = _landed(spark, sf_dir, name, lambda p: L.land_nav_documents(_nav(spark, sf_dir), p, **options))
    return J.read_nav_documents(spark, path)


BAD_CODE_EVERY = 9


@register(
    "schemes_quarantine",
    f"WITH listed AS (SELECT 0 AS listing, s_suppkey, s_name FROM supplier "
    f"UNION ALL SELECT 1, s_suppkey, lower(s_name) FROM supplier WHERE s_acctbal > {L.RELIST_MIN_ACCTBAL}), "
    f"placed AS (SELECT listing, s_suppkey // {L.PAGE_SIZE} AS page, s_suppkey, s_name, "
    f"ROW_NUMBER() OVER (PARTITION BY listing, s_suppkey // {L.PAGE_SIZE} ORDER BY s_suppkey) - 1 AS pos FROM listed) "
    f"SELECT CAST(listing AS INTEGER) AS listing, CAST(page AS INTEGER) AS page, CAST(pos AS INTEGER) AS pos, "
    f"CASE WHEN s_suppkey % {2 * BAD_CODE_EVERY} <> 0 THEN 'X' || s_suppkey END AS code_text, s_name AS scheme_name "
    f"FROM placed WHERE s_suppkey % {BAD_CODE_EVERY} = 0",
    "S5/K3: listed items without a valid code, kept once over two loads",
)
def q_schemes_quarantine(spark, sf_dir):
    supplier = T.read_table(spark, sf_dir, "supplier")
    path = _landed(spark, sf_dir, "schemes_bad", lambda p: L.land_scheme_pages(supplier, p, bad_every=BAD_CODE_EVERY))
    wh = jobs.Warehouse(shared_dir(spark, "tables", "schemes", unique=True))
    jobs.run_scheme_ingest(spark, path, wh)
    jobs.run_scheme_ingest(spark, path, wh)
    bad = spark.read.parquet(wh.path("schemes_quarantine"))
    return bad.select("listing", "page", "pos", "code_text", F.get_json_object("item", "$.schemeName").alias("scheme_name"))


# Documents of every fifth scheme come without ``meta``, every seventh broken.
NO_META_EVERY = 5
CUT_EVERY = 7


NAV_DOC_COLS_SQL = (
    "scheme_code, nav_date, nav, 'Fund House ' || CAST(scheme_code // 10 AS VARCHAR) AS fund_house, "
    "'Scheme ' || CAST(scheme_code AS VARCHAR) AS scheme_name"
)


@register(
    "nav_json_explode",
    f"WITH {RAW_NAV_CTE} SELECT * REPLACE (CASE WHEN scheme_code % {NO_META_EVERY} <> 0 THEN fund_house END AS fund_house, "
    f"CASE WHEN scheme_code % {NO_META_EVERY} <> 0 THEN scheme_name END AS scheme_name) "
    f"FROM (SELECT {NAV_DOC_COLS_SQL} FROM raw_nav)",
    "S6/P2: NAV documents, some without meta -> one row per item with meta repeated",
)
def q_nav_json_explode(spark, sf_dir):
    docs = _nav_docs(spark, sf_dir, "nav_documents", no_meta_every=NO_META_EVERY)
    rows = J.explode_nav_documents(docs, nav_type="double")
    return rows.select("scheme_code", "nav_date", "nav", "fund_house", "scheme_name")


@register(
    "nav_documents_corrupt",
    f"WITH {RAW_NAV_CTE} SELECT scheme_code, COUNT(DISTINCT year(nav_date)) AS n_documents FROM raw_nav "
    f"WHERE scheme_code % {CUT_EVERY} = 0 GROUP BY scheme_code",
    "S6: documents that broke off, by the scheme they were requested for",
)
def q_nav_documents_corrupt(spark, sf_dir):
    bad = J.corrupt_documents(_nav_docs(spark, sf_dir, "nav_documents_cut", cut_every=CUT_EVERY))
    code = F.regexp_extract(J.CORRUPT, r'"requested":(\d+)', 1).cast("bigint")
    return bad.groupBy(code.alias("scheme_code")).agg(F.count(F.lit(1)).alias("n_documents"))


@register(
    "new_nav_rows",
    f"WITH {RAW_NAV_CTE} SELECT {NAV_DOC_COLS_SQL} FROM raw_nav r WHERE NOT EXISTS ("
    f"SELECT 1 FROM raw_nav s WHERE s.nav_date < DATE '{DELTA_CUTOFF}' "
    f"AND s.scheme_code = r.scheme_code AND s.nav_date = r.nav_date)",
    "E5/K4/J3: parsed NAV rows whose key is not stored; first in payload order wins",
)
def q_new_nav_rows(spark, sf_dir):
    stored = _nav(spark, sf_dir).filter(F.col("nav_date") < F.lit(DELTA_CUTOFF).cast("date"))
    # each document is followed by one that clashes with its oldest days
    docs = _nav_docs(spark, sf_dir, "nav_documents_again", republish=True)
    return I.new_nav_rows(J.explode_nav_documents(docs, nav_type="double"), stored).select(
        "scheme_code", "nav_date", "nav", "fund_house", "scheme_name"
    )


def _lenient_nav(spark, sf_dir):
    docs = _nav_docs(spark, sf_dir, "nav_documents_na", year_end_unavailable=True)
    return J.split_quarantine(J.explode_nav_documents(docs, nav_type="double", strict=False))


YEAR_END_SQL = "(month(nav_date) = 12 AND day(nav_date) = 31)"


@register(
    "nav_valid_rows",
    f"WITH {RAW_NAV_CTE} SELECT {NAV_DOC_COLS_SQL} FROM raw_nav WHERE NOT {YEAR_END_SQL}",
    "S6 lenient ingest: rows whose NAV text parses",
)
def q_nav_valid_rows(spark, sf_dir):
    valid, _ = _lenient_nav(spark, sf_dir)
    return valid.select("scheme_code", "nav_date", "nav", "fund_house", "scheme_name")


@register(
    "nav_quarantine",
    f"WITH {RAW_NAV_CTE} SELECT scheme_code, strftime(nav_date, '%d-%m-%Y') AS date_text, "
    f"'N.A.' AS nav_text FROM raw_nav WHERE {YEAR_END_SQL}",
    "S6 lenient ingest: rows routed to quarantine (NAV text not a number)",
)
def q_nav_quarantine(spark, sf_dir):
    _, bad = _lenient_nav(spark, sf_dir)
    return bad.select("scheme_code", F.col("_date_text").alias("date_text"), F.col("_nav_text").alias("nav_text"))


@register(
    "parse_nav_date",
    f"WITH {RAW_NAV_CTE} SELECT scheme_code, strftime(nav_date, '%d-%m-%Y') AS padded_text, "
    f"strftime(nav_date, '%-d-%-m-%Y') AS short_text, nav_date AS parsed_padded, nav_date AS parsed_short "
    f"FROM raw_nav",
    "P2: day-first text (padded and unpadded) -> date",
)
def q_parse_nav_date(spark, sf_dir):
    texts = _nav(spark, sf_dir).select(
        "scheme_code",
        format_day_first("nav_date", "dd-MM-yyyy").alias("padded_text"),
        format_day_first("nav_date", "d-M-yyyy").alias("short_text"),
    )
    return texts.select(
        "*",
        parse_day_first("padded_text").alias("parsed_padded"),
        parse_day_first("short_text").alias("parsed_short"),
    )


@register(
    "weather_flatten",
    "SELECT CAST(51.5074 AS DOUBLE) AS latitude, CAST(-0.1278 AS DOUBLE) AS longitude, value AS temperature, "
    "CAST(user_id AS DOUBLE) AS windspeed, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS winddirection, "
    "CAST(hour(ts) AS INTEGER) AS weathercode FROM events",
    "S7/P6: weather objects flattened, constant location added",
)
def q_weather_flatten(spark, sf_dir):
    path = _landed(spark, sf_dir, "weather", lambda p: L.land_weather(T.read_table(spark, sf_dir, "events"), p))
    return J.flatten_weather(J.read_weather(spark, path))


@register(
    "weather_corrupt",
    f"SELECT event_id, TRUE AS broken FROM events WHERE event_id % {CUT_EVERY} = 0",
    "S7/K6: weather objects that broke off, kept once however often they are loaded",
)
def q_weather_corrupt(spark, sf_dir):
    events = T.read_table(spark, sf_dir, "events")
    path = _landed(spark, sf_dir, "weather_cut", lambda p: L.land_weather(events, p, cut_every=CUT_EVERY))
    wh = jobs.Warehouse(shared_dir(spark, "tables", "weather", unique=True))
    jobs.run_weather_load(spark, path, wh)
    jobs.run_weather_load(spark, path, wh)
    bad = spark.read.parquet(wh.path("weather_corrupt"))
    code = F.regexp_extract(J.CORRUPT, r'"event":(\d+)', 1).cast("bigint")
    return bad.select(code.alias("event_id"), (~F.endswith(J.CORRUPT, F.lit("}}"))).alias("broken"))


@register(
    "people_explode",
    "SELECT c_mktsegment AS craft, c_name AS name, "
    "c_name || ' is currently in space flying on the ' || c_mktsegment || '! Hello! :)' AS message FROM customer",
    "S8/P7: people objects exploded into messages",
)
def q_people_explode(spark, sf_dir):
    path = _landed(spark, sf_dir, "people", lambda p: L.land_people(T.read_table(spark, sf_dir, "customer"), p))
    return J.people_messages(J.read_people(spark, path))


@register(
    "people_count",
    "SELECT CAST(COUNT(*) AS BIGINT) AS number_of_people, CAST(COUNT(*) AS BIGINT) AS people_listed FROM customer",
    "S8: head count reported by the documents next to the people listed",
)
def q_people_count(spark, sf_dir):
    path = _landed(spark, sf_dir, "people", lambda p: L.land_people(T.read_table(spark, sf_dir, "customer"), p))
    return J.people_in_space(J.read_people(spark, path))


@register(
    "csv_scan",
    "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, "
    "o_orderstatus, CAST(o_totalprice AS VARCHAR) AS o_totalprice, "
    "CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate, o_orderpriority FROM orders",
    "S4: header CSV read without inference (all columns strings)",
)
def q_csv_scan(spark, sf_dir):
    path = _landed(spark, sf_dir, "orders_csv", lambda p: L.land_orders_csv(T.read_table(spark, sf_dir, "orders"), p))
    return CSV.read_csv(spark, path)


@register(
    "preview",
    f"{METRICS_WITH} {ENRICHED_SELECT} ORDER BY scheme_code, nav_date LIMIT 20",
    "O2: first 20 enriched rows in key order",
)
def q_preview(spark, sf_dir):
    return CSV.preview(q_nav_enriched(spark, sf_dir), ["scheme_code", "nav_date"], 20)


def _append_thrice(spark, sf_dir, name: str, **layout):
    """Earlier run stored, rerun appends only new keys, third run appends none."""
    keys = ["scheme_code", "nav_date"]
    root = shared_dir(spark, "tables", name, unique=True)
    W.overwrite(R.return_features(_nav(spark, sf_dir), AS_OF), f"{root}/computed")
    feats = spark.read.parquet(f"{root}/computed")
    table_name = f"{name}_{os.path.basename(root)}" if layout.get("buckets") else None
    table = keyed_table(f"{root}/stored", keys, name=table_name, **layout)
    W.append(feats.filter(F.col("nav_date") < F.lit(DELTA_CUTOFF).cast("date")), table)
    W.append_new(spark, feats, table, keys)
    if table_name:  # as a process whose catalog doesn't know the table
        spark.sql(f"DROP TABLE {table_name}")
    W.append_new(spark, feats, table, keys)
    return table.read(spark).select(*feats.columns)


def _append_query(name: str, doc: str, **layout):
    @register(name, f"{DAILY_RETURNS_WITH} SELECT * FROM daily_returns", doc)
    def _q(spark, sf_dir):
        return _append_thrice(spark, sf_dir, name, **layout)

    return _q


q_append_sink = _append_query("append_sink", "K1/E1 load: earlier run, rerun, rerun into plain files")
_append_query("append_sink_bucketed", "K1/E1 load into a bucketed table that the catalog forgets", buckets=4)
_append_query("append_sink_by_year", "K1/E1 load into a year-partitioned table", year_partitioned=True)


@register(
    "create_tables",
    "SELECT 'schemes' AS table_name, COUNT(*) AS n_rows FROM supplier UNION ALL "
    "SELECT unnest(['raw_nav', 'daily_returns', 'scheme_metrics', 'nav_enriched', 'daily_returns_5y', 'weather']), 0",
    "K5: tables created empty where absent, then the scheme list ingested into them",
)
def q_create_tables(spark, sf_dir):
    wh = jobs.Warehouse(shared_dir(spark, "tables", "warehouse", unique=True))
    jobs.create_tables(spark, wh)
    path = _landed(spark, sf_dir, "schemes", lambda p: L.land_scheme_pages(T.read_table(spark, sf_dir, "supplier"), p))
    jobs.run_scheme_ingest(spark, path, wh)
    jobs.create_tables(spark, wh)
    counts = None
    for name in S.TABLES:
        one = wh.table(name).read(spark).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        counts = one if counts is None else counts.unionByName(one)
    return counts


@register(
    "overwrite_sink",
    f"{METRICS_WITH} SELECT * FROM metrics_t",
    "K2/E2 load: overwrite replaces rows and column set",
)
def q_overwrite_sink(spark, sf_dir):
    dr = _mixed_daily_returns(spark, sf_dir)
    path = shared_dir(spark, "tables", "scheme_metrics", unique=True)
    W.overwrite(M.valid_schemes(dr, AS_OF), path)
    W.overwrite(M.scheme_metrics(dr, AS_OF), path, cluster_by=["scheme_code"])
    return spark.read.parquet(path)


# ---------------------------------------------------------------------------
# Portfolio analytics (tier B1-B7; definitions ours). Portfolio = customer,
# scheme = supplier, position value = line extended price.
# ---------------------------------------------------------------------------


def _positions(spark, sf_dir):
    li = T.read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    od = T.read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return li.join(od, li.l_orderkey == od.o_orderkey).select(
        F.col("o_custkey").alias("portfolio_id"),
        F.col("l_suppkey").alias("scheme_code"),
        F.col("l_extendedprice").alias("value"),
    )


def _holdings(spark, sf_dir):
    return PF.holdings_from_positions(_positions(spark, sf_dir))


def _scheme_names(spark, sf_dir):
    return T.read_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("scheme_code"), F.col("s_name").alias("scheme_name")
    )


PORTFOLIO_CTES = f"""
positions AS (
  SELECT o.o_custkey AS portfolio_id, l.l_suppkey AS scheme_code, l.l_extendedprice AS value
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
holdings AS (
  SELECT portfolio_id, scheme_code, ROUND(SUM(value), 2) AS holding_value FROM positions GROUP BY 1, 2),
totals AS (SELECT portfolio_id, ROUND(SUM(holding_value), 2) AS total FROM holdings GROUP BY 1),
weights AS (
  SELECT h.portfolio_id, h.scheme_code, h.holding_value, t.total,
         h.holding_value / NULLIF(t.total, 0) AS weight
  FROM holdings h JOIN totals t ON h.portfolio_id = t.portfolio_id),
pr AS (
  SELECT w.portfolio_id, r.nav_date, ROUND(SUM(w.weight * r.daily_return_pct), 6) AS portfolio_return_pct
  FROM weights w JOIN daily_returns r ON w.scheme_code = r.scheme_code
  WHERE r.nav_date >= {SINCE_3Y} AND r.daily_return_pct IS NOT NULL
  GROUP BY 1, 2),
pstats AS (
  SELECT portfolio_id, COUNT(portfolio_return_pct) AS n_ret, AVG(portfolio_return_pct) AS a,
         STDDEV_SAMP(portfolio_return_pct) AS v
  FROM pr GROUP BY 1),
wcagr AS (
  SELECT w.portfolio_id, ROUND(SUM(w.weight * m.cagr_percent), 6) AS weighted_cagr_percent
  FROM weights w JOIN metrics_t m ON w.scheme_code = m.scheme_code GROUP BY 1),
pmetrics AS (
  SELECT COALESCE(s.portfolio_id, c.portfolio_id) AS portfolio_id, c.weighted_cagr_percent,
         CASE WHEN s.n_ret >= 30 AND s.v > 0
              THEN ROUND(SQRT(252) * ((s.a - (6.0 / 252)) / NULLIF(s.v, 0)), 6) END AS sharpe_ratio,
         CASE WHEN s.n_ret >= 30 THEN ROUND(s.v, 6) END AS daily_volatility,
         CASE WHEN s.n_ret >= 30 THEN ROUND(s.v * SQRT(252), 6) END AS annualized_volatility
  FROM pstats s FULL JOIN wcagr c ON s.portfolio_id = c.portfolio_id),
divers AS (
  SELECT portfolio_id, COUNT(*) AS n_holdings, ROUND(SUM(weight * weight), 6) AS hhi,
         ROUND(1.0 / SUM(weight * weight), 6) AS effective_holdings
  FROM weights GROUP BY 1),
under AS (
  SELECT h.portfolio_id, MAX(CASE WHEN m.cagr_percent < {PF.MIN_SCHEME_CAGR} THEN 1 ELSE 0 END) AS u
  FROM holdings h JOIN metrics_t m ON h.scheme_code = m.scheme_code GROUP BY 1),
flags AS (
  SELECT d.portfolio_id, d.hhi > {PF.MAX_HHI} AS low_diversification,
         COALESCE(p.annualized_volatility > {PF.MAX_ANNUALIZED_VOL}, FALSE) AS risk_misaligned,
         COALESCE(u.u = 1, FALSE) AS underperforming_fund
  FROM divers d LEFT JOIN pmetrics p ON d.portfolio_id = p.portfolio_id
  LEFT JOIN under u ON d.portfolio_id = u.portfolio_id)
"""
PORTFOLIO_WITH = f"{DAILY_RETURNS_WITH}, {METRIC_CTES}, {PORTFOLIO_CTES}"


@register(
    "portfolio_allocation",
    f"{PORTFOLIO_WITH} SELECT w.portfolio_id, w.scheme_code, s.s_name AS scheme_name, w.holding_value, "
    f"ROUND(w.holding_value / NULLIF(w.total, 0) * 100.0, 6) AS allocation_pct "
    f"FROM weights w LEFT JOIN supplier s ON w.scheme_code = s.s_suppkey",
    "B1: holding value and allocation percent per portfolio and scheme",
)
def q_portfolio_allocation(spark, sf_dir):
    return PF.portfolio_allocation(_holdings(spark, sf_dir), _scheme_names(spark, sf_dir))


@register(
    "portfolio_nav_history",
    f"{PORTFOLIO_WITH} SELECT scheme_code, nav_date, nav FROM raw_nav "
    f"WHERE nav_date >= {_since(24)} AND scheme_code IN (SELECT scheme_code FROM holdings)",
    "B2: last 24 months of NAV for held schemes (semi join)",
)
def q_portfolio_nav_history(spark, sf_dir):
    return PF.portfolio_nav_history(_nav(spark, sf_dir), _holdings(spark, sf_dir), AS_OF)


@register(
    "max_drawdown",
    f"WITH {RAW_NAV_CTE}, {NAV_BASE_CTE} SELECT scheme_code, "
    f"ROUND(MIN(nav / NULLIF(peak, 0) - 1.0) * 100.0, 6) AS max_drawdown_pct FROM ("
    f"SELECT scheme_code, nav, MAX(nav) OVER (PARTITION BY scheme_code ORDER BY nav_date "
    f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM recent WHERE nav IS NOT NULL) x "
    f"GROUP BY scheme_code",
    "B3: maximum drawdown per scheme inside the lookback",
)
def q_max_drawdown(spark, sf_dir):
    return PF.max_drawdown(_nav(spark, sf_dir), AS_OF)


@register(
    "portfolio_allocation_by_name",
    f"{PORTFOLIO_WITH}, named AS (SELECT s_name AS scheme_name, MIN(s_suppkey) AS scheme_code FROM supplier GROUP BY 1) "
    "SELECT w.portfolio_id, w.scheme_code, w.holding_value, "
    "ROUND(w.holding_value / NULLIF(w.total, 0) * 100.0, 6) AS allocation_pct "
    "FROM weights w JOIN named USING (scheme_code)",
    "B1: positions given by scheme name",
)
def q_portfolio_allocation_by_name(spark, sf_dir):
    by_name = _positions(spark, sf_dir).join(_scheme_names(spark, sf_dir), "scheme_code").drop("scheme_code")
    coded = PF.codes_from_names(by_name, _scheme_names(spark, sf_dir))
    return PF.portfolio_allocation(PF.holdings_from_positions(coded))


@register(
    "portfolio_allocation_given",
    f"{PORTFOLIO_WITH}, given AS (SELECT o_custkey AS portfolio_id, l_suppkey AS scheme_code, "
    "ROUND(SUM(l_quantity), 6) AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey IS NOT NULL GROUP BY 1, 2), "
    "sums AS (SELECT portfolio_id, ROUND(SUM(p), 6) AS t FROM given GROUP BY 1) "
    "SELECT portfolio_id, scheme_code, ROUND(p / NULLIF(t, 0) * 100.0, 6) AS allocation_pct FROM given JOIN sums USING (portfolio_id)",
    "B1: allocations given as percentages, scaled to 100",
)
def q_portfolio_allocation_given(spark, sf_dir):
    li = T.read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    od = T.read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    given = li.join(od, li.l_orderkey == od.o_orderkey).select(
        F.col("o_custkey").alias("portfolio_id"), F.col("l_suppkey").alias("scheme_code"), F.col("l_quantity").alias("given_pct")
    )
    return PF.allocation_from_percentages(given).drop("holding_value")


def _stored_returns(spark, sf_dir):
    """The daily returns as the weekly chain leaves them: a written table."""
    path = shared_dir(spark, "tables", "daily_returns", unique=True)
    W.overwrite(R.return_features(_nav(spark, sf_dir), AS_OF), path)
    return spark.read.parquet(path)


def _pmetrics(spark, sf_dir):
    dr = _stored_returns(spark, sf_dir)
    return PF.portfolio_metrics(_holdings(spark, sf_dir), dr, M.scheme_metrics(dr, AS_OF), AS_OF)


@register("portfolio_metrics", f"{PORTFOLIO_WITH} SELECT * FROM pmetrics", "B4: weighted portfolio metrics")
def q_portfolio_metrics(spark, sf_dir):
    return _pmetrics(spark, sf_dir)


@register("diversification", f"{PORTFOLIO_WITH} SELECT * FROM divers", "B5: holdings count and Herfindahl index")
def q_diversification(spark, sf_dir):
    return PF.diversification(_holdings(spark, sf_dir))


def _flags(spark, sf_dir, appetite=None):
    dr = _stored_returns(spark, sf_dir)
    return PF.portfolio_flags(_holdings(spark, sf_dir), dr, M.scheme_metrics(dr, AS_OF), AS_OF, appetite)


@register("portfolio_flags", f"{PORTFOLIO_WITH} SELECT * FROM flags", "B6: diversification / risk / fund flags")
def q_portfolio_flags(spark, sf_dir):
    return _flags(spark, sf_dir)


# Risk appetite of a customer, by account balance (fixture choice).
LOW_APPETITE_BELOW, HIGH_APPETITE_FROM = 0.0, 5000.0


@register(
    "portfolio_risk_alignment",
    f"{PORTFOLIO_WITH} SELECT f.portfolio_id, low_diversification, "
    f"COALESCE(p.annualized_volatility > CASE WHEN c_acctbal < {LOW_APPETITE_BELOW} THEN {PF.APPETITE_LIMITS['low']} "
    f"WHEN c_acctbal >= {HIGH_APPETITE_FROM} THEN {PF.APPETITE_LIMITS['high']} ELSE {PF.APPETITE_LIMITS['medium']} END, FALSE) "
    "AS risk_misaligned, underperforming_fund FROM flags f LEFT JOIN pmetrics p USING (portfolio_id) "
    "LEFT JOIN customer ON c_custkey = f.portfolio_id",
    "B6: risk alignment with each portfolio's own appetite",
)
def q_portfolio_risk_alignment(spark, sf_dir):
    level = F.when(F.col("c_acctbal") < LOW_APPETITE_BELOW, "low").when(F.col("c_acctbal") >= HIGH_APPETITE_FROM, "high").otherwise("medium")
    appetite = T.read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("portfolio_id"), level.alias("risk_appetite"))
    return _flags(spark, sf_dir, appetite)


@register(
    "portfolio_decision",
    f"{PORTFOLIO_WITH} SELECT portfolio_id, CASE WHEN low_diversification OR risk_misaligned "
    f"OR underperforming_fund THEN 'REBALANCE' ELSE 'HOLD' END AS decision FROM flags",
    "B7: HOLD / REBALANCE",
)
def q_portfolio_decision(spark, sf_dir):
    return PF.portfolio_decision(_flags(spark, sf_dir))


# ---------------------------------------------------------------------------
# Incremental forms, key ranges, retrieval
# ---------------------------------------------------------------------------

#: successive weekly loads, as the first dates of the later ones (the last adds nothing)
BATCH_DATES = ["2000-06-01", "2001-03-01", "2001-10-01"]


def _grown_warehouse(spark, sf_dir, name: str, after_each) -> jobs.Warehouse:
    """A warehouse whose ``raw_nav`` grows batch by batch; ``after_each`` runs after
    every load, and once more after the last."""
    wh = jobs.Warehouse(shared_dir(spark, "tables", name, unique=True))
    nav = _decimal_nav(spark, sf_dir).withColumns({"fund_house": F.lit(None).cast("string"), "scheme_name": F.lit(None).cast("string")})
    for low, high in zip([None, *BATCH_DATES], [*BATCH_DATES, None]):
        part = nav
        part = part.filter(F.col("nav_date") >= F.lit(low).cast("date")) if low else part
        part = part.filter(F.col("nav_date") < F.lit(high).cast("date")) if high else part
        W.append(part, wh.table("raw_nav"), S.RAW_NAV)
        after_each(wh)
    after_each(wh)
    return wh


@register(
    "daily_returns_incremental",
    f"{DECIMAL_DR_WITH} SELECT * FROM daily_returns",
    "E1 batch by batch from the stored tails, an empty batch last",
)
def q_daily_returns_incremental(spark, sf_dir):
    wh = _grown_warehouse(spark, sf_dir, "incremental", lambda w: jobs.run_daily_returns_incremental(spark, w, AS_OF))
    return wh.table("daily_returns").read(spark)


@register(
    "scheme_metrics_incremental",
    f"{DECIMAL_DR_WITH.replace('daily_returns AS', 'exact AS')}, daily_returns AS (SELECT scheme_code, nav_date, "
    f"CAST(nav AS DOUBLE) AS nav, CAST(daily_return_pct AS DOUBLE) AS daily_return_pct FROM exact), {METRIC_CTES} "
    "SELECT * FROM metrics_t",
    "E2 from moments of months, after each of several loads",
)
def q_scheme_metrics_incremental(spark, sf_dir):
    def weekly(w):
        jobs.run_daily_returns_incremental(spark, w, AS_OF)
        jobs.run_scheme_metrics_incremental(spark, w, AS_OF)

    stored = _grown_warehouse(spark, sf_dir, "moments", weekly).table("scheme_metrics").read(spark)
    return stored.select("scheme_code", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in S.METRIC_COLUMNS])


@register(
    "nav_point_lookup",
    f"WITH {RAW_NAV_CTE}, ends AS (SELECT scheme_code, MAX(nav_date) AS last FROM raw_nav GROUP BY scheme_code), "
    "wanted AS (SELECT scheme_code, last AS nav_date FROM ends UNION ALL SELECT scheme_code, last + 1 FROM ends) "
    "SELECT w.scheme_code, CAST(w.nav_date AS DATE) AS nav_date, nav FROM wanted w "
    "LEFT JOIN raw_nav r ON r.scheme_code = w.scheme_code AND r.nav_date = w.nav_date",
    "K5/F10: each scheme's last day and the day after, looked up in a table indexed by key ranges",
)
def q_nav_point_lookup(spark, sf_dir):
    nav = _nav(spark, sf_dir)
    stored = RangedTable(f"{shared_dir(spark, 'tables', 'ranged', unique=True)}/raw_nav")
    stored.append_new(nav.filter(F.col("nav_date") < F.lit(DELTA_CUTOFF).cast("date")), files=8)
    stored.append_new(nav, files=4)
    last = nav.groupBy("scheme_code").agg(F.max("nav_date").alias("last"))
    days = F.explode(F.array("last", F.date_add("last", 1)))
    return stored.lookup(last.select("scheme_code", days.alias("nav_date"))).select("scheme_code", "nav_date", "nav")


@register("embedding_topk", None, "B9: ten nearest vectors of every twentieth, by an inverted file")
def q_embedding_topk(spark, sf_dir):
    vectors = T.read_table(spark, sf_dir, "embeddings")
    return RT.embedding_topk(vectors, shared_dir(spark, "tables", "inverted_file", unique=True), k=10, every=20)


# ---------------------------------------------------------------------------
# Names with misspellings, carried NAVs, peers, balanced ranges
# ---------------------------------------------------------------------------

# what part keys make of their names: as it is, a character less, two others, unknown
_MISSPELT_SQL = (
    "CASE p_partkey % 4 WHEN 0 THEN upper(p_name) "
    "WHEN 1 THEN left(p_name, CAST(p_partkey % length(p_name) AS INT)) || substring(p_name, CAST(p_partkey % length(p_name) AS INT) + 2) "
    "WHEN 2 THEN 'q' || substring(p_name, 2, length(p_name) - 2) || 'q' ELSE 'no such ' || p_name END"
)


@register(
    "resolved_names",
    f"WITH given AS (SELECT DISTINCT {_MISSPELT_SQL} AS scheme_name FROM part), "
    "listed AS (SELECT lower(trim(p_name)) AS name, MIN(p_partkey) AS scheme_code, ARG_MIN(p_name, p_partkey) AS matched_name FROM part GROUP BY 1), "
    "near AS (SELECT scheme_name, name, listed.scheme_code, matched_name, levenshtein(lower(trim(scheme_name)), name) AS d FROM given, listed), "
    "best AS (SELECT scheme_name, MIN(d) AS distance FROM near WHERE d <= 2 GROUP BY 1), "
    "found AS (SELECT scheme_name, ANY_VALUE(distance) AS distance, COUNT(*) AS n, ANY_VALUE(near.scheme_code) AS scheme_code, ANY_VALUE(matched_name) AS matched_name "
    "FROM near JOIN best USING (scheme_name) WHERE d = distance GROUP BY 1) "
    "SELECT scheme_name, CASE WHEN n IS NULL THEN 'unknown' WHEN n > 1 THEN 'ambiguous' WHEN distance = 0 THEN 'exact' ELSE 'corrected' END AS status, "
    "CASE WHEN n = 1 THEN scheme_code END AS scheme_code, CASE WHEN n = 1 THEN matched_name END AS matched_name, "
    "CAST(distance AS INTEGER) AS distance, CAST(COALESCE(n, 0) AS BIGINT) AS n_candidates FROM given LEFT JOIN found USING (scheme_name)",
    "B1: misspelt names resolved to the nearest listed one",
)
def q_resolved_names(spark, sf_dir):
    part = T.read_table(spark, sf_dir, "part")
    given = part.select(F.expr(_MISSPELT_SQL).alias("scheme_name"))
    return N.resolve_names(given, part.select(F.col("p_partkey").alias("scheme_code"), F.col("p_name").alias("scheme_name")))


VALUE_MONTHS = 3


def _units(spark, sf_dir):
    li = T.read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    od = T.read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    held = li.join(od, li.l_orderkey == od.o_orderkey).filter("l_suppkey IS NOT NULL")
    return held.groupBy(F.col("o_custkey").alias("portfolio_id"), F.col("l_suppkey").alias("scheme_code")).agg(F.sum("l_quantity").cast("decimal(12,0)").alias("units"))


@register(
    "portfolio_value",
    f"WITH {DECIMAL_NAV_CTE}, units AS (SELECT o_custkey AS portfolio_id, l_suppkey AS scheme_code, CAST(SUM(l_quantity) AS DECIMAL(12,0)) AS units "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey IS NOT NULL GROUP BY 1, 2), "
    f"days AS (SELECT DISTINCT nav_date FROM raw_nav WHERE nav IS NOT NULL AND nav_date BETWEEN {_since(VALUE_MONTHS)} AND {AS_OF_SQL}), "
    "grid AS (SELECT scheme_code, nav_date FROM (SELECT DISTINCT scheme_code FROM units), days), "
    "carried AS (SELECT g.scheme_code, g.nav_date, r.nav, r.nav_date AS known FROM grid g "
    "ASOF JOIN (SELECT * FROM raw_nav WHERE nav IS NOT NULL) r ON g.scheme_code = r.scheme_code AND g.nav_date >= r.nav_date), "
    f"priced AS (SELECT * FROM carried WHERE date_diff('day', known, nav_date) <= {AJ.MAX_GAP_DAYS}), "
    "held AS (SELECT portfolio_id, COUNT(*) AS n FROM units GROUP BY 1) "
    "SELECT u.portfolio_id, p.nav_date, CAST(ROUND(SUM(u.units * p.nav), 2) AS DOUBLE) AS portfolio_value, COUNT(*) AS n_priced, "
    "CAST(SUM(CASE WHEN known < nav_date THEN 1 ELSE 0 END) AS BIGINT) AS n_carried, ANY_VALUE(held.n) - COUNT(*) AS n_unpriced "
    "FROM units u JOIN priced p USING (scheme_code) JOIN held ON held.portfolio_id = u.portfolio_id GROUP BY 1, 2",
    "B4: daily portfolio values at the last known NAVs, carried a week at most",
)
def q_portfolio_value(spark, sf_dir):
    return AJ.portfolio_value(_units(spark, sf_dir), _decimal_nav(spark, sf_dir), AS_OF, VALUE_MONTHS)


@register(
    "peer_underperformance",
    f"{METRICS_WITH}, peers AS (SELECT scheme_code, CAST(scheme_code // 10 AS VARCHAR) AS fund_house, cagr_percent, "
    "ROW_NUMBER() OVER (PARTITION BY scheme_code // 10 ORDER BY cagr_percent) AS rn, COUNT(*) OVER (PARTITION BY scheme_code // 10) AS n FROM metrics_t), "
    "quartile AS (SELECT fund_house, ANY_VALUE(n) AS n_peers, MAX(cagr_percent) AS peer_quartile FROM peers WHERE rn <= GREATEST((n + 3) // 4, 1) GROUP BY 1) "
    "SELECT scheme_code, fund_house, cagr_percent, peer_quartile, n_peers, cagr_percent < peer_quartile AS underperforming FROM peers JOIN quartile USING (fund_house)",
    "B6: schemes below the lower quartile of their fund house",
)
def q_peer_underperformance(spark, sf_dir):
    dr = R.return_features(T.load_mixed_nav(spark, sf_dir), AS_OF)
    met = M.scheme_metrics(dr, AS_OF)
    houses = met.select("scheme_code", F.floor(F.col("scheme_code") / 10).cast("string").alias("fund_house"))
    return PF.peer_underperformance(met, houses)


SCAN_RANGES = 8


@register(
    "scan_ranges",
    f"WITH {RAW_NAV_CTE}, codes AS (SELECT scheme_code * scheme_code * scheme_code AS code FROM raw_nav WHERE scheme_code IS NOT NULL), "
    "ranked AS (SELECT code, ROW_NUMBER() OVER (ORDER BY code) AS rn, COUNT(*) OVER () AS n FROM codes), "
    f"cuts AS (SELECT DISTINCT code + 1 AS cut FROM ranked, range(1, {SCAN_RANGES}) AS t(i) WHERE rn = (i * n + {SCAN_RANGES - 1}) // {SCAN_RANGES}), "
    "numbered AS (SELECT code, (SELECT COUNT(*) FROM cuts WHERE cut <= code) AS range_no FROM (SELECT code, COUNT(*) AS m FROM codes GROUP BY 1)), "
    "sizes AS (SELECT code, COUNT(*) AS m FROM codes GROUP BY 1) "
    "SELECT CAST(range_no AS INTEGER) AS range_no, MIN(code) AS first_code, MAX(code) AS last_code, CAST(SUM(m) AS BIGINT) AS n_rows "
    "FROM numbered JOIN sizes USING (code) GROUP BY 1",
    "S2: ranges of a skewed key with about equally many rows each, as a partitioned read uses them",
)
def q_scan_ranges(spark, sf_dir):
    codes = _nav(spark, sf_dir).filter("scheme_code IS NOT NULL").select((F.col("scheme_code") * F.col("scheme_code") * F.col("scheme_code")).alias("code"))
    ranges = QT.key_ranges(codes, "code", SCAN_RANGES)
    number = F.coalesce(*[F.when(F.expr(p), i) for i, p in enumerate(QT.range_predicates("code", ranges))])
    return codes.groupBy(number.cast("int").alias("range_no")).agg(
        F.min("code").alias("first_code"), F.max("code").alias("last_code"), F.count(F.lit(1)).alias("n_rows")
    )
