"""E1 as a stream: features of NAV rows as they arrive, from Spark's state store.

State is kept for each scheme: its NAV rows from ``since`` on, in date order. A new
row is written out with the values that its features need (earlier NAVs, and exact
sums over the rows before it); the features themselves are the same column
expressions as in the batch form. A row that is late, dated before rows that were
written already, gets its own features from the rows before it, and leaves the
others as they are; a key that is there already is ignored. So any split of a series
into micro-batches in date order gives what the batch gives.

A scheme's state is bounded by the days since ``since``. The state and the stream's
place are in the checkpoint folder, so a restart goes on where the last run stopped.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from navframe import params as P
from navframe import schemas as S
from navframe.operators import returns as R
from navframe.sinks import writers as W
from navframe.sinks.table import Table

LAGS = {"prev_day_nav": P.LAG_DAY, "prev_week_nav": P.LAG_WEEK, "prev_month_nav": P.LAG_MONTH, "nav_90d_ago": P.LAG_90D}
_NAV, _SUM = P.NAV_DECIMAL, "decimal(28,6)"
STATE = f"dates array<date>, navs array<{_NAV}>"
ROWS = (
    f"scheme_code bigint, nav_date date, nav {_NAV}, "
    + ", ".join(f"{name} {_NAV}" for name in LAGS)
    + "".join(f", sum_{n} {_SUM}, count_{n} bigint" for n in P.MOVING_AVG_ROWS)
)


def needed_values(dates: list, navs: list, at: int) -> list:
    """What the features of row ``at`` need: its lags, and sum and count of the NAVs
    in each moving frame."""
    out = [navs[at - rows] if at >= rows else None for rows in LAGS.values()]
    for n in P.MOVING_AVG_ROWS:
        frame = [v for v in navs[max(0, at - n + 1) : at + 1] if v is not None]
        out += [sum(frame, Decimal(0)) if frame else None, len(frame)]
    return out


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One scheme's rows of a micro-batch, by date: each joins the state and is
    written out; of rows of one date the first is kept."""
    dates, navs = (list(x) for x in state.get) if state.exists else ([], [])
    columns = [c.split(" ")[0] for c in ROWS.split(", ")]
    rows = []
    arrived = [(d, v) for batch in batches for d, v in zip(batch["nav_date"], batch["nav"])]
    for day, nav in sorted(arrived, key=lambda r: r[0]):  # stable: the first of a date stays first
        at = bisect.bisect_left(dates, day)
        if at < len(dates) and dates[at] == day:
            continue
        nav = None if pd.isna(nav) else nav
        dates.insert(at, day)
        navs.insert(at, nav)
        rows.append([key[0], day, nav, *needed_values(dates, navs, at)])
    state.update((dates, navs))
    yield pd.DataFrame(rows, columns=columns)


def feature_stream(nav: DataFrame, since) -> DataFrame:
    """Feature rows of a stream of ``scheme_code, nav_date, nav``, for the series from
    the date ``since`` on."""
    rows = nav.select(F.col(R.KEY).cast("bigint").alias(R.KEY), R.ORDER, F.col("nav").cast(_NAV).alias("nav"))
    rows = rows.filter(F.col(R.KEY).isNotNull() & (F.col(R.ORDER) >= F.lit(since).cast("date")))
    found = rows.groupBy(R.KEY).applyInPandasWithState(_advance, ROWS, STATE, "append", GroupStateTimeout.NoTimeout)
    averages = {f"moving_avg_{n}d": F.round((F.col(f"sum_{n}") / F.nullif(F.col(f"count_{n}"), F.lit(0))).cast(R._avg_type()), P.ROUND_DIGITS) for n in P.MOVING_AVG_ROWS}
    lagged = found.select(
        R.KEY, R.ORDER, "nav", "prev_day_nav", "prev_week_nav", "prev_month_nav", F.col("prev_month_nav").alias("nav_30d_ago"), "nav_90d_ago",
        *[c.alias(n) for n, c in averages.items()],
    )
    return R._with_returns(lagged)


def start_features(
    spark: SparkSession,
    raw_nav_path: str,
    daily_returns: str | Table,
    checkpoint_path: str,
    since,
    max_files_per_trigger: int | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Features of the NAV files that were added to ``raw_nav_path``, appended to
    ``daily_returns`` by key, so a micro-batch that is replayed adds nothing twice."""
    if not checkpoint_path:
        raise ValueError("a checkpoint path is required: it holds the schemes' state")
    reader = spark.readStream.schema(S.RAW_NAV)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    feats = feature_stream(reader.parquet(raw_nav_path), since)

    def _batch(batch: DataFrame, epoch_id: int) -> None:
        W.append_new(batch.sparkSession, batch, daily_returns, S.KEYS["daily_returns"], schema=S.DAILY_RETURNS)

    writer = feats.writeStream.outputMode("append").foreachBatch(_batch).option("checkpointLocation", checkpoint_path)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
