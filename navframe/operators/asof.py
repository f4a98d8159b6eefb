"""As-of joins: the last value known at a time, and valuations built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from navframe import params as P
from navframe.functions.dates import as_of_col, lookback_start
from navframe.operators.joins import broadcast_if_small
from navframe.operators.portfolio import BLOCK_ROWS, KEY, PID, daily_products, stored_blocks, stored_by_portfolio

#: days that a NAV is carried on
MAX_GAP_DAYS = 7


def asof_join(asked: DataFrame, known: DataFrame, key: str, at: str, values: list[str], max_gap_days: int | None = None) -> DataFrame:
    """``asked`` rows (``key``, the date ``at``, more columns) with the ``values`` of
    the last ``known`` row of the key that is dated no later, as far back as
    ``max_gap_days``, and its date ``<at>_known``; null where there is none.

    Both sides are merged into one series of events of a key, sorted by date with
    known rows first, and the last known one is carried on: one exchange and one sort,
    and no pair of rows is formed. A key's events are read in order in one task, a row
    at a time. ``known`` has one row a key and date.
    """
    others = [c for c in asked.columns if c not in (key, at)]
    events = asked.select(key, at, F.lit(1).alias("_kind"), F.struct(*others).alias("_row"), F.lit(None).cast(known.select(F.struct(*values, at)).schema[0].dataType).alias("_known"))
    facts = known.select(key, at, F.lit(0).alias("_kind"), F.lit(None).cast(events.schema["_row"].dataType).alias("_row"), F.struct(*values, at).alias("_known"))
    order = Window.partitionBy(key).orderBy(at, "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last("_known", ignorenulls=True).over(order)
    merged = events.unionByName(facts).withColumn("_last", last).filter("_kind = 1")
    near = F.col("_last").isNotNull()
    if max_gap_days is not None:
        near = near & (F.datediff(at, F.col(f"_last.{at}")) <= max_gap_days)
    return merged.select(key, at, *[F.col(f"_row.{c}").alias(c) for c in others], *[F.when(near, F.col(f"_last.{v}")).alias(v) for v in values], F.when(near, F.col(f"_last.{at}")).alias(f"{at}_known"))


def carried_nav(nav: DataFrame, schemes: DataFrame, as_of=None, months: int = P.LOOKBACK_MONTHS, max_gap_days: int = MAX_GAP_DAYS) -> DataFrame:
    """The NAV of each of the ``schemes`` (``scheme_code``) on every day of the
    lookback on which any scheme has one: its own, or its last one, carried over at
    most ``max_gap_days``. ``nav_date_known`` is the day it is of; days without one
    are left out."""
    start = lookback_start(as_of, months)
    rows = nav.filter(F.col(KEY).isNotNull() & F.col("nav").isNotNull())
    days = rows.filter((F.col("nav_date") >= start) & (F.col("nav_date") <= as_of_col(as_of))).select("nav_date").distinct()
    calendar = schemes.select(KEY).distinct().withColumn("nav_date", F.explode(F.sequence(start, as_of_col(as_of))))
    asked = calendar.join(broadcast_if_small(days), "nav_date", "left_semi").select(KEY, "nav_date")
    known = rows.filter(F.col("nav_date") >= F.date_sub(start, max_gap_days)).select(KEY, "nav_date", "nav")
    return asof_join(asked, known, KEY, "nav_date", ["nav"], max_gap_days).filter("nav IS NOT NULL")


def portfolio_value(
    units: DataFrame, nav: DataFrame, as_of=None, months: int = P.LOOKBACK_MONTHS, max_gap_days: int = MAX_GAP_DAYS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Value of each portfolio on each day, its ``units`` (``portfolio_id,
    scheme_code, units``, one row a holding) at the last known NAVs.

    ``n_priced`` holdings have a NAV that day, ``n_carried`` of them an earlier one;
    ``n_unpriced`` have none within the gap and count for nothing. As in the ratios,
    the units are stored by portfolio and meet the NAVs of a block of days at a time,
    so the values are summed without an exchange; they are written block by block.
    Decimal units and NAVs, the stored types, are multiplied and summed exactly.
    """
    units = units.filter(F.col(KEY).isNotNull()).select(PID, KEY, "units")
    held = stored_by_portfolio(units.join(units.groupBy(PID).agg(F.count(F.lit(1)).alias("_n")), PID))
    carried = F.col("nav_date_known") < F.col("nav_date")
    series = carried_nav(nav, held, as_of, months, max_gap_days).select(KEY, "nav_date", "nav", carried.cast("int").alias("carried"))

    def valued(products: DataFrame) -> DataFrame:
        days = products.groupBy(PID, "_n", "nav_date").agg(
            F.round(F.sum(F.col("units") * F.col("nav")), 2).cast("double").alias("portfolio_value"),
            F.count(F.lit(1)).alias("n_priced"),
            F.sum("carried").alias("n_carried"),
        )
        return days.select(PID, "nav_date", "portfolio_value", "n_priced", "n_carried", (F.col("_n") - F.col("n_priced")).alias("n_unpriced"))

    kind = held.schema[PID].dataType.simpleString()
    schema = f"{PID} {kind}, nav_date date, portfolio_value double, n_priced bigint, n_carried bigint, n_unpriced bigint"
    return stored_blocks((valued(products) for products in daily_products(held, series, block_rows)), schema, held)
