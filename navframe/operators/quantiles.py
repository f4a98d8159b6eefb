"""Exact order statistics by counted histograms, for groups of any size.

The k-th smallest value of each group is found digit by digit: counts of the leading
``BITS`` bits of the values give the digit that the k-th one begins with, then the
values with that beginning are counted by their next digit, and so on. Each pass is
one partially aggregated count, so a group that holds most rows is counted where its
rows lie, and what meets in one task are a group's digits: ``2**BITS`` at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navframe.operators.joins import broadcast_if_small

BITS = 12


def kth_values(df: DataFrame, group: str, value: str, ranks: DataFrame) -> DataFrame:
    """``group``, ``k`` and the ``k``-th smallest ``value`` (bigint, from 1) of the
    group, for the rows ``group``, ``k`` of ``ranks``; ranks beyond the group's size
    have no row. Null values don't count."""
    ends = df.agg(F.min(value), F.max(value)).first()
    if ends[0] is None:
        return ranks.select(group, "k", F.lit(None).cast("bigint").alias(value)).limit(0)
    low, span = int(ends[0]), int(ends[1]) - int(ends[0])
    if span >= 1 << 62:
        raise ValueError(f"{value} spans more than 62 bits")
    rows = df.filter(F.col(value).isNotNull()).select(F.col(group).alias("g"), (F.col(value) - F.lit(low)).alias("v"))
    shift = BITS * max(1, math.ceil(span.bit_length() / BITS))
    # how many of the group's values with the same beginning precede the wanted one
    state = ranks.select(F.col(group).alias("g"), "k", F.lit(0).cast("bigint").alias("start"), F.col("k").cast("bigint").alias("rest"))
    while shift > 0:
        shift -= BITS
        beginnings = state.select("g", "start").distinct()
        begin = _shifted("v", shift + BITS).alias("start")
        counted = rows.select("g", begin, _shifted("v", shift).alias("next"))
        # only values that begin as a wanted one are counted
        counted = counted.withColumnsRenamed({"g": "h", "start": "s"}).join(broadcast_if_small(beginnings), _same(), "left_semi")
        counted = counted.groupBy("h", "s", "next").agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("h", "s").orderBy("next"))
        counted = counted.withColumn("upto", upto)
        holds = (F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("n") < F.col("rest"))
        state = state.join(counted, _same() & holds).select("g", "k", F.col("next").alias("start"), (F.col("rest") - (F.col("upto") - F.col("n"))).alias("rest"))
    return state.select(F.col("g").alias(group), "k", (F.col("start") + F.lit(low)).alias(value))


def _same() -> Column:
    return F.col("h").eqNullSafe(F.col("g")) & (F.col("s") == F.col("start"))


def _shifted(name: str, bits: int) -> Column:
    return F.shiftright(name, bits) if bits < 63 else F.lit(0).cast("bigint")


def group_quantiles(df: DataFrame, group: str, value: str, q: float) -> DataFrame:
    """``group``, ``k``, ``n`` and the value of rank ``ceil(q * n)`` of each group."""
    sizes = df.filter(F.col(value).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("k", F.greatest(F.ceil(F.lit(q) * F.col("n")), F.lit(1)).cast("bigint"))
    found = kth_values(df, group, value, sizes.select(group, "k")).withColumnRenamed(group, "_g")
    return sizes.join(found.drop("k"), F.col(group).eqNullSafe(F.col("_g"))).select(group, "k", "n", value)


def key_ranges(df: DataFrame, column: str, n: int) -> list[tuple[int | None, int | None]]:
    """``n`` ranges of a whole-number column with about equally many rows each:
    (first, end) with the end left out; the first and last are open. Fewer where one
    value holds more than a range's rows. Null values belong to the first."""
    total = df.filter(F.col(column).isNotNull()).count()
    if not total or n < 2:
        return [(None, None)]
    spark = df.sparkSession
    wanted = spark.createDataFrame([(1, max(1, math.ceil(i * total / n))) for i in range(1, n)], "one int, k bigint")
    found = kth_values(df.select(F.lit(1).alias("one"), F.col(column).cast("bigint").alias("v")), "one", "v", wanted.distinct())
    cuts = sorted({r.v + 1 for r in found.collect()})  # n - 1 numbers
    last = df.agg(F.max(column)).first()[0]
    cuts = [c for c in cuts if c <= last]
    return list(zip([None, *cuts], [*cuts, None]))


def range_predicates(column: str, ranges: list[tuple[int | None, int | None]]) -> list[str]:
    """The ranges as SQL conditions, for a JDBC read's ``predicates`` or a filter."""
    out = []
    for low, end in ranges:
        parts = ([f"{column} >= {low}"] if low is not None else []) + ([f"{column} < {end}"] if end is not None else [])
        text = " AND ".join(parts) or "1 = 1"
        out.append(f"({text}) OR {column} IS NULL" if low is None else text)
    return out
