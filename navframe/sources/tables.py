"""Parquet table access and the stand-in NAV series derived from the test tables.

The test tables carry no NAV data, so NAV queries read a series Spark derives
from ``lineitem`` (one row per supplier and ship day). The derivation is an
aggregate with the composite key ``(scheme_code, nav_date)``, so a supplier
with a third of all rows is still spread over many shuffle partitions, and
partial aggregation runs before the exchange.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def nav_series(lineitem: DataFrame) -> DataFrame:
    """Stand-in ``raw_nav``: ``scheme_code, nav_date, nav`` (double).

    Same text as the oracle: supplier = scheme, ship day = NAV date,
    max unit price of the day = NAV.
    """
    return (
        lineitem.select(
            F.col("l_suppkey").alias("scheme_code"),
            F.col("l_shipdate").cast("date").alias("nav_date"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        )
        .groupBy("scheme_code", "nav_date")
        .agg(F.max("unit_price").alias("nav"))
    )


def thin_nav_series(orders: DataFrame) -> DataFrame:
    """Stand-in with thin keys (1 to ~25 dates per key): customer = scheme,
    order day = NAV date, max order total of the day = NAV."""
    return (
        orders.select(
            F.col("o_custkey").alias("scheme_code"),
            F.col("o_orderdate").cast("date").alias("nav_date"),
            F.col("o_totalprice"),
        )
        .groupBy("scheme_code", "nav_date")
        .agg(F.max("o_totalprice").alias("nav"))
    )


def mixed_nav_series(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Both stand-ins in one series with disjoint keys: suppliers keep their
    key (long histories, all above the 30-row gate), customers get negative
    keys (short histories, all below it), so gates are exercised both ways."""
    thin = thin_nav_series(orders).withColumn("scheme_code", F.lit(-1) - F.col("scheme_code"))
    return nav_series(lineitem).unionByName(thin)


def load_mixed_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_nav_series(read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "orders"))


def load_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nav_series(read_table(spark, sf_dir, "lineitem"))


# The SQL the oracle side uses for the same stand-ins (DuckDB dialect).
NAV_SERIES_SQL = (
    "SELECT l_suppkey AS scheme_code, CAST(l_shipdate AS DATE) AS nav_date, "
    "MAX(l_extendedprice / l_quantity) AS nav FROM lineitem GROUP BY 1, 2"
)
THIN_NAV_SERIES_SQL = (
    "SELECT o_custkey AS scheme_code, CAST(o_orderdate AS DATE) AS nav_date, "
    "MAX(o_totalprice) AS nav FROM orders GROUP BY 1, 2"
)
MIXED_NAV_SERIES_SQL = (
    f"{NAV_SERIES_SQL} UNION ALL SELECT -1 - o_custkey AS scheme_code, "
    "CAST(o_orderdate AS DATE) AS nav_date, MAX(o_totalprice) AS nav FROM orders GROUP BY 1, 2"
)
