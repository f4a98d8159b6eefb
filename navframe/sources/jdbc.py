"""JDBC sources.

Connection details are passed in (``url`` and a ``properties`` dict with user,
password and driver); nothing is looked up from an environment.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

DEFAULT_FETCHSIZE = 1000


def read_table(
    spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None, fetchsize: int = DEFAULT_FETCHSIZE
) -> DataFrame:
    """A whole table (or a parenthesised subquery with an alias)."""
    props = {"fetchsize": str(fetchsize), **(properties or {})}
    return spark.read.jdbc(url, table, properties=props)


def column_bounds(
    spark: SparkSession, url: str, table: str, column: str, properties: dict[str, str] | None = None
) -> tuple[int, int] | None:
    """``min`` / ``max`` of the partition column, computed by the database
    (one row comes back), instead of fixed constants."""
    q = f"(SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {table}) b"
    row = spark.read.jdbc(url, q, properties=dict(properties or {})).first()
    if row is None or row[0] is None:  # by position: databases fold names differently
        return None
    return int(row[0]), int(row[1])


def read_partitioned(
    spark: SparkSession,
    url: str,
    table: str,
    column: str,
    num_partitions: int,
    properties: dict[str, str] | None = None,
    bounds: tuple[int, int] | None = None,
    fetchsize: int = DEFAULT_FETCHSIZE,
) -> DataFrame:
    """Parallel read split into ``num_partitions`` ranges of ``column``.

    Bounds only shape the split (rows outside them land in the edge
    partitions); they come from the data unless given.
    """
    props = {"fetchsize": str(fetchsize), **(properties or {})}
    b = bounds or column_bounds(spark, url, table, column, properties)
    if b is None:
        return spark.read.jdbc(url, table, properties=props)
    lo, hi = b
    return spark.read.jdbc(
        url, table, column=column, lowerBound=lo, upperBound=hi + 1, numPartitions=num_partitions, properties=props
    )


def read_balanced(
    spark: SparkSession,
    url: str,
    table: str,
    column: str,
    num_partitions: int,
    properties: dict[str, str] | None = None,
    fetchsize: int = DEFAULT_FETCHSIZE,
) -> DataFrame:
    """S2 on unevenly spread keys: a parallel read in ranges of ``column`` with about
    equally many rows each. The key column alone is read first, for the bounds."""
    from navframe.operators.quantiles import key_ranges, range_predicates

    ranges = key_ranges(read_keys(spark, url, table, [column], properties), column, num_partitions)
    props = {"fetchsize": str(fetchsize), **(properties or {})}
    return spark.read.jdbc(url, table, predicates=range_predicates(column, ranges), properties=props)


def read_keys(
    spark: SparkSession, url: str, table: str, keys: Sequence[str], properties: dict[str, str] | None = None
) -> DataFrame:
    """S3: only the key columns (Spark prunes the column list into the query)."""
    return read_table(spark, url, table, properties).select(*keys)
