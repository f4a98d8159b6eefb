"""Temp-view registration and SQL over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def register_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def count_rows(spark: SparkSession, df: DataFrame, view: str = "source_table") -> DataFrame:
    """``SELECT COUNT(*) AS total_rows`` over a temp view of ``df``."""
    register_view(df, view)
    return spark.sql(f"SELECT COUNT(*) AS total_rows FROM {view}")
