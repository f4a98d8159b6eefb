"""Connected components of a link table, in Spark.

Alternating large-star and small-star steps: every step rewrites edges towards
smaller neighbours until the table is a set of stars. Only two numbers a step
reach the driver. A hub's neighbours meet in partial minima and in joins that
adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navframe.llm import common


def _minima(edges: DataFrame, node: str, other: str) -> DataFrame:
    return edges.groupBy(F.col(node).alias("n")).agg(F.least(F.min(other), F.first(node)).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    m = _minima(both, "u", "v")
    moved = both.filter("v > u").join(m, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    m = _minima(down, "u", "v")
    moved = down.join(m, F.col("u") == F.col("n"))
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(m.select(F.col("n").alias("u"), F.col("m").alias("v"))).filter("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``u``, ``v`` bigint links to ``node``, ``root``: every linked node other
    than the smallest of its component, and that smallest node."""
    edges = common.store(_small_star(links.filter("u != v").select("u", "v")), "components")
    state = None
    while True:
        edges = common.store(_small_star(_large_star(edges)), "components")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
