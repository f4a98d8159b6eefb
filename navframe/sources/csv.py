"""CSV source (S4) and ordered preview (O2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, header: bool = True) -> DataFrame:
    """Header CSV. Without ``schema`` every column is a string (no inference
    pass over the data); with one, values are parsed to its types."""
    reader = spark.read.option("header", str(header).lower())
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)


def write_csv(df: DataFrame, path: str, header: bool = True, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", str(header).lower()).option("dateFormat", "yyyy-MM-dd").csv(path)


def preview(df: DataFrame, order_by: Sequence[str], n: int = 20) -> DataFrame:
    """The first ``n`` rows in a stated order (a reproducible ``show``).

    Spark plans ``orderBy + limit`` as a per-partition top-n followed by a
    single merge of at most ``n`` rows per partition.
    """
    return df.orderBy(*order_by).limit(n)
