"""Small state tables that are replaced as a whole, safely.

A new version is written to its own folder, and then named by one row in
``<path>.versions``. A reader takes the version that was named last, so a driver that
dies while writing leaves the former version in place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navframe.sinks.table import ABSENT


@dataclass(frozen=True)
class VersionedTable:
    path: str

    def latest(self, spark: SparkSession) -> tuple[int, object] | None:
        """Number and mark of the last version; None before the first."""
        try:
            row = spark.read.parquet(f"{self.path}.versions").orderBy(F.col("version").desc()).first()
        except AnalysisException as e:
            if e.getCondition() in ABSENT:
                return None
            raise
        return (row.version, row.mark) if row else None

    def read(self, spark: SparkSession) -> DataFrame:
        version, _ = self.latest(spark)
        return spark.read.parquet(f"{self.path}/version={version}")

    def write(self, df: DataFrame, mark) -> int:
        """Store the next version; ``mark`` (a timestamp) says how far it has come."""
        spark = df.sparkSession
        last = self.latest(spark)
        version = last[0] + 1 if last else 1
        df.write.mode("overwrite").parquet(f"{self.path}/version={version}")
        named = spark.createDataFrame([(version, mark)], "version bigint, mark timestamp")
        named.coalesce(1).write.mode("append").parquet(f"{self.path}.versions")
        return version
