"""A table at rest: a Parquet folder, optionally a bucketed catalog table,
optionally partitioned by the year of its date.

Bucketing the NAV tables by ``scheme_code`` (same bucket count everywhere)
makes the scan itself hash-partitioned on the key the windows, the metric
aggregate and the enrichment join use, so E1, E2 and E3 plan with no
exchange at all; only a per-bucket sort remains for the windows.

The bucket layout is kept in ``<path>.layout`` beside the data. A process whose
catalog doesn't know a bucketed table registers the stored files under that
layout before it reads or appends, so the files, not the catalog, decide whether
a table exists. Opening a folder under another layout than it was written with
is an error.

Partitioning by ``nav_year`` (derived from ``nav_date`` on write, dropped on
read) lets a reader that only needs the lookback skip whole years of history
before any file is opened. Files are sorted by ``(scheme_code, nav_date)``
(within a year, where partitioned), so Parquet row-group statistics on the date
cannot do that. Readers pass
``since=`` to get the pruning; the result never includes the helper column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

YEAR_COL = "nav_year"
DATE_COL = "nav_date"
LAYOUT = "buckets int, bucket_by string"
#: error conditions that mean that no file is stored
ABSENT = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


@dataclass(frozen=True)
class Table:
    path: str
    name: str | None = None  # catalog name; required when bucketed
    bucket_by: str | None = None
    buckets: int | None = None
    sort_by: tuple[str, ...] = field(default_factory=tuple)
    year_partitioned: bool = False

    @property
    def bucketed(self) -> bool:
        return bool(self.buckets and self.bucket_by and self.name)

    def _layout(self) -> dict:
        return {"buckets": self.buckets if self.bucketed else 0, "bucket_by": self.bucket_by if self.bucketed else ""}

    def _stored_schema(self, spark: SparkSession) -> T.StructType | None:
        """Schema of the stored files; None only when nothing is stored. Any
        other error (an unreadable file, a store that is down) is raised."""
        try:
            return spark.read.parquet(self.path).schema
        except AnalysisException as e:
            if e.getCondition() in ABSENT:
                return None
            raise

    def _check_layout(self, spark: SparkSession) -> None:
        try:
            rows = spark.read.schema(LAYOUT).json(f"{self.path}.layout").collect()
        except AnalysisException as e:
            if e.getCondition() not in ABSENT:
                raise
            rows = []
        stored = rows[0].asDict() if rows else {"buckets": 0, "bucket_by": ""}
        if stored != self._layout():
            raise ValueError(f"{self.path} is stored as {stored}, opened as {self._layout()}")

    def exists(self, spark: SparkSession) -> bool:
        return self._stored_schema(spark) is not None

    def _open(self, spark: SparkSession) -> bool:
        """Check the layout and register a bucketed table; False if absent."""
        schema = self._stored_schema(spark)
        if schema is None:
            if self.name and spark.catalog.tableExists(self.name):
                spark.sql(f"DROP TABLE {self.name}")  # its files are gone
            return False
        self._check_layout(spark)
        if self.bucketed and not spark.catalog.tableExists(self.name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
            sort = f"SORTED BY ({', '.join(self.sort_by)}) " if self.sort_by else ""
            years = f"PARTITIONED BY ({YEAR_COL}) " if self.year_partitioned else ""
            spark.sql(
                f"CREATE TABLE {self.name} ({columns}) USING PARQUET {years}"
                f"CLUSTERED BY ({self.bucket_by}) {sort}INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
            )
            if self.year_partitioned:
                spark.sql(f"MSCK REPAIR TABLE {self.name}")
        return True

    def read(self, spark: SparkSession, since=None) -> DataFrame:
        """The table; with ``since`` (a date or date Column) and a
        year-partitioned table, only the years from ``since`` on are read."""
        if self.bucketed:
            self._open(spark)
            df = spark.table(self.name)
        else:
            df = spark.read.parquet(self.path)
        if self.year_partitioned:
            if since is not None:
                start = since if isinstance(since, Column) else F.lit(since).cast("date")
                df = df.filter(F.col(YEAR_COL) >= F.year(start))
            df = df.drop(YEAR_COL)
        return df

    def write(self, df: DataFrame, mode: str, observation: Observation | None = None) -> None:
        """Add to or replace the table. Bucketed rows are dealt by the bucket key
        first, so each bucket of a write is one file (a year). ``observation``
        counts the ``rows`` written."""
        spark = df.sparkSession
        stored = self._open(spark)
        if self.year_partitioned:
            df = df.withColumn(YEAR_COL, F.year(DATE_COL))
        if self.bucketed:
            df = df.repartition(self.buckets, self.bucket_by)
        elif self.sort_by:
            df = df.sortWithinPartitions(*([YEAR_COL] if self.year_partitioned else []), *self.sort_by)
        if observation is not None:  # above the exchange, which an empty input removes
            df = df.observe(observation, F.count(F.lit(1)).alias("rows"))
        w = df.write.mode(mode).format("parquet")
        if self.year_partitioned:
            w = w.partitionBy(YEAR_COL)
        if not self.bucketed:
            w.save(self.path)
            return
        if not stored:  # the layout first: files without it would be taken for plain ones
            spark.createDataFrame([tuple(self._layout().values())], LAYOUT).coalesce(1).write.mode("overwrite").json(f"{self.path}.layout")
        w = w.option("path", self.path).bucketBy(self.buckets, self.bucket_by)
        if self.sort_by:
            w = w.sortBy(*self.sort_by)
        w.saveAsTable(self.name)


def keyed_table(
    path: str,
    keys: Sequence[str],
    name: str | None = None,
    buckets: int | None = None,
    year_partitioned: bool = False,
) -> Table:
    """A NAV-keyed table: bucketed by the first key, sorted by all keys, and
    (for tables keyed by date) optionally partitioned by the year."""
    return Table(
        path=path,
        name=name,
        bucket_by=keys[0] if buckets else None,
        buckets=buckets,
        sort_by=tuple(keys),
        year_partitioned=year_partitioned and DATE_COL in keys,
    )
