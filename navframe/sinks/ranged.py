"""A table clustered by key ranges, with a stored index of each file's range.

Every append is one batch: rows dealt into key ranges, sorted inside a file, written
to ``<path>/batch=<id>``. Then one row a file (its first and last key, and its rows)
is added to ``<path>.ranges``. That write is the commit: a batch whose ranges aren't
stored is not part of the table, so a job that dies between the two leaves the table
as it was, and running it again adds the batch once.

A point lookup reads the ranges, and opens only files whose range holds the key: one
a batch at most. Compaction writes the rows of small files anew as one batch, whose
ranges name the files that it replaces; readers see the old files until that commit,
and the new ones from it on. Files that nothing refers to can be removed by
:meth:`RangedTable.vacuum`.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from navframe.operators.delta import dedup_new_rows, new_rows
from navframe.sinks.table import ABSENT

#: keys that are looked up one by one in the ranges; more are joined with the table
MAX_POINTS = 1000


@dataclass(frozen=True)
class RangedTable:
    path: str
    keys: tuple[str, ...] = ("scheme_code", "nav_date")

    @property
    def ranges_path(self) -> str:
        return f"{self.path}.ranges"

    # -- the index ---------------------------------------------------------------------

    def ranges(self, spark: SparkSession) -> DataFrame | None:
        """One row a file of the table: ``batch``, ``file`` (relative to ``path``),
        ``low`` and ``high`` (structs of the keys), ``rows``. None before the first
        commit."""
        try:
            log = spark.read.parquet(self.ranges_path)
        except AnalysisException as e:
            if e.getCondition() in ABSENT:
                return None
            raise
        gone = log.select(F.explode("replaces").alias("file")).distinct()
        return log.drop("replaces").join(gone, "file", "left_anti").select("batch", "file", "low", "high", "rows")

    def _files(self, files: DataFrame) -> list[str]:
        return [f"{self.path}/{r.file}" for r in files.select("file").collect()]

    def _key(self) -> Column:
        return F.struct(*self.keys)

    # -- writing -----------------------------------------------------------------------

    def write_batch(self, df: DataFrame, files: int | None = None) -> str:
        """Write rows as a batch that isn't part of the table yet; returns its id.
        ``files`` is their number; left out, adaptive execution sizes them."""
        batch = uuid.uuid4().hex
        dealt = df.repartitionByRange(files, *self.keys) if files else df.repartitionByRange(*self.keys)
        dealt.sortWithinPartitions(*self.keys).write.parquet(f"{self.path}/batch={batch}")
        return batch

    def commit(self, spark: SparkSession, batch: str, schema: T.StructType, replaces: Sequence[str] = ()) -> int:
        """Make a written batch part of the table, in place of the files that it
        ``replaces``; returns its rows."""
        rows = spark.read.schema(schema).parquet(f"{self.path}/batch={batch}")
        name = F.concat(F.lit(f"batch={batch}/"), F.element_at(F.split("_metadata.file_path", "/"), -1))
        ranges = rows.groupBy(name.alias("file")).agg(F.min(self._key()).alias("low"), F.max(self._key()).alias("high"), F.count(F.lit(1)).alias("rows"))
        replaced = F.lit(list(replaces)) if replaces else F.array().cast("array<string>")
        made = ranges.select(F.lit(batch).alias("batch"), "file", "low", "high", "rows", replaced.alias("replaces")).coalesce(1)
        made.write.mode("append").parquet(self.ranges_path)  # one file: all of the commit or none
        return made.sparkSession.read.parquet(self.ranges_path).filter(F.col("batch") == batch).agg(F.sum("rows")).first()[0] or 0

    def append(self, df: DataFrame, files: int | None = None) -> int:
        return self.commit(df.sparkSession, self.write_batch(df, files), df.schema)

    def append_new(self, df: DataFrame, order: Sequence[str] | None = None, files: int | None = None) -> int:
        """Append the rows whose key isn't stored; with ``order`` the first of a key in
        the batch. Only stored files whose range meets the batch's are read."""
        spark = df.sparkSession
        ranges = self.ranges(spark)
        stored = spark.createDataFrame([], df.select(*self.keys).schema)
        if ranges is not None:
            ends = df.agg(F.min(self._key()).alias("low"), F.max(self._key()).alias("high")).first()
            if ends.low is not None:
                meets = (F.col("low") <= _literal(ends.high, self.keys, df.schema)) & (F.col("high") >= _literal(ends.low, self.keys, df.schema))
                paths = self._files(ranges.filter(meets))
                if paths:
                    stored = spark.read.parquet(*paths).select(*self.keys)
        delta = dedup_new_rows(df, stored, self.keys, order) if order else new_rows(df, stored, self.keys)
        return self.append(delta, files)

    # -- reading -----------------------------------------------------------------------

    def read(self, spark: SparkSession) -> DataFrame:
        """The whole table."""
        ranges = self.ranges(spark)
        if ranges is None:
            raise ValueError(f"nothing is stored in {self.path}")
        # whole batches by their folder; by file only those that lost files since
        log = spark.read.parquet(self.ranges_path).groupBy("batch").agg(F.count(F.lit(1)).alias("written"))
        left = ranges.groupBy("batch").agg(F.count(F.lit(1)).alias("left")).join(log, "batch")
        whole = [f"{self.path}/batch={r.batch}" for r in left.filter("left = written").collect()]
        return spark.read.parquet(*whole, *self._files(ranges.join(left.filter("left < written"), "batch", "left_semi")))

    def find(self, spark: SparkSession, *key) -> DataFrame:
        """The rows of one key; only files whose range holds it are opened."""
        ranges = self.ranges(spark)
        if ranges is None:
            raise ValueError(f"nothing is stored in {self.path}")
        schema = ranges.schema["low"].dataType
        wanted = F.struct(*[F.lit(v).cast(schema[k].dataType).alias(k) for k, v in zip(self.keys, key)])
        paths = self._files(ranges.filter((F.col("low") <= wanted) & (F.col("high") >= wanted)))
        whole = spark.read.parquet(f"{self.path}/{ranges.select('file').first().file}").schema
        rows = spark.read.schema(whole).parquet(*paths) if paths else spark.createDataFrame([], whole)
        for k, v in zip(self.keys, key):
            rows = rows.filter(F.col(k) == F.lit(v).cast(schema[k].dataType))
        return rows

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` keys (distinct) with the stored columns of each, null where the
        key isn't stored. Up to ``MAX_POINTS`` keys choose their files by the ranges."""
        spark = wanted.sparkSession
        ranges = self.ranges(spark)
        if ranges is None:
            raise ValueError(f"nothing is stored in {self.path}")
        points = wanted.select(*self.keys).limit(MAX_POINTS + 1).collect()
        if len(points) > MAX_POINTS:
            rows = self.read(spark)
        else:
            near = spark.createDataFrame(points, wanted.select(*self.keys).schema).select(self._key().alias("key"))
            held = ranges.join(F.broadcast(near), (F.col("low") <= F.col("key")) & (F.col("high") >= F.col("key")), "left_semi")
            paths = self._files(held)
            rows = spark.read.parquet(*paths) if paths else self.read(spark).limit(0)
        return wanted.join(rows, list(self.keys), "left")

    # -- upkeep ------------------------------------------------------------------------

    def compact(self, spark: SparkSession, small_rows: int, files: int | None = None) -> int:
        """Write the rows of files with fewer than ``small_rows`` rows anew, as one
        batch; returns how many files it replaced."""
        ranges = self.ranges(spark)
        small = [r.file for r in ranges.filter(F.col("rows") < small_rows).select("file").collect()] if ranges is not None else []
        if len(small) < 2:
            return 0
        rows = spark.read.parquet(*[f"{self.path}/{f}" for f in small])
        self.commit(spark, self.write_batch(rows, files), rows.schema, replaces=small)
        return len(small)

    def vacuum(self, spark: SparkSession) -> int:
        """Delete files that are not part of the table: replaced ones, and those of
        batches never committed. Not for use while a writer is at work."""
        ranges = self.ranges(spark)
        kept = {r.file for r in ranges.select("file").collect()} if ranges is not None else set()
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        gone = 0
        for folder in fs.listStatus(path):
            for f in fs.listStatus(folder.getPath()):
                if f"{folder.getPath().getName()}/{f.getPath().getName()}" not in kept and f.getPath().getName().endswith(".parquet"):
                    fs.delete(f.getPath(), False)
                    gone += 1
        return gone


def _literal(row, keys: Sequence[str], schema: T.StructType) -> Column:
    return F.struct(*[F.lit(row[k]).cast(schema[k].dataType).alias(k) for k in keys])
