"""Stored tables: existence, layouts, file order, separate processes, streams."""

import json
import os
import subprocess
import sys

import pyarrow.parquet as pq
import pytest
from conftest import ROOT
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from navframe import schemas as S
from navframe.plans import jobs
from navframe.sinks import writers as W
from navframe.sinks.table import Table, keyed_table

KEYS = ["scheme_code", "nav_date"]
UNREADABLE = (PySparkException, Py4JJavaError)


def _doc(code, items):
    return json.dumps({"requested": code, "data": [{"date": d, "nav": n} for d, n in items]})


def _land(folder, name, docs):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join(docs) + "\n")


def _cli(tmp_dir, *args):
    env = os.environ | {"PYTHONPATH": ROOT}
    done = subprocess.run([sys.executable, "-m", "navframe.cli", *args, "--master", "local[2]"], cwd=tmp_dir, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


@pytest.mark.parametrize("years", [[], ["--year-partitioned"]])
def test_bucketed_history_survives_a_new_process(spark, tmp_dir, years):
    wh = os.path.join(tmp_dir, "wh")
    for k, (name, docs) in enumerate([("a.json", [_doc(1, [("01-01-2024", "10"), ("02-01-2024", "11")])]), ("b.json", [_doc(1, [("02-01-2024", "99"), ("03-01-2025", "12")])])]):
        land = os.path.join(tmp_dir, f"land{k}")
        _land(land, name, docs)
        _cli(tmp_dir, "nav", "--nav-landing", land, "--warehouse", wh, "--buckets", "4", *years)
    _cli(tmp_dir, "daily-returns", "--warehouse", wh, "--buckets", "4", "--as-of", "2025-02-01", *years)
    table = jobs.Warehouse(wh, buckets=4, year_partitioned=bool(years))
    got = sorted((r["nav_date"].isoformat(), int(r["nav"])) for r in table.table("raw_nav").read(spark).collect())
    assert got == [("2024-01-01", 10), ("2024-01-02", 11), ("2025-01-03", 12)]
    assert table.table("daily_returns").read(spark).count() == 3


def test_only_absence_means_absent(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t")
    table = Table(path=path)
    assert not table.exists(spark)
    os.makedirs(path)
    assert not table.exists(spark)
    with open(os.path.join(path, "part-0.parquet"), "wb") as f:
        f.write(b"not parquet at all")
    with pytest.raises(UNREADABLE):
        table.exists(spark)
    with pytest.raises(UNREADABLE):
        W.append_new(spark, spark.createDataFrame([(1,)], "scheme_code bigint"), table, ["scheme_code"])


def test_a_layout_is_kept(spark, tmp_dir):
    df = spark.range(100).select(F.col("id").alias("scheme_code"), F.lit("2024-01-01").cast("date").alias("nav_date"))
    bucketed = keyed_table(os.path.join(tmp_dir, "t"), KEYS, name="t_layout_kept", buckets=4)
    W.append(df, bucketed)
    with pytest.raises(ValueError, match="stored as"):
        W.append(df, bucketed.path)
    with pytest.raises(ValueError, match="stored as"):
        keyed_table(bucketed.path, KEYS, name="t_layout_other", buckets=8).read(spark)
    plain = os.path.join(tmp_dir, "plain")
    W.append(df, plain)
    with pytest.raises(ValueError, match="stored as"):
        W.append(df, keyed_table(plain, KEYS, name="t_layout_plain", buckets=4))


def _files(path):
    return [os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")]


def test_files_are_sorted_and_few(spark, tmp_dir):
    df = spark.range(4000).select(((F.col("id") * 7919) % 97).alias("scheme_code"), F.expr("date_add(DATE'2022-06-01', cast(id % 900 as int))").alias("nav_date")).distinct().repartition(8)
    by_year = keyed_table(os.path.join(tmp_dir, "years"), KEYS, year_partitioned=True)
    W.append(df, by_year)
    bucketed = keyed_table(os.path.join(tmp_dir, "buckets"), KEYS, name="t_few_files", buckets=16)
    W.append(df, bucketed)
    assert len(_files(bucketed.path)) <= 16
    for f in _files(by_year.path) + _files(bucketed.path):
        rows = list(zip(*(pq.ParquetFile(f).read(columns=KEYS).column(k).to_pylist() for k in KEYS)))
        assert rows == sorted(rows), f


@pytest.mark.parametrize("buckets", [None, 4])
def test_stream_restarts_without_doubling(spark, tmp_dir, buckets):
    from navframe.streaming.nav_ingest import start_nav_ingest

    land = os.path.join(tmp_dir, "land")
    _land(land, "a.json", [_doc(1, [("01-01-2024", "10"), ("02-01-2024", "bad")]), "{cut off"])
    wh = jobs.Warehouse(os.path.join(tmp_dir, "wh"), buckets=buckets)
    args = (spark, land, wh.table("raw_nav"), os.path.join(tmp_dir, "ckpt"), wh.path("q"), wh.path("c"))
    for name, docs in ((None, None), ("b.json", [_doc(1, [("01-01-2024", "99"), ("03-01-2024", "12")])])):
        if name:
            _land(land, name, docs)
        assert start_nav_ingest(*args).awaitTermination(120)
    # a lost checkpoint: everything is read again, nothing is stored twice
    again = (*args[:3], os.path.join(tmp_dir, "ckpt2"), *args[4:])
    assert start_nav_ingest(*again).awaitTermination(120)
    assert sorted(int(r["nav"]) for r in wh.table("raw_nav").read(spark).collect()) == [10, 12]
    assert spark.read.parquet(wh.path("q")).count() == 1
    assert spark.read.parquet(wh.path("c")).count() == 1
    with pytest.raises(ValueError, match="checkpoint"):
        start_nav_ingest(spark, land, wh.table("raw_nav"), "")


def test_create_tables_once(spark, tmp_dir):
    wh = jobs.Warehouse(os.path.join(tmp_dir, "wh"))
    assert jobs.create_tables(spark, wh) == list(S.TABLES)
    assert jobs.create_tables(spark, wh) == []
    assert jobs.run_daily_returns(spark, wh) == 0
    for name, schema in S.TABLES.items():
        S.check(wh.table(name).read(spark), schema)


def test_sequences_and_chunks(spark):
    from helpers import series

    from navframe.operators import returns as R
    from navframe.operators import sequences as Q

    dr = R.return_features(series(spark, [100.0, 110.0, 121.0, 133.1, 146.41]), "2024-12-31")
    rows = Q.sequence_features(dr, 3).collect()
    assert [(len(r["sequence"]), round(r["target"], 6)) for r in rows] == [(3, 10.0)]
    docs = spark.createDataFrame([(1, " ".join(map(str, range(11)))), (2, " a\tb\n"), (3, ""), (4, None)], "doc_id bigint, text string")
    got = {(r["doc_id"], r["chunk_no"]): (r["start_word"], r["n_words"], r["chunk"]) for r in Q.document_chunks(docs, 5, 2).collect()}
    assert got == {(1, 0): (0, 5, "0 1 2 3 4"), (1, 1): (3, 5, "3 4 5 6 7"), (1, 2): (6, 5, "6 7 8 9 10"), (2, 0): (0, 2, "a b")}
