"""Tables indexed by key ranges (K5, F10) and nearest vectors."""

import datetime as dt
import glob
import math
import os

import numpy as np
import pytest
from conftest import SF01
from pyspark.sql import functions as F

from navframe.operators import retrieval as RT
from navframe.sinks.ranged import MAX_POINTS, RangedTable

D0 = dt.date(2024, 1, 1)


def nav(spark, codes, days=20, value=1.0):
    rows = [(c, D0 + dt.timedelta(days=d), value + c + d) for c in codes for d in range(days)]
    return spark.createDataFrame(rows, "scheme_code bigint, nav_date date, nav double")


def opened(df):
    return [f for f in df.inputFiles()]


def check_ranges(spark, table):
    """The stored ranges are those of the files."""
    for r in table.ranges(spark).collect():
        rows = spark.read.parquet(f"{table.path}/{r.file}").collect()
        keys = sorted((x.scheme_code, x.nav_date) for x in rows)
        assert (tuple(r.low), tuple(r.high), r.rows) == (keys[0], keys[-1], len(keys))


def test_a_point_lookup_opens_one_file(spark, tmp_dir):
    table = RangedTable(os.path.join(tmp_dir, "nav"))
    assert table.append(nav(spark, range(100)), files=10) == 2000
    assert table.ranges(spark).count() >= 8
    found = table.find(spark, 42, D0 + dt.timedelta(days=3))
    assert len(opened(found)) == 1 and [r.nav for r in found.collect()] == [46.0]
    assert table.find(spark, 1000, D0).count() == 0 and opened(table.find(spark, 1000, D0)) == []
    assert table.find(spark, 42, D0 - dt.timedelta(days=1)).count() == 0
    check_ranges(spark, table)


def test_keyed_appends_keep_the_ranges(spark, tmp_dir):
    table = RangedTable(os.path.join(tmp_dir, "nav"))
    assert table.append_new(nav(spark, range(50)), files=8) == 1000
    assert table.append_new(nav(spark, range(40, 60), value=9.0), files=4) == 200  # ten codes are new
    assert table.append_new(nav(spark, range(60)), files=4) == 0
    check_ranges(spark, table)
    assert table.read(spark).count() == 1200
    assert table.find(spark, 45, D0).first().nav == 46.0  # the stored row stays
    wanted = spark.createDataFrame([(3, D0), (55, D0), (77, D0)], "scheme_code bigint, nav_date date")
    got = {r.scheme_code: r.nav for r in table.lookup(wanted).collect()}
    assert got == {3: 4.0, 55: 64.0, 77: None}
    many = nav(spark, range(60), 20).select("scheme_code", "nav_date")
    assert many.count() > MAX_POINTS and table.lookup(many).filter("nav is null").count() == 0
    first = spark.createDataFrame([(1, D0, 2.0), (1, D0, 1.0), (None, D0, 0.0)], "scheme_code bigint, nav_date date, nav double")
    other = RangedTable(os.path.join(tmp_dir, "other"))
    assert other.append_new(first, order=["nav"]) == 1


def test_a_batch_is_there_when_its_ranges_are(spark, tmp_dir):
    table = RangedTable(os.path.join(tmp_dir, "nav"))
    with pytest.raises(ValueError):
        table.read(spark)
    table.append(nav(spark, range(5)))
    table.write_batch(nav(spark, range(5, 9)))  # the driver dies here
    assert table.read(spark).count() == 100 and table.find(spark, 7, D0).count() == 0
    assert table.append_new(nav(spark, range(9))) == 80  # run again
    assert table.read(spark).count() == 180


def test_compaction_survives_a_dead_driver(spark, tmp_dir, monkeypatch):
    table = RangedTable(os.path.join(tmp_dir, "nav"))
    table.append(nav(spark, range(20)), files=2)
    for c in range(20, 26):
        table.append(nav(spark, [c]), files=2)
    before = sorted(map(tuple, table.read(spark).collect()))
    files = table.ranges(spark).count()
    with monkeypatch.context() as m:
        m.setattr(RangedTable, "commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("gone")))
        with pytest.raises(RuntimeError):
            table.compact(spark, 100, files=1)
    assert sorted(map(tuple, table.read(spark).collect())) == before and table.ranges(spark).count() == files
    assert table.compact(spark, 100, files=1) == 12
    assert sorted(map(tuple, table.read(spark).collect())) == before
    assert table.ranges(spark).count() == 3
    check_ranges(spark, table)
    assert table.compact(spark, 100) == 0
    data = lambda: glob.glob(f"{table.path}/*/*.parquet")
    assert len(data()) > 3
    assert table.vacuum(spark) == 13 and len(data()) == 3  # the replaced files and the batch that was never committed
    assert sorted(map(tuple, table.read(spark).collect())) == before


# -- nearest vectors ----------------------------------------------------------------------


def exact(ids, v, k, every):
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        near = np.round(v @ v[i], 9)
        near[i] = -np.inf
        order = np.lexsort((ids, -near))[:k]
        out[int(ids[i])] = [int(x) for x in ids[order]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def recall(got, want):
    return sum(len(set(got[q]) & set(w)) for q, w in want.items()) / sum(map(len, want.values()))


def test_recall_on_the_test_vectors(spark, tmp_dir):
    df = spark.read.parquet(f"{SF01}/embeddings.parquet")
    rows = df.collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    want = exact(ids, v, 10, 20)
    got = found(RT.embedding_topk(df, os.path.join(tmp_dir, "index")))
    assert got.keys() == want.keys() and recall(got, want) >= 0.9


def test_clustered_vectors_need_few_cells(spark, tmp_dir):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(40, 16))
    v = middles[rng.integers(0, 40, 3000)] + 0.15 * rng.normal(size=(3000, 16))
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id bigint, embedding array<double>")
    index = RT.build_index(df, os.path.join(tmp_dir, "index"), 10, dim=16, cells=64)
    assert index.n_probe <= 16
    queries = index.vectors.filter("vec_id % 20 = 0").select("vec_id", "v")
    want = exact(np.arange(3000), v, 10, 20)
    assert recall(found(RT.search(index, queries, 10)), want) >= 0.9
    whole = found(RT.search(index, queries, 10, n_probe=len(index.centroids)))
    assert whole == want  # all cells: exact, ties by id


def test_cells_are_split_by_size(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(RT, "PART_ROWS", 30)
    monkeypatch.setattr(RT, "BLOCK_ROWS", 4)
    rng = np.random.default_rng(4)
    v = np.concatenate([np.repeat(rng.normal(size=(1, 8)), 200, axis=0), rng.normal(size=(100, 8))])  # many equal ones
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id bigint, embedding array<double>")
    index = RT.build_index(df, os.path.join(tmp_dir, "index"), 5, dim=8)
    got = found(RT.search(index, index.vectors.filter("vec_id % 20 = 0").select("vec_id", "v"), 5, n_probe=len(index.centroids)))
    assert got == exact(np.arange(300), v, 5, 20)


def test_improper_vectors_are_left_out(spark, tmp_dir):
    rows = [
        (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [math.nan, 1.0]), (6, [math.inf, 1.0]),
        (7, [None, 1.0]), (None, [1.0, 0.0]), (8, [1.0, 1.0]), (8, [1.0, 1.0]), (9, [1e-300, 1e-300]), (20, [-1.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = RT.embedding_topk(df, os.path.join(tmp_dir, "index"), k=3, dim=2).collect()
    assert {(r.query_id, r.rank, r.vec_id, round(r.similarity, 6)) for r in got} == {
        (0, 1, 1, 1.0), (0, 2, 8, 0.707107), (0, 3, 9, 0.707107), (20, 1, 8, -0.707107), (20, 2, 9, -0.707107), (20, 3, 0, -1.0),
    }
    assert RT.embedding_topk(df.limit(0), os.path.join(tmp_dir, "none"), dim=2).count() == 0
