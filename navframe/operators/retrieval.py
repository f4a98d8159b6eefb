"""Embedding retrieval (tier B9): nearest vectors by an inverted file.

Vectors are scaled to unit length and compared by cosine similarity. Centroids are
fitted on a bounded sample of the table (``SAMPLE`` vectors, those with the smallest
hash of their id) and every vector is assigned to the cell of its nearest centroid.
A query is compared with the vectors of its nearest cells alone. How many cells are
probed is measured, not guessed: the smallest number for which the sample's own
queries (``TRIALS`` at most) find ``TARGET`` of their exact neighbours. Clustered
vectors need few cells; vectors without structure need most of them.

A cell is cut by its counted size into parts of about ``PART_ROWS`` vectors, and its
queries into blocks of about ``BLOCK_ROWS``, so a task compares a bounded part with a
bounded block, however many vectors one cell holds; it returns each query's best
``k`` alone, and the bests of a query's parts are merged. Pairs of vectors are never
rows. Centroids (at most ``CELLS``) and the counts of the cells are of fixed size.

Defined results: vectors that are null, of another length, zero, or with a null or
non-finite component are neither stored nor queried. A null id is no vector. Equal
similarities are ordered by id. A query isn't its own neighbour; repeated ids are
one vector (the smallest).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE, CELLS, STEPS, TRIALS, TARGET = 16_384, 256, 8, 400, 0.94
PART_ROWS, BLOCK_ROWS = 20_000, 4_000


@dataclass(frozen=True)
class Index:
    """``centroids`` (unit rows), cells to probe, and the stored vectors
    (``vec_id``, ``v``, ``cell``)."""

    centroids: np.ndarray
    n_probe: int
    vectors: DataFrame


def unit_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = 64) -> DataFrame:
    """``vec_id`` and ``v`` (array of double, of length one) of the proper vectors."""
    v = F.col(f"`{vec_col}`")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    kept = df.filter(F.col(f"`{id_col}`").isNotNull() & v.isNotNull() & (F.size(v) == dim) & fine)
    rows = kept.select(F.col(f"`{id_col}`").alias("vec_id"), F.transform(v, lambda x: x.cast("double")).alias("v"))
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    # the largest component first, so that squares of small ones don't vanish
    rows = rows.withColumn("m", F.array_max(F.transform("v", lambda x: F.abs(x)))).filter("m > 0")
    rows = rows.withColumn("v", F.transform("v", lambda x: x / F.col("m")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return rows.withColumn("norm", norm).select("vec_id", F.transform("v", lambda x: x / F.col("norm")).alias("v"))


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit(vectors: DataFrame, k: int, cells: int = CELLS, sample: int = SAMPLE, target: float = TARGET) -> tuple[np.ndarray, int]:
    """Centroids of a bounded sample, and how many cells a query must probe to find
    ``target`` of its ``k`` nearest ones there."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()
    if not rows:
        return np.zeros((0, 0)), 0
    points = np.array([r.v for r in rows])
    cells = max(1, min(cells, len(points) // 32))
    centroids = points[:cells].copy()
    for _ in range(STEPS):
        owner = (points @ centroids.T).argmax(axis=1)
        for c in range(cells):
            mine = points[owner == c]
            if len(mine) and np.linalg.norm(mine.sum(axis=0)) > 0:
                centroids[c] = mine.sum(axis=0) / np.linalg.norm(mine.sum(axis=0))
    owner = (points @ centroids.T).argmax(axis=1)
    trials = points[-TRIALS:]
    near = trials @ points.T
    near[np.arange(len(trials)), np.arange(len(points) - len(trials), len(points))] = -np.inf
    best = np.argsort(-near, axis=1, kind="stable")[:, : max(1, min(k, len(points) - 1))]
    rank = np.argsort(np.argsort(-(trials @ centroids.T), axis=1, kind="stable"), axis=1)  # of each cell
    needed = np.sort(np.take_along_axis(rank, owner[best], axis=1).ravel()) + 1
    return centroids, int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)])


def build_index(df: DataFrame, path: str, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = 64, **fitting) -> Index:
    """Fit the centroids, assign every vector to its cell and store the vectors in
    the folder ``path``, partitioned by cell, so that a search opens its cells."""
    spark = df.sparkSession
    vectors = unit_vectors(df, id_col, vec_col, dim)
    centroids, n_probe = fit(vectors, k, **fitting)
    cell = _cells(vectors, centroids, 1).select("vec_id", "v", F.col("cells")[0].alias("cell"))
    # one cell's rows meet in few files; adaptive execution splits a cell that holds many
    cell.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(path)
    return Index(centroids, n_probe, spark.read.schema(cell.schema).parquet(path))


def _cells(vectors: DataFrame, centroids: np.ndarray, n: int) -> DataFrame:
    """``cells``: the numbers of the ``n`` nearest centroids."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = matrix(batch.column(1)) @ centroids.T
            best = np.argsort(-near, axis=1, kind="stable")[:, :n].astype(np.int32)
            ends = pa.array(np.arange(len(best) + 1, dtype=np.int32) * best.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(best.ravel()))], names=["vec_id", "v", "cells"])

    if not len(centroids):
        return vectors.select("vec_id", "v", F.lit(None).cast("array<int>").alias("cells"))
    return vectors.mapInArrow(run, f"vec_id {kind}, v array<double>, cells array<int>")


def _best(k: int, queries: pa.Table, stored: pa.Table) -> pa.Table:
    """Each query's ``k`` best vectors of one part: ties by id."""
    out = {"query_id": [], "vec_id": [], "similarity": []}
    if len(queries) and len(stored):
        order = np.argsort(stored["vec_id"].to_numpy(zero_copy_only=False), kind="stable")
        ids, v = stored["vec_id"].to_numpy(zero_copy_only=False)[order], matrix(stored["v"])[order]
        asked, q = queries["query_id"].to_numpy(zero_copy_only=False), matrix(queries["v"])
        for begin in range(0, len(q), 256):
            near = np.round(q[begin : begin + 256] @ v.T, 9)
            near[asked[begin : begin + 256, None] == ids[None, :]] = -np.inf
            best = np.argsort(-near, axis=1, kind="stable")[:, :k]
            values = np.take_along_axis(near, best, axis=1)
            row, col = np.nonzero(np.isfinite(values))
            out["query_id"].append(asked[begin : begin + 256][row])
            out["vec_id"].append(ids[best[row, col]])
            out["similarity"].append(values[row, col])
    kind = stored.schema.field("vec_id").type
    made = [np.concatenate(x) if x else [] for x in out.values()]
    return pa.table([pa.array(made[0], kind), pa.array(made[1], kind), pa.array(made[2], pa.float64())], names=list(out))


def search(index: Index, queries: DataFrame, k: int = 10, n_probe: int | None = None) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``similarity`` of the ``k`` best
    vectors for each query (``vec_id``, ``v``: see :func:`unit_vectors`)."""
    kind = index.vectors.schema["vec_id"].dataType.simpleString()
    schema = f"query_id {kind}, vec_id {kind}, similarity double"
    spark = queries.sparkSession
    if not len(index.centroids):
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, similarity double")
    probing = _cells(queries, index.centroids, n_probe or index.n_probe).select(F.col("vec_id").alias("query_id"), "v", F.explode("cells").alias("cell"))
    parts = index.vectors.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts"))
    blocks = probing.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    grid = F.broadcast(parts.join(blocks, "cell"))  # a row a cell: at most CELLS
    numbers = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    asked = probing.join(grid, "cell").withColumn("block", dealt("query_id", "blocks")).withColumn("part", numbers("parts"))
    held = index.vectors.join(grid, "cell").withColumn("part", dealt("vec_id", "parts")).withColumn("block", numbers("blocks"))
    keys = ["cell", "part", "block"]

    def best(asked: pa.Table, held: pa.Table) -> pa.Table:
        return _best(k, asked, held)

    found = asked.select(*keys, "query_id", "v").groupBy(*keys).cogroup(held.select(*keys, "vec_id", "v").groupBy(*keys)).applyInArrow(best, schema)
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "vec_id")  # at most k rows a part
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "similarity")


def embedding_topk(df: DataFrame, path: str, k: int = 10, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = 64) -> DataFrame:
    """The ``k`` nearest vectors of each vector whose id ``every`` divides, among all."""
    index = build_index(df, path, k, id_col, vec_col, dim)
    return search(index, index.vectors.filter(F.col("vec_id") % every == 0).select("vec_id", "v"), k)
