"""Centroid clustering with Ptolemaic pivots (operator 13).

Lloyd rounds over integer vectors: each vector joins its nearest centroid, and each
centroid moves to the componentwise floor of its vectors' mean. All arithmetic that
decides a result is exact (64-bit integers), so results depend on neither the order
of rows nor the number of tasks.

Nearest centroids are found with Ptolemy's inequality. For pivots ``p`` and ``s``,
a vector ``v`` and a centroid ``c``,

    d(v, c) * d(p, s) >= |d(v, p) * d(c, s) - d(v, s) * d(c, p)|

so cached distances to a few pivots give a lower bound of every distance to a
centroid. The pivots and their pairs are fixed for a run; the vectors' pivot
distances are computed once and stored beside the vectors. A vector is compared
exactly with the centroid of the smallest bound, and then with those centroids alone
whose bound does not exceed that distance. Bounds are floating-point numbers, rounded
down by more than their error, so no nearest centroid is missed, ties included.

Centroids and pivots are a fixed number of vectors, independent of the table; they
travel with the tasks. A task returns one sum and count a centroid, so a round
shuffles at most tasks x centroids rows, and a cluster that holds most vectors is
summed where they lie.

Defined results: vectors of another length, or with a null, NaN or infinite component,
are left out. Repeated rows are vectors of their own. A null id clusters, but never
seeds. Seeds of equal hash are in the order of their components. With fewer vectors
than centroids there are as many centroids as vectors with an id. An empty table, or
one without ids, gives no rows. Components of 2**27 or more in size would overflow
the exact arithmetic; the job stops with an error then.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navframe.llm import common

N_CENTROIDS, ROUNDS, DIM, SCALE = 40, 5, 64, 256
#: pivots; all pairs of them give bounds
N_PIVOTS = 6
#: a lower bound is a difference of products of roots, each within a few units in
#: the last place; this margin, relative to the products, exceeds their error
MARGIN = 1e-12
#: size of a component below which squares and their sums fit 64 bits
LIMIT = 1 << 27
#: rows compared at once
ROWS = 4096


# -- vectors ---------------------------------------------------------------------------


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, dim: int, scale: int) -> DataFrame:
    """``vec_id`` and ``v`` (array of bigint): floor(scale * component) of the
    vectors with ``dim`` finite components."""
    v = F.col(f"`{vec_col}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    small = F.forall("v", lambda x: F.abs(x) < LIMIT)
    kept = df.filter(v.isNotNull() & (F.size(v) == dim) & finite).select(F.col(f"`{id_col}`").alias("vec_id"), whole.alias("v"))
    stop = F.raise_error(F.lit(f"a component is not below {LIMIT} after scaling"))
    return kept.withColumn("v", F.when(small, F.col("v")).otherwise(stop.cast("array<bigint>")))


def seed_order(vec_id: Column) -> Column:
    return F.sha2(F.concat(F.lit("2:"), vec_id.cast("string")), 256)


def first_centroids(vectors: DataFrame, k: int) -> np.ndarray:
    rows = vectors.filter("vec_id is not null").orderBy(seed_order(F.col("vec_id")), "v").limit(k).select("v").collect()
    return np.array([r.v for r in rows], dtype=np.int64).reshape(len(rows), -1 if rows else 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``a`` to those of ``b``."""
    out = np.empty((len(a), len(b)), dtype=np.int64)
    for j, row in enumerate(b):
        d = a - row
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


# -- pivots ----------------------------------------------------------------------------


class Pivots:
    """Fixed pivots, far from each other, and their pairs."""

    def __init__(self, points: np.ndarray, n: int = N_PIVOTS):
        chosen = [0]
        far = squared(points, points[:1])[:, 0]
        while len(chosen) < n and far.max(initial=0) > 0:
            chosen.append(int(far.argmax()))  # the smallest number among the farthest
            far = np.minimum(far, squared(points, points[chosen[-1:]])[:, 0])
        self.points = points[chosen]
        self.pairs = [(p, s) for p, s in itertools.combinations(range(len(chosen)), 2)]
        self.between = np.sqrt(squared(self.points, self.points).astype(np.float64))

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        return np.sqrt(squared(vectors, self.points).astype(np.float64))

    def bounds(self, vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """Lower bounds of the squared distances, from both sides' pivot distances."""
        best = np.zeros((len(vectors), len(centroids)))
        for p, s in self.pairs:
            one = vectors[:, p, None] * centroids[None, :, s]
            two = vectors[:, s, None] * centroids[None, :, p]
            low = (np.abs(one - two) - MARGIN * (one + two)) / self.between[p, s]
            np.maximum(best, low, out=best)
        return best * best * (1 - MARGIN)


def nearest(vectors: np.ndarray, cached: np.ndarray, pivots: Pivots, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (the smallest number among equals), its squared distance,
    and how many distances were computed."""
    low = pivots.bounds(cached, pivots.distances(centroids))
    rows = np.arange(len(vectors))
    guess = low.argmin(axis=1)
    d = vectors - centroids[guess]
    best, dist = guess.astype(np.int64), np.einsum("ij,ij->i", d, d)
    limit = dist.astype(np.float64) * (1 + MARGIN)
    survivors = low <= limit[:, None]
    survivors[rows, guess] = False
    for c in range(len(centroids)):
        at = np.flatnonzero(survivors[:, c])
        d = vectors[at] - centroids[c]
        exact = np.einsum("ij,ij->i", d, d)
        closer = (exact < dist[at]) | ((exact == dist[at]) & (c < best[at]))
        best[at[closer]], dist[at[closer]] = c, exact[closer]
    return best, dist, len(vectors) + int(np.count_nonzero(survivors))


# -- rounds ----------------------------------------------------------------------------


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for begin in range(0, len(batch), ROWS):
        yield batch.slice(begin, ROWS)


def _cache(vectors: DataFrame, pivots: Pivots) -> DataFrame:
    """The vectors with their pivot distances."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def make():
        def run(batch: pa.RecordBatch):
            for piece in _pieces(batch):
                made = pivots.distances(_matrix(piece.column(1)))
                yield {"vec_id": piece.column(0), "v": piece.column(1), "near": common.list_array(list(made), pa.float64())}

        return run

    return common.map_rows(vectors, ["vec_id", "v"], f"vec_id {kind}, v array<bigint>, near array<double>", make)


def _sums(cached: DataFrame, pivots: Pivots, centroids: np.ndarray) -> DataFrame:
    """``cluster``, ``n`` and ``sums`` (exact, a component each): one row of each a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(centroids), dtype=np.int64)
        sums = np.zeros_like(centroids)
        for batch in batches:
            for piece in _pieces(batch):
                vectors = _matrix(piece.column(0))
                best, _, _ = nearest(vectors, _floats(piece.column(1)), pivots, centroids)
                n += np.bincount(best, minlength=len(n))
                order = np.argsort(best, kind="stable")
                first = np.flatnonzero(np.diff(best[order], prepend=-1))
                sums[best[order[first]]] += np.add.reduceat(vectors[order], first, axis=0)
        held = np.flatnonzero(n)
        if len(held):
            yield pa.RecordBatch.from_arrays(
                [pa.array(held.astype(np.int32)), pa.array(n[held]), common.list_array(list(sums[held]), pa.int64())], names=["cluster", "n", "sums"]
            )

    common.on_workers(cached.sparkSession)
    parts = cached.select("v", "near").mapInArrow(run, "cluster int, n bigint, sums array<bigint>")
    exact = "decimal(38,0)"
    total = [F.sum(F.col("sums")[i].cast(exact)).alias(f"s{i}") for i in range(centroids.shape[1])]
    return parts.groupBy("cluster").agg(F.sum(F.col("n").cast(exact)).alias("n"), *total)


def _floats(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _assigned(cached: DataFrame, pivots: Pivots, centroids: np.ndarray) -> DataFrame:
    kind = cached.schema["vec_id"].dataType.simpleString()

    def make():
        def run(batch: pa.RecordBatch):
            for piece in _pieces(batch):
                best, dist, n = nearest(_matrix(piece.column(1)), _floats(piece.column(2)), pivots, centroids)
                yield {"vec_id": piece.column(0), "cluster": best, "distance": dist}

        return run

    return common.map_rows(cached, ["vec_id", "v", "near"], f"vec_id {kind}, cluster int, distance bigint", make)


def cluster(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = N_CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """``vec_id``, ``cluster`` and ``distance`` (squared) of every kept vector, and
    the final centroids (at most ``k`` integer vectors)."""
    vectors = integer_vectors(df, id_col, vec_col, dim, scale)
    centroids = first_centroids(vectors, k)
    if not len(centroids):
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance bigint"), centroids
    pivots = Pivots(centroids)
    cached = common.store(_cache(vectors, pivots), "centroid_vectors")
    for _ in range(rounds):
        moved = centroids.copy()
        for row in _sums(cached, pivots, centroids).collect():  # a row a centroid
            moved[row.cluster] = [int(row[f"s{i}"]) // int(row.n) for i in range(dim)]
        centroids = moved
    return common.store(_assigned(cached, pivots, centroids), "centroid_clusters"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The assignments with ``cluster_inertia``, ``inertia`` (sums of ``distance``)
    and ``centroid_sha256`` (of the centroid's components, joined by commas)."""
    spark = assigned.sparkSession
    by_cluster = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = by_cluster.agg(F.sum("cluster_inertia").alias("inertia"))
    names = [(c, ",".join(map(str, row.tolist()))) for c, row in enumerate(centroids)]
    named = spark.createDataFrame(names, "cluster int, parts string").select("cluster", F.sha2("parts", 256).alias("centroid_sha256"))
    # a row a centroid: as many as the parameter says
    facts = F.broadcast(by_cluster.join(F.broadcast(named), "cluster").withColumn("inertia", F.lit((total.first() or [None])[0]).cast("bigint")))
    return assigned.join(facts, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
