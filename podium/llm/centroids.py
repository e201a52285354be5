"""Centroid clustering of integer vectors, with distances to fixed pivots that spare most distances to centroids.

The pivots never move, so the distance of every vector to each of them is computed once and stored
beside the vector. In a round, the triangle inequality turns these and the centroids' own distances
to the pivots into lower bounds: a centroid whose bound is above the distance to the best one so far
is left out, the others get their exact distance in whole numbers. Vectors stay in the tasks
that read them; what a round moves is one row of sums per task and cluster.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.session import materialize, ship_package


@dataclass(frozen=True)
class ClusterConfig:
    clusters: int = 40
    rounds: int = 5
    width: int = 64
    scale: int = 256
    seed: int = 2
    pivots: int = 12


#: Components of this size or more have squares whose sum may not fit a long.
LIMIT = 2**26
#: Vectors that are compared at a time.
_BLOCK = 4096
#: Share of two lengths by which rounding may raise a bound.
_SLACK = 1e-9


def integer_vectors(rows: DataFrame, config: ClusterConfig, id_column: str, vector_column: str) -> DataFrame:
    """vec_id and whole numbers of the vectors that have the right number of finite components."""
    x = F.col(vector_column)
    finite = F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < LIMIT / config.scale))  # NaN is above any number
    kept = rows.where((F.size(x) == config.width) & finite)
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * config.scale).cast("int"))
    return kept.select(F.col(id_column).cast("long").alias("vec_id"), whole.alias("vector"))


def first_centroids(vectors: DataFrame, config: ClusterConfig) -> np.ndarray:
    """The vectors with the smallest hashes of their ids, in this order; of one id, by their components."""
    name = F.concat(F.lit(f"{config.seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    first = vectors.orderBy(F.sha2(name.cast("binary"), 256), "vector").limit(config.clusters).collect()
    return np.array([r["vector"] for r in first], np.int64).reshape(len(first), config.width)


def spread_pivots(centroids: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the centroids, each one as far as possible from those taken before it."""
    taken = [0]
    near = squared(centroids, centroids[0])
    while len(taken) < min(n, len(centroids)):
        taken.append(int(near.argmax()))
        near = np.minimum(near, squared(centroids, centroids[taken[-1]]))
    return centroids[taken]


def squared(vectors: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole numbers."""
    apart = vectors - point
    return np.einsum("ij,ij->i", apart, apart)


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def with_pivots(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The vectors and their exact squared distances to the pivots."""

    def measure(batches):
        for batch in batches:
            found = _matrix(batch.column("vector"), np.int64) if batch.num_rows else np.zeros((0, pivots.shape[1]), np.int64)
            far = np.stack([squared(found, p) for p in pivots], axis=1)
            lists = pa.ListArray.from_arrays(np.arange(len(far) + 1, dtype=np.int32) * len(pivots), pa.array(far.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["vec_id", "vector", "far"])

    return vectors.mapInArrow(measure, "vec_id long, vector array<int>, far array<long>")


def nearest(vectors: np.ndarray, far: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of the nearest centroid, the smaller number if equal; and how many distances that took."""
    to_pivots = np.sqrt(far.astype(np.float64))
    between = np.sqrt(np.stack([squared(centroids, p) for p in pivots], axis=1).astype(np.float64))
    bound = np.zeros((len(vectors), len(centroids)))
    for p in range(len(pivots)):
        apart = np.abs(to_pivots[:, p, None] - between[None, :, p])
        apart -= _SLACK * (to_pivots[:, p, None] + between[None, :, p])
        np.maximum(bound, apart, out=bound)
    bound *= bound
    # the most promising centroid gives each vector a first distance, with which the others are compared
    number = bound.argmin(axis=1)
    apart = vectors - centroids[number]
    best = np.einsum("ij,ij->i", apart, apart)
    spent = len(vectors)
    tried = number.copy()
    for c in range(len(centroids)):
        rows = np.flatnonzero((bound[:, c] <= best) & (tried != c))
        spent += len(rows)
        found = squared(vectors[rows], centroids[c])
        better = (found < best[rows]) | ((found == best[rows]) & (c < number[rows]))
        best[rows[better]], number[rows[better]] = found[better], c
    return number, best, spent


def _assigned(batches, centroids: np.ndarray, pivots: np.ndarray):
    for batch in batches:
        for begin in range(0, batch.num_rows, _BLOCK):
            rows = batch.slice(begin, _BLOCK)
            vectors = _matrix(rows.column("vector"), np.int64)
            number, best, _ = nearest(vectors, _matrix(rows.column("far"), np.int64), centroids, pivots)
            yield rows.column("vec_id"), vectors, number, best


def cluster_sums(stored: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Per cluster that has vectors, their number and the sum of each component."""
    k, width = centroids.shape

    def add(batches):
        count, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for _, vectors, number, _ in _assigned(batches, centroids, pivots):
            count += np.bincount(number, minlength=k)
            order = np.argsort(number, kind="stable")
            present, at = np.unique(number[order], return_index=True)
            sums[present] += np.add.reduceat(vectors[order], at, axis=0)
        full = np.flatnonzero(count)
        columns = [pa.array(full.astype(np.int32)), pa.array(count[full]), *(pa.array(sums[full, d]) for d in range(width))]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["cluster", "n", *(f"s{d}" for d in range(width))]
    parts = stored.mapInArrow(add, "cluster int, " + ", ".join(f"{name} long" for name in names[1:]))
    rows = parts.groupBy("cluster").agg(*(F.sum(name).alias(name) for name in names[1:])).collect()
    return {r["cluster"]: (r["n"], [r[name] for name in names[2:]]) for r in rows}


def cluster(
    rows: DataFrame, config: ClusterConfig = ClusterConfig(), id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """One row per vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, have another number of components or hold a null, NaN, infinite or too large number (``LIMIT`` after
    scaling, whose square may not fit) are not kept and have no row. Repeated rows count as often as they
    occur; a null id is one like any other. With fewer vectors than clusters each one is a centroid at first. An empty
    cluster keeps its centroid. A table without vectors gives no rows. Other columns are ignored. All rounds run when this is called.
    """
    spark = rows.sparkSession
    ship_package(spark)
    vectors = integer_vectors(rows, config, id_column, vector_column)
    centroids = first_centroids(vectors, config)
    if not len(centroids):
        shape = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], shape)
    pivots = spread_pivots(centroids, config.pivots)
    stored = materialize(with_pivots(vectors, pivots), "pivots")
    for _ in range(config.rounds):
        centroids = centroids.copy()
        for number, (count, sums) in cluster_sums(stored, centroids, pivots).items():
            centroids[number] = [total // count for total in sums]

    def assign(batches):
        for ids, _, number, best in _assigned(batches, centroids, pivots):
            yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)), pa.array(best)], names=["vec_id", "cluster", "distance"])

    found = materialize(stored.mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned")
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()  # a row per cluster
    inertia = {r["cluster"]: r["inertia"] for r in sums}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of_cluster = F.array(*(F.lit(inertia.get(c, 0)).cast("long") for c in range(len(centroids))))
    return found.select(
        "vec_id", "cluster", "distance", of_cluster[F.col("cluster")].alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), F.array(*map(F.lit, digests))[F.col("cluster")].alias("centroid_sha256"),
    )
