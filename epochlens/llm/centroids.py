"""Centroid clustering of vectors by whole-number arithmetic, with distances kept up to date instead of computed anew.

Every vector carries its exact dot product with every centroid. When centroids move, only the components that changed
are multiplied: the dot product with centroid c grows by the sum of x[i] * (new[c][i] - old[c][i]) over those i. The
squared distance is |x|^2 - 2 x.c + |c|^2, all in whole numbers, and the nearest centroid is read off it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, functions as F

from epochlens.llm.common import lists, map_batches
from epochlens.session import cut

CLUSTERS, ROUNDS, SEED = 16, 3, 1
DIMENSIONS, SCALE = 64, 64
#: Whole-number components must be smaller than this in size, so that squared distances fit in a long.
LARGEST = 1 << 27


def whole(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): floor(scale * component) of the vectors with exactly `dimensions` components, none of them null,
    non-finite or as large as `LARGEST` after scaling; other rows are left out."""
    x = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.floor(v * F.lit(float(scale))))
    fits = F.forall(F.col("embedding").cast("array<double>"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) * F.lit(float(scale)) < F.lit(float(LARGEST - 1))))
    kept = vectors.select("vec_id", "embedding").where((F.size("embedding") == dimensions) & F.coalesce(fits, F.lit(False)))
    return kept.select("vec_id", x.cast("array<int>").alias("x"))


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors with the smallest SHA-256 of `seed:vec_id`, in that order, as rows; fewer where there are fewer.

    Rows with the same id follow by their components, rows without an id come last.
    """
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = vectors.select("x", key.alias("key")).orderBy(F.col("key").asc_nulls_last(), "x").limit(clusters).collect()
    return np.array([r["x"] for r in chosen], np.int64)


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """A list column with lists of one length as a matrix."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)


def _assigned(dots: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the first of equals, and its squared distance."""
    distances = norms[:, None] - 2 * dots + (centroids * centroids).sum(axis=1)[None, :]
    nearest = distances.argmin(axis=1)
    return nearest.astype(np.int32), distances[np.arange(len(nearest)), nearest]


def _pass(vectors: DataFrame, start: Callable[[pa.RecordBatch, np.ndarray], np.ndarray], centroids: np.ndarray) -> DataFrame:
    """(vec_id, x, dots, cluster, distance) where `start` gives the dot products of a batch with `centroids`."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = _matrix(batch, "x")
            dots = start(batch, x)
            cluster, distance = _assigned(dots, (x * x).sum(axis=1), centroids)
            flat = lists(pa.array(dots.ravel()), np.full(len(dots), dots.shape[1]))
            return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), flat, pa.array(cluster), pa.array(distance)], ["vec_id", "x", "dots", "cluster", "distance"])

        return each

    return map_batches(vectors, make, f"vec_id {kind}, x array<int>, dots array<bigint>, cluster int, distance bigint")


def measured(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """All dot products, for the first assignment."""
    return _pass(vectors, lambda _, x: x @ centroids.T, centroids)


def moved(vectors: DataFrame, old: np.ndarray, new: np.ndarray) -> DataFrame:
    """Dot products kept from `old` to `new` by the components of the centroids that changed."""
    change = new - old
    parts = [(c, np.flatnonzero(change[c])) for c in range(len(change)) if change[c].any()]

    def start(batch: pa.RecordBatch, x: np.ndarray) -> np.ndarray:
        dots = _matrix(batch, "dots").copy()
        for c, where in parts:
            dots[:, c] += x[:, where] @ change[c, where]
        return dots

    return _pass(vectors, start, new)


def updated(assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count) of each cluster's vectors; an empty cluster keeps its centroid.

    Sums are combined before the shuffle, and one row for each cluster comes to the driver.
    """
    dims = centroids.shape[1]
    sums = [F.sum(F.col("x")[i].cast("bigint")).alias(f"s{i}") for i in range(dims)]
    new = centroids.copy()
    for r in assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        new[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
    return new


def clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each kept vector.

    Every round assigns each vector to the nearest centroid and moves the centroids; at the end vectors are assigned
    once more. Vectors that are null, have another length, or hold a null or non-finite component are left out;
    repeated rows and ids count as often as they stand there, ties go to the smaller number, an empty table gives no
    rows, and further columns are ignored. Centroids (k rows) are all that passes the driver.
    """
    kept = cut(whole(vectors))
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        return kept.where(F.lit(False)).select(
            "vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("bigint").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256")
        )
    assigned = cut(measured(kept, centroids))
    for _ in range(rounds):
        new = updated(assigned, centroids)
        assigned, centroids = cut(moved(assigned, centroids, new)), new
    return with_totals(assigned, centroids)


def with_totals(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add the inertia of the cluster and of all, and the hash of the cluster's centroid."""
    within = {r["cluster"]: r["d"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    hashes = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    rows = [Row(cluster=c, cluster_inertia=within.get(c, 0), inertia=sum(within.values()), centroid_sha256=h) for c, h in enumerate(hashes)]
    totals = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
