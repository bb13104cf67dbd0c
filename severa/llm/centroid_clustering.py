"""Centroid clustering with an incremental distance matrix.

Every vector keeps its exact integer dot products with all centroids in a staged table. When centroids move, only their
components that changed are multiplied, and added to the stored products; the squared distance is the vector's own square
less twice the product plus the centroid's square, so the nearest centroid is an argmin over a row of the table. A task sums
the vectors of each cluster, a shuffle adds these sums up, and centroids times components numbers reach the driver a round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from severa.staging import drop_staged, stage

from .common import small_batches
from .vectors import grid, lists, products, scaled, usable

_STATE = "vec_id {0}, v array<int>, dots array<long>, cluster int, distance long"


def _updated(old: np.ndarray, new: np.ndarray):
    """Rows (vec_id, v, dots with the old centroids) -> dots with the new ones, the nearest of them and its distance."""
    change, squares = new - old, (new * new).sum(1)
    moved = [(c, np.flatnonzero(change[c])) for c in range(len(new)) if change[c].any()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            v = grid(batch.column(1), new.shape[1]).astype(np.int64)
            dots = batch.column(2).flatten().to_numpy().reshape(len(v), len(new)).copy()
            for c, at in moved:
                dots[:, c] += products(v[:, at], change[c : c + 1, at])[:, 0]
            far = squares - 2 * dots
            nearest = far.argmin(1)  # the first of equals
            distance = far[np.arange(len(v)), nearest] + (v * v).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(v, pa.int32()), lists(dots, pa.int64()), pa.array(nearest, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "v", "dots", "cluster", "distance"])

    return run


def _sums(k: int, width: int):
    """Rows (v, cluster) -> vectors and sums of components by cluster, for the rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            v, cluster = grid(batch.column(0), width).astype(np.int64), batch.column(1).to_numpy()
            np.add.at(total, cluster, v)
            n += np.bincount(cluster, minlength=k)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some], pa.int64()), lists(total[some], pa.int64())], names=["cluster", "n", "total"])

    return run


def _integers(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(scaled(grid(batch.column(1), width)), pa.int32())], names=["vec_id", "v"])

    return run


def _moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after a round: the floor of the mean of their vectors; empty ones stay."""
    k, width = centroids.shape
    sums = state.select("v", "cluster").mapInArrow(_sums(k, width), "cluster int, n long, total array<long>")
    added = [F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(width)]
    out = centroids.copy()
    for row in sums.groupBy("cluster").agg(F.sum("n").alias("n"), *added).collect():
        out[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(width)]
    return out


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, seed: int = 2) -> DataFrame:
    """vectors (vec_id, embedding, any others) -> vec_id, cluster, distance (squared, to its centroid), cluster_inertia and
    inertia (distances summed over its cluster and over all) and centroid_sha256 (of its centroid's components).

    Vectors with exactly `width` components, none null or non-finite, are kept, and their components become floor(256 * x).
    Centroids start as the k vectors with the smallest sha256 of "<seed>:<vec_id>"; of equal hashes the smaller vector
    comes first, and a row without a vec_id, though clustered, comes after all with one. With fewer than k vectors there are
    as many centroids. Ties go to the smaller number; empty centroids stay where they are. Rows that repeat are vectors
    each. An empty table gives no rows; other columns are not read. Components beyond 65,536 are an error."""
    spark = vectors.sparkSession
    small_batches(spark)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    kept = vectors.where(usable(F.col("embedding")) & (F.size("embedding") == width)).select("vec_id", "embedding")
    rows = kept.mapInArrow(_integers(width), f"vec_id {kind}, v array<int>")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(order.asc_nulls_last(), "v").limit(k).select("v").toArrow()
    if not len(first):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = grid(first.column("v"), width).astype(np.int64)
    none = F.array_repeat(F.lit(0).cast("long"), len(centroids))
    before, old = rows.select("vec_id", "v", none.alias("dots")), np.zeros_like(centroids)
    for i in range(rounds + 1):
        state = stage(before.select("vec_id", "v", "dots").mapInArrow(_updated(old, centroids), _STATE.format(kind)), "clusters")
        if i:
            drop_staged(before)
        before = state
        if i < rounds:
            old, centroids = centroids, _moved(state, centroids)
    ends = state.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()
    total, names = sum(r["d"] for r in ends), [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    told = spark.createDataFrame([(r["cluster"], r["d"], total, names[r["cluster"]]) for r in ends], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # At most k rows.
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
