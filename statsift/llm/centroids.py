"""Clustering around centroids, in whole numbers, with partial distances.

Components are whole numbers, so distances, sums and centroids are exact and do not
depend on how rows are dealt to tasks.  Each round is one pass: tasks assign their
vectors and add them up by cluster, Spark adds up the tasks' sums, and the driver
gets one sum a cluster and component.

A vector's squared distance is gathered over the dimensions of highest variance first.
A centroid is abandoned as soon as its part is above the best whole distance so far;
what survives is carried on over all dimensions.

Defined cases: vectors that are null, hold null or non-finite components, or have
another number of components take no part; a null id is hashed as an empty one; rows with
the same hash start in the order of their components; repeated rows count as often as
they occur; of fewer vectors than clusters each is a centroid; a component beyond
2**27 / scale is a ValueError; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statsift.llm import _common as c
from statsift.llm import _vectors as v

#: Dimensions after which a distance is held against the best so far; the last step takes all that are left.
STEPS = (8, 16, 32)


def nearest(rows: np.ndarray, centroids: np.ndarray, steps: tuple[int, ...] = STEPS) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row (of equal ones the first), its squared distance, and how many components were compared."""
    n, width = rows.shape
    cluster, best = np.zeros(n, np.int32), np.full(n, np.iinfo(np.int64).max)
    edges = [0, *(s for s in steps if s < width), width]
    compared = 0
    for k, centre in enumerate(centroids):
        alive, sums = np.arange(n), np.zeros(n, np.int64)
        for low, high in zip(edges, edges[1:]):
            off = rows[alive, low:high] - centre[low:high]
            compared += off.size
            sums = sums + np.einsum("ij,ij->i", off, off)
            stay = sums <= best[alive]
            alive, sums = alive[stay], sums[stay]
        closer = sums < best[alive]
        cluster[alive[closer]], best[alive[closer]] = k, sums[closer]
    return cluster, best, compared


def by_variance(rows: DataFrame, width: int) -> np.ndarray:
    """Dimensions in falling order of their variance over all rows."""

    def moments(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        x = v.matrix(batch.column("v"), width).astype(np.float64)
        return {0: np.array([float(len(x))]), 1: x.sum(0), 2: (x * x).sum(0)}

    n, total, squares = (got[1] for got in sorted(v.summed(rows, moments, "double").items()))
    return np.argsort(-(squares / n - (total / n) ** 2), kind="stable")  # no more than an order comes from it


def first_centroids(rows: DataFrame, k: int, seed: int, width: int) -> np.ndarray:
    """The vectors of the ``k`` smallest SHA-256 of ``seed:id``, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    chosen = rows.select(digest.alias("digest"), "v").orderBy("digest", F.hex("v")).limit(k).collect()
    return v.matrix(pa.array([bytes(r["v"]) for r in chosen], pa.binary()), width)


def next_centroids(rows: DataFrame, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Each centroid as the floor of the mean of its vectors; one without vectors stays."""
    width = centroids.shape[1]
    sorted_centroids = centroids[:, order]

    def sums(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        x = v.matrix(batch.column("v"), width)
        cluster, _, _ = nearest(x[:, order], sorted_centroids)
        return {int(k): np.concatenate((x[cluster == k].sum(0), [np.count_nonzero(cluster == k)])) for k in np.unique(cluster)}

    out = centroids.copy()
    for k, held in v.summed(rows, sums).items():
        out[k] = held[:-1] // held[-1]
    return out


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector that takes part.

    The rounds run when this is called."""
    spark = vectors.sparkSession
    rows = c.cut(v.whole_vectors(vectors, scale, dims, id_col, vec_col), "whole-vectors")
    centroids = first_centroids(rows, k, seed, dims)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    order = by_variance(rows, dims)
    for _ in range(rounds):
        centroids = next_centroids(rows, centroids, order)
    sorted_centroids = centroids[:, order]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found, distance, _ = nearest(v.matrix(batch.column("v"), dims)[:, order], sorted_centroids)
                yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "cluster": pa.array(found), "distance": pa.array(distance)})

    assigned = c.cut(rows.mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned")
    held = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row a cluster
    of = [(i, held.get(i, 0), sum(held.values()), hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest()) for i, x in enumerate(centroids)]
    table = spark.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    return assigned.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
