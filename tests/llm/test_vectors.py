"""Clustering and exact search against plain loops."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from statsift.llm import centroids, top_k

SCHEMA = "vec_id long, embedding array<float>, cluster string, uid string, score long"


def vectors(n: int, dims: int, seed: int = 0) -> list[tuple]:
    rng = np.random.default_rng(seed)
    scale = np.linspace(1.5, 0.05, dims)
    return [(i, [float(np.float32(x)) for x in rng.normal(size=dims) * scale * rng.choice([0.2, 1, 3])]) for i in range(n)]


def odd_vectors(dims: int) -> list[tuple]:
    rows = vectors(150, dims)
    rows += [(200 + i, list(rows[3][1])) for i in range(60)]  # one very common vector
    rows += [(7, list(rows[7][1])), (None, list(rows[9][1])), (300, None), (None, None), (301, []), (302, [None] * dims), (303, [math.nan] + [0.0] * (dims - 1))]
    rows += [(320, [math.inf] + [0.0] * (dims - 1)), (340, [0.0] * dims), (341, [0.5] * (dims - 1)), (342, [1.0] * (dims + 1))]
    return rows


def frame(spark, rows, parts=5):
    random.Random(1).shuffle(rows := list(rows))
    return spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], SCHEMA).repartition(parts)


def whole(v, scale):
    return [math.floor(scale * x) for x in v]


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def loop_clusters(rows, k, rounds, dims, scale, seed):
    kept = [(i, whole(v, scale)) for i, v in rows if good(v) and len(v) == dims]
    key = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes().hex())
    centres = [v for _, v in sorted(kept, key=key)[:k]]

    def nearest(v):
        return min(((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres)))

    for _ in range(rounds):
        home = [nearest(v)[1] for _, v in kept]
        for j in range(len(centres)):
            mine = [v for (_, v), h in zip(kept, home) if h == j]
            if mine:
                centres[j] = [sum(col) // len(mine) for col in zip(*mine)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    total = sum(d for _, _, d in found)
    return [(i, j, d, sum(x for _, h, x in found if h == j), total, hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for i, j, d in found]


@pytest.mark.parametrize("dims,k,rounds", [(16, 8, 10), (64, 5, 3), (3, 4, 2), (16, 400, 1)])
def test_clusters(spark, dims, k, rounds):
    rows = odd_vectors(dims)
    got = centroids.cluster(frame(spark, rows), k=k, rounds=rounds, dims=dims).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(loop_clusters(rows, k, rounds, dims, 1024, 3), key=repr)


def test_ties_go_to_the_smaller_number_and_centroids_are_abandoned():
    rows = np.array([[0, 0, 0], [10, 0, 0], [5, 0, 0], [5, 1, 1]], np.int64)
    cluster, distance, _ = centroids.nearest(rows, np.array([[0, 0, 0], [10, 0, 0]], np.int64), steps=(1, 2))
    assert (cluster.tolist(), distance.tolist()) == ([0, 1, 0, 0], [0, 0, 25, 27])
    far = np.concatenate((np.zeros((50, 64), np.int64), np.full((50, 64), 100)))
    _, _, compared = centroids.nearest(far, np.array([[0] * 64, [100] * 64], np.int64))
    assert compared == 100 * 64 + 50 * 8 + 50 * 64  # half of the rows leave the second centroid after one step


def test_no_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert centroids.cluster(none).collect() == []
    assert top_k.search(none, F.col("vec_id") % 20 == 0).collect() == []
    only_odd = frame(spark, [(0, None), (20, [None])])
    assert centroids.cluster(only_odd, dims=1).collect() == []
    assert top_k.search(only_odd, F.col("vec_id") % 20 == 0).collect() == []


def test_components_beyond_the_bound_are_an_error(spark):
    with pytest.raises(Exception, match="a component is beyond"):
        centroids.cluster(frame(spark, [(1, [1e30])]), dims=1)


def loop_search(rows, k, scale, every):
    kept = [(n, i, whole(v, scale)) for n, (i, v) in enumerate(rows) if good(v)]
    out = []
    for n, i, q in kept:
        if i is not None and i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j is None, j or 0) for m, j, v in kept if m != n)[:k]
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(best)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block,queries", [(4096, 1024), (16, 4), (64, 1000)])
@pytest.mark.parametrize("dims,k", [(40, 20), (6, 300)])
def test_search(spark, dims, k, block, queries):
    rows = odd_vectors(dims)
    got = top_k.search(frame(spark, rows), F.col("vec_id") % 7 == 0, k=k, scale=64, block_rows=block, query_rows=queries)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=repr) == loop_search(rows, k, 64, 7)


def test_search_by_stripes_and_bands(spark, monkeypatch):
    monkeypatch.setattr(top_k, "STRIPE", 2)
    monkeypatch.setattr(top_k, "BANDS", 3)
    rows = vectors(400, 24, 5)
    got = top_k.search(frame(spark, rows), F.col("vec_id") % 3 == 0, k=5, scale=64, block_rows=30, query_rows=10)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=repr) == loop_search(rows, 5, 64, 3)


def test_no_blocks_are_sent_to_the_driver(spark, monkeypatch):
    """Query blocks times their bands are not broadcast, however small their file is, and the parts that the driver samples for are bounded."""
    monkeypatch.setattr(top_k, "BANDS", 3)
    parts = []
    packed = top_k.packed_blocks
    monkeypatch.setattr(top_k, "packed_blocks", lambda *a: (lambda out: (parts.append(out.rdd.getNumPartitions()), out)[1])(packed(*a)))
    out = top_k.search(frame(spark, vectors(400, 24, 5)), F.col("vec_id") % 3 == 0, k=5, scale=64, block_rows=30, query_rows=10)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and max(parts) <= 3


def test_bounds_drop_pairs_and_lose_none():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(3000, 64)) * np.linspace(60, 1, 64) * rng.exponential(size=(3000, 1))).astype(np.int64)
    x = x[np.argsort(-(x**2).sum(1), kind="stable")]
    basis = np.linalg.eigh(x.T @ x.astype(float))[1][:, ::-1]
    all_of = top_k.block(np.arange(3000), np.arange(3000), x, basis)
    q = top_k.block(np.arange(0, 3000, 100), np.arange(0, 3000, 100), x[::100], basis)
    (qi, score, xi), floor, scored = top_k.best_of(q, all_of, 10, np.full(30, top_k.LOWEST), step=200)
    assert scored < 30 * 3000 / 4
    exact = x[::100] @ x.T
    for i in range(30):
        exact[i, i * 100] = -(2**62)
        want = sorted(zip(-exact[i], range(3000)))[:10]
        assert sorted((-s, j) for s, j in zip(score[qi == i], xi[qi == i])) == want
        assert floor[i] == -want[-1][0]


def test_scores_beyond_doubles():
    q = np.array([[2**27, 2**27 - 1]], np.int64)
    assert top_k.exact_scores(q, q).tolist() == [[2**54 + (2**27 - 1) ** 2]]
