"""Centroid clustering against plain Python, and the threshold algorithm against all distances."""

import hashlib
import math
import random

import numpy as np
import pytest

from ledgerloom.llm import centroids

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, cluster string, distance string, v string"


def plain(rows, k=8, rounds=10):
    kept = []
    for r in rows:
        x = r[1]
        if x is not None and len(x) == 64 and all(c is not None and math.isfinite(c) for c in x):
            kept.append((r[0], [math.floor(1024 * float(np.float32(c))) for c in x]))
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cs = [list(v) for _, v in start[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(cs))

    for _ in range(rounds if cs else 0):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for i, vs in groups.items():
            cs[i] = [sum(col) // len(vs) for col in zip(*vs)]
    out = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    inertia = [sum(d for _, c, d in out if c == i) for i in range(k)]
    return [(i, c, d, inertia[c], sum(inertia), hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest()) for i, c, d in out]


def compare(spark, rows):
    got = centroids.digest(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    order = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got.collect()), key=order) == sorted(plain(rows), key=order)


def row(ident, x):
    return ident, x, 1, "clash", "clash", "clash", "clash"


def test_against_plain(spark):
    rng = random.Random(2)
    middle = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(5)]
    rows = [row(i, [c + rng.gauss(0, 0.2) for c in rng.choice(middle)]) for i in range(300)]
    bad = [None, [], [1.0] * 63, [1.0] * 65, [None] + [0.0] * 63, [float("nan")] + [0.0] * 63, [float("inf")] * 64]
    rows += [row(1000 + i, x) for i, x in enumerate(bad)]
    rows += [row(None, [0.5] * 64), row(7, rows[9][1]), row(7, [0.25] * 64)] + [rows[3]] * 5
    compare(spark, rows)


@pytest.mark.parametrize("n", [0, 1, 3, 8])
def test_few_vectors(spark, n):
    compare(spark, [row(i, [float(i)] * 64) for i in range(n)])


def test_all_equal_and_ties(spark):
    """Equal vectors go to centroid 0; the other seven stay empty and where they are."""
    compare(spark, [row(i, [0.125] * 64) for i in range(40)])
    compare(spark, [row(i, [float(i % 2)] + [0.0] * 63) for i in range(40)])


def test_large_components(spark):
    """Beyond the range where 64-bit squares are safe, Python's integers give the exact distances."""
    rng = random.Random(5)
    compare(spark, [row(i, [rng.choice([-1.0, 1.0]) * rng.uniform(1e5, 2e5)] + [rng.uniform(0, 1) for _ in range(63)]) for i in range(30)])
    with pytest.raises(Exception):
        centroids.digest(spark.createDataFrame([row(1, [3e38] * 64)], SCHEMA)).collect()


@pytest.mark.parametrize("k, dims, spread", [(8, 64, 50), (40, 3, 50), (40, 1, 8), (1, 5, 9), (25, 2, 3)])
def test_threshold_algorithm(k, dims, spread):
    """Same nearest centroid as all distances give, ties to the smaller number, and the walk stops early where few dimensions lead."""
    rng = np.random.default_rng(k + dims)
    c, v = rng.integers(-spread, spread, (k, dims)), rng.integers(-spread, spread, (500, dims))
    cluster, best, depth = centroids.nearest(v, c)
    every = ((v[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (cluster == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    assert depth.max() <= k
    if dims <= 3 and k == 40 and spread == 50:
        assert depth.mean() < k / 2
    o = centroids.nearest(v.astype(object), c.astype(object))
    assert (o[0] == cluster).all() and (o[1] == best).all()
