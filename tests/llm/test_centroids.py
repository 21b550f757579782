"""Centroid clustering against plain integer k-means and an exhaustive nearest search."""

import hashlib
import math
import random

import numpy as np
import pytest

from proxima.llm import centroids as C


def slow(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(v)) for v in e]) for i, e in rows
            if e is not None and len(e) == 64 and all(v is not None and math.isfinite(v) for v in e)]
    text = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    cents = [x for _, x in sorted((text(i), x) for i, x in kept)[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in kept]
        for j in range(len(cents)):
            mine = [x for (_, x), o in zip(kept, own) if o == j]
            if mine:
                cents[j] = [sum(v) // len(mine) for v in zip(*mine)]
    got = [(i, *near(x)) for i, x in kept]
    inertia = [sum(d for _, d, o in got if o == j) for j in range(len(cents))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((-1 if i is None else i), o, d, inertia[o], sum(inertia), sha[o]) for i, d, o in got)


def seen(df):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame([(i, e, 7, "x") for i, e in rows], "vec_id long, embedding array<double>, cluster int, distance string")


def test_equals_plain_kmeans(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.gauss(0, 1) + (i % 5) for _ in range(64)]) for i in range(300)]
    rows += [(7, rows[7][1]), (None, [0.1] * 64), (None, [0.2] * 64), (900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [None] + [1.0] * 63),
             (905, [float("nan")] + [1.0] * 63), (906, [float("inf")] + [1.0] * 63), (907, [-0.0] * 64), (908, [0.0] * 64)]
    assert seen(C.cluster(table(spark, rows))) == slow(rows)


def test_ties_repeats_and_few_vectors(spark):
    same = [(i, [0.5] * 64) for i in range(40)]
    assert seen(C.cluster(table(spark, same))) == slow(same)
    two = [(1, [0.0] * 64), (2, [1.0] + [0.0] * 63)]
    assert seen(C.cluster(table(spark, two))) == slow(two)
    grid = [(i, [float(i % 3)] * 32 + [float(i % 2)] * 32) for i in range(60)]
    assert seen(C.cluster(table(spark, grid))) == slow(grid)


def test_large_components_stay_exact(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.choice((-1, 1)) * 2.0 ** 18.5] + [rnd.random() for _ in range(63)]) for i in range(50)]
    assert seen(C.cluster(table(spark, rows))) == slow(rows)
    (one,) = C.cluster(table(spark, [(1, [2.0 ** 21] * 64)])).take(1) or [None]
    assert one is None  # an integer of 2^31 is out of range


def test_empty(spark):
    out = C.cluster(table(spark, []))
    assert out.collect() == [] and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("k", [1, 2, 9, 60])
def test_the_search_is_exact_and_measures_few(k):
    rng = np.random.default_rng(k)
    cents = rng.integers(-40, 40, (k, 3)) * (1 + 50 * (np.arange(k)[:, None] % 4))
    cents[-1] = cents[0]
    x = rng.integers(-60, 60, (3000, 3))
    at, d, measured = C.Lists.of(cents.astype(np.int64)).nearest(x.astype(np.int64))
    full = ((x[:, None, :] - cents[None]) ** 2).sum(axis=2)
    assert (at == full.argmin(axis=1)).all() and (d == full.min(axis=1)).all()
    if k == 60:
        assert measured.mean() < 0.8 * k
