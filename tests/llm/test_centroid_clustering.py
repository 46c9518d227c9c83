import random
from fractions import Fraction
from hashlib import sha256
from math import floor, inf, nan

import numpy as np
import pytest

from larkspur.llm.centroid_clustering import EXACT, centroid_clusters, kept_vectors, nearest

D = 5


def brute(rows, k, rounds, dims=D):
    kept = [(i, [floor(Fraction(x) * 1024) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and abs(x) < inf for x in v)]
    rank = lambda r: (r[0] is None, sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(kept, key=rank)[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = [[] for _ in centroids]
        for _, v in kept:
            groups[near(v)[1]].append(v)
        centroids = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, centroids, strict=True)]
    got = [(i, *near(v)) for i, v in kept]
    sums = [sum(d for _, d, j in got if j == c) for c in range(len(centroids))]
    fit = lambda n: n if n < 2**63 else None
    names = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, j, fit(d), fit(sums[j]), fit(sum(sums)), names[j]) for i, d, j in got]


def check(spark, rows, k=3, rounds=4, kind="double"):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster string, v int").repartition(3)
    got, _ = centroid_clusters(df, k, rounds, D)
    assert got.columns[:6] == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(brute(rows, k, rounds), key=repr)


def test_against_brute_force(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.gauss(i % 4, 0.3) for _ in range(D)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(20)] + [(7, rows[7][1]), (None, rows[3][1]), (None, rows[9][1])]
    rows += [(400, None), (401, []), (402, [1.0] * 4), (403, [1.0] * 6), (404, [1.0, None, 1.0, 1.0, 1.0]), (405, [nan] * D), (406, [inf] + [0.0] * 4), (407, [-inf] + [0.0] * 4)]
    check(spark, rows)
    check(spark, rows, 8, 10)
    check(spark, rows, 1, 2)


def test_ties_and_equal_centroids(spark):
    """Grids have many equal distances; equal first centroids leave the later ones empty."""
    rows = [(i, [float(i % 3), float(i // 3 % 3), 0.0, 0.5, -1.5]) for i in range(90)]
    check(spark, rows, 6, 5)
    check(spark, [(i, [1.0] * D) for i in range(10)], 4, 3)


def test_few_or_no_vectors(spark):
    check(spark, [(1, [0.1] * D), (2, [0.2] * D)], 8, 3)
    check(spark, [])
    check(spark, [(1, [nan] * D)])


def test_large_numbers_are_exact(spark):
    rnd = random.Random(2)
    sizes = [1.0, 2.0**17, 2.0**17 + 1, 1e9, 1e30, 1.7e308, -1e12, -1.7e308, 5e-324]
    rows = [(i, [rnd.choice(sizes) * rnd.choice([1, -1, 0.5]) for _ in range(D)]) for i in range(60)]
    check(spark, rows, 4, 4)
    check(spark, [(i, [rnd.uniform(-9, 9) for _ in range(D)]) for i in range(50)] + [(99, [1e10] * D)], 3, 4)


def test_float_column(spark):
    rnd = random.Random(3)
    rows = [(i, [float(np.float32(rnd.random())) for _ in range(D)]) for i in range(100)]
    check(spark, rows, 5, 6, "float")


@pytest.mark.parametrize("size", [10, 1000, 1 << 20, EXACT])
def test_intervals_hold(size):
    """Close and equal distances at all sizes: the float32 product alone would often be wrong."""
    rng = np.random.default_rng(size)
    base = rng.integers(-size, size, 64, endpoint=True)
    near = lambda n, by: np.clip(base + rng.integers(-by, by, (n, 64), endpoint=True), -size, size)
    c = np.concatenate([near(6, 3), rng.integers(-size, size, (6, 64), endpoint=True)])
    c = np.concatenate([c, c[:3]])
    x = np.concatenate([near(500, 4), rng.integers(-size, size, (500, 64), endpoint=True), c])
    gap = x[:, None, :] - c
    assert np.array_equal(nearest(x, c), (gap * gap).sum(2).argmin(1))


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, [0.5] * D, 3)], "`a.b` long, key array<double>, embedding int")
    assert kept_vectors(df, "a.b", "key", D).count() == 1
    assert centroid_clusters(df, 2, 2, D, key="a.b", vector="key")[0].columns[0] == "a.b"
