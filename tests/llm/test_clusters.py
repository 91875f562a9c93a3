"""Clustering in whole numbers against plain Python, and the screening against its own bound."""

from __future__ import annotations

import hashlib
import math
import random
from fractions import Fraction

import numpy as np

from cueframe.llm.clusters import Centroids, Sums, cluster_vectors, limbs


def plainly(rows, k, rounds, seed, size):
    kept = [(i, [math.floor(Fraction(x) * 1024) for x in v]) for i, v in rows if v is not None and len(v) == size and None not in v and all(map(math.isfinite, v))]
    by_hash = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest()))
    centroids = [v for _, v in by_hash[:k]]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min((away(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centroids)]
    found = [(i, *reversed(nearest(v))) for i, v in kept]
    fits = lambda x: x if x < 1 << 63 else None
    inside = {}
    for _, j, d in found:
        inside[j] = inside.get(j, 0) + d
    over = {j for _, j, d in found if d >= 1 << 63}
    total = None if over else fits(sum(inside.values()))
    return [(i, j, fits(d), None if j in over else fits(inside[j]), total, hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, j, d in found]


def check(spark, rows, k, rounds, size, kind="double"):
    df = spark.createDataFrame([(i, v, n % 3, "x") for n, (i, v) in enumerate(rows)], f"vec_id long, embedding array<{kind}>, cluster int, V string").repartition(5)
    found = sorted((tuple(r) for r in cluster_vectors(df, k, rounds, 3, size).collect()), key=repr)
    assert found == sorted(plainly([(i, None if v is None else [None if x is None else float(np.float32(x)) if kind == "float" else float(x) for x in v]) for i, v in rows], k, rounds, 3, size), key=repr)


def test_against_plain_python(spark):
    r = random.Random(1)
    rows = [(i, [r.gauss(i % 4, 0.7) for _ in range(6)]) for i in range(300)]
    rows += [(1000 + i, v) for i, (_, v) in enumerate(rows[:40])]  # copies
    rows += [(7000, None), (7001, []), (7002, [1.0] * 5), (7003, [1.0] * 5 + [None]), (7004, [float("nan")] * 6), (7005, [1.0] * 5 + [float("inf")]), (7006, [0.0] * 6), (None, [0.5] * 6), (7007, [-0.0] * 6)]
    check(spark, rows, 5, 4, 6)
    check(spark, rows, 5, 4, 6, "float")


def test_ties_copies_and_few_rows(spark):
    check(spark, [(i, [float(i % 2), 0.0]) for i in range(20)], 4, 3, 2)  # equal centroids: the smaller number takes all
    check(spark, [(1, [0.25, -0.25]), (2, [3.0, 1.0])], 8, 10, 2)
    check(spark, [], 8, 2, 2)
    check(spark, [(1, [None, 1.0])], 8, 2, 2)


def test_numbers_beyond_64_bits(spark):
    check(spark, [(1, [1e30, -1e30]), (2, [1.0, 2.0]), (3, [1e300, 0.0]), (4, [-7e5, 1.5]), (5, [1.25, 2.5]), (6, [2e9, 2e9]), (7, [2e9, 1e9])], 3, 3, 2)


def test_screening_never_loses_the_nearest():
    r = np.random.default_rng(2)
    for scale in (3, 1000, 1 << 23):
        centroids = r.integers(-scale, scale, (16, 64))
        centroids[8:] = centroids[:8] + r.integers(-1, 2, (8, 64))  # hardly apart
        x = np.r_[r.integers(-scale, scale, (500, 64)), (centroids[:8] + centroids[8:]) // 2, centroids]
        held = Centroids(centroids.tolist())
        exact = ((x[:, None, :].astype(object) - centroids[None].astype(object)) ** 2).sum(axis=2)
        left = held.screen(x)
        assert left[exact == exact.min(axis=1)[:, None]].all()
        assert (held.assign(x) == exact.astype(float).argmin(axis=1)).all() or scale > 1000
        assert held.assign(x).tolist() == [min(range(16), key=lambda j: (row[j], j)) for row in exact.tolist()]
        assert left.mean() < 0.6 or scale < 1000


def test_limbs_and_sums():
    for value in (0, -1, 1 << 40, -(1 << 40), (1 << 200) - 3, -(1 << 200) + 5):
        assert sum(x << (40 * k) for k, x in enumerate(limbs(value))) == value and all(abs(x) <= 1 << 40 for x in limbs(value))
    sums = Sums(2, 2)
    sums.add(np.array([1, 1]), np.array([[5, -6], [7, 8]]))
    sums.add(np.array([1]), [[1 << 90, 1]])
    assert sorted(sums.rows())[0] == (1, -1, 0, 3)
    assert sum(v << (40 * limb) for _, p, limb, v in sums.rows() if p == 0) == 12 + (1 << 90)
