"""Centroid clustering against plain integers."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from fathomline.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, cluster string, distance int"


def brute(rows, k=16, rounds=3, n=64, scale=64):
    kept = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in rows if v is not None and len(v) == n and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [q for _, q in order[:k]]
    distance = lambda q, k: sum((a - b) ** 2 for a, b in zip(q, c[k], strict=True))
    for step in range(rounds + 1):
        best = [min((distance(q, k), k) for k in range(len(c))) for _, q in kept]
        if step < rounds:
            for k in range(len(c)):
                own = [q for (_, q), (_, b) in zip(kept, best, strict=True) if b == k]
                if own:
                    c[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    inner = {k: sum(d for d, b in best if b == k) for k in range(len(c))}
    fit = lambda v: v if v < 1 << 63 else None
    # a sum is lost with any of its distances
    return sorted(((i, b, fit(d), fit(inner[b]), fit(sum(inner.values())), hashlib.sha256(",".join(map(str, c[b])).encode()).hexdigest()) for (i, _), (d, b) in zip(kept, best, strict=True)), key=str)


def got(spark, rows, **how):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, centroids.cluster_vectors(df, **how).collect()), key=str)


def vectors(rng, n, spread=1.0):
    return [(i, [rng.gauss(0, spread) for _ in range(64)]) for i in range(n)]


def test_against_integers(spark):
    rng = random.Random(1)
    rows = vectors(rng, 300)
    rows += [rows[0], rows[0], (None, rows[3][1]), (None, rows[4][1]), (7, rows[9][1])]
    rows += [(900, None), (901, [1.0]), (902, [math.nan] * 64), (903, [math.inf] + [0.0] * 63), (904, [None] + [0.0] * 63), (905, [0.0] * 65), (906, [])]
    assert got(spark, rows) == brute(rows)


def test_ties_and_few_vectors(spark):
    rng = random.Random(2)
    # whole numbers of 1/64 on a coarse grid: many equal distances, many equal vectors
    rows = [(i, [rng.choice([0.0, 1.0]) if d < 3 else 0.0 for d in range(64)]) for i in range(120)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows[:5]) == brute(rows[:5])
    assert got(spark, []) == []
    assert got(spark, [(1, None)]) == []


@pytest.mark.parametrize("size", [1e3, 3e6, 1e9, 1e17, 1e30, 1e160, 1e300])
def test_large_components(spark, size):
    """Whatever the components' size, the assignment is exact; numbers past 64 bits are null."""
    rng = random.Random(4)
    rows = vectors(rng, 40) + [(100 + i, [rng.gauss(0, 1) * (size if d % 7 == 0 else 1) for d in range(64)]) for i in range(12)]
    assert got(spark, rows) == brute(rows)


def test_intervals_hold():
    """The float32 shortlist alone never loses the nearest, near ties of large integers included."""
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 26), 1 << 26, 64)
    own = centroids.Centroids([(base + rng.integers(-2, 3, 64)).tolist() for _ in range(8)])
    x = (base + rng.integers(-3, 4, (500, 64))) / 64.0
    block = centroids.Block(x, 64)
    best, distance = own.nearest(block)
    for r in range(500):
        d, k = min((sum((a - b) ** 2 for a, b in zip(block.row(r), own.rows[k], strict=True)), k) for k in range(8))
        assert (best[r], distance[r]) == (k, d)
