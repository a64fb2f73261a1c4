from __future__ import annotations

import math
import random

import numpy as np
import pytest

from loresift.llm import top_k

SCHEMA = "vec_id long, embedding array<double>, label int, dims int, d string"


def make(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], SCHEMA).repartition(3)


def brute(rows, k):
    good = [
        (i, [int(x) * 64 if abs(x) > 2**53 else math.floor(64 * x) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, a in good:
        if q % 20:
            continue
        scored = [(sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q and len(a) == len(b)]
        best = sorted(scored, key=lambda s: (-s[0], s[1]))[:k]
        out += [(q, n + 1, i, s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def search(rows, k=20, **sizes):
    found = top_k.top_k(rows, rows.where("vec_id % 20 = 0"), k, **sizes)
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("spread", [1.0, 3.0, 300.0])
def test_matches_brute_force(spark, spread):
    draw = random.Random(int(spread))
    rows = [(i, [draw.gauss(0, spread) for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, rows[i % 3][1]) for i in range(100)]  # ties
    assert search(make(spark, rows), data_block=64, query_block=5) == brute(rows, 20)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5]), (20, None), (40, [nan, 1.0]), (60, [1.0, None]), (80, [inf, 1.0]), (1, [0.0, -0.001]), (2, []),
        (100, []), (3, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (120, [-1.0, 0.25]),
    ]
    assert search(make(spark, rows)) == brute(rows, 20)
    assert search(make(spark, rows).where("false")) == []
    assert search(make(spark, rows[:1])) == []


def test_bounds_enclose_scores():
    draw = np.random.default_rng(1)
    vectors, queries = draw.integers(-900, 900, (200, 16)), draw.integers(-900, 900, (9, 16))
    upper, gap = top_k.Approximation(vectors).upper_and_gap(queries)
    exact = queries @ vectors.T
    assert (exact <= upper).all() and (exact >= upper - gap[:, None]).all() and (gap > 0).all()


def test_large_components(spark):
    draw = random.Random(5)
    rows = [(i, [draw.gauss(0, 1) for _ in range(4)]) for i in range(100)]
    rows += [(101 + i, [draw.gauss(0, 1) * 2**28, draw.gauss(0, 1) * 2**25, 1.0, -1.0]) for i in range(19)]
    rows += [(140, [0.0, 0.0, 2.0**30, 0.25]), (141, [2.0**9, 1.0, 0.5, 0.0]), (142, [2.0**9, 1.0, 0.5, 0.25])]
    assert search(make(spark, rows), data_block=40, query_block=3) == brute(rows, 20)


def test_components_of_any_size(spark):
    draw = random.Random(6)
    rows = [(i, [draw.gauss(0, 1) for _ in range(3)]) for i in range(1, 90) if i % 20]
    rows += [(20, [1.0, 0.0, 0.0]), (40, [0.0, 0.5, 0.0])]
    # far below, orthogonal, and beyond what doubles hold after scaling
    rows += [(200, [-1e30, -1e30, 0.0]), (201, [-1e300, -1.7e308, 0.0]), (202, [0.0, -1e18, 5.0]), (203, [-1e25, 0.0, 1e30])]
    below = [r for r in rows if r[0] != 200]
    assert search(make(spark, below), data_block=30) == brute(below, 20)
    with pytest.raises(Exception, match="beyond 64 bits"):
        search(make(spark, [(0, [1.0]), (1, [2.0**60])]))
