"""Hard negatives against brute force, the bounds, and the awkward cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from noonday.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, block string, vector string, asked string, positives string, mean string"


def truth(rows, anchors, k=5, low=80, high=100):
    sound = [(i, x, y) for i, x, y in rows if i is not None and y is not None and x and all(c is not None and math.isfinite(c) for c in x)]
    scaled = {i: (y, [math.floor(256 * c) for c in x]) for i, x, y in sound}
    out = []
    for a, (y, x) in scaled.items():
        if a % anchors:
            continue
        score = {i: sum(p * q for p, q in zip(x, v, strict=True)) for i, (_, v) in scaled.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if scaled[i][0] == y][:k]:
            hard = [i for i in order if scaled[i][0] != y and low * score[p] <= 100 * score[i] <= high * score[p]][:k]
            out += [(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(hard)]
    return sorted(out)


def made(spark, rows):
    return spark.createDataFrame([(i, x, y, "x", "x", "x", "x", "x") for i, x, y in rows], SCHEMA)


def result(frame, anchors, **settings):
    found = negatives.mine(frame, F.col("vec_id") % anchors == 0, **settings)
    return sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def clustered(n, dims, seed):
    draw = np.random.default_rng(seed)
    centres = draw.normal(0, 0.3, (12, dims))
    return [(i, (centres[i % 12] + draw.normal(0, 0.02 + 0.1 * (i % 3), dims)).tolist(), int(draw.integers(0, 3)) if i % 3 else 0) for i in range(n)]


def test_bounds_hold():
    draw = np.random.default_rng(2)
    for dims in (1, 5, 32, 70):
        x = np.floor(draw.normal(0, 50, (40, dims)))
        fine = negatives.summary(x, 4)
        last = None
        for width in negatives.WIDTHS:
            mean, deviation = negatives.merged(*fine, dims, 4, width)
            again = negatives.summary(x, width)
            assert np.allclose(mean, again[0]) and np.allclose(deviation, again[1])
            middle, spread = (mean * negatives.sizes(dims, width)) @ mean.T, deviation @ deviation.T
            assert (np.abs(x @ x.T - middle) <= spread + 1e-6).all()
            assert last is None or (spread <= last + 1e-6).all()
            last = spread


@pytest.mark.parametrize(("dims", "most"), [(64, 1 << 17), (64, 100), (7, 300)])
def test_negatives(spark, dims, most):
    """A hot label (a third of all rows and more), equal vectors, tied scores."""
    rows = clustered(900, dims, dims)
    rows += [(2000 + i, rows[0][1], i % 2) for i in range(120)] + [(3000 + i, [0.0] * dims, 1) for i in range(30)]
    want = truth(rows, 20)
    assert len(want) > 300
    assert result(made(spark, rows).repartition(5), 20, most=most) == want


def test_rows_that_take_no_part(spark):
    draw = random.Random(3)
    sound = [(i, [draw.gauss(0, 1) for _ in range(6)], i % 2) for i in range(60)]
    bad = [
        (None, [1.0] * 6, 0), (100, None, 0), (110, [1.0] * 6, None), (120, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (130, [math.nan] * 6, 1),
        (140, [math.inf] * 6, 0), (150, [], 0), (160, [9.0] * 5, 1), (170, [1e300] * 6, 1),
    ]
    repeated = [(0, [9.0] * 6, 1), (10, sound[10][1], sound[10][2])]
    assert result(made(spark, sound + bad + repeated), 10) == truth(sound, 10)


def test_few_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 2), (2, [0.9, 0.0], 2), (20, [-1.0, 0.0], 5), (40, [-1.0, 0.0], 5)]
    assert result(made(spark, rows), 20) == truth(rows, 20)
    assert result(made(spark, rows[:1]), 20) == []
    assert result(made(spark, rows).where("false"), 20) == []
