"""Hard negatives against a plain search of all pairs."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import hard_negatives as H


def plain(rows, step, k=5, m=3, low=50, high=95):
    kept = [
        (n, i, lab, [math.floor(256 * float(x)) for x in v])
        for n, (i, v, lab) in enumerate(rows)
        if None not in (i, v, lab) and all(x is not None and math.isfinite(x) and math.isfinite(256 * x) for x in v)
    ]
    limit = H.LONGEST

    def score(a, b):
        return max(-limit, min(limit, sum(x * y for x, y in zip(a, b))))

    out = collections.Counter()
    for n, i, lab, v in kept:
        if i % step:
            continue
        ranked = sorted((-score(v, w), j, o, other) for o, j, other, w in kept if o != n)
        for s, j, _, other in [r for r in ranked if r[3] == lab][:k]:
            fits = [r for r in ranked if r[3] != lab and low * -s <= 100 * -r[0] <= high * -s][:m]
            for rank, (t, g, _, _) in enumerate(fits, 1):
                out[i, j, rank, g, -s, -t] += 1
    return out


def got(spark, rows, step):
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS part", "'x' AS row", "2 AS score")
    out = H.hard_negatives(docs, F.col("vec_id") % step == 0)
    names = "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    return collections.Counter(tuple(r[n] for n in names) for r in out.collect())


def test_equals_a_search_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(H, "LEAST_ROWS", 64)
    monkeypatch.setattr(H, "LEAF", 8)
    rnd = random.Random(3)
    rows = [(n, [rnd.gauss(0, 1) + (n % 4 == d) for d in range(6)], rnd.randrange(5)) for n in range(500)]
    rows += [(1000 + n, [0.5] * 6, n % 2) for n in range(150)]  # a third of copies, many ties
    assert got(spark, rows, 25) == plain(rows, 25)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (1, [1.0, 1.0], 1), (2, [0.9, 1.0], 2), (3, [0.5, 1.2], 2),
        (4, None, 1), (5, [1.0, None], 1), (6, [float("nan"), 1.0], 1), (7, [float("inf"), 1.0], 1), (8, [1.0, 1.0], None),
        (None, [1.0, 1.0], 1), (9, [], 2), (10, [1.0], 2), (11, [0.9, 1.0, 7.0], 3), (12, [-1.0, -2.0], 1), (13, [0.0, 0.0], 1),
        (14, [200.0, 300.0], 1), (15, [190.0, 280.0], 4),
    ]
    assert got(spark, rows, 1) == plain(rows, 1)
    assert got(spark, rows[:1], 1) == got(spark, rows[:0] or [(1, None, 1)], 1) == {}


def test_huge_components(spark):
    rows = [(n, [10.0 ** (n % 12), -(3.0 ** n), 1.0], n % 2) for n in range(1, 30)] + [(40, [1e307, 1.0], 1), (41, [1e308, 1.0], 1)]
    assert got(spark, rows, 1) == plain(rows, 1)


@pytest.mark.parametrize("score", [0, 1, -1, 7, 199, 10**15])
def test_score_windows(score):
    a, b = H.score_window(score, 50, 95)
    for x in range(-5, 6):
        for edge in (a, b):
            assert (a <= edge + x <= b) == (50 * score <= 100 * (edge + x) <= 95 * score)


def test_bounds_hold_every_row():
    rnd = np.random.default_rng(2)
    points, queries = rnd.normal(size=(300, 5)), rnd.normal(size=(20, 5))
    tree = H.BallTree(points, np.zeros(300, int), np.arange(300), np.arange(300))
    low, high = H.bounds(queries, tree.centres, tree.radius)
    for node, (a, b) in enumerate(zip(tree.start, tree.stop)):
        scores = queries @ tree.vectors[a:b].T
        assert (scores >= low[:, [node]]).all() and (scores <= high[:, [node]]).all()
    assert len(tree.leaves) > 4
