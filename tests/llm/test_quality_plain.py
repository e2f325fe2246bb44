"""The additive model against plain loops: steps, grids, fit and scores."""

import bisect
import math
import random

import numpy as np
import pytest

from evidentia.llm import quality as Q


def value(g, h):
    return sum(g) / (sum(h) + Q.RIDGE)


def gain(g, h):
    return sum(g) ** 2 / (sum(h) + Q.RIDGE)


def plain_tree(g, h):
    """The best step function with up to three parts, by trying all cuts."""
    n = len(g)
    if n < 2:
        return [0.0] * n
    cuts = [(i, j) for i in range(1, n) for j in range(i + 1, n + 1)]
    i, j = max(cuts, key=lambda c: sum(gain(g[a:b], h[a:b]) for a, b in ((0, c[0]), (c[0], c[1]), (c[1], n)) if b > a))
    return [value(g[a:b], h[a:b]) for a, b in ((0, i), (i, j), (j, n)) for _ in range(b - a)]


def plain_quadrants(g, h):
    n, m = len(g), len(g[0])
    best = None
    for i in range(1, n):
        for j in range(1, m):
            parts = [[(a, b) for a in rows for b in cols] for rows in (range(i), range(i, n)) for cols in (range(j), range(j, m))]
            score = sum(gain([g[a][b] for a, b in p], [h[a][b] for a, b in p]) for p in parts)
            if best is None or score > best[0] + 1e-15:
                best = score, parts
    out = [[0.0] * m for _ in range(n)]
    for p in best[1]:
        v = value([g[a][b] for a, b in p], [h[a][b] for a, b in p])
        for a, b in p:
            out[a][b] = v
    return out, best[0]


@pytest.mark.parametrize("seed", range(6))
def test_steps_equal_a_search_of_all_cuts(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 9))
    g, h = rng.normal(size=n), rng.uniform(0.01, 1, n)
    assert Q._tree(g, h) == pytest.approx(plain_tree(g.tolist(), h.tolist()))
    g, h = rng.normal(size=(n + 1, 4)), rng.uniform(0.01, 1, (n + 1, 4))
    table, best = Q._pair_tree(g, h)
    want, score = plain_quadrants(g.tolist(), h.tolist())
    assert best == pytest.approx(score) and table.tolist() == [pytest.approx(r) for r in want]


def test_scores_equal_sums_of_looked_up_bins():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4)).round(2)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    model = Q.fit(x, y)
    assert model.pairs
    for row, got in zip(x[:60].tolist(), model.scores(x[:60]), strict=True):
        total = model.base + sum(t[bisect.bisect_right(c.tolist(), v)] for c, t, v in zip(model.cuts, model.tables, row, strict=True))
        for (a, b), t in zip(model.pairs, model.pair_tables, strict=True):
            total += t[bisect.bisect_right(model.pair_cuts[a].tolist(), row[a]), bisect.bisect_right(model.pair_cuts[b].tolist(), row[b])]
        assert got == pytest.approx(1 / (1 + math.exp(-total)))


def test_fit_equals_plain_boosting(monkeypatch):
    """Cyclic rounds of plain steps on few rows, without pairs, give the same tables."""
    monkeypatch.setattr(Q, "PAIRS", 0)
    monkeypatch.setattr(Q, "ROUNDS", 4)
    rng = random.Random(2)
    x = np.array([[rng.gauss(0, 1), rng.choice([0.0, 1.0, 2.0])] for _ in range(80)])
    y = np.array([float(a + 0.3 * b > 0.4) for a, b in x])
    model = Q.fit(x, y)
    total = [model.base] * len(y)
    tables = [[0.0] * (len(c) + 1) for c in model.cuts]
    bins = [[bisect.bisect_right(c.tolist(), v) for v in x[:, j]] for j, c in enumerate(model.cuts)]
    for _ in range(4):
        for j in range(2):
            p = [1 / (1 + math.exp(-t)) for t in total]
            g, h = [0.0] * len(tables[j]), [0.0] * len(tables[j])
            for k, b in enumerate(bins[j]):
                g[b] += y[k] - p[k]
                h[b] += p[k] * (1 - p[k])
            for b, s in enumerate(plain_tree(g, h)):
                tables[j][b] += Q.RATE * s
            total = [model.base + sum(tables[f][bins[f][k]] for f in range(2)) for k in range(len(y))]
    for got, want in zip(model.tables, tables, strict=True):
        assert got.tolist() == pytest.approx(want)
