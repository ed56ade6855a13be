"""Neighbour embedding: its parts against numpy, and how many neighbours the layout keeps."""

import math

import numpy as np
import pytest

from threadloom.operators import density as D
from threadloom.operators import embedding as E
from threadloom.operators import linear as L


def kept_neighbours(x, y, k=10):
    def nearest(z):
        d = ((z[:, None] - z[None]) ** 2).sum(2)
        np.fill_diagonal(d, np.inf)
        return np.argsort(d, axis=1)[:, :k]

    return float(np.mean([len(set(a) & set(b)) / k for a, b in zip(nearest(x).tolist(), nearest(y).tolist())]))


def test_curve():
    a, b = E.curve(0.1)
    assert a == pytest.approx(1.577, abs=0.02) and b == pytest.approx(0.895, abs=0.01)


def test_weights_sum_to_the_perplexity(spark):
    rng = np.random.default_rng(1)
    rows = [(i, j, float(rng.random() + (0 if j else 0.01))) for i in range(30) for j in range(100, 100 + (8 if i else 3))]
    got = E.calibrated(spark.createDataFrame(rows, "a long, b long, d double"), 8).collect()
    for i in range(1, 30):
        own = {r.b: r.w for r in got if r.a == i}
        assert len(own) == 8 and sum(own.values()) == pytest.approx(math.log2(8), abs=1e-6) and max(own.values()) == 1
    both = E.united(spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.4), (3, 1, 0.3)], "a long, b long, w double")).collect()
    assert sorted((r.a, r.b, round(r.w, 9)) for r in both) == [(1, 2, 0.7), (1, 3, 0.3), (2, 1, 0.7), (3, 1, 0.3)]


def test_layout_keeps_more_neighbours_than_principal_components(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (8, 12))[rng.integers(0, 8, 300)] * 4 + rng.normal(0, 1, (300, 3)) @ rng.normal(0, 1, (3, 12)) + rng.normal(0, 0.1, (300, 12))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(300, x[0].tolist()), (301, None)], "id long, v array<double>")
    got = {r.id: r.y for r in E.neighbour_embedding(rows, "id", "v", orders=1, run=1024).collect()}
    assert len(got) == 302 and got[301] is None and got[300] == got[0]
    y = np.array([got[i] for i in range(300)])
    pca = {r.id: r.pc for r in L.pca(rows.filter("id < 300"), "v", 2, "pc").collect()}
    layout, components = kept_neighbours(x, y), kept_neighbours(x, np.array([pca[i] for i in range(300)]))
    assert np.isfinite(y).all() and layout > 0.45 and layout > components + 0.1


def test_few_rows_and_none(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "id long, v array<double>")
    assert sorted((r.id, r.y) for r in E.neighbour_embedding(rows, "id", "v").collect()) == [(1, [0.0, 0.0]), (2, None)]
    assert E.neighbour_embedding(rows.limit(0), "id", "v").count() == 0 and D.nodes_of(rows, "id", "v").count() == 1
