"""Density clustering against a brute-force version over all pairs."""

import collections

import numpy as np
import pytest

from threadloom.operators import density as D


def brute(x, least, samples):
    """Labels by the full distance matrix, Prim's tree, splits from the top down and excess of mass; copies are rows."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, min(samples, n - 1)]
    w = np.maximum(np.maximum(d, core[:, None]), core[None])
    inside, best, link, edges = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int), []
    at = 0
    for _ in range(n - 1):
        inside[at] = True
        closer = ~inside & (w[at] < best)
        best[closer], link[closer] = w[at][closer], at
        nxt = int(np.where(inside, np.inf, best).argmin())
        edges.append((best[nxt], link[nxt], nxt))
        at = nxt
    clusters, stack = [], [(set(range(n)), None, 0.0)]
    edges = [(max(w, D.CLOSEST), a, b) for w, a, b in edges]
    while stack:
        points, parent, born = stack.pop()
        me, leave = len(clusters), []
        clusters.append({"parent": parent, "born": born, "leave": leave, "all": sorted(points)})
        while True:
            inner = [e for e in edges if e[1] in points and e[2] in points]
            if not inner:
                leave += [(p, 1 / D.CLOSEST) for p in points]
                break
            top = max(inner)[0]
            near = collections.defaultdict(list)
            for w, a, b in inner:
                if w < top:
                    near[a].append(b)
                    near[b].append(a)
            parts, free = [], set(points)
            while free:
                part, todo = set(), [free.pop()]
                while todo:
                    p = todo.pop()
                    part.add(p)
                    new = [q for q in near[p] if q in free]
                    free -= set(new)
                    todo += new
                parts.append(part)
            big = [p for p in parts if len(p) >= least]
            small = [p for part in parts if len(part) < least for p in part]
            if len(big) == 1:
                leave += [(p, 1 / top) for p in small]
                points = big[0]
                continue
            leave += [(p, 1 / top) for p in points]
            stack += [(p, me, 1 / top) for p in big]
            break
    own = [sum(v - c["born"] for _, v in c["leave"]) for c in clusters]
    total, keep = list(own), [True] * len(clusters)
    for k in reversed(range(len(clusters))):
        below = sum(total[j] for j, c in enumerate(clusters) if c["parent"] == k)
        keep[k] = own[k] >= below
        total[k] = max(own[k], below)
    keep[0] = False
    label = np.full(n, -1)
    for k, c in enumerate(clusters):
        above, free = c["parent"], keep[k]
        while above is not None:
            free, above = free and not keep[above], clusters[above]["parent"]
        if free:
            label[c["all"]] = k
    return label


def same(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b)) and {x for x, y in zip(a, b) if (x == -1) != (y == -1)} == set()


def blobs(n, seed, d=3):
    rng = np.random.default_rng(seed)
    parts = [rng.normal(c, s, (m, d)) for c, s, m in ((0, 0.3, n // 5), (4, 0.8, n // 4), (5.5, 0.25, n // 8), ((0, 6, 0)[:d], 0.5, n // 6))]
    x = np.concatenate(parts)
    return np.concatenate([x, rng.uniform(-4, 10, (n - len(x), d))])


def clustered(spark, x, **more):
    rows = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], "id long, v array<double>, label string")
    got = dict(tuple(r) for r in D.density_clusters(rows, "id", "v", **more).collect())
    assert sorted(got) == list(range(len(x)))
    return [got[i] for i in range(len(x))]


def test_two_thousand_points_equal_brute_force(spark):
    x = blobs(2000, 1)
    want = brute(x, 20, 5)
    got = clustered(spark, x, run=4096, orders=1, limit=1200)
    assert same(got, want.tolist()) and len(set(got)) > 3 and got.count(-1) > 50


def test_copies_count_as_rows(spark):
    x = blobs(300, 2)
    x = np.concatenate([x, np.repeat(x[:4], 12, axis=0), np.repeat(x[-1:], 30, axis=0)])
    assert same(clustered(spark, x, min_cluster_size=15, run=1024, orders=1), brute(x, 15, 5).tolist())


def test_no_rows_few_rows_and_nulls(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0, 2.0])], "id long, v array<double>")
    assert [tuple(r) for r in D.density_clusters(rows, "id", "v").orderBy("id").collect()] == [(1, -1), (2, -1), (3, -1)]
    assert D.density_clusters(rows.limit(0), "id", "v").count() == 0


@pytest.mark.parametrize("bounded", [True, False])
def test_one_task_joins_parts_as_rounds_do(spark, bounded, monkeypatch):
    """The same forest and parts, ties and parts that may take no edge included; few edges need few tables."""
    rng = np.random.default_rng(11)
    pairs = sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, 120, (400, 2)).tolist() if a != b})
    edges = spark.createDataFrame([(a, b, float(rng.integers(1, 30))) for a, b in pairs], "a long, b long, w double")
    labels = spark.createDataFrame([(i, i) for i in range(125)], "node long, part long")
    bounds = spark.createDataFrame([(i, float(rng.integers(3, 25))) for i in range(118)], "node long, bound double") if bounded else None
    tables, kept = [], D.cut
    monkeypatch.setattr(D, "cut", lambda rows: tables.append(1) or kept(rows))
    found = {}
    for limit in (0, 150, None):
        tables.clear()
        tree, parts = D.spanning_forest(labels, edges, bounds, at_once=limit)
        found[limit] = sorted(map(tuple, tree.collect())), sorted(map(tuple, parts.collect())), len(tables)
    assert found[0][:2] == found[150][:2] == found[None][:2] and len(found[0][0]) > 60
    assert found[None][2] <= 4 < found[0][2]


def test_recall_of_neighbours(spark):
    """Of the ten nearest rows of every 50th row, over runs far smaller than the table."""
    x = np.random.default_rng(5).normal(0, 1, (4000, 16)) + np.repeat(np.random.default_rng(6).normal(0, 3, (20, 16)), 200, axis=0)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    near = collections.defaultdict(set)
    for r in D.neighbours(D.nodes_of(rows, "id", "v"), 10, run=512).filter("a % 50 = 0").collect():
        near[r.a].add(r.b)
    hits = 0
    for i in range(0, 4000, 50):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        hits += len(near[i] & set(np.argsort(d)[:10].tolist()))
    assert hits / (80 * 10) >= 0.9


@pytest.mark.parametrize("limit", [7, 20])
def test_levels_do_not_change_the_tree(spark, limit):
    rng = np.random.default_rng(limit)
    edges = [(i, int(rng.integers(0, i)), 0.5 if i % 13 == 0 else float(rng.random())) for i in range(1, 40)]
    nodes = spark.createDataFrame([(i, 1) for i in range(40)], "node long, weight long")
    tree = spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in edges], "a long, b long, w double")
    places, clusters = D.condensed(nodes, tree, 4, limit)
    whole, all_clusters = D.condensed(nodes, tree, 4, 10**6)
    got, want = ({r.node: r.cluster for r in p.collect()} for p in (places, whole))
    assert same([got[i] or -1 for i in range(40)], [want[i] or -1 for i in range(40)])
    assert sorted(round(r.own, 9) for r in clusters.collect()) == sorted(round(r.own, 9) for r in all_clusters.collect())
