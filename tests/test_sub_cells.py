"""k-means within labels: many labels, labels of one task and labels of many, against a plain loop."""

import numpy as np
from pyspark.sql import functions as F

from threadloom.operators import cluster as C


def table(spark, labels, each, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (labels * each, 2)) + rng.choice([-4, 0, 4], (labels * each, 2))
    rows = [(i, f"g{i % labels}" if i % labels else None, float(a), float(b)) for i, (a, b) in enumerate(x)]
    return spark.createDataFrame(rows, "id long, g string, a double, b double")


def test_a_thousand_labels(spark):
    out = C.sub_cells(table(spark, 1000, 41), "g", ["a", "b"], "id", starts=3).groupBy("g").agg(F.count("*").alias("n"), F.count_distinct("cell").alias("k")).collect()
    assert len(out) == 1000 and {r.n for r in out} == {41} and {r.k for r in out} == {2}


def test_both_ways_agree_and_equal_a_loop(spark):
    df = table(spark, 3, 130)
    one = {r.id: r for r in C.sub_cells(df, "g", ["a", "b"], "id").collect()}
    many = {r.id: r.cell for r in C.sub_cells(df, "g", ["a", "b"], "id", whole=50, together=2).collect()}
    assert {k: r.cell for k, r in one.items()} == many and len(one) == 390
    order = {r.id: r.h for r in df.select("id", F.xxhash64(F.lit(42), F.col("id")).alias("h")).collect()}
    for g in (None, "g1", "g2"):
        own = sorted((r for r in one.values() if r.g == g), key=lambda r: (order[r.id], r.id))
        x = np.array([[r.a, r.b] for r in own])
        found = []
        for s in range(10):
            c = np.array([x[(s * 5 + j) % 50] for j in range(5)])
            for _ in range(300):
                at = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
                c = np.array([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(5)])
            found.append((round(float(((x - c[at]) ** 2).sum()), 9), s, at.tolist()))
        assert [r.cell for r in own] == min(found)[2]


def test_few_rows_and_none(spark):
    df = table(spark, 2, 10)
    assert {r.cell for r in C.sub_cells(df, "g", ["a", "b"], "id").collect()} == {0}
    assert C.sub_cells(df.limit(0), "g", ["a", "b"], "id").count() == 0
