"""Mixed models of overlapping subgroups in one pass."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from threadloom.operators import linear as L

DATA = "/root/testdata/sf0.001"


def _fit(x, y, g, ratio):
    """Likelihood, coefficients and their errors by the whole covariance matrix."""
    x, z = np.column_stack([x, np.ones(len(y))]), (g[:, None] == np.unique(g)).astype(float)
    v = np.eye(len(y)) + ratio * z @ z.T
    a = x.T @ np.linalg.solve(v, x)
    beta = np.linalg.solve(a, x.T @ np.linalg.solve(v, y))
    free, rest = len(y) - x.shape[1], y - x @ beta
    s2 = rest @ np.linalg.solve(v, rest) / free
    value = -0.5 * (free * np.log(s2) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1])
    return value, beta[:-1], np.sqrt(np.diag(np.linalg.inv(a)) * s2)[:-1]


@pytest.mark.parametrize("ranges", ["1", "7"])
def test_mixed_groups_equal_the_whole_covariance(spark, ranges):
    """A group of half of the rows, which several ranges share, a group without a name, small groups, nulls among cells and in a rule."""
    rng = np.random.default_rng(11)
    n = 600
    g = np.where(rng.random(n) < 0.5, 7, rng.integers(0, 60, n))
    a, b = rng.normal(size=(2, n))
    y, z = 0.3 * a - 0.2 * a * b + rng.normal(size=60)[g] + rng.normal(size=n), b + rng.normal(size=n)
    rows = [(None if k == 3 else f"g{k}", *map(float, c)) for k, *c in zip(g.tolist(), a, b, y, z)]
    rows += [("g1", None, 0.0, 1.0, 1.0), ("g1", 1.0, 0.0, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "g string, a double, b double, y double, z double")
    rules = {"all": (F.lit(True), np.full(n, True)), "positive": (F.col("a") > 0, a > 0), "tail": (F.when(F.col("b") > 1, True), b > 1), "none": (F.col("y") > 1e9, None), "few": (F.col("b") > 2.5, None)}
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = L.mixed_groups(df, {c: F.col(c) for c in "ab"}, {c: F.col(c) for c in "yz"}, "g", {k: r for k, (r, _) in rules.items()}, {"ab": ("a", "b", 0.1, 2.0)}, least=50).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = {(r.subgroup, r.outcome, r.variable): r for r in found}
    assert len(got) == len(found) == 3 * 2 * 3
    x = np.column_stack([a, b, (a * b - 0.1) / 2])
    for name in ("all", "positive", "tail"):
        own = rules[name][1]
        for outcome, v in (("y", y), ("z", z)):
            r = [got[name, outcome, c] for c in ("a", "b", "ab")]
            ratio = r[0].icc / (1 - r[0].icc)
            value, beta, se = _fit(x[own], v[own], g[own], ratio)
            assert [k.beta for k in r] == pytest.approx(beta) and [k.se for k in r] == pytest.approx(se)
            assert all(value > _fit(x[own], v[own], g[own], near)[0] - 1e-9 for near in ((ratio * 0.8, ratio * 1.25) if ratio else (1e-3,)))


def test_j17_passes_do_not_grow_with_its_subgroups(spark):
    spark.sparkContext.setJobGroup("j17", "")
    try:
        assert queries()["j17_associations"](spark, DATA).count() == 7 * 6 * 21
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("j17")) < 60


def test_j17_without_a_subgroup_of_200_rows(spark, tmp_path):
    spark.read.parquet(f"{DATA}/lineitem.parquet").limit(150).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.read.parquet(f"{DATA}/orders.parquet").write.parquet(f"{tmp_path}/orders.parquet")
    assert queries()["j17_associations"](spark, str(tmp_path)).count() == 0
