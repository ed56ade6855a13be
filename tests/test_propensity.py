"""Stratified folds, and models refitted within overlapping groups, against one fit a group in numpy and pandas."""

import collections
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from threadloom.operators import designs as D
from threadloom.operators import linear as L

COLUMNS = ["a", "b"]
RULES = {"all": "true", "low": "a < 0.3", "high": "a >= 0.3", "tiny": "id < 40"}


@pytest.fixture(scope="module")
def units(spark):
    rng = random.Random(6)
    rows = []
    for i in range(700):
        a, b = rng.gauss(0, 1), rng.gauss(3, 50)
        d = int(rng.random() < 1 / (1 + math.exp(-(0.8 * a + 0.01 * b - 0.3))))
        rows.append((i, i // 3, a, b, d, float(rng.random() < 0.3 + 0.2 * d + 0.1 * (a > 0)), rng.gauss(a, 1)))
    return spark.createDataFrame(rows, "id long, cluster long, a double, b double, d int, y double, y2 double").repartition(4)


def groups():
    return {n: F.expr(r) for n, r in RULES.items()}


def newton(x, y, c=1.0):
    x = np.c_[x, np.ones(len(x))]
    beta, penalty = np.zeros(x.shape[1]), np.diag([1 / c] * (x.shape[1] - 1) + [0.0])
    for _ in range(60):
        m = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve(x.T @ (x * (m * (1 - m))[:, None]) + penalty, x.T @ (y - m) - penalty @ beta)
    return beta


@pytest.mark.parametrize("n", [0, 1, 4, 23, 100])
@pytest.mark.parametrize("folds", [2, 5])
def test_folds_are_stratified(spark, n, folds):
    rng = random.Random(n)
    rows = [(i, int(rng.random() < 0.3), rng.choice("xyy")) for i in range(n)] + [(-1, 1, "x")] * 7
    got = L.stratified_folds(spark.createDataFrame(rows, "id long, d int, g string"), folds, group=["g"]).collect()
    assert collections.Counter((r.id, r.d, r.g) for r in got) == collections.Counter(rows)
    for g in "xy":
        own = [r for r in got if r.g == g]
        for part in (own, [r for r in own if r.d], [r for r in own if not r.d]):
            sizes = [sum(r.fold == k for r in part) for k in range(folds)]
            assert sum(sizes) == len(part) and max(sizes) - min(sizes) <= 1


def test_refits_equal_one_fit_a_group(units):
    got = L.group_propensity(units, COLUMNS, groups(), least=30).toPandas()
    assert sorted(got["subgroup"].unique()) == ["all", "high", "low"]
    whole = units.toPandas()
    for name, own in got.groupby("subgroup"):
        own = own.sort_values("id")
        assert own["id"].tolist() == sorted(whole.query("a < 0.3" if name == "low" else "a >= 0.3" if name == "high" else "id >= 0")["id"])
        x = own[COLUMNS].to_numpy()
        x = (x - x.mean(0)) / x.std(0)
        for k in range(5):
            out = (own["fold"] == k).to_numpy()
            beta = newton(x[~out], own["d"].to_numpy()[~out])
            want = 1 / (1 + np.exp(-(np.c_[x, np.ones(len(x))][out] @ beta)))
            assert own["ps"].to_numpy()[out] == pytest.approx(want, abs=1e-8)


def test_propensity_equals_one_group(units):
    a = L.propensity(units, COLUMNS).select("id", "ps").toPandas().sort_values("id")
    b = L.group_propensity(units, COLUMNS, {"all": F.lit(True)}).select("id", "ps").toPandas().sort_values("id")
    assert a["ps"].to_numpy() == pytest.approx(b["ps"].to_numpy(), abs=1e-9)


def test_group_effects_equal_pandas(units):
    effects, diagnostics = D.group_effects(units, COLUMNS, groups(), ["y", "y2"], replicates=60, least=30)
    effects, diagnostics = effects.toPandas(), diagnostics.toPandas().set_index("subgroup")
    assert len(effects) == 6 and sorted(diagnostics.index) == ["all", "high", "low"]
    scored = L.group_propensity(units, COLUMNS, groups(), least=30).toPandas()
    for name, own in scored.groupby("subgroup"):
        controls = int((own["d"] == 0).sum())
        k = min(5, max(3, controls // 30))
        own = own.assign(s=pd.qcut(own["ps"], k, labels=False, duplicates="drop"))
        one, zero = own[own["d"] == 1]["ps"].to_numpy(), own[own["d"] == 0]["ps"].to_numpy()
        auc = ((one[:, None] > zero).sum() + 0.5 * (one[:, None] == zero).sum()) / (len(one) * len(zero))
        g = diagnostics.loc[name]
        assert (g["n"], g["treated"], g["control"], g["k"]) == (len(own), len(one), controls, k) and g["auc"] == pytest.approx(auc)
        for y in ("y", "y2"):
            total = weight = 0.0
            for _, part in own.groupby("s"):
                t, c = part[part["d"] == 1][y], part[part["d"] == 0][y]
                if len(t) >= 2 and len(c) >= 2:
                    total, weight = total + len(t) * (t.mean() - c.mean()), weight + len(t)
            e = effects[(effects["subgroup"] == name) & (effects["outcome"] == y)].iloc[0]
            spread = own[own["d"] == 0][y].std(ddof=0)
            assert e["att"] == pytest.approx(total / weight) and e["cohen_d"] == pytest.approx(total / weight / spread)
            assert e["ci_low"] < e["att"] < e["ci_high"] and e["sig"] == ("*" if e["ci_low"] > 0 or e["ci_high"] < 0 else "")
            assert e["treated_mean"] == pytest.approx(own[own["d"] == 1][y].mean())


def test_models_that_do_not_settle_are_an_error(units):
    with pytest.raises(ArithmeticError):
        L.logistic_beta(units, COLUMNS, "d", steps=1)


def test_no_group_is_large_enough(units):
    effects, diagnostics = D.group_effects(units, COLUMNS, {"tiny": F.expr("id < 40")}, ["y"], replicates=5)
    assert effects.count() == diagnostics.count() == 0


def test_betas_of_groups_equal_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(i, None if i % 5 == 4 else i % 5, rng.normal(size=4).tolist(), float(rng.normal())) for i in range(400)] + [(1000, 99, [1.0, 2.0, 3.0, 4.0], 1.0)]
    df = spark.createDataFrame(rows, "id long, g int, v array<double>, y double")
    got = {r.g: r for r in L.group_betas(df, F.col("v"), 4, "y", "g").collect()}
    assert sorted(got, key=str) == sorted([0, 1, 2, 3, 99, None], key=str) and got[99].beta is None
    for g in (0, 1, 2, 3, None):
        own = [r for r in rows if r[1] == g]
        x, y = np.array([[*r[2], 1.0] for r in own]), np.array([r[3] for r in own])
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        assert got[g].n == len(own) and got[g].beta == pytest.approx(beta[:4]) and got[g].intercept == pytest.approx(beta[4])
        assert got[g].r2 == pytest.approx(1 - ((y - x @ beta) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def test_covariance_matches_equal_brute_force(spark):
    from threadloom.operators import cluster as C

    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6))
    age = rng.normal(size=300)
    df = spark.createDataFrame([(i, f"c{i % 4}", v.tolist(), float(a)) for i, (v, a) in enumerate(zip(x, age))], "id long, cell string, v array<double>, age double")
    got = C.covariance_matches(df, ["cell"], "v", 6, F.col("id") % 3 == 0, "id", "age", tiers=2, n=4).collect()
    inverse, tier = np.linalg.inv(np.cov(x.T, bias=True)), (age > np.median(age)).astype(int)
    want = []
    for c in range(4):
        for t in (0, 1):
            own = [i for i in range(300) if i % 4 == c and tier[i] == t]
            anchor = min(i for i in own if i % 3 == 0)
            far = {i: float(np.sqrt((x[i] - x[anchor]) @ inverse @ (x[i] - x[anchor]))) for i in own}
            want += [(f"c{c}", t, anchor, i, pytest.approx(far[i], abs=1e-9), k) for k, i in enumerate(sorted(own, key=lambda i: (far[i], i))[:4], 1)]
    assert sorted((tuple(r) for r in got), key=lambda r: (r[0], r[1], r[5])) == want


def test_overlapping_folds_sort_each_row_once(spark, monkeypatch):
    """The folds of each group as its own stratified folds, from one sorted table of as many rows as there are."""
    from threadloom.operators import scan as scans

    rows = spark.range(700).selectExpr("id % 650 AS id", "CASE WHEN id % 41 <> 0 THEN CAST(id % 3 = 0 AS int) END AS d", "CASE WHEN id % 37 <> 0 THEN id % 10 END AS x")
    groups = {"all": F.lit(True), "low": F.col("x") < 6, "even": F.col("x") % 2 == 0, "none": F.col("x") > 99}
    written, real = [], scans.cut
    monkeypatch.setattr(scans, "cut", lambda t: written.append(real(t)) or written[-1])
    got = L.overlapping_folds(rows, groups, keep=["id", "d"]).collect()
    assert [t.count() for t in written] == [700] and got[0].asDict().keys() == {"id", "d", "folds"}
    for i, (name, rule) in enumerate(groups.items()):
        want = sorted(((r.id, r.fold) for r in L.stratified_folds(rows.filter(rule)).collect()), key=repr)
        assert sorted(((r.id, r.folds[i]) for r in got if r.folds[i] is not None), key=repr) == want, name


def test_score_ranks_equal_numpy(spark):
    """AUC with ties and exact quantiles of several scores, from ranges much smaller than the table."""
    from threadloom.operators import stats as S

    rng = np.random.default_rng(4)
    x = np.stack([rng.normal(size=3000), rng.integers(5, size=3000) / 4, np.where(rng.random(3000) < 0.4, np.nan, rng.normal(size=3000)), np.full(3000, np.nan)], axis=1)
    d = rng.integers(2, size=3000)
    table = spark.createDataFrame([(int(k), [float(v) for v in r]) for k, r in zip(d, x)], "d int, x array<double>")

    def scores(batch, these):
        return batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(-1, 4)[:, these]

    got = S.score_ranks(table, scores, ["a", "b", "c", "none"], [0.0, 0.2, 0.5, 1.0], size=100, together=3)
    assert got["none"] == (None, [])
    for k, name in enumerate("abc"):
        own = ~np.isnan(x[:, k])
        ones, zeros = x[own & (d == 1), k], x[own & (d == 0), k]
        auc = (ones[:, None] > zeros).mean() + (ones[:, None] == zeros).mean() / 2
        assert abs(got[name][0] - auc) < 1e-12 and np.allclose(got[name][1], np.quantile(x[own, k], [0, 0.2, 0.5, 1]), atol=1e-12)
