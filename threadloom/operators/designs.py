"""Families of models over the same rows: moderated effects with bootstrapped errors, ablations of blocks of columns."""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators import linear as L
from threadloom.operators import stats as S
from threadloom.sources.io import cut


def multiplicities(keys: np.ndarray, replicates: int, first: int = 0) -> np.ndarray:
    """Poisson(1) draws (keys x replicates) that depend on the 64-bit key and the number of the replicate alone."""
    steps = np.arange(first + 1, first + replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = keys.astype(np.int64).view(np.uint64)[:, None] + steps[None]
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53
    return np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]), u, side="right").astype(float)


def moderation(
    rows: DataFrame, moderators: Sequence[str], outcomes: Sequence[str], stratum: str = "stratum", cluster: str = "cluster", replicates: int = 0, seed: int = 42
) -> DataFrame:
    """Effects of d on each outcome where a moderator is 0 (beta_d), and their change with it (beta_dxm): least squares of the outcome on
    d, the moderator and their product within strata (each stratum has an intercept of its own).

    With replicates there are also the bootstrap's mean, error and 95 % interval under resampling of clusters; a cluster's multiplicity
    is a Poisson(1) draw from its hash, so a task weighs its own rows and nothing is gathered. All models come from one pass: a task adds up the products
    of all columns for each replicate, and column sums for each stratum. Rows with a null among the cells are left out; a
    singular system gives null.
    """
    spark, m, o = rows.sparkSession, len(moderators), len(outcomes)
    p = 2 + 2 * m + o
    upper = np.triu_indices(p)
    names = sorted(r[0] for r in rows.select(stratum).distinct().collect() if r[0] is not None)  # a row for each stratum
    picked = rows.filter(F.col(stratum).isNotNull()).select(L._vector(["d", *moderators, *outcomes]).alias("v"), F.col(stratum).alias("s"), F.xxhash64(F.lit(seed), F.col(cluster)).alias("c"))
    draws, places = replicates + 1, len(names)
    width = draws * (len(upper[0]) + places * p)

    def run(batches):
        import pyarrow as pa

        products, sums = np.zeros((draws, len(upper[0]))), np.zeros((places, draws, p))
        for batch in batches:
            v = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 1 + m + o)
            at = np.searchsorted(np.array(names), batch.column(1).to_numpy(zero_copy_only=False))
            keys = batch.column(2).to_numpy(zero_copy_only=False)
            fine = ~np.isnan(v).any(1)
            v, at, keys = v[fine], at[fine], keys[fine]
            x = np.concatenate([np.ones((len(v), 1)), v[:, : 1 + m], v[:, :1] * v[:, 1 : 1 + m], v[:, 1 + m :]], axis=1)
            for a in range(0, len(x), 2_000):
                part, where = x[a : a + 2_000], at[a : a + 2_000]
                w = np.concatenate([np.ones((len(part), 1)), multiplicities(keys[a : a + 2_000], replicates)], axis=1)
                products += w.T @ (part[:, upper[0]] * part[:, upper[1]])
                for s in np.unique(where).tolist():
                    sums[s] += w[where == s].T @ part[where == s]
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([products.ravel(), sums.ravel()])], pa.list_(pa.float64()))], names=["g"])

    row = L._added(picked, "g array<double>", run, []).first()
    flat = np.array(row.g if row and row.g else np.zeros(width))
    g = np.zeros((draws, p, p))
    g[:, upper[0], upper[1]] = flat[: draws * len(upper[0])].reshape(draws, -1)
    g = g + np.triu(g, 1).transpose(0, 2, 1)
    for own in flat[draws * len(upper[0]) :].reshape(places, draws, p):
        g -= own[:, :, None] * own[:, None, :] / np.maximum(own[:, :1, None], 1e-300)
    out = []
    for k, moderator in enumerate(moderators):
        at = [1, 2 + k, 2 + m + k]
        xx, xy = g[:, at][:, :, at], g[:, at][:, :, 2 + 2 * m :]
        size = np.prod(np.einsum("rii->ri", xx), axis=1)
        sound = np.abs(np.linalg.det(xx)) > 1e-12 * np.maximum(size, 1e-300)
        beta = np.full((draws, 3, o), np.nan)
        beta[sound] = np.linalg.solve(xx[sound], xy[sound])
        for j, outcome in enumerate(outcomes):
            b_d, b_x, drawn = float(beta[0, 0, j]), float(beta[0, 2, j]), beta[1:, 2, j]
            drawn = drawn[~np.isnan(drawn)]
            found = [float(drawn.mean()), float(drawn.std(ddof=1)), *map(float, np.percentile(drawn, [2.5, 97.5]))] if len(drawn) > 1 else [None] * 4
            clear = None if found[2] is None else found[2] > 0 or found[3] < 0
            out.append((moderator, outcome, *(None if math.isnan(b) else b for b in (b_d, b_x)), *found, clear))
    return spark.createDataFrame(out, "moderator string, outcome string, beta_d double, beta_dxm double, boot_mean double, boot_se double, ci_low double, ci_high double, significant boolean")


def ablation(
    rows: DataFrame, unions: dict[str, Sequence[str]], outcome: str, id_column: str = "id", cluster: str = "cluster", folds: int = 5, strata: int = 5, replicates: int = 500, bound: float = 0.1
) -> DataFrame:
    """For each named set of columns: p, auc of the out-of-fold propensity from them, att of the outcome over its strata with a clustered
    interval, sig, and smd_above, how many of the columns differ by more than the bound within strata.

    The sets' logistic regressions take their steps in the same passes, for all folds; scores are in one long table (a row for each unit and
    set, of an id, the outcome and the score); the balance is a pass in which each task adds up the columns by set, stratum and arm. The
    driver holds coefficients and edges. Rows with a null among the cells are left out.
    """
    columns = list(dict.fromkeys(c for u in unions.values() for c in u))
    at = {name: [columns.index(c) for c in u] for name, u in unions.items()}
    z = L.stratified_folds(L.standardise(rows.withColumns({c: F.col(c).cast("double") for c in columns}), columns).select(id_column, F.col(cluster).alias("cluster"), "d", F.col(outcome).cast("double").alias("y"), *columns), folds, "d", id_column, out="__fold")
    z = cut(z.filter("d IS NOT NULL").select("cluster", F.col("d").cast("int").alias("d"), L._vector([*columns, F.lit(1.0), "d"]).alias("v"), F.array("__fold").alias("folds"), F.array("y").alias("ys")))
    p, names = len(columns) + 1, list(unions)
    models = [(np.array([*at[name], p - 1]), 0, k) for name in names for k in range(folds)]
    betas = np.zeros((len(names), folds, p))
    for (cells, _, k), m, beta in zip(models, np.repeat(range(len(names)), folds), L.logistic_models(z, p, models)):
        betas[m, k, cells] = beta

    def scores(batch, these):
        v, own, d = _cells(batch)
        s = np.full((len(v), len(these)), np.nan)
        for k in range(folds):
            mine = (own[:, 0] == k) & ~np.isnan(v).any(1)
            s[mine] = _expit(v[mine, :p] @ betas[these, k].T)
        return d, s

    facts, binned, above = _families(z, scores, names, {n: strata for n in names}, at, bound)
    long = binned(["y"], "model")
    att = S.strat_att(S.stratum_sums(long, ["y"], ["model"]), ["model"])
    ci = S.cluster_bootstrap(long, ["y"], replicates=replicates, keys=["model"], placed=True).select("model", "ci_low", "ci_high")
    table = rows.sparkSession.createDataFrame([(n, len(at[n]), facts[n][0], above[n][2]) for n in names], "model string, p int, auc double, smd_above int")
    out = table.join(att, "model").join(ci, "model", "left")
    return out.select("model", "p", "auc", "att", "ci_low", "ci_high", S.significant(F.col("ci_low"), F.col("ci_high")).alias("sig"), "smd_above")


def _expit(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def _cells(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """v, folds and d of a batch of (cluster, d, v, folds, ys)."""
    n = batch.num_rows
    v = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
    return v, batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(n, -1), batch.column(1).to_numpy(zero_copy_only=False)


def _families(base: DataFrame, scores, names: list[str], strata: dict[str, int], at: dict[str, list[int]], bound: float):
    """Of many scores of a stored table (cluster, d, v, folds, ys): AUC and edges of each; a function to rows of (cluster, d, outcomes, score's name, stratum),
    which stand by cluster; and by score n, treated and how many of its columns differ by more than the bound within strata.

    The table is exchanged by cluster with a number of a stratum for each score; only a task's own memory ever has a row for each score.
    """
    steps = sorted({i / k for k in strata.values() for i in range(k + 1)})
    facts, edges = S.score_ranks(base, scores, names, steps), []
    for n in names:
        own = list(dict.fromkeys(facts[n][1][steps.index(i / strata[n])] + 0.0 for i in range(strata[n] + 1))) if facts[n][1] else []
        edges.append(np.array(own))
    most, every = max(strata.values(), default=1), list(range(len(names)))

    def strata_of(batch):
        d, s = scores(batch, every)
        found = np.full(s.shape, -1, np.int8)
        for m, e in enumerate(edges):
            fine = ~np.isnan(s[:, m])
            found[fine, m] = np.searchsorted(e[1:-1], s[fine, m], side="left") if len(e) > 1 else -2
        return d, found

    def number(batches):
        import pyarrow as pa

        for batch in batches:
            codes = strata_of(batch)[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), pa.array(list(codes), pa.list_(pa.int8()))], names=["cluster", "d", "ys", "codes"])

    def arms(batches):
        import pyarrow as pa

        held = {n: np.zeros((most + 1, 2, 1 + 2 * len(c))) for n, c in at.items()}
        for batch in batches:
            v = _cells(batch)[0]
            d, codes = strata_of(batch)
            for m, n in enumerate(names):
                fine = codes[:, m] != -1
                place = 2 * np.where(codes[fine, m] < 0, most, codes[fine, m]) + d[fine]
                x = v[fine][:, at[n]]
                one = np.concatenate([np.ones((len(x), 1)), x, x * x], axis=1)
                for k in np.unique(place).tolist():
                    held[n][k // 2, k % 2] += one[place == k].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([h.ravel() for h in held.values()], pa.list_(pa.float64()))], names=["model", "g"])

    above = {}
    for r in L._added(base, "model string, g array<double>", arms, ["model"]).collect():  # a row for each score
        p = len(at[r.model])
        g = np.array(r.g).reshape(most + 1, 2, 1 + 2 * p)
        n, s = g[:, :, 0], g[:, :, 1 : 1 + p]
        whole = g.sum(0)
        mean = whole[:, 1 : 1 + p] / np.maximum(whole[:, :1], 1)
        pooled = np.sqrt(np.maximum(whole[:, 1 + p :] / np.maximum(whole[:, :1], 1) - mean**2, 0).mean(0))
        both = (n > 0).all(1)
        weight = n.sum(1)[both]
        means = s[both] / n[both][:, :, None]
        within = np.abs((weight[:, None] * (means[:, 1] - means[:, 0])).sum(0)) / max(weight.sum(), 1)
        above[r.model] = (int(n.sum()), int(n[:, 1].sum()), int((within[pooled > 1e-12] / pooled[pooled > 1e-12] > bound).sum()), int((n.sum(1)[:most] > 0).sum()))
    kind, ys = base.schema["cluster"].dataType.simpleString(), base.schema["ys"].dataType.simpleString()
    wide = cut(base.mapInArrow(number, f"cluster {kind}, d int, ys {ys}, codes array<tinyint>"))

    def binned(outcomes, label):
        each = wide.repartition("cluster").select("cluster", "d", *[F.get("ys", F.lit(i)).alias(o) for i, o in enumerate(outcomes)], F.posexplode("codes").alias("__m", "stratum")).filter("stratum <> -1")
        return each.withColumn("stratum", F.when(F.col("stratum") >= 0, F.col("stratum").cast("int"))).withColumn(label, F.get(F.array(*[F.lit(n) for n in names]), F.col("__m"))).drop("__m")

    return facts, binned, above


def group_effects(
    rows: DataFrame, columns: Sequence[str], groups: dict[str, Column], outcomes: Sequence[str], id_column: str = "id", cluster: str = "cluster",
    strata: int = 5, folds: int = 5, least: int = 50, replicates: int = 500, bound: float = 0.1,
) -> tuple[DataFrame, DataFrame]:
    """Effects within overlapping groups from propensities refitted in each: a table by subgroup and outcome, and one of diagnostics.

    Effects: n, treated, control, control_mean, treated_mean, att, ci_low, ci_high (clustered bootstrap), cohen_d, sig. Diagnostics: n,
    treated, control, auc, k and smd_above. A group has min(strata, max(3, controls / 30)) strata by quantiles of its own scores;
    groups with less than `least` rows in either arm are left out. All groups share the passes over the rows.
    """
    label = "subgroup"
    rules = {n: F.coalesce(r.cast("boolean"), F.lit(False)) for n, r in groups.items()}
    sizes = rows.agg(*[F.count_if(r & (F.col("d") == k)).alias(f"{k}_{i}") for i, r in enumerate(rules.values()) for k in (0, 1)]).first()
    names = sorted(n for i, n in enumerate(groups) if min(sizes[f"0_{i}"], sizes[f"1_{i}"]) >= least)
    if not names:
        means = ", ".join(f"{c} double" for c in ("control_mean", "treated_mean", "att", "ci_low", "ci_high", "cohen_d"))
        counts = "n long, treated long, control long"
        return tuple(rows.sparkSession.createDataFrame([], f"{label} string, {rest}") for rest in (f"outcome string, {counts}, {means}, sig string", f"{counts}, auc double, k long, smd_above long"))
    p, ys = len(columns) + 1, [F.col(o).cast("double") for o in outcomes]
    picked = rows.select(F.col(id_column).alias("__id"), F.col(cluster).alias("cluster"), F.col("d").cast("int").alias("d"), L._vector([*columns, F.lit(1.0), "d"]).alias("v"), F.array(*ys).alias("ys"), *[rules[n].alias(f"__r{i}") for i, n in enumerate(names)])
    folded = L.overlapping_folds(picked, {n: F.col(f"__r{i}") for i, n in enumerate(names)}, folds, "d", "__id", keep=["cluster", "d", "v", "ys"])
    base = cut(folded.filter("d IS NOT NULL").select("cluster", "d", "v", F.transform("folds", lambda k: F.coalesce(k, F.lit(L.OUTSIDE))).alias("folds"), "ys"))
    member = lambda i, c: F.when(F.get("folds", F.lit(i)) >= 0, F.get("v", F.lit(c)))
    stats = base.agg(*[f(member(i, c)).alias(f"{k}_{i}_{c}") for i in range(len(names)) for c in range(p - 1) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    or_zero = lambda x: 0.0 if x is None else x
    scales = []
    for i in range(len(names)):
        mean, spread = ([or_zero(stats[f"{k}_{i}_{c}"]) for c in range(p - 1)] for k in "ms")
        scales.append((np.array([*mean, 0.0]), np.array([*[s if s > 1e-12 else 1.0 for s in spread], 1.0])))
    models = [(np.arange(p), g, k) for g in range(len(names)) for k in range(folds)]
    betas = np.array(L.logistic_models(base, p, models, scales)).reshape(len(names), folds, p)

    def scores(batch, these):
        v, own, d = _cells(batch)
        fine, s = ~np.isnan(v).any(1), np.full((len(v), len(these)), np.nan)
        for j, g in enumerate(these):
            mine = fine & (own[:, g] >= 0)
            s[mine, j] = _expit((((v[mine, :p] - scales[g][0]) / scales[g][1]) * betas[g, own[mine, g]]).sum(1))
        return d, s

    sound = F.forall("v", lambda x: x.isNotNull())
    found = base.filter(sound).agg(*[F.count_if((F.get("folds", F.lit(i)) >= 0) & (F.col("d") == 0)).alias(f"n_{i}") for i in range(len(names))]).first()
    wanted = {n: min(strata, max(3, found[f"n_{i}"] // 30)) for i, n in enumerate(names)}
    facts, binned, above = _families(base, scores, names, wanted, {n: list(range(p - 1)) for n in names}, bound)
    long, keys = binned(list(outcomes), label), [label, "outcome"]
    sums = S.stratum_sums(long, list(outcomes), [label])
    means = S.naive_difference(sums, keys).select(*keys, "control_mean", "treated_mean", "control_sd")
    ci = S.cluster_bootstrap(long, list(outcomes), replicates=replicates, keys=[label], placed=True).select(*keys, "ci_low", "ci_high")
    spark = rows.sparkSession
    diagnostics = spark.createDataFrame([(n, above[n][0], above[n][1], above[n][0] - above[n][1], facts[n][0], above[n][3], above[n][2]) for n in names], f"{label} string, n long, treated long, control long, auc double, k long, smd_above long")
    effects = S.strat_att(sums, keys).join(means, keys).join(ci, keys, "left").join(diagnostics.select(label, "n", "treated", "control"), label)
    effects = effects.select(
        *keys, "n", "treated", "control", "control_mean", "treated_mean", "att", "ci_low", "ci_high",
        F.when(F.col("control_sd") > 0, F.col("att") / F.col("control_sd")).otherwise(0.0).alias("cohen_d"), S.significant(F.col("ci_low"), F.col("ci_high")).alias("sig"),
    )
    return effects, diagnostics


# What tasks call travels with them: executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
