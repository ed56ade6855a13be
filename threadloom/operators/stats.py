"""Statistics as aggregations: quantile bins, agreement, stratified effects, balance, ranks, sensitivity, bootstrap."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.operators.draws import POISSON, added_sums, weighted_sums  # noqa: F401  the SQL takes the thresholds from here

#: Steps of the integrals of p-values.
P_STEPS = 2000


def meet(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left with right's other columns, where the keys are equal or both null; without keys right is one row."""
    if not keys:
        return left.join(F.broadcast(right), F.lit(True), how)
    named = right.select(*[F.col(k).alias(f"__of_{k}") if k in keys else F.col(k) for k in right.columns])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    return left.join(named, same, how).drop(*[f"__of_{k}" for k in keys])


def cumulative(counts: DataFrame, x: str, columns: list[str], group: list[str] = ()) -> DataFrame:
    """counts (one row for each group and x) with below_c: the sum of c over the group's smaller x.

    Rows are cut into ranges of (group, x); each range adds up its own rows, and what lies before it comes from the ranges' totals. No
    task sees more than one range, or one row for each range, however many values there are.
    """
    from threadloom.sources.io import cut

    parts = cut(counts.repartitionByRange(*group, x).withColumn("__range", F.spark_partition_id()))
    totals = parts.groupBy(*group, "__range").agg(*[F.sum(c).alias(f"__t_{c}") for c in columns])
    earlier = W.partitionBy(*group).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    totals = totals.select(*group, "__range", *[F.coalesce(F.sum(f"__t_{c}").over(earlier), F.lit(0)).alias(f"__e_{c}") for c in columns])
    own = W.partitionBy(*group, "__range").orderBy(x).rowsBetween(W.unboundedPreceding, -1)
    below = {f"below_{c}": F.col(f"__e_{c}") + F.coalesce(F.sum(c).over(own), F.lit(0)) for c in columns}
    return meet(parts, totals, [*group, "__range"]).select(*counts.columns, *[c.alias(k) for k, c in below.items()])


def quantiles(rows: DataFrame, x: str, at: list[float], group: list[str] = (), out: str = "quantiles") -> DataFrame:
    """Exact linear-interpolated quantiles of x per group as an array, nulls left out; groups of nulls have none (no row without rows).

    Values are counted, ranked by cumulative(), and only those at the wanted ranks go on: two rows for each quantile.
    """
    counts = rows.filter(F.col(x).isNotNull()).groupBy(*group, x).agg(F.count("*").alias("n"))
    ranked = cumulative(counts, x, ["n"], group)
    sizes = ranked.groupBy(*group).agg(F.sum("n").alias("__size"))
    joined = meet(ranked, sizes, list(group))
    wanted = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(len(at) - 1)), lambda k: F.struct(k.alias("k"), (F.get(F.array(*[F.lit(float(p)) for p in at]), k) * (F.col("__size") - 1)).alias("p"))),
        lambda w: (F.floor(w["p"]) < F.col("below_n") + F.col("n")) & (F.ceil(w["p"]) >= F.col("below_n")),
    )
    hits = joined.select(*group, F.col(x).cast("double").alias("__x"), "n", "below_n", F.explode(wanted).alias("w"))
    low = F.max(F.when((F.floor("w.p") >= F.col("below_n")) & (F.floor("w.p") < F.col("below_n") + F.col("n")), F.col("__x")))
    high = F.max(F.when((F.ceil("w.p") >= F.col("below_n")) & (F.ceil("w.p") < F.col("below_n") + F.col("n")), F.col("__x")))
    at_p = F.first("w.p")
    # The two neighbours, each times its nearness.
    value = F.when(F.floor(at_p) == F.ceil(at_p), low).when(low == high, low).otherwise((F.ceil(at_p) - at_p) * low + (at_p - F.floor(at_p)) * high)
    each = hits.groupBy(*group, F.col("w.k").alias("k")).agg(value.alias("v"))
    return each.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias(out)).filter(F.size(out) > 0)


def qcut_edges(rows: DataFrame, x: str, k: int, group: list[str] = ()) -> DataFrame:
    """Distinct linear-interpolated quantiles of x at 0, 1/k ... 1 per group."""
    edges = quantiles(rows, x, [i / k for i in range(k + 1)], group, "edges")
    return edges.withColumn("edges", F.array_distinct(F.transform("edges", lambda e: e + F.lit(0.0))))  # -0.0 is 0.0


def bin_of(x: Column, edges: Column) -> Column:
    """Number of inner edges below x: right-closed bins, the least value in the first; null if fewer than two edges are distinct."""
    inner = F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.when(F.size(edges) > 1, F.aggregate(inner, F.lit(0), lambda n, e: n + (x > e).cast("int")))


def qcut(rows: DataFrame, x: str, k: int, out: str, group: list[str] = ()) -> DataFrame:
    """rows with the quantile bin of x, within groups if given. Edges are k + 1 numbers for each group."""
    edges = qcut_edges(rows, x, k, list(group))
    joined = rows.join(edges, list(group)) if group else rows.join(F.broadcast(edges), F.lit(True), "left")  # one row of edges
    return joined.withColumn(out, bin_of(F.col(x), F.col("edges"))).drop("edges")


def confusion(rows: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per dimension with counts yy, yn, ny, nn of two Y/N columns; a single scan."""
    parts = [F.struct(F.lit(k).alias("dimension"), F.col(a).alias("a"), F.col(b).alias("b")) for k, (a, b) in pairs.items()]
    long = rows.select(F.explode(F.array(*parts)).alias("p")).select("p.*")
    n = lambda a, b: F.count_if((F.col("a") == a) & (F.col("b") == b))
    return long.groupBy("dimension").agg(n("Y", "Y").alias("yy"), n("Y", "N").alias("yn"), n("N", "Y").alias("ny"), n("N", "N").alias("nn"))


def kappa(yy: Column, yn: Column, ny: Column, nn: Column) -> Column:
    """Cohen's kappa; 1 if chance agreement is 1."""
    n = yy + yn + ny + nn
    po = (yy + nn) / n
    pe = ((yy + yn) * (yy + ny) + (yn + nn) * (ny + nn)) / (n * n)
    return F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe))


def stratum_sums(rows: DataFrame, outcomes: list[str], keys: list[str] = (), stratum: str = "stratum") -> DataFrame:
    """Per keys, outcome and stratum: n and mean of y by arm. The only pass over the rows that estimators need."""
    parts = F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(o).cast("double").alias("y")) for o in outcomes])
    long = rows.select(*keys, stratum, "d", F.explode(parts).alias("o"))
    arm = lambda d: F.when(F.col("d") == d, F.col("o.y"))
    return long.filter(F.col("o.y").isNotNull() & F.col(stratum).isNotNull()).groupBy(*keys, F.col("o.outcome").alias("outcome"), stratum).agg(
        F.count(arm(1)).alias("n_t"), F.count(arm(0)).alias("n_c"), F.sum(arm(1)).alias("y_t"), F.sum(arm(0)).alias("y_c"),
        F.coalesce(F.var_pop(arm(1)), F.lit(0.0)).alias("v_t"), F.coalesce(F.var_pop(arm(0)), F.lit(0.0)).alias("v_c"),
    )


def strat_att(sums: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """Mean treated-weighted difference over strata with at least so many in each arm; null without such strata."""
    fine = (F.col("n_t") >= least) & (F.col("n_c") >= least)
    diff = F.col("n_t") * (F.col("y_t") / F.col("n_t") - F.col("y_c") / F.col("n_c"))
    return sums.groupBy(*keys).agg((F.sum(F.when(fine, diff)) / F.sum(F.when(fine, F.col("n_t")))).alias("att"))


def naive_difference(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Raw difference of arm means, and its size in standard deviations (population) of the controls; 0 without spread."""
    n_t, n_c = F.sum("n_t"), F.sum("n_c")
    m_t, m_c = F.try_divide(F.sum("y_t"), n_t), F.try_divide(F.sum("y_c"), n_c)
    second = F.try_divide(F.sum(F.col("n_c") * F.col("v_c") + F.when(F.col("n_c") > 0, F.col("y_c") * F.col("y_c") / F.col("n_c")).otherwise(0.0)), n_c)
    sd = F.sqrt(F.greatest(second - m_c * m_c, F.lit(0.0)))
    return sums.groupBy(*keys).agg((m_t - m_c).alias("naive"), m_t.alias("treated_mean"), m_c.alias("control_mean"), sd.alias("control_sd")).withColumn(
        "cohen_d", F.when(F.col("control_sd") > 1e-12, F.col("naive") / F.col("control_sd")).otherwise(0.0)
    )


def strata_table(rows: DataFrame, stratum: str = "stratum", score: str = "ps") -> DataFrame:
    n, t = F.count("*"), F.sum("d")
    return rows.groupBy(stratum).agg(n.alias("n"), t.alias("treated"), (n - t).alias("control"), F.bround(100 * t / n, 1).alias("treated_pct"), F.min(score).alias("ps_min"), F.max(score).alias("ps_max"))


def balance(rows: DataFrame, covariates: list[str], stratum: str = "stratum", signed: bool = False, group: list[str] = ()) -> DataFrame:
    """Standardised mean differences per covariate (by groups if given), raw and within strata (weighted by stratum size); pooled spread of 0 gives 0."""
    group = list(group)
    parts = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("x")) for c in covariates])
    long = rows.select(*group, stratum, "d", F.explode(parts).alias("c")).select(*group, stratum, "d", "c.*")
    arm = lambda d: F.when(F.col("d") == d, F.col("x"))
    by = long.groupBy(*group, "variable", stratum).agg(
        F.count("*").alias("n"), F.avg(arm(1)).alias("t"), F.avg(arm(0)).alias("c"), F.count(arm(1)).alias("n_t"), F.count(arm(0)).alias("n_c"),
    )
    whole = long.groupBy(*group, "variable").agg(F.avg(arm(1)).alias("mt"), F.avg(arm(0)).alias("mc"), F.sqrt((F.var_pop(arm(1)) + F.var_pop(arm(0))) / 2).alias("pooled"))
    fine = (F.col("n_t") > 0) & (F.col("n_c") > 0)
    within = by.groupBy(*group, "variable").agg((F.sum(F.when(fine, F.col("n") * (F.col("t") - F.col("c")))) / F.sum(F.when(fine, F.col("n")))).alias("within"))
    out = meet(whole, within, [*group, "variable"])
    size = (lambda x: x) if signed else F.abs
    scaled = lambda x: F.when(F.col("pooled") > 0, F.coalesce(size(x) / F.col("pooled"), F.lit(0.0))).otherwise(0.0)
    return out.select(*group, "variable", scaled(F.col("mt") - F.col("mc")).alias("raw"), scaled(F.col("within")).alias("strat"))


def auc(rows: DataFrame, score: str = "ps", group: list[str] = ()) -> DataFrame:
    """Area under the ROC curve with ties at half. Rows are counted by score; the running sum over scores is by ranges."""
    by = rows.groupBy(*group, score).agg(F.sum("d").cast("double").alias("n1"), (F.count("*") - F.sum("d")).cast("double").alias("n0"))
    return cumulative(by, score, ["n0"], group).groupBy(*group).agg(F.try_divide(F.sum(F.col("n1") * (F.col("below_n0") + F.col("n0") / 2)), F.sum("n1") * F.sum("n0")).alias("auc"))


def average_ranks(rows: DataFrame, x: str, out: str, group: list[str] = ()) -> DataFrame:
    """rows with the rank of x within its group, ties at their mean; rows without x are left out."""
    ranked = cumulative(rows.filter(F.col(x).isNotNull()).groupBy(*group, x).agg(F.count("*").alias("n")), x, ["n"], group)
    return meet(rows, ranked, [*group, x]).select(*rows.columns, (F.col("below_n") + (F.col("n") + 1) / 2).alias(out))


def spearman(rows: DataFrame, x: str, y: str, group: list[str] = ()) -> DataFrame:
    """Rank correlation with average ranks for ties, the number of rows and the two-sided p-value by Student's t; constant input gives null,
    and so do fewer than three rows for p. Ranks are joined by value, so no task sorts a whole group."""
    r = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*group, F.col(x).alias("__u"), F.col(y).alias("__v"))
    r = average_ranks(average_ranks(r, "__u", "__x", group), "__v", "__y", group)
    rho = F.try_divide(F.covar_pop("__x", "__y"), F.stddev_pop("__x") * F.stddev_pop("__y"))
    out = r.groupBy(*group).agg(rho.alias("rho"), F.count("*").alias("n"))
    return out.withColumn("p_value", correlation_p(F.col("rho"), F.col("n")))


def correlation_p(rho: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation of n pairs by Student's t with n - 2 degrees of freedom.

    With t = sqrt(df) tan(a) the tail is a ratio of integrals of cos(a) ** (df - 1), here of a = z / sqrt(df) by Simpson's rule on P_STEPS
    steps, up to z = 40 or the end of the range. Null without a correlation or with fewer than three pairs.
    """
    df = (n - 2).cast("double")
    root = F.sqrt(df)
    end = F.least(root * F.lit(math.pi / 2), F.lit(40.0))
    start = F.least(F.when(F.abs(rho) >= 1 - 1e-15, end).otherwise(root * F.asin(F.least(F.abs(rho), F.lit(1.0)))), end)

    def integral(a: Column) -> Column:
        h = (end - a) / P_STEPS
        f = lambda k: F.pow(F.greatest(F.cos((a + k * h) / root), F.lit(0.0)), df - 1)
        weight = lambda k: F.when((k == 0) | (k == P_STEPS), 1).when(k % 2 == 1, 4).otherwise(2)
        return F.aggregate(F.sequence(F.lit(0), F.lit(P_STEPS)), F.lit(0.0), lambda s, k: s + weight(k) * f(k)) * h / 3

    return F.when(rho.isNotNull() & (n > 2), integral(start) / integral(F.lit(0.0)))


def e_value(att: Column, low: Column) -> dict[str, Column]:
    """Strength that confounding would need, of the risk ratio 1 + att and of its lower bound; defined for positive effects."""
    e = lambda rr: rr + F.sqrt(rr * (rr - 1))
    return {"e_value": F.when(att > 0, e(1 + att)), "e_value_low": F.when(att > 0, F.when(low > 0, e(1 + low)).otherwise(1.0))}


def significant(low: Column, high: Column) -> Column:
    return F.when((low > 0) | (high < 0), "*").otherwise("")


def normal_tail(z: Column) -> Column:
    """1 - Phi(z) by the rational form of Abramowitz and Stegun 26.2.17 (error under 7.5e-8)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def rosenbaum(sums: DataFrame, gammas: list[float], keys: list[str], parity: bool = False) -> DataFrame:
    """p-values of the stratified difference per gamma. parity: gamma plays no part, as in the published table; else z is shrunk by log(gamma)'s bound on the mean."""
    n_t, n_c = F.col("n_t"), F.col("n_c")
    fine = (n_t > 0) & (n_c > 0)
    total = F.sum(F.when(fine, n_t * (F.col("y_t") / n_t - F.col("y_c") / n_c)))
    spread = F.sum(F.when((n_t > 1) & (n_c > 1), n_t * (F.col("v_t") / n_t + F.col("v_c") / n_c)))
    out = sums.groupBy(*keys).agg(total.alias("t"), spread.alias("v"), F.sum(F.when(fine, n_t)).alias("n")).withColumn("gamma", F.explode(F.array(*[F.lit(float(g)) for g in gammas])))
    shift = F.lit(0.0) if parity else F.col("n") * ((F.col("gamma") - 1) / (F.col("gamma") + 1)) / 2
    z = (F.col("t") - shift) / F.sqrt("v")
    return out.select(*keys, "gamma", F.when(F.col("v") > 0, normal_tail(z)).alias("p_value"))


def anchor_lags(lags: DataFrame, units: DataFrame, draws: int = 20) -> DataFrame:
    """Lags (us) for units without one: sampled (an observed lag, by a hash of id and draw), median, p25, p75, zero.

    lags: (lag), units: (id). A draw is a rank; ranks meet the observed lag that covers them by an equi-join: distinct lags are numbered
    by cumulative() and cut into blocks of ranks, of which a frequent lag has several.
    """
    counts = lags.filter("lag IS NOT NULL").groupBy("lag").agg(F.count("*").alias("n"))
    ranked = cumulative(counts, "lag", ["n"]).select("lag", F.col("below_n").alias("low"), (F.col("below_n") + F.col("n")).alias("high"))
    size = int(ranked.agg(F.max("high")).first()[0] or 0)
    block = max(1, size // 4096)
    spread = ranked.withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / block), F.floor((F.col("high") - 1) / block))))
    kinds = [("sample", 0), *(("mean20", k) for k in range(1, draws + 1))]
    drawn = units.select("id", F.explode(F.array(*[F.struct(F.lit(s).alias("strategy"), F.lit(k).alias("draw")) for s, k in kinds])).alias("k"))
    drawn = drawn.withColumn("rank", F.floor(uniform(F.col("id"), F.col("k.draw")) * max(size, 1)).cast("long")).withColumn("block", F.floor(F.col("rank") / block))
    sampled = drawn.join(spread, (drawn["block"] == spread["block"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")), "left").select("id", "k.strategy", "k.draw", F.col("lag").cast("double").alias("lag"))
    found = quantiles(lags, "lag", [0.5, 0.25, 0.75]).first()
    middle = list(found[0]) if found else [None] * 3
    fixed = F.array(*[F.struct(F.lit(s).alias("strategy"), F.lit(0).alias("draw"), F.lit(v).cast("double").alias("lag")) for s, v in zip(("median", "p25", "p75", "zero"), [*middle, 0.0])])
    return sampled.union(units.select("id", F.explode(fixed).alias("k")).select("id", "k.strategy", "k.draw", "k.lag"))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts, joined by hyphens: its first 13 digits."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("long") / F.lit(float(16**13))


def bootstrap_effects(rows: DataFrame, outcomes: list[str], cluster: str = "cluster", stratum: str = "stratum", replicates: int = 500, seed: int = 42, keys: list[str] = (), placed: bool = False) -> DataFrame:
    """(keys, outcome, r, att): strat_att() of each replicate under resampling of clusters with replacement; strata stay as they are.

    Rows are summed by cluster, stratum and arm first. A cluster's multiplicity in a replicate is a Poisson(1) draw from the md5 of (seed,
    replicate, cluster), the large-sample form of drawing as many clusters as there are: every cluster draws for itself, so
    nothing is gathered, and all keys share a draw. A task multiplies its clusters' draws and sums as matrices, and hands on one row for
    each of its keys and strata. placed: rows stand by cluster already. Replicates without an effect are left out; a null cluster is one of its own.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    ys = [f"__y{i}" for i in range(len(outcomes))]
    narrow = rows.select(F.col(cluster).alias("__c"), F.col(stratum).alias("__s"), F.col("d").alias("__d"), *[F.col(k).alias(n) for k, n in zip(keys, names)], *[F.col(o).cast("double").alias(y) for o, y in zip(outcomes, ys)])
    narrow = narrow.filter(F.col("__s").isNotNull() & F.coalesce(*[F.col(y) for y in ys]).isNotNull())
    arm = lambda d, y: F.when(F.col("__d") == d, F.col(y))
    cells = [c for y in ys for c in (F.count(arm(1, y)).cast("double"), F.count(arm(0, y)).cast("double"), F.coalesce(F.sum(arm(1, y)), F.lit(0.0)), F.coalesce(F.sum(arm(0, y)), F.lit(0.0)))]
    # One exchange, by cluster: its sums and its draws are made where its rows are.
    sums = (narrow if placed else narrow.repartition("__c")).groupBy("__c", *names, "__s").agg(*[c.alias(f"__v{i}") for i, c in enumerate(cells)])
    held = sums.sortWithinPartitions("__c").select(F.col("__c").cast("string").alias("__c"), *names, "__s", F.array(*[f"__v{i}" for i in range(len(cells))]).alias("v"))
    by, width = [*names, "__s"], len(cells)
    kinds = ", ".join(f"{c} {held.schema[c].dataType.simpleString()}" for c in by)
    drawn = held.mapInArrow(lambda batches: weighted_sums(batches, by, replicates, seed), f"{kinds}, g array<double>")
    added = drawn.repartition(*by).mapInArrow(lambda batches: added_sums(batches, by, width), f"{kinds}, r int, v array<double>")
    parts = [F.struct(F.lit(o).alias("outcome"), *[F.get("v", F.lit(4 * i + j)).alias(c) for j, c in enumerate(("n_t", "n_c", "y_t", "y_c"))]) for i, o in enumerate(outcomes)]
    each = added.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "r", F.col("__s").alias("s"), F.explode(F.array(*parts)).alias("o")).select(*keys, "r", "s", "o.*")
    whole = each.groupBy(*keys, "outcome", "r", "s").agg(*[F.sum(c).alias(c) for c in ("n_t", "n_c", "y_t", "y_c")])
    return strat_att(whole, [*keys, "outcome", "r"]).filter("att IS NOT NULL")


def score_ranks(base: DataFrame, scores, names: list[str], at: list[float], size: int = 1_000_000, together: int = 4) -> dict[str, tuple[float | None, list[float]]]:
    """For each of many scores of a stored table's rows its AUC and its exact, linear-interpolated quantiles.

    scores: from an Arrow batch and some of the names' numbers to the arms (0 or 1) and an array of rows x scores, NaN where a row has none. Scores
    are never rows: a task hands on its distinct ones with their counts, as arrays cut at the bounds of ranges of about `size` rows, and a range is
    counted on its own. Bounds come from order statistics of all rows; `together` scores are exchanged at a time. The driver has a row for
    each range, and 256 numbers for each task and score.
    """
    import numpy as np

    found: dict = {}
    for start in range(0, len(names), together):
        these = list(range(start, min(start + together, len(names))))

        def outline(batches, these=these):
            import pyarrow as pa

            held = {m: ([], []) for m in these}
            for batch in batches:
                s = scores(batch, these)[1]
                for j, m in enumerate(these):
                    x = np.sort(s[:, j][~np.isnan(s[:, j])])
                    if len(x):
                        k = min(64, len(x))
                        held[m][0].append(x[((np.arange(k) + 0.5) * len(x) / k).astype(int)])
                        held[m][1].append(np.full(k, len(x) / k))
            for m, (x, n) in held.items():
                if x:
                    x, n = np.concatenate(x), np.concatenate(n)
                    order = np.argsort(x)
                    ends = np.cumsum(n[order])
                    picked = x[order][np.minimum(np.searchsorted(ends, (np.arange(256) + 0.5) * ends[-1] / 256), len(x) - 1)]
                    yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([ends[-1]], pa.float64()), pa.array([picked], pa.list_(pa.float64()))], names=["m", "n", "x"])

        seen: dict = {m: [] for m in these}
        for r in base.mapInArrow(outline, "m int, n double, x array<double>").collect():  # a row for each task and score
            seen[r.m].append((r.n, r.x))
        bounds = {}
        for m, parts in seen.items():
            x = np.array([v for _, own in parts for v in own])
            n = np.array([k / 256 for k, own in parts for _ in own])
            order, pieces = np.argsort(x), max(1, int(np.ceil(n.sum() / size)))
            ends = np.cumsum(n[order])
            bounds[m] = np.unique(x[order][np.searchsorted(ends, np.arange(1, pieces) * ends[-1] / pieces)]) if pieces > 1 else np.zeros(0)

        def counted(wanted, these=these, bounds=bounds):
            def out(held):
                import pyarrow as pa

                rows = []
                for j, m in enumerate(these):
                    x, d = np.concatenate([s[:, j] for _, s in held]), np.concatenate([d for d, _ in held])
                    values, where = np.unique(x[~np.isnan(x)], return_inverse=True)
                    n1 = np.bincount(where, d[~np.isnan(x)] == 1, len(values)).astype(np.int32)
                    n = np.bincount(where, minlength=len(values)).astype(np.int32)
                    cuts = np.searchsorted(values, bounds[m], side="left")
                    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(values)])):
                        if b > a and (wanted is None or (m, k) in wanted):
                            rows.append((m, k, values[a:b], n1[a:b], n[a:b] - n1[a:b]))
                kinds = [pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
                columns = list(zip(*rows)) or [()] * 5
                return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds)], names=["m", "k", "x", "n1", "n0"])

            def run(batches):
                held, rows = [], 0
                for batch in batches:
                    held.append(scores(batch, these))
                    rows += len(held[-1][0])
                    if rows > 200_000:
                        yield out(held)
                        held, rows = [], 0
                if held:
                    yield out(held)

            return base.mapInArrow(run, "m int, k int, x array<double>, n1 array<int>, n0 array<int>").groupBy("m", "k")

        def merged(table):
            x, n1, n0 = (table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("x", "n1", "n0"))
            values, where = np.unique(x, return_inverse=True)
            return values, np.bincount(where, n1), np.bincount(where, n0)

        def pairs(table):
            import pyarrow as pa

            _, n1, n0 = merged(table)
            return pa.table({"m": table.column("m")[:1], "k": table.column("k")[:1], "n1": [float(n1.sum())], "n0": [float(n0.sum())], "u": [float((n1 * (np.cumsum(n0) - n0 / 2)).sum())]})

        ranges = sorted(counted(None).applyInArrow(pairs, "m int, k int, n1 double, n0 double, u double").collect())  # a row for each range
        wanted: dict = {}
        for m in these:
            own = [r for r in ranges if r.m == m]
            ones, zeros, below, total = sum(r.n1 for r in own), sum(r.n0 for r in own), 0.0, 0.0
            places = {int(f(q * (ones + zeros - 1))) for q in at for f in (np.floor, np.ceil)} if own else set()
            lower = 0
            for r in own:
                total, below = total + r.u + r.n1 * below, below + r.n0
                for place in places:
                    if lower <= place < lower + r.n1 + r.n0:
                        wanted.setdefault((m, r.k), []).append((place, int(place - lower)))
                lower += r.n1 + r.n0
            found[m] = (total / (ones * zeros) if ones * zeros else None, ones + zeros)

        def ranked(table):
            import pyarrow as pa

            values, n1, n0 = merged(table)
            m, k = table.column("m")[0].as_py(), table.column("k")[0].as_py()
            ends = np.cumsum(n1 + n0)
            places = wanted[m, k]
            return pa.table({"m": pa.array([m] * len(places), pa.int32()), "place": pa.array([p for p, _ in places], pa.int64()), "x": values[np.searchsorted(ends, [p for _, p in places], side="right")]})

        at_place = {(r.m, r.place): r.x for r in counted(wanted).applyInArrow(ranked, "m int, place long, x double").collect()} if wanted else {}  # two rows for each quantile
        for m in these:
            auc_of, n = found[m]
            cells = []
            for q in at if n else ():
                p = q * (n - 1)
                low, high = at_place[m, int(np.floor(p))], at_place[m, int(np.ceil(p))]
                cells.append(low if low == high else (np.ceil(p) - p) * low + (p - np.floor(p)) * high)
            found[m] = (auc_of, cells)
    return {name: found[m] for m, name in enumerate(names)}


def interval(replicated: DataFrame, value: str, keys: list[str], least_finite: int = 50) -> DataFrame:
    """ci_low, ci_high (95 %) and the number of replicates by keys; no interval from least_finite replicates or fewer."""
    end = lambda p: F.when(F.count("*") > least_finite, F.percentile(value, F.lit(p)))
    return replicated.groupBy(*keys).agg(end(0.025).alias("ci_low"), end(0.975).alias("ci_high"), F.count("*").alias("replicates"))


def cluster_bootstrap(rows: DataFrame, outcomes: list[str], cluster: str = "cluster", stratum: str = "stratum", replicates: int = 500, seed: int = 42, least_finite: int = 50, keys: list[str] = (), placed: bool = False) -> DataFrame:
    """95 % intervals of strat_att(), by keys if given, from bootstrap_effects(). Deterministic by seed."""
    return interval(bootstrap_effects(rows, outcomes, cluster, stratum, replicates, seed, keys, placed), "att", [*keys, "outcome"], least_finite)


def effect_difference(rows: DataFrame, outcomes: list[str], half: Column, cluster: str = "cluster", stratum: str = "stratum", replicates: int = 500, seed: int = 42, least_finite: int = 50) -> DataFrame:
    """By outcome att_low and att_high (rows where half is false, true), delta (low less high), its 95 % interval and sig, whether that excludes 0.

    Both halves of a replicate share one draw of clusters, so that the interval is of the paired difference. Rows whose half is null
    are left out; a replicate counts if both halves have an effect in it.
    """
    parts = rows.withColumn("__half", half.cast("boolean")).filter("__half IS NOT NULL")
    low, high = (F.max(F.when(F.col("__half") == h, F.col("att"))) for h in (False, True))
    atts = strat_att(stratum_sums(parts, outcomes, ["__half"], stratum), ["__half", "outcome"]).groupBy("outcome").agg(low.alias("att_low"), high.alias("att_high"))
    each = bootstrap_effects(parts, outcomes, cluster, stratum, replicates, seed, ["__half"]).groupBy("outcome", "r").agg((low - high).alias("delta")).filter("delta IS NOT NULL")
    out = atts.join(interval(each, "delta", ["outcome"], least_finite), "outcome", "left")
    return out.select("outcome", "att_low", "att_high", (F.col("att_low") - F.col("att_high")).alias("delta"), "ci_low", "ci_high", ((F.col("ci_low") > 0) | (F.col("ci_high") < 0)).alias("sig"))


def effect_table(rows: DataFrame, outcomes: list[str], keys: list[str] = (), cluster: str = "cluster", stratum: str = "stratum", replicates: int = 500) -> DataFrame:
    """By keys and outcome: n, treated, control_mean, treated_mean, att, ci_low, ci_high and sig."""
    by = [*keys, "outcome"]
    sums = stratum_sums(rows, outcomes, list(keys), stratum)
    counts = sums.groupBy(*by).agg(F.sum(F.col("n_t") + F.col("n_c")).alias("n"), F.sum("n_t").alias("treated"))
    means = naive_difference(sums, by).select(*by, "control_mean", "treated_mean")
    out = meet(meet(counts, means, by), strat_att(sums, by), by)
    out = meet(out, cluster_bootstrap(rows, outcomes, cluster, stratum, replicates, keys=list(keys)), by, "left")
    return out.select(*by, "n", "treated", "control_mean", "treated_mean", "att", "ci_low", "ci_high", significant(F.col("ci_low"), F.col("ci_high")).alias("sig"))


def common_support(rows: DataFrame, score: str = "ps") -> DataFrame:
    """Where both arms have scores, and how many rows lie outside of it."""
    arm = lambda d: F.when(F.col("d") == d, F.col(score))
    bounds = rows.agg(F.greatest(F.min(arm(1)), F.min(arm(0))).alias("low"), F.least(F.max(arm(1)), F.max(arm(0))).alias("high"))
    return rows.crossJoin(F.broadcast(bounds)).groupBy("low", "high").agg(F.count_if((F.col(score) < F.col("low")) | (F.col(score) > F.col("high"))).alias("outside"), F.count("*").alias("n"))  # one row of bounds


def score_tails(rows: DataFrame, score: str = "ps", below: list[float] = (0.01, 0.05, 0.1), above: list[float] = (0.9, 0.95, 0.99)) -> DataFrame:
    cells = F.array(*[F.struct(F.lit("below").alias("side"), F.lit(x).alias("bound"), (F.col(score) < x).alias("hit")) for x in below], *[F.struct(F.lit("above").alias("side"), F.lit(x).alias("bound"), (F.col(score) > x).alias("hit")) for x in above])
    return rows.select("d", F.explode(cells).alias("c")).groupBy("c.side", "c.bound").agg(F.count_if((F.col("d") == 1) & F.col("c.hit")).alias("treated"), F.count_if((F.col("d") == 0) & F.col("c.hit")).alias("control"))


def summary(rows: DataFrame, x: str, group: list[str] = (), at: list[float] = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)) -> DataFrame:
    """n, mean, sample deviation, min, exact percentiles and max."""
    sums = rows.groupBy(*group).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    q = quantiles(rows, x, list(at), group)
    return meet(sums, q, list(group), "left").select(*group, "n", "mean", "std", "min", *[F.get("quantiles", F.lit(k)).alias(f"p{round(100 * p)}") for k, p in enumerate(at)], "max")
