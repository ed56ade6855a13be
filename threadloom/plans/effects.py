"""Queries of agreement, stratified effects, balance, ranks, sensitivity and bootstrap."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.operators import stats as S
from threadloom.plans import bindings as B
from threadloom.plans.registry import query

t = B.table


def _strata(spark, sf, k=5):
    return S.qcut(B.sample(spark, sf), "ps", k, "stratum")


def _edges(k, x="ps", src="sample"):
    inner = ", ".join(f"quantile_cont({x}, {i / k})" for i in range(k + 1))
    return f"SELECT list_sort(list_distinct([{inner}])) AS e FROM {src}"


def _bin(x="ps"):
    return f"CASE WHEN len(e) > 1 THEN len(list_filter(e[2:len(e) - 1], lambda z: z < {x})) END"


def _strata_sql(k=5):
    return f"{B.SAMPLE}, edges AS ({_edges(k)}), st AS (SELECT sample.*, ({_bin()})::INT AS stratum FROM sample, edges)"


_SUMS = """long AS (SELECT stratum, cluster, d, unnest(['y', 'y2']) AS outcome, unnest([y, y2]) AS v FROM st),
 sums AS (SELECT outcome, stratum, count(*) FILTER (d = 1) AS n_t, count(*) FILTER (d = 0) AS n_c, coalesce(sum(v) FILTER (d = 1), 0) AS y_t, coalesce(sum(v) FILTER (d = 0), 0) AS y_c,
  coalesce(var_pop(v) FILTER (d = 1), 0) AS v_t, coalesce(var_pop(v) FILTER (d = 0), 0) AS v_c FROM long GROUP BY ALL)"""
_ATT = "sum(CASE WHEN n_t >= 2 AND n_c >= 2 THEN n_t * (y_t / n_t - y_c / n_c) END) / sum(CASE WHEN n_t >= 2 AND n_c >= 2 THEN n_t END)"


def _r(df, *columns, digits=8):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("f08_qcut", f"WITH {_strata_sql(10)} SELECT id, stratum FROM st")
def f08(spark, sf):
    return _strata(spark, sf, 10).select("id", "stratum")


@query("f08_qcut_groups", "WITH e AS (SELECT source, list_sort(list_distinct([quantile_cont(n_chars, 0), quantile_cont(n_chars, 1 / 3), quantile_cont(n_chars, 2 / 3), quantile_cont(n_chars, 1)])) AS e FROM documents GROUP BY 1) SELECT doc_id, (CASE WHEN len(e) > 1 THEN len(list_filter(e[2:len(e) - 1], lambda z: z < n_chars)) END)::INT AS tertile FROM documents JOIN e USING (source)")
def f08b(spark, sf):
    return S.qcut(t(spark, sf, "documents").select("doc_id", "source", "n_chars"), "n_chars", 3, "tertile", ["source"]).select("doc_id", "tertile")


_YN = "yn AS (SELECT l.doc_id, CASE WHEN quality = 1 THEN 'Y' ELSE 'N' END AS a, CASE WHEN toxic = 1 THEN 'Y' ELSE 'N' END AS b, CASE WHEN n_chars > 1500 THEN 'Y' ELSE 'N' END AS c FROM labels l JOIN documents d USING (doc_id))"


def _annotators(spark, sf):
    yn = lambda c: F.when(c, "Y").otherwise("N")
    j = t(spark, sf, "labels").join(t(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return j.select("doc_id", yn(F.col("quality") == 1).alias("a"), yn(F.col("toxic") == 1).alias("b"), yn(F.col("n_chars") > 1500).alias("c"))


_PAIRS = {"ab": ("a", "b"), "ac": ("a", "c"), "bc": ("b", "c")}
_CONF = "conf AS (SELECT dimension, count(*) FILTER (x = 'Y' AND y = 'Y') AS yy, count(*) FILTER (x = 'Y' AND y = 'N') AS yn, count(*) FILTER (x = 'N' AND y = 'Y') AS ny, count(*) FILTER (x = 'N' AND y = 'N') AS nn FROM (SELECT unnest(['ab', 'ac', 'bc']) AS dimension, unnest([a, a, b]) AS x, unnest([b, c, c]) AS y FROM yn) GROUP BY 1)"
_KAPPA = "CASE WHEN pe = 1 THEN 1 ELSE (po - pe) / (1 - pe) END"
_KSQL = f"k AS (SELECT dimension, yy, yn, ny, nn, (yy + nn) / n AS po, ((yy + yn) * (yy + ny) + (yn + nn) * (ny + nn)) / (n * n) AS pe FROM (SELECT *, (yy + yn + ny + nn)::DOUBLE AS n FROM conf))"
_BAND = "CASE WHEN {0} >= 0.81 THEN 'Almost perfect' WHEN {0} >= 0.61 THEN 'Substantial' WHEN {0} >= 0.41 THEN 'Moderate' WHEN {0} >= 0.21 THEN 'Fair' ELSE 'Slight' END"


@query("e26_e27_kappa", f"WITH {_YN}, {_CONF}, {_KSQL} SELECT dimension, yy, yn, ny, nn, round({_KAPPA}, 9) AS kappa, {_BAND.format(_KAPPA)} AS level FROM k")
def e26(spark, sf):
    c = S.confusion(_annotators(spark, sf), _PAIRS)
    k = S.kappa(F.col("yy"), F.col("yn"), F.col("ny"), F.col("nn"))
    return c.withColumns({"kappa": F.round(k, 9), "level": X.kappa_level(k)})


@query("e28_prevalence_bias", f"WITH {_YN} SELECT 'ab' AS dimension, round(count(*) FILTER (a = 'Y') / count(*), 9) AS rate_a, round(count(*) FILTER (b = 'Y') / count(*), 9) AS rate_b, count(*) FILTER (a = 'Y' AND b = 'N') AS a_over_b, count(*) FILTER (a = 'N' AND b = 'Y') AS b_over_a, count(*) FILTER (a = 'Y' AND b = 'N') - count(*) FILTER (a = 'N' AND b = 'Y') AS net FROM yn WHERE doc_id >= 121")
def e28(spark, sf):
    c = S.confusion(_annotators(spark, sf).filter("doc_id >= 121"), {"ab": ("a", "b")})
    n = F.col("yy") + F.col("yn") + F.col("ny") + F.col("nn")
    return c.select("dimension", F.round((F.col("yy") + F.col("yn")) / n, 9).alias("rate_a"), F.round((F.col("yy") + F.col("ny")) / n, 9).alias("rate_b"), F.col("yn").alias("a_over_b"), F.col("ny").alias("b_over_a"), (F.col("yn") - F.col("ny")).alias("net"))


@query("e29_m10_agreement_table", f"WITH {_YN}, sets AS (SELECT 'all' AS part, * FROM yn UNION ALL SELECT 'test', * FROM yn WHERE doc_id >= 121), conf AS (SELECT part, dimension, count(*) FILTER (x = 'Y' AND y = 'Y') AS yy, count(*) FILTER (x = 'Y' AND y = 'N') AS yn, count(*) FILTER (x = 'N' AND y = 'Y') AS ny, count(*) FILTER (x = 'N' AND y = 'N') AS nn FROM (SELECT part, unnest(['ab', 'ac', 'bc']) AS dimension, unnest([a, a, b]) AS x, unnest([b, c, c]) AS y FROM sets) GROUP BY ALL), k AS (SELECT part, dimension, (yy + nn) / n AS po, ((yy + yn) * (yy + ny) + (yn + nn) * (ny + nn)) / (n * n) AS pe FROM (SELECT *, (yy + yn + ny + nn)::DOUBLE AS n FROM conf)) SELECT part, dimension, round({_KAPPA}, 3) AS kappa FROM k")
def e29(spark, sf):
    a = _annotators(spark, sf)
    parts = [S.confusion(x, _PAIRS).withColumn("part", F.lit(p)) for p, x in (("all", a), ("test", a.filter("doc_id >= 121")))]
    c = parts[0].unionByName(parts[1])
    return c.select("part", "dimension", F.round(S.kappa(F.col("yy"), F.col("yn"), F.col("ny"), F.col("nn")), 3).alias("kappa"))


@query("e30_strat_att", f"WITH {_strata_sql()}, {_SUMS} SELECT outcome, round({_ATT}, 8) AS att FROM sums GROUP BY 1")
def e30(spark, sf):
    return _r(S.strat_att(S.stratum_sums(_strata(spark, sf), ["y", "y2"]), ["outcome"]), "att")


@query("e32_naive_cohen", f"WITH {B.SAMPLE}, long AS (SELECT d, unnest(['y', 'y2']) AS outcome, unnest([y, y2]) AS v FROM sample) SELECT outcome, round(avg(v) FILTER (d = 1) - avg(v) FILTER (d = 0), 8) AS naive, round(avg(v) FILTER (d = 1), 8) AS treated_mean, round(avg(v) FILTER (d = 0), 8) AS control_mean, round(stddev_pop(v) FILTER (d = 0), 8) AS control_sd, round((avg(v) FILTER (d = 1) - avg(v) FILTER (d = 0)) / stddev_pop(v) FILTER (d = 0), 8) AS cohen_d FROM long GROUP BY 1")
def e32(spark, sf):
    return _r(S.naive_difference(S.stratum_sums(_strata(spark, sf), ["y", "y2"]), ["outcome"]), "naive", "treated_mean", "control_mean", "control_sd", "cohen_d")


@query("e34_balance", f"""WITH {_strata_sql()}, l AS (SELECT stratum, d, unnest(['l_quantity', 'l_discount', 'l_tax']) AS variable, unnest([l_quantity, l_discount, l_tax]) AS x FROM st),
 b AS (SELECT variable, stratum, count(*) AS n, avg(x) FILTER (d = 1) AS t, avg(x) FILTER (d = 0) AS c FROM l GROUP BY ALL), w AS (SELECT variable, avg(x) FILTER (d = 1) - avg(x) FILTER (d = 0) AS diff, sqrt((var_pop(x) FILTER (d = 1) + var_pop(x) FILTER (d = 0)) / 2) AS p FROM l GROUP BY 1),
 s AS (SELECT variable, sum(CASE WHEN t IS NOT NULL AND c IS NOT NULL THEN n * (t - c) END) / sum(CASE WHEN t IS NOT NULL AND c IS NOT NULL THEN n END) AS within FROM b GROUP BY 1) SELECT variable, round(abs(diff) / p, 8) AS raw, round(abs(within) / p, 8) AS strat FROM w JOIN s USING (variable)""")
def e34(spark, sf):
    return _r(S.balance(_strata(spark, sf), ["l_quantity", "l_discount", "l_tax"]), "raw", "strat")


@query("e35_strata_table", f"WITH {_strata_sql()} SELECT stratum, count(*) AS n, sum(d)::BIGINT AS treated, (count(*) - sum(d))::BIGINT AS control, round_even(100 * sum(d) / count(*), 1) AS treated_pct, min(ps) AS ps_min, max(ps) AS ps_max FROM st GROUP BY 1")
def e35(spark, sf):
    return S.strata_table(_strata(spark, sf))


@query("e36_score_tails", f"WITH {B.SAMPLE} SELECT side, bound, count(*) FILTER (d = 1 AND hit) AS treated, count(*) FILTER (d = 0 AND hit) AS control FROM (SELECT d, 'below' AS side, b::DOUBLE AS bound, ps < b::DOUBLE AS hit FROM sample, (VALUES (0.21), (0.25), (0.3)) v(b) UNION ALL SELECT d, 'above', b::DOUBLE, ps > b::DOUBLE FROM sample, (VALUES (0.4), (0.45), (0.5)) v(b)) GROUP BY ALL")
def e36(spark, sf):
    return S.score_tails(B.sample(spark, sf), below=[0.21, 0.25, 0.3], above=[0.4, 0.45, 0.5])


#: The upper tail of the normal distribution as S.normal_tail() has it.
_TAIL = "CASE WHEN z >= 0 THEN u ELSE 1 - u END"
_UPPER = "exp(-z * z / 2) / sqrt(2 * pi()) * (k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429)))))"


def _rosenbaum_sql(gammas, shift):
    return f"""WITH {_strata_sql()}, {_SUMS}, s AS (
  SELECT outcome, sum(CASE WHEN n_t > 0 AND n_c > 0 THEN n_t * (y_t / n_t - y_c / n_c) END) AS t, sum(CASE WHEN n_t > 1 AND n_c > 1 THEN n_t * (v_t / n_t + v_c / n_c) END) AS v, sum(CASE WHEN n_t > 0 AND n_c > 0 THEN n_t END) AS n FROM sums GROUP BY 1),
g AS (SELECT unnest({gammas})::DOUBLE AS gamma), z AS (SELECT outcome, gamma, (t - {shift}) / sqrt(v) AS z FROM s, g WHERE v > 0),
k AS (SELECT *, 1.0::DOUBLE / (1 + 0.2316419::DOUBLE * abs(z)) AS k FROM z), u AS (SELECT *, {_UPPER} AS u FROM k)
SELECT outcome, gamma, round({_TAIL}, 6) AS p_value FROM u"""


def _rosenbaum(spark, sf, gammas, **how):
    p = S.rosenbaum(S.stratum_sums(_strata(spark, sf), ["y", "y2"]), gammas, ["outcome"], **how)
    return p.select("outcome", "gamma", F.round("p_value", 6).alias("p_value"))


@query("e37_rosenbaum", _rosenbaum_sql([1.0, 1.5, 2.0], "0"))
def e37(spark, sf):
    return _rosenbaum(spark, sf, [1.0, 1.5, 2.0], parity=True)


@query("e37_rosenbaum_bounds", _rosenbaum_sql([1.0, 1.25, 1.5, 2.0], "n * ((gamma - 1) / (gamma + 1)) / 2"))
def e37b(spark, sf):
    return _rosenbaum(spark, sf, [1.0, 1.25, 1.5, 2.0])


@query("e38_e_value", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0 THEN round(1 + l_discount + sqrt((1 + l_discount) * l_discount), 9) END AS e_value, CASE WHEN l_discount > 0 THEN CASE WHEN l_tax - 0.04 > 0 THEN round(1 + (l_tax - 0.04) + sqrt((1 + (l_tax - 0.04)) * (l_tax - 0.04)), 9) ELSE 1 END END AS e_value_low FROM lineitem")
def e38(spark, sf):
    e = S.e_value(F.col("l_discount"), F.col("l_tax") - 0.04)
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[F.round(c, 9).alias(k) for k, c in e.items()])


def _poisson(u):
    return " + ".join(f"({u} >= {t!r})::INT" for t in S.POISSON)


def _boot_sql(long, keys=(), replicates=500):
    """CTEs from `long` (keys, cluster, stratum, d, outcome, v) to `atts` (keys, outcome, r, att): sums of clusters, draws, effects."""
    k = "".join(f"{c}, " for c in keys)
    return f"""cs AS (SELECT {k}cluster, outcome, stratum, count(*) FILTER (d = 1) AS n_t, count(*) FILTER (d = 0) AS n_c, coalesce(sum(v) FILTER (d = 1), 0) AS y_t, coalesce(sum(v) FILTER (d = 0), 0) AS y_c FROM {long} WHERE stratum IS NOT NULL AND v IS NOT NULL GROUP BY ALL),
 du AS (SELECT cluster, r, ('0x' || substr(md5('42-' || r || '-' || cluster), 1, 13))::BIGINT / {float(16**13)!r} AS u FROM (SELECT DISTINCT cluster FROM cs), range(1, {replicates + 1}) t(r)),
 dr AS (SELECT cluster, r, {_poisson('u')} AS m FROM du),
 bs AS (SELECT {k}outcome, r, stratum, sum(n_t * m) AS n_t, sum(n_c * m) AS n_c, sum(y_t * m) AS y_t, sum(y_c * m) AS y_c FROM cs JOIN dr USING (cluster) WHERE m > 0 GROUP BY ALL),
 atts AS (SELECT {k}outcome, r, {_ATT} AS att FROM bs GROUP BY ALL)"""


_LONG = "long AS (SELECT stratum, cluster, d, unnest(['y', 'y2']) AS outcome, unnest([y, y2]) AS v FROM st)"


@query("e39_cluster_bootstrap", f"WITH {_strata_sql()}, {_LONG}, {_boot_sql('long')} SELECT outcome, round(quantile_cont(att, 0.025), 8) AS ci_low, round(quantile_cont(att, 0.975), 8) AS ci_high, count(*) AS replicates FROM atts WHERE att IS NOT NULL GROUP BY 1")
def e39(spark, sf):
    return _r(S.cluster_bootstrap(_strata(spark, sf), ["y", "y2"]), "ci_low", "ci_high")


_GROUPS = "g AS (SELECT st.*, unnest(list_filter(['full', CASE WHEN l_quantity > 25 THEN 'large' END, CASE WHEN l_discount < 0.05 THEN 'cheap' END], lambda z: z IS NOT NULL)) AS subgroup FROM st)"


def _groups(spark, sf, k=5):
    s = _strata(spark, sf, k)
    return s.withColumn("subgroup", F.explode(F.array_compact(F.array(F.lit("full"), F.when(F.col("l_quantity") > 25, "large"), F.when(F.col("l_discount") < 0.05, "cheap")))))


_GSUMS = "gs AS (SELECT subgroup, stratum, count(*) FILTER (d = 1) AS n_t, count(*) FILTER (d = 0) AS n_c, coalesce(sum(y) FILTER (d = 1), 0) AS y_t, coalesce(sum(y) FILTER (d = 0), 0) AS y_c FROM g GROUP BY ALL)"


@query("j11_m06_subgroup_att", f"WITH {_strata_sql()}, {_GROUPS}, {_GSUMS} SELECT subgroup, 'y' AS outcome, round({_ATT}, 8) AS att FROM gs GROUP BY 1")
def j11(spark, sf):
    return _r(S.strat_att(S.stratum_sums(_groups(spark, sf), ["y"], ["subgroup"]), ["subgroup", "outcome"]), "att")


@query("e41_control_baselines", f"WITH {_strata_sql()}, {_GROUPS} SELECT subgroup, round_even(avg(y), 4) AS y, round_even(avg(y2), 4) AS y2 FROM g WHERE d = 0 GROUP BY 1 HAVING count(*) >= 10")
def e41(spark, sf):
    g = _groups(spark, sf).filter("d = 0").groupBy("subgroup").agg(F.count("*").alias("n"), F.bround(F.avg("y"), 4).alias("y"), F.bround(F.avg("y2"), 4).alias("y2"))
    return g.filter("n >= 10").drop("n")


@query("e42_subgroup_means", f"WITH {_strata_sql()}, {_GROUPS}, l AS (SELECT subgroup, unnest(['l_quantity', 'l_tax']) AS feature, unnest([l_quantity, l_tax]) AS x FROM g WHERE d = 1) SELECT feature, round(avg(x) FILTER (subgroup = 'full'), 6) AS \"full\", round(avg(x) FILTER (subgroup = 'large'), 6) AS large, round(avg(x) FILTER (subgroup = 'cheap'), 6) AS cheap, round(stddev_samp(x) FILTER (subgroup = 'full') / sqrt(count(x) FILTER (subgroup = 'full')), 6) AS full_sem FROM l GROUP BY 1")
def e42(spark, sf):
    l = _groups(spark, sf).filter("d = 1").select("subgroup", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in ("l_quantity", "l_tax")])).alias("f")).select("subgroup", "f.*")
    own = lambda g: F.when(F.col("subgroup") == g, F.col("x"))
    return l.groupBy("feature").agg(*[F.round(F.avg(own(g)), 6).alias(g) for g in ("full", "large", "cheap")], F.round(F.stddev_samp(own("full")) / F.sqrt(F.count(own("full"))), 6).alias("full_sem"))


@query("e45_bin_profile", f"WITH {_strata_sql()} SELECT stratum AS quintile, count(*) AS n, round(avg(y), 8) AS y, round(avg(y2), 8) AS y2, round(avg(l_quantity), 8) AS quantity FROM st GROUP BY 1")
def e45(spark, sf):
    return _strata(spark, sf).groupBy(F.col("stratum").alias("quintile")).agg(F.count("*").alias("n"), F.round(F.avg("y"), 8).alias("y"), F.round(F.avg("y2"), 8).alias("y2"), F.round(F.avg("l_quantity"), 8).alias("quantity"))


@query("j03_auc", f"WITH {B.SAMPLE}, r AS (SELECT d, rank() OVER (ORDER BY ps) + (count(*) OVER (PARTITION BY ps) - 1) / 2 AS r FROM sample) SELECT round((sum(r) FILTER (d = 1) - count(*) FILTER (d = 1) * (count(*) FILTER (d = 1) + 1) / 2) / (count(*) FILTER (d = 1)::DOUBLE * count(*) FILTER (d = 0)), 9) AS auc FROM r")
def j03(spark, sf):
    return _r(S.auc(B.sample(spark, sf)), "auc", digits=9)


def _p_sql(rho, n):
    """The p-value of a correlation by the same integrals as correlation_p()."""
    root, steps = f"sqrt(({n} - 2)::DOUBLE)", S.P_STEPS
    end = f"least({root} * pi() / 2, 40)"
    start = f"least(CASE WHEN abs({rho}) >= 1 - 1e-15 THEN {end} ELSE {root} * asin(least(abs({rho}), 1)) END, {end})"

    def integral(a):
        h = f"(({end} - {a}) / {steps})"
        return f"list_sum(list_transform(range(0, {steps + 1}), lambda k: CASE WHEN k = 0 OR k = {steps} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * pow(greatest(cos(({a} + k * {h}) / {root}), 0), {n} - 3))) * {h} / 3"

    return f"CASE WHEN {n} > 2 THEN ({integral(start)}) / ({integral('0::DOUBLE')}) END"


@query("j18_spearman", "WITH r AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2 AS x, rank() OVER (PARTITION BY lang ORDER BY doc_id % 17) + (count(*) OVER (PARTITION BY lang, doc_id % 17) - 1) / 2 AS y FROM documents), c AS (SELECT lang, corr(x, y) AS rho, count(*) AS n FROM r GROUP BY 1) " + f"SELECT lang, round(rho, 8) AS rho, n, round({_p_sql('rho', 'n')}, 7) AS p_value FROM c")
def j18(spark, sf):
    d = t(spark, sf, "documents").select("lang", "n_chars", (F.col("doc_id") % 17).alias("k"))
    return _r(_r(S.spearman(d, "n_chars", "k", ["lang"]), "rho"), "p_value", digits=7)


@query("m05_direction_correlations", "WITH l AS (SELECT vec_id, unnest(['first', 'second']) AS feature, unnest([embedding[1]::DOUBLE, embedding[2]::DOUBLE]) AS x, label FROM embeddings), r AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2 AS x, rank() OVER (PARTITION BY feature ORDER BY label) + (count(*) OVER (PARTITION BY feature, label) - 1) / 2 AS y FROM l), c AS (SELECT feature, corr(x, y) AS rho, count(*) AS n FROM r GROUP BY 1) " + f"SELECT feature, round(rho, 8) AS rho, round(abs(rho), 8) AS abs_rho, round({_p_sql('rho', 'n')}, 7) AS p_value FROM c")
def m05(spark, sf):
    e = t(spark, sf, "embeddings").select("label", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.get("embedding", F.lit(k)).cast("double").alias("x")) for k, n in enumerate(("first", "second"))])).alias("f")).select("label", "f.*")
    return S.spearman(e, "x", "label", ["feature"]).select("feature", F.round("rho", 8).alias("rho"), F.round(F.abs("rho"), 8).alias("abs_rho"), F.round("p_value", 7).alias("p_value"))


@query("j08_anchor_fixed", f"WITH {B.EDITS}, {B.ASKED}, r AS (SELECT a.user_id AS id, min(e.us) FILTER (e.us > q AND ns = 3) - any_value(q) AS lag FROM asked a LEFT JOIN edits e USING (user_id) GROUP BY 1), s AS (SELECT quantile_cont(lag, 0.5) AS median, quantile_cont(lag, 0.25) AS p25, quantile_cont(lag, 0.75) AS p75 FROM r) SELECT id, unnest(['median', 'p25', 'p75', 'zero']) AS strategy, round(unnest([median, p25, p75, 0]), 3) AS lag FROM r, s")
def j08(spark, sf):
    x = B.asked(spark, sf).join(B.edits(spark, sf), "user_id", "left").groupBy(F.col("user_id").alias("id")).agg((F.min(F.when((F.col("us") > F.col("q")) & (F.col("ns") == 3), F.col("us"))) - F.first("q")).alias("lag"))
    out = S.anchor_lags(x.filter("lag IS NOT NULL"), x.select("id"))
    return out.filter("strategy IN ('median', 'p25', 'p75', 'zero')").select("id", "strategy", F.round("lag", 3).alias("lag"))


_DRAWS = "kinds AS (SELECT CASE WHEN k = 0 THEN 'sample' ELSE 'mean20' END AS strategy, k::INT AS draw FROM range(0, 21) t(k))"


@query(
    "j08_anchor_sampled",
    f"""WITH {B.EDITS}, {B.ASKED}, r AS (SELECT a.user_id AS id, min(e.us) FILTER (e.us > q AND ns = 3) - any_value(q) AS lag FROM asked a LEFT JOIN edits e USING (user_id) GROUP BY 1),
 o AS (SELECT lag, row_number() OVER (ORDER BY lag) - 1 AS place FROM r WHERE lag IS NOT NULL), {_DRAWS},
 u AS (SELECT id, strategy, draw, floor(('0x' || substr(md5(id || '-' || draw), 1, 13))::BIGINT / {float(16**13)!r} * (SELECT count(*) FROM o))::BIGINT AS place FROM r, kinds)
 SELECT id, strategy, draw, lag::DOUBLE AS lag FROM u LEFT JOIN o USING (place)""",
)
def j08b(spark, sf):
    x = B.asked(spark, sf).join(B.edits(spark, sf), "user_id", "left").groupBy(F.col("user_id").alias("id")).agg((F.min(F.when((F.col("us") > F.col("q")) & (F.col("ns") == 3), F.col("us"))) - F.first("q")).alias("lag"))
    return S.anchor_lags(x.filter("lag IS NOT NULL"), x.select("id")).filter("strategy IN ('sample', 'mean20')")


@query("j09_treatments", f"WITH {B.EDITS}, {B.ASKED}, r AS (SELECT a.user_id, (min(e.us) FILTER (e.us > q AND ns = 3) - any_value(q)) / 3600000000 AS lag FROM asked a LEFT JOIN edits e USING (user_id) GROUP BY 1) SELECT user_id, (lag IS NOT NULL)::INT AS y_treat, coalesce((lag <= 48)::INT, 0) AS y_treat_48h FROM r")
def j09(spark, sf):
    x = B.asked(spark, sf).join(B.edits(spark, sf), "user_id", "left").groupBy("user_id").agg((F.min(F.when((F.col("us") > F.col("q")) & (F.col("ns") == 3), F.col("us"))) - F.first("q")).alias("lag"))
    return x.select("user_id", F.col("lag").isNotNull().cast("int").alias("y_treat"), F.coalesce((F.col("lag") / 3_600_000_000 <= 48).cast("int"), F.lit(0)).alias("y_treat_48h"))


def _grid_sql():
    parts = []
    for k in (3, 5, 10):
        parts.append(f"SELECT {k} AS k, sample.d, sample.y, {_bin()} AS stratum FROM sample, ({_edges(k)})")
    return f"{B.SAMPLE}, st AS ({' UNION ALL '.join(parts)}), sums AS (SELECT k, stratum, count(*) FILTER (d = 1) AS n_t, count(*) FILTER (d = 0) AS n_c, coalesce(sum(y) FILTER (d = 1), 0) AS y_t, coalesce(sum(y) FILTER (d = 0), 0) AS y_c FROM st GROUP BY ALL)"


@query("j10_m04_k_grid", f"WITH {_grid_sql()} SELECT k, round({_ATT}, 8) AS att FROM sums GROUP BY 1")
def j10(spark, sf):
    s = B.sample(spark, sf)
    grid = None
    for k in (3, 5, 10):
        part = S.qcut(s, "ps", k, "stratum").withColumn("k", F.lit(k))
        grid = part if grid is None else grid.unionByName(part)
    return _r(S.strat_att(S.stratum_sums(grid, ["y"], ["k"]), ["k"]), "att")


_EFFECTS = f"""sums AS (SELECT KEYS outcome, stratum, count(*) FILTER (d = 1) AS n_t, count(*) FILTER (d = 0) AS n_c, coalesce(sum(v) FILTER (d = 1), 0) AS y_t, coalesce(sum(v) FILTER (d = 0), 0) AS y_c FROM long GROUP BY ALL),
 e AS (SELECT KEYS outcome, (sum(n_t) + sum(n_c))::BIGINT AS n, sum(n_t)::BIGINT AS treated, sum(y_c) / sum(n_c) AS control_mean, sum(y_t) / sum(n_t) AS treated_mean, {_ATT} AS att FROM sums GROUP BY ALL),
 ci AS (SELECT KEYS outcome, quantile_cont(att, 0.025) AS ci_low, quantile_cont(att, 0.975) AS ci_high FROM atts WHERE att IS NOT NULL GROUP BY ALL),
 t AS (SELECT e.*, ci_low, ci_high, CASE WHEN ci_low > 0 OR ci_high < 0 THEN '*' ELSE '' END AS sig FROM e JOIN ci USING (KEYS outcome))"""
_ROUNDED = "n, treated, round(control_mean, 8) AS control_mean, round(treated_mean, 8) AS treated_mean, round(att, 8) AS att, round(ci_low, 8) AS ci_low, round(ci_high, 8) AS ci_high, sig"
_NUMBERS = ("control_mean", "treated_mean", "att", "ci_low", "ci_high")
_SPANS = ((0, 60), (60, 180), (180, 365), (365, 730))
_PERSISTENCE = f"""WITH {B.LONG}, {B.LONG_ASKED}, x AS (SELECT a.user_id, a.q, e.us, e.ns FROM asked a LEFT JOIN edits e USING (user_id)),
 o AS (SELECT user_id, user_id % 2 AS d, user_id % 5 AS stratum, """ + ", ".join(f"(count(*) FILTER (ns = 0 AND us > q + {a}::BIGINT * 86400000000 AND us <= q + {b}::BIGINT * 86400000000) >= {k})::INT::DOUBLE AS o{k}_{b}" for a, b in _SPANS for k in (1, 2)) + """ FROM x GROUP BY 1),
 long AS (SELECT user_id AS cluster, d, stratum, unnest([""" + ", ".join(f"'o{k}_{b}'" for _, b in _SPANS for k in (1, 2)) + "]) AS outcome, unnest([" + ", ".join(f"o{k}_{b}" for _, b in _SPANS for k in (1, 2)) + f"""]) AS v FROM o),
 {_boot_sql('long')}, {_EFFECTS.replace('KEYS ', '')} SELECT outcome, {_ROUNDED} FROM t"""


@query("j12_persistence", _PERSISTENCE)
def j12(spark, sf):
    from threadloom.operators.scan import window_measures

    day = 86_400_000_000
    spans = {str(b): (a * day + 1, b * day + 1) for a, b in _SPANS}
    n = window_measures(B.long_asked(spark, sf), B.long_edits(spark, sf), "user_id", "q", "us", spans, {"n": (F.col("ns") == 0).cast("long")})
    names = {f"o{k}_{b}": (F.col(f"n_{b}") >= k).cast("double") for b in spans for k in (1, 2)}
    o = n.select("user_id", *[c.alias(m) for m, c in names.items()]).withColumns({"d": F.col("user_id") % 2, "stratum": F.col("user_id") % 5})
    return _r(S.effect_table(o, list(names), cluster="user_id"), *_NUMBERS)


@query("j22_interaction_grid", f"WITH e AS (SELECT list_sort(list_distinct([quantile_cont(l_quantity, 0), quantile_cont(l_quantity, 1 / 3), quantile_cont(l_quantity, 2 / 3), quantile_cont(l_quantity, 1)])) AS a, list_sort(list_distinct([quantile_cont(l_extendedprice, 0), quantile_cont(l_extendedprice, 1 / 3), quantile_cont(l_extendedprice, 2 / 3), quantile_cont(l_extendedprice, 1)])) AS b FROM lineitem) SELECT len(list_filter(a[2:len(a) - 1], lambda z: z < l_quantity))::INT AS t1, len(list_filter(b[2:len(b) - 1], lambda z: z < l_extendedprice))::INT AS t2, count(*) AS n, round(avg(l_tax), 8) AS tax FROM lineitem, e GROUP BY ALL")
def j22(spark, sf):
    l = S.qcut(S.qcut(t(spark, sf, "lineitem"), "l_quantity", 3, "t1"), "l_extendedprice", 3, "t2")
    return l.groupBy("t1", "t2").agg(F.count("*").alias("n"), F.round(F.avg("l_tax"), 8).alias("tax"))


_TERTILES = f"""{_strata_sql()}, te AS (SELECT list_sort(list_distinct([quantile_cont(l_extendedprice, 0), quantile_cont(l_extendedprice, 1 / 3), quantile_cont(l_extendedprice, 2 / 3), quantile_cont(l_extendedprice, 1)])) AS b FROM sample),
 s3 AS (SELECT st.*, len(list_filter(b[2:len(b) - 1], lambda z: z < l_extendedprice))::INT AS tertile FROM st, te)"""
_COVARIATES = ["l_quantity", "l_discount", "l_tax"]
_SMD = f"""lx AS (SELECT tertile, stratum, d, unnest({_COVARIATES!r}) AS variable, unnest([{', '.join(_COVARIATES)}]) AS x FROM s3),
 bx AS (SELECT tertile, variable, stratum, count(*) AS n, avg(x) FILTER (d = 1) AS t, avg(x) FILTER (d = 0) AS c FROM lx GROUP BY ALL),
 wx AS (SELECT tertile, variable, sum(CASE WHEN t IS NOT NULL AND c IS NOT NULL THEN n * (t - c) END) / sum(CASE WHEN t IS NOT NULL AND c IS NOT NULL THEN n END) AS within FROM bx GROUP BY ALL),
 px AS (SELECT tertile, variable, sqrt((var_pop(x) FILTER (d = 1) + var_pop(x) FILTER (d = 0)) / 2) AS pooled FROM lx GROUP BY ALL),
 smd AS (SELECT tertile, count(*) FILTER (abs(within) / pooled > 0.1) AS smd_above FROM wx JOIN px USING (tertile, variable) GROUP BY ALL)"""
_AUCS = "ra AS (SELECT tertile, d, rank() OVER (PARTITION BY tertile ORDER BY ps) + (count(*) OVER (PARTITION BY tertile, ps) - 1) / 2 AS r FROM s3), au AS (SELECT tertile, (sum(r) FILTER (d = 1) - count(*) FILTER (d = 1) * (count(*) FILTER (d = 1) + 1) / 2) / (count(*) FILTER (d = 1)::DOUBLE * count(*) FILTER (d = 0)) AS auc FROM ra GROUP BY 1)"


@query(
    "m01_att_by_tertile",
    f"WITH {_TERTILES}, long AS (SELECT tertile, stratum, cluster, d, unnest(['y', 'y2']) AS outcome, unnest([y, y2]) AS v FROM s3), {_boot_sql('long', ['tertile'])}, {_EFFECTS.replace('KEYS', 'tertile,')}, {_AUCS}, {_SMD} SELECT tertile, outcome, {_ROUNDED}, round(auc, 8) AS auc, smd_above FROM t JOIN au USING (tertile) JOIN smd USING (tertile)",
)
def m01(spark, sf):
    s = S.qcut(_strata(spark, sf), "l_extendedprice", 3, "tertile")
    smd = S.balance(s, _COVARIATES, group=["tertile"]).groupBy("tertile").agg(F.count_if(F.col("strat") > 0.1).alias("smd_above"))
    out = S.effect_table(s, ["y", "y2"], ["tertile"]).join(S.auc(s, "ps", ["tertile"]), "tertile").join(smd, "tertile")
    return _r(out, *_NUMBERS, "auc")


_FIVE = {"y": "y", "y2": "y2", "both": "y * y2", "price": "l_extendedprice / 10000", "taxed": "(l_tax > 0.04)::INT::DOUBLE"}


@query(
    "m02_att_difference",
    f"""WITH {_strata_sql()}, long AS (SELECT l_quantity > 25 AS half, stratum, cluster, d, unnest({list(_FIVE)!r}) AS outcome, unnest([{', '.join(_FIVE.values())}]) AS v FROM st), {_boot_sql('long', ['half'])},
 sums AS (SELECT half, outcome, stratum, count(*) FILTER (d = 1) AS n_t, count(*) FILTER (d = 0) AS n_c, coalesce(sum(v) FILTER (d = 1), 0) AS y_t, coalesce(sum(v) FILTER (d = 0), 0) AS y_c FROM long GROUP BY ALL),
 e AS (SELECT half, outcome, {_ATT} AS att FROM sums GROUP BY ALL), f AS (SELECT outcome, max(att) FILTER (NOT half) AS att_low, max(att) FILTER (half) AS att_high FROM e GROUP BY 1),
 dd AS (SELECT outcome, r, max(att) FILTER (NOT half) - max(att) FILTER (half) AS delta FROM atts GROUP BY ALL), ci AS (SELECT outcome, quantile_cont(delta, 0.025) AS ci_low, quantile_cont(delta, 0.975) AS ci_high FROM dd WHERE delta IS NOT NULL GROUP BY 1)
 SELECT outcome, round(att_low, 8) AS att_low, round(att_high, 8) AS att_high, round(att_low - att_high, 8) AS delta, round(ci_low, 8) AS ci_low, round(ci_high, 8) AS ci_high, ci_low > 0 OR ci_high < 0 AS sig FROM f JOIN ci USING (outcome)""",
)
def m02(spark, sf):
    made = {"both": F.col("y") * F.col("y2"), "price": F.col("l_extendedprice") / 10000, "taxed": (F.col("l_tax") > 0.04).cast("double")}
    out = S.effect_difference(_strata(spark, sf).withColumns(made), list(_FIVE), F.col("l_quantity") > 25)
    return _r(out, "att_low", "att_high", "delta", "ci_low", "ci_high")
