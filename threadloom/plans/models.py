"""Queries of linear models, embeddings, clusters and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions.scalar import stars
from threadloom.operators import cluster as C
from threadloom.operators import designs as D
from threadloom.operators import linear as L
from threadloom.operators import stats as S
from threadloom.plans import bindings as B
from threadloom.plans import effects as E
from threadloom.plans.registry import query
from threadloom.sources.io import cut

t = B.table
X3 = ["l_quantity", "l_discount", "l_tax"]


def _vectors(spark, sf):
    return t(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))


def _rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


@query("j01_j16_standardise", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem), 6) AS {c}" for c in X3) + " FROM lineitem")
def j01(spark, sf):
    return _rounded(L.standardise(t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *X3), X3))


@query("j16_reply_matrix", "WITH p AS (SELECT quantile_cont(l_quantity, 0.99) AS q FROM lineitem), c AS (SELECT l_orderkey, l_linenumber, greatest(0, least(coalesce(l_quantity, 0), q)) AS lag FROM lineitem, p) SELECT l_orderkey, l_linenumber, round((lag - (SELECT avg(lag) FROM c)) / (SELECT stddev_pop(lag) FROM c), 6) AS lag FROM c")
def j16(spark, sf):
    from threadloom.functions.scalar import clip, finite

    l = t(spark, sf, "lineitem")
    p = S.quantiles(l, "l_quantity", [0.99]).select(F.get("quantiles", F.lit(0)).alias("q"))
    c = l.crossJoin(F.broadcast(p)).select("l_orderkey", "l_linenumber", clip(finite(F.col("l_quantity")), F.lit(0.0), F.col("q")).alias("lag"))  # one row of quantiles
    return _rounded(L.standardise(c, ["lag"]))


_FOLDS = f"WITH {B.SAMPLE}, r AS (SELECT id, d, row_number() OVER (ORDER BY d, md5('42-' || id), id) - 1 AS place FROM sample)"


@query("j02_stratified_folds", _FOLDS + " SELECT id, d, (place % 5)::INT AS fold FROM r")
def j02_folds(spark, sf):
    return L.stratified_folds(B.sample(spark, sf).select("id", "d"))


#: Eight overlapping groups, as rules over the sample.
EIGHT = {"full": "true", "large": "l_quantity > 25", "small": "l_quantity <= 25", "cheap": "l_discount < 0.05", "dear": "l_extendedprice > 30000", "taxed": "l_tax > 0.04", "untaxed": "l_tax <= 0.04", "odd": "id % 2 = 1"}


@query(
    "j11_group_folds",
    f"WITH {B.SAMPLE}, g AS (SELECT id, d, unnest(list_filter([{', '.join(f"CASE WHEN {r} THEN '{n}' END" for n, r in EIGHT.items())}], lambda z: z IS NOT NULL)) AS subgroup FROM sample) SELECT subgroup, id, ((row_number() OVER (PARTITION BY subgroup ORDER BY d, md5('42-' || id), id) - 1) % 5)::INT AS fold FROM g",
)
def j11_folds(spark, sf):
    s = B.sample(spark, sf)
    folded = L.overlapping_folds(s, {n: F.expr(r) for n, r in EIGHT.items()}, keep=["id"])
    long = folded.select("id", F.posexplode("folds").alias("k", "fold")).filter("fold IS NOT NULL")
    return long.select(F.get(F.array(*[F.lit(n) for n in EIGHT]), F.col("k")).alias("subgroup"), "id", "fold")


def _refits(spark, sf, replicates=500):
    s = B.sample(spark, sf).drop("ps").withColumns({"week": (F.col("id") % 7).cast("double"), "price": F.log("l_extendedprice")})
    return D.group_effects(s, [*X3, "week", "price"], {n: F.expr(r) for n, r in EIGHT.items()}, ["y", "y2"], replicates=replicates)


@query("j11_subgroup_refits")
def j11_refits(spark, sf):
    return _rounded(_refits(spark, sf)[0])


@query("j11_subgroup_diagnostics")
def j11_diagnostics(spark, sf):
    return _rounded(_refits(spark, sf)[1])


@query("j02_propensity")
def j02(spark, sf):
    s = B.sample(spark, sf).drop("ps")
    return L.propensity(s, X3).select("id", "d", F.round("ps", 6).alias("ps"))


@query("j04_coefficients")
def j04(spark, sf):
    s = L.standardise(B.sample(spark, sf), X3)
    beta = L.logistic_beta(s, X3, "d")
    table = spark.createDataFrame([(c, float(b)) for c, b in zip(X3, beta)], "variable string, coef double")
    return L.rank_by_size(table, "coef", 20, "variable").withColumn("abs_coef", F.abs("coef"))


def _blocks():
    """Blocks of columns of the sample, by name, and the expressions of those that it does not have."""
    q, x, c, w = (F.col(f"l_{k}") for k in ("quantity", "extendedprice", "discount", "tax"))
    made = {
        "emb": {"e0": F.sin(q), "e1": F.cos(q), "e2": F.sin(x / 1000)},
        "emb_full": {"e0": F.sin(q), "e1": F.cos(q), "e2": F.sin(x / 1000), "e3": F.cos(x / 1000), "e4": F.sin(100 * c)},
        "temporal": {f"t{k}": (F.col("id") % 4 == k).cast("int") for k in range(1, 4)},
        "qtype": {"cheap": (c < 0.05).cast("int"), "low_tax": (w < 0.04).cast("int")},
        "mentor": {"m0": F.col("cluster") % 7},
    }
    blocks = {"history": ["l_quantity", "l_extendedprice"], "qtext": ["l_discount"], "qpersp": ["l_tax"], **{k: list(v) for k, v in made.items()}}
    return blocks, {c: e for v in made.values() for c, e in v.items()}


def _unions(blocks):
    """The sixteen named sets: all, all but one, all with the whole embedding, single blocks and pairs, all with the mentor's columns."""
    full = ["history", "qtext", "qpersp", "qtype", "emb", "temporal"]
    sets = {"full": full, **{f"full - {b}": [x for x in full if x != b] for b in ("qtype", "temporal", "emb", "qtext", "qpersp")}}
    sets |= {"full + whole emb": ["emb_full" if x == "emb" else x for x in full], "history": ["history"], **{f"history + {b}": ["history", b] for b in ("emb", "qtext", "qpersp", "qtype")}}
    sets |= {"question": ["qtext", "qpersp", "qtype"], "emb": ["emb"], "qtype": ["qtype"], "full + mentor": [*full, "mentor"]}
    return {name: [c for b in bs for c in blocks[b]] for name, bs in sets.items()}


@query("j05_ablation")
def j05(spark, sf):
    blocks, made = _blocks()
    out = D.ablation(B.sample(spark, sf).drop("ps").withColumns(made), _unions(blocks), "y", replicates=200)
    return _rounded(out)


@query("j06_pca")
def j06(spark, sf):
    p = L.pca(_vectors(spark, sf), "embedding", 20, "pc")
    return p.select("vec_id", *[F.round(F.get("pc", F.lit(k)), 6).alias(f"pc{k + 1}") for k in range(20)])


@query("j07_one_hot", "SELECT doc_id, (lang = 'en')::INT AS lang_en, (lang = 'es')::INT AS lang_es, (lang = 'fr')::INT AS lang_fr FROM documents")
def j07(spark, sf):
    return L.one_hot(t(spark, sf, "documents").select("doc_id", "lang"), "lang", "lang_").drop("lang")


@query("j13_independent_columns", "SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS variable")
def j13(spark, sf):
    l = t(spark, sf, "lineitem").select(*X3, F.lit(1.0).alias("constant"), (F.col("l_quantity") * 2 + F.col("l_tax")).alias("sum"))
    kept = L.independent_columns(l, ["l_quantity", "constant", "l_discount", "l_tax", "sum"])
    return spark.createDataFrame([(c,) for c in kept], "variable string")


@query("j14_mixed_model")
def j14(spark, sf):
    return _rounded(L.mixed_model(B.sample(spark, sf), X3, "y", "cluster"), 5)


@query("j15_ols", "SELECT 'l_quantity' AS variable, round(regr_slope(l_extendedprice, l_quantity), 4) AS beta, round(sqrt((1 - regr_r2(l_extendedprice, l_quantity)) * var_pop(l_extendedprice) / var_pop(l_quantity) / (count(*) - 2)), 4) AS se FROM lineitem")
def j15(spark, sf):
    o = L.ols(t(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice")
    return o.select("variable", F.round("beta", 4).alias("beta"), F.round("se", 4).alias("se"))


_BASE = {"q": "l_quantity", "x": "l_extendedprice", "c": "l_discount", "w": "l_tax", "g": "id % 7", "h": "id % 11"}
_GROUPS = {"all": "true", "large": "l_quantity > 25", "small": "l_quantity <= 25", "cheap": "l_discount < 0.05", "dear": "l_extendedprice > 30000", "taxed": "l_tax > 0.04", "untaxed": "l_tax <= 0.04"}


@query("j17_associations")
def j17(spark, sf):
    """Six outcomes on 21 features (six columns and their products), over all rows and in six subgroups of 200 rows at least."""
    s = cut(B.sample(spark, sf).drop("ps", "d"))  # joined once, not for each pass
    raw = {k: F.expr(e).cast("double") for k, e in _BASE.items()}
    base = {k: (raw[k] - mean) / deviation for k, (mean, deviation) in L.scales(s, raw).items()}
    pairs = {f"{a}_{b}": (a, b) for i, a in enumerate(_BASE) for b in list(_BASE)[i + 1 :]}
    found = L.scales(s, {k: base[a] * base[b] for k, (a, b) in pairs.items()})
    made = {"y3": F.col("l_extendedprice") * (1 - F.col("l_discount")) / 10_000, "y4": F.col("y") * F.col("y2"), "y5": F.log1p("l_extendedprice"), "y6": (F.col("id") % 5).cast("double")}
    out = L.mixed_groups(s, base, {"y": F.col("y"), "y2": F.col("y2")} | made, "cluster", {n: F.expr(r) for n, r in _GROUPS.items()}, {k: (*pairs[k], *found[k]) for k in pairs}, least=200)
    return _rounded(out.withColumn("stars", stars(F.col("p"))), 5)


@query("j19_residual", "WITH b AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem) SELECT l_orderkey, l_linenumber, round(l_extendedprice - a - b * l_quantity, 2) AS residual FROM lineitem, b")
def j19(spark, sf):
    r = L.residual(t(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice", 0.0, "residual")
    return r.select("l_orderkey", "l_linenumber", F.round("residual", 2).alias("residual"))


def _solve_sql(name, table, columns, y, keys="", ridge=0.0):
    """SQL of the least squares of y on two columns, centred: sums by keys, then Cramer's rule; with a ridge on both."""
    a, b = columns
    by = f"{keys}, " if keys else ""
    group = f" GROUP BY {keys}" if keys else ""
    return (
        f"{name}_m AS (SELECT {by}count(*)::DOUBLE AS n, avg({a}) AS ma, avg({b}) AS mb, avg({y}) AS my, var_pop({a}) * count(*) + {ridge} AS aa, var_pop({b}) * count(*) + {ridge} AS bb, "
        f"covar_pop({a}, {b}) * count(*) AS ab, covar_pop({a}, {y}) * count(*) AS ay, covar_pop({b}, {y}) * count(*) AS by_, var_pop({y}) * count(*) AS yy FROM {table}{group}), "
        f"{name} AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS ba, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS bb_ FROM {name}_m)"
    )


_FOLDS = """e AS (SELECT [quantile_cont(l_orderkey, 0.2), quantile_cont(l_orderkey, 0.4), quantile_cont(l_orderkey, 0.6), quantile_cont(l_orderkey, 0.8)] AS e FROM lineitem),
l AS (SELECT l_discount AS a, l_quantity AS b, l_extendedprice AS y, len(list_filter(e, lambda z: z < l_orderkey)) AS fold FROM lineitem, e),
tr AS (SELECT f, a, b, y FROM l, range(5) r(f) WHERE fold <> f)"""


@query("j20_ridge_cv", f"WITH {_FOLDS}, {_solve_sql('s', 'tr', ['a', 'b'], 'y', 'f', 10.0)}, r AS (SELECT f, 1 - sum((y - my - ay / aa * (a - ma)) ** 2) / (var_pop(y) * count(*)) AS r1, 1 - sum((y - my - ba * (a - ma) - bb_ * (b - mb)) ** 2) / (var_pop(y) * count(*)) AS r2 FROM l JOIN s ON fold = f GROUP BY f) SELECT round(avg(r1), 6) AS r2_base, round(avg(r2), 6) AS r2, round(avg(r2) - avg(r1), 6) AS incremental FROM r")
def j20(spark, sf):
    l = t(spark, sf, "lineitem")
    base, more = L.ridge_cv_r2(l, ["l_discount"], "l_extendedprice", 10.0, "l_orderkey"), L.ridge_cv_r2(l, ["l_discount", "l_quantity"], "l_extendedprice", 10.0, "l_orderkey")
    return spark.createDataFrame([(round(base, 6), round(more, 6), round(more - base, 6))], "r2_base double, r2 double, incremental double")


@query("j21_direction")
def j21(spark, sf):
    v = _vectors(spark, sf).withColumn("c", (F.col("vec_id") % 7).cast("double"))
    _, projected = L.direction(v.withColumn("y", F.col("label").cast("double")), "embedding", "y", ["c"])
    return projected.select("vec_id", F.round("projection", 6).alias("projection"))


def _det3(*rows):
    (a, b, c), (d, e, f), (g, h, i) = rows
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def _dr_sql():
    """In each stratum the coefficient of d beside l_quantity and l_tax, by Cramer's rule on centred sums."""
    x = ["d", "l_quantity", "l_tax"]
    inner = [f"covar_pop({a}, {b}) * count(*) AS c{i}{j}" for i, a in enumerate(x) for j, b in enumerate(x)] + [f"covar_pop({a}, v) * count(*) AS y{i}" for i, a in enumerate(x)]
    below, above = [[f"c{i}{j}" for j in range(3)] for i in range(3)], [[f"y{i}", f"c{i}1", f"c{i}2"] for i in range(3)]
    return f"""WITH {B.SAMPLE}, e AS (SELECT list_sort(list_distinct([{", ".join(f"quantile_cont(ps, {k / 5})" for k in range(6))}])) AS e FROM sample),
st AS (SELECT sample.*, len(list_filter(e[2:len(e) - 1], lambda z: z < ps)) AS stratum FROM sample, e), g AS (SELECT stratum, d, l_quantity, l_tax, unnest(['y', 'y2']) AS outcome, unnest([y, y2]) AS v FROM st),
s AS (SELECT outcome, stratum, count(*) AS n, {", ".join(inner)} FROM g GROUP BY ALL HAVING sum(d) >= 2 AND count(*) - sum(d) >= 2)
SELECT outcome, round(sum(n * {_det3(*above)} / {_det3(*below)}) / sum(n), 6) AS dr FROM s GROUP BY 1"""


@query("e31_strat_dr", _dr_sql())
def e31(spark, sf):
    s = S.qcut(B.sample(spark, sf), "ps", 5, "stratum")
    return _rounded(L.strat_dr(s, ["l_quantity", "l_tax"], ["y", "y2"]))


_CENT = "cells AS (SELECT label, generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings), cent AS (SELECT label, k, avg(x) AS x FROM cells GROUP BY ALL), nrm AS (SELECT label, sqrt(sum(x * x)) + 1e-12 AS n FROM cent GROUP BY 1), cos AS (SELECT p.label AS a, q.label AS b, sum(p.x * q.x) / any_value(pn.n) / any_value(qn.n) AS cosine FROM cent p JOIN cent q ON p.k = q.k AND p.label < q.label JOIN nrm pn ON pn.label = p.label JOIN nrm qn ON qn.label = q.label GROUP BY ALL)"


@query("j25_centroid_cosines", f"WITH {_CENT} SELECT a, b, round(cosine, 6) AS cosine FROM cos")
def j25(spark, sf):
    return _rounded(C.cosine_matrix(C.centroids(_vectors(spark, sf), "label", "embedding"), "label"))


@query("d14_theta_edges", f"WITH {_CENT} SELECT a, b FROM cos WHERE cosine > 0.1")
def d14(spark, sf):
    return C.cosine_matrix(C.centroids(_vectors(spark, sf), "label", "embedding"), "label").filter("cosine > 0.1").select("a", "b")


@query("j26_merged_clusters", f"WITH RECURSIVE {_CENT}, u AS (SELECT a, b FROM cos WHERE cosine > 0.1 UNION SELECT b, a FROM cos WHERE cosine > 0.1), r(l, root) AS (SELECT DISTINCT label, label FROM embeddings UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.l), m AS (SELECT l, min(root) AS c FROM r GROUP BY l) SELECT l AS label, (dense_rank() OVER (ORDER BY c) - 1)::INT AS merged FROM m")
def j26(spark, sf):
    v = _vectors(spark, sf)
    edges = C.cosine_matrix(C.centroids(v, "label", "embedding"), "label").filter("cosine > 0.1")
    return C.merged_labels(v, edges)


_COH = "u AS (SELECT vec_id, label, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) + 1e-12 AS n, embedding FROM embeddings), c AS (SELECT label, generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE / n AS x FROM u), s AS (SELECT label, k, sum(x) AS s, count(*) AS n FROM c GROUP BY ALL), coh AS (SELECT label, max(n) AS n, (sum(s * s) - max(n)) / (max(n) * (max(n) - 1)) AS coherence FROM s GROUP BY 1)"


@query("j27_coherence", f"WITH {_COH} SELECT label, n, round(coherence, 6) AS coherence FROM coh")
def j27(spark, sf):
    return _rounded(C.coherence(_vectors(spark, sf), "label", "embedding"))


@query("j27_dissolved", f"WITH {_COH} SELECT vec_id, CASE WHEN coherence < 0.35 AND n >= 5 THEN -1 ELSE embeddings.label END AS label FROM embeddings JOIN coh ON coh.label = embeddings.label")
def j27b(spark, sf):
    return C.dissolved(_vectors(spark, sf), "label", "embedding").select("vec_id", "label")


@query("e46_j29_cluster_profile", "WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id::VARCHAR), vec_id) AS r FROM embeddings) SELECT label, count(*) AS n, round_even(avg(vec_id), 4) AS vec_id, string_agg('t' || vec_id, ' ||| ' ORDER BY r) FILTER (r <= 5) AS samples FROM r GROUP BY label")
def e46(spark, sf):
    return C.profile(_vectors(spark, sf).withColumn("text", F.concat(F.lit("t"), "vec_id")), "label", ["vec_id"], "text", "vec_id")


@query("j28_sub_cells")
def j28(spark, sf):
    v = _vectors(spark, sf).withColumns({"a": F.get("embedding", F.lit(0)), "b": F.get("embedding", F.lit(1))})
    return C.sub_cells(v, "label", ["a", "b"], "vec_id").select("vec_id", "label", "cell")


_NEAR = """v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings UNION ALL SELECT vec_id + 1000000, list_transform(embedding::DOUBLE[], lambda x, i: CASE WHEN i <= 2 THEN 0.0 ELSE x END) FROM embeddings WHERE label % 2 = 0
  UNION ALL SELECT vec_id + 2000000, embedding::DOUBLE[] FROM embeddings WHERE label = 1)"""


@query("j23_j24_threshold_groups", f"WITH RECURSIVE {_NEAR}, u AS (SELECT id, v, sqrt(list_dot_product(v, v)) + 1e-12 AS n FROM v), e AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id < b.id WHERE list_dot_product(a.v, b.v) / a.n / b.n >= 0.95), l AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(l, root) AS (SELECT id, id FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.l), m AS (SELECT l, min(root) AS c FROM r GROUP BY l) SELECT l AS vec_id, (dense_rank() OVER (ORDER BY c) - 1)::INT AS merged FROM m")
def j23(spark, sf):
    """Vectors, those of even labels again with two values cut, and those of one label copied: links around the bound."""
    v = _vectors(spark, sf)
    cut_off = F.transform("embedding", lambda x, i: F.when(i < 2, 0.0).otherwise(x))
    near = v.filter("label % 2 = 0").select((F.col("vec_id") + 1000000).alias("vec_id"), cut_off.alias("embedding"))
    copies = v.filter("label = 1").select((F.col("vec_id") + 2000000).alias("vec_id"), "embedding")
    return C.threshold_groups(v.select("vec_id", "embedding").union(near).union(copies), "vec_id", "embedding", least=0.95, bits=8)


_MODERATORS = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}
_FLAGS = {"cheap": "l_discount < 0.05", "taxed": "l_tax > 0.04", "even": "id % 2 = 0", "dear": "l_extendedprice > 30000"}
_OUTCOMES = {"y": "y", "y2": "y2", "paid": "l_extendedprice * (1 - l_discount) / 10000", "both": "y * y2", "mod": "id % 7"}
_KS = [3, 5, 7, 10]


def _moderated(spark, sf, k):
    """The sample with strata, four standardised moderators, four of two values and five outcomes."""
    s = S.qcut(B.sample(spark, sf), "ps", k, "stratum").withColumns({n: F.expr(e).cast("double") for n, e in {**_MODERATORS, **_FLAGS, **_OUTCOMES}.items()})
    return L.standardise(s, list(_MODERATORS))


def _moderation_sql(k):
    """Coefficients of d, m and dm within strata: sums of centred products by stratum, added up, then Cramer's rule."""
    v = ["d", "m", "dm"]
    cells = {f"c{i}{j}": f"covar_pop({a}, {b}) * count(*)" for i, a in enumerate(v) for j, b in enumerate(v)} | {f"y{i}": f"covar_pop({a}, v) * count(*)" for i, a in enumerate(v)}
    below = [[f"c{i}{j}" for j in range(3)] for i in range(3)]
    cramer = lambda at: f"{_det3(*[[f'y{i}' if j == at else f'c{i}{j}' for j in range(3)] for i in range(3)])} / {_det3(*below)}"
    scaled = [f"({e} - avg({e}) OVER ()) / stddev_pop({e}) OVER ()" for e in _MODERATORS.values()] + [f"({e})::INT::DOUBLE" for e in _FLAGS.values()]
    return f"""WITH {E._strata_sql(k)}, a AS (SELECT stratum, d::DOUBLE AS d, unnest({[*_MODERATORS, *_FLAGS]}) AS moderator, unnest([{", ".join(scaled)}]) AS m, {", ".join(f"({e})::DOUBLE AS o_{n}" for n, e in _OUTCOMES.items())} FROM st),
b AS (SELECT stratum, d, moderator, m, d * m AS dm, unnest({list(_OUTCOMES)}) AS outcome, unnest([{", ".join(f"o_{n}" for n in _OUTCOMES)}]) AS v FROM a WHERE stratum IS NOT NULL),
s AS (SELECT moderator, outcome, stratum, {", ".join(f"{e} AS {n}" for n, e in cells.items())} FROM b GROUP BY ALL), w AS (SELECT moderator, outcome, {", ".join(f"sum({n}) AS {n}" for n in cells)} FROM s GROUP BY ALL),
r AS (SELECT moderator, outcome, {cramer(0)} AS beta_d, {cramer(2)} AS beta_dxm FROM w)"""


@query("m03_moderation", f"{_moderation_sql(5)} SELECT moderator, outcome, round(beta_d, 6) AS beta_d, round(beta_dxm, 6) AS beta_dxm FROM r")
def m03(spark, sf):
    found = D.moderation(_moderated(spark, sf, 5), [*_MODERATORS, *_FLAGS], list(_OUTCOMES))
    return _rounded(found.select("moderator", "outcome", "beta_d", "beta_dxm"))


@query("m03_moderation_intervals")
def m03b(spark, sf):
    return _rounded(D.moderation(_moderated(spark, sf, 5), [*_MODERATORS, *_FLAGS], list(_OUTCOMES), replicates=200))


@query("m04_net_effects", " UNION ALL ".join(f"(SELECT * FROM ({_moderation_sql(k)} SELECT {k} AS k, moderator, round(beta_d, 6) AS beta_d, round(beta_dxm, 6) AS beta_dxm, round(beta_d + beta_dxm, 6) AS net FROM r WHERE outcome = 'y' AND moderator IN ({', '.join(repr(m) for m in _FLAGS)})))" for k in _KS))
def m04(spark, sf):
    """The grid of strata: effects with and without each moderator of two values."""
    out = None
    for k in _KS:
        part = D.moderation(_moderated(spark, sf, k), list(_FLAGS), ["y"]).select(F.lit(k).alias("k"), "moderator", "beta_d", "beta_dxm", (F.col("beta_d") + F.col("beta_dxm")).alias("net"))
        out = part if out is None else out.unionByName(part)
    return _rounded(out)


@query("m07_cluster_betas", f"WITH v AS (SELECT label, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS y FROM embeddings), {_solve_sql('s', 'v', ['a', 'b'], 'y', 'label')} SELECT label::INT AS label, round(ba, 6) AS beta_a, round(bb_, 6) AS beta_b, round((ba * ay + bb_ * by_) / yy, 6) AS r2 FROM s")
def m07(spark, sf):
    v = _vectors(spark, sf).withColumn("y", F.get("embedding", F.lit(2)))
    out = L.group_betas(v, F.slice("embedding", 1, 2), 2, "y", "label")
    return _rounded(out.select(F.col("label").cast("int").alias("label"), F.get("beta", F.lit(0)).alias("beta_a"), F.get("beta", F.lit(1)).alias("beta_b"), "r2"))


def _cluster_betas(spark, sf):
    """The last dimension on all others, within each cluster; ridge, as clusters may be smaller than the vectors are long."""
    v = _vectors(spark, sf).withColumn("y", F.element_at("embedding", -1))
    return L.group_betas(v, F.slice("embedding", 1, 63), 63, "y", "label", 1.0)


@query("m07_beta_vectors")
def m07_vectors(spark, sf):
    b = _cluster_betas(spark, sf)
    return b.select("label", "n", F.round("intercept", 6).alias("intercept"), F.round("r2", 6).alias("r2"), F.posexplode("beta").alias("k", "beta")).withColumn("beta", F.round("beta", 6))


@query("m07_beta_cosines")
def m07_cosines(spark, sf):
    return _rounded(C.cosine_matrix(_cluster_betas(spark, sf).withColumnRenamed("beta", "centroid"), "label"))


@query("m08_covariance_matches")
def m08_covariance(spark, sf):
    v = _vectors(spark, sf).withColumn("age", F.get("embedding", F.lit(0)) * 100 + F.col("vec_id") % 13)
    return _rounded(C.covariance_matches(v, ["label"], "embedding", 64, F.col("vec_id") % 5 == 0, "vec_id", age="age"))


@query("m08_matched_groups", "WITH v AS (SELECT vec_id, label, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings), s AS (SELECT var_pop(a) AS va, var_pop(b) AS vb FROM v), f AS (SELECT label, arg_min(a, vec_id) AS fa, arg_min(b, vec_id) AS fb FROM v WHERE a > 0 GROUP BY 1), d AS (SELECT label, vec_id, sqrt((a - fa) * (a - fa) / va + (b - fb) * (b - fb) / vb) AS distance FROM v JOIN f USING (label), s) SELECT label, vec_id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id)::INT AS rank FROM d QUALIFY rank <= 3")
def m08(spark, sf):
    v = _vectors(spark, sf).withColumns({"a": F.get("embedding", F.lit(0)), "b": F.get("embedding", F.lit(1))})
    return _rounded(C.matched_groups(v, ["label"], ["a", "b"], F.col("a") > 0, "vec_id"))


@query("j24_density_clusters")
def j24(spark, sf):
    from threadloom.operators.density import density_clusters

    return density_clusters(_vectors(spark, sf), "vec_id", "embedding")


@query("j23_neighbour_embedding")
def j23(spark, sf):
    from threadloom.operators.embedding import neighbour_embedding

    y = neighbour_embedding(_vectors(spark, sf), "vec_id", "embedding")
    return y.select("vec_id", F.round(F.get("y", F.lit(0)), 3).alias("y0"), F.round(F.get("y", F.lit(1)), 3).alias("y1"))


@query("a12_a13_i08_i09_plugins", "SELECT d.doc_id, l.toxic::DOUBLE AS toxicity, 0::DOUBLE AS compound FROM documents d LEFT JOIN labels l USING (doc_id)")
def plugins(spark, sf):
    from threadloom.functions.plugins import table_scores, zero_scores

    scores = t(spark, sf, "labels").select("doc_id", F.col("toxic").cast("double").alias("toxicity"))
    return zero_scores(table_scores(t(spark, sf, "documents").select("doc_id"), scores, "doc_id", ["toxicity"]), ["compound"])


@query(
    "k05_a13_bounded_calls",
    "WITH d AS (SELECT doc_id, len(coalesce(text, '')) AS n FROM documents) SELECT doc_id, CASE WHEN n % 5 > 0 THEN n::DOUBLE END AS chars, CASE WHEN n % 5 = 0 THEN 'no answer' END AS error, CASE WHEN n % 5 = 0 THEN 2 ELSE 0 END AS tries FROM d",
)
def k05(spark, sf):
    """A service that fails for some texts, called twice over: what it has answered is not asked again, the rest are dead letters."""
    from threadloom.functions.plugins import resumed_scores
    from threadloom.sources.io import scratch

    def service(text):
        if len(text) % 5 == 0:
            raise ValueError("no answer")
        return {"chars": len(text)}

    docs, path = t(spark, sf, "documents").select("doc_id", "text"), scratch(spark, "calls")
    resumed_scores(docs.filter("doc_id % 2 = 0"), "text", "doc_id", ["chars"], service, path, tries=2, waits=(0.0,))
    scored, dead = resumed_scores(docs, "text", "doc_id", ["chars"], service, path, tries=2, waits=(0.0,))
    return scored.withColumns({"error": F.lit(None).cast("string"), "tries": F.lit(0)}).unionByName(dead.withColumn("chars", F.lit(None).cast("double")))


def _streamed(spark, sf, name):
    """A table as a file stream."""
    path = f"{sf}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    folder, leaf = path.rsplit("/", 1)
    return spark.readStream.schema(schema).option("pathGlobFilter", leaf).parquet(folder) if not _is_dir(spark, path) else spark.readStream.schema(schema).parquet(path)


def _is_dir(spark, path):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _drained(spark, frame, mode):
    """The result of a stream once its files are read, from a table in the shared folder: appended to, or written anew by each batch."""
    from threadloom.sources.io import scratch

    path, seen = scratch(spark, "stream"), scratch(spark, "stream-checkpoint")
    if mode == "append":
        out = frame.writeStream.format("parquet").option("path", path)
    else:
        out = frame.writeStream.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(path))
    out.outputMode(mode).option("checkpointLocation", seen).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(frame.schema).parquet(path)


@query("k02_stream_windows", "SELECT strftime(time_bucket(INTERVAL 1 day, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def k02(spark, sf):
    from threadloom.streaming.roster import windowed_counts

    e = _streamed(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = _drained(spark, windowed_counts(e, "ts", ["event_type"], "1 day"), "complete")
    return w.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("k01_stream_ingest", "SELECT DISTINCT event_id, event_type FROM events")
def k01(spark, sf):
    from threadloom.streaming.roster import ingest

    e = _streamed(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "event_type", "ts")
    return _drained(spark, ingest(e, "event_id", "ts", "40 days"), "append").select("event_id", "event_type")


@query("k03_stream_roster", "SELECT member, seq, CASE WHEN p THEN 'joined' ELSE 'left' END AS event FROM (SELECT user_id AS member, event_id AS seq, value > 50 AS p, lag(value > 50, 1, false) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE p <> before")
def k03(spark, sf):
    from threadloom.streaming.roster import roster_states

    e = _streamed(spark, sf, "events").select(F.col("user_id").alias("member"), F.col("event_id").alias("seq"), (F.col("value") > 50).alias("present"))
    return _drained(spark, roster_states(e), "append")


@query("k04_stream_interval_join", "SELECT q.event_id AS question, e.event_id AS event FROM events q JOIN events e ON e.user_id = q.user_id AND e.ts < q.ts AND e.ts >= q.ts - INTERVAL 2 DAYS WHERE q.event_type = 'signup' AND q.value > 60")
def k04(spark, sf):
    from threadloom.streaming.roster import interval_pairs

    e = _streamed(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    asked = e.filter("event_type = 'signup' AND value > 60").select("user_id", F.col("event_id").alias("question"), F.col("ts").alias("asked"))
    pairs = interval_pairs(asked, e.select("user_id", F.col("event_id").alias("event"), "ts"), "user_id", 2)
    return _drained(spark, pairs.select("question", "event"), "append")


@query("a20_sinks", "SELECT unnest(['appended', 'csv', 'json', 'json array', 'text']) AS sink, l_orderkey, n FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)")
def a20(spark, sf):
    """Counts written to the shared folder as JSON lines, CSV, text, one JSON array for each file, and two appended halves, and read again."""
    from threadloom.sources import io

    n, shape = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")), "l_orderkey long, n long"
    at = {k: io.scratch(spark, f"sink-{k.replace(' ', '-')}") for k in ("json", "csv", "text", "appended", "json array")}
    io.write(n, at["json"], "json")
    io.write(n, at["csv"], "csv")
    n.select(F.concat_ws("\t", "l_orderkey", "n").alias("value")).write.text(at["text"])
    for odd in (0, 1):
        io.write(n.filter(F.col("l_orderkey") % 2 == odd), at["appended"], "parquet", "append")
    n.groupBy(F.floor(F.col("l_orderkey") / 10_000).alias("file")).agg(F.to_json(F.collect_list(F.struct("l_orderkey", "n"))).alias("value")).select("value").write.text(at["json array"])
    cells = F.split("value", "\t")
    back = {
        "json": io.read_json(spark, at["json"], shape),
        "csv": spark.read.schema(shape).option("header", True).csv(at["csv"]),
        "text": spark.read.text(at["text"]).select(cells[0].cast("long").alias("l_orderkey"), cells[1].cast("long").alias("n")),
        "appended": spark.read.schema(shape).parquet(at["appended"]),
        "json array": spark.read.text(at["json array"]).select(F.explode(F.from_json("value", f"array<struct<{shape.replace(' long', ': long')}>>")).alias("r")).select("r.*"),
    }
    out = None
    for name, rows in back.items():
        part = rows.select(F.lit(name).alias("sink"), "l_orderkey", "n")
        out = part if out is None else out.union(part)
    return out
