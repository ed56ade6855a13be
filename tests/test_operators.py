"""Operators on rows at their boundaries."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.functions.scalar import DAY, parse_ts
from threadloom.operators import cluster as C
from threadloom.operators import corpus as K
from threadloom.operators import designs as D
from threadloom.operators import linear as L
from threadloom.operators import sequence as Q
from threadloom.operators import stats as S
from threadloom.operators import temporal as T
from threadloom.sources import io


def test_as_of_boundaries(spark):
    history = spark.createDataFrame([("a", 10, 1), ("a", 20, None), ("a", 30, 0)], "k string, us long, w int")
    probe = spark.createDataFrame([("a", 9, 0), ("a", 10, 1), ("a", 25, 2), ("a", 30, 3), ("b", 5, 4)], "k string, us long, id int")
    got = {r.id: r.w for r in T.as_of(probe, history, "k", "w").collect()}
    assert got == {0: None, 1: 1, 2: 1, 3: 0, 4: None}
    assert {r.id: r.w for r in T.as_of(probe, history, "k", "w", clamp=True).collect()} == {0: 1, 1: 1, 2: 1, 3: 0, 4: None}


def _events(spark, rows):
    schema = "u int, q long, us long, ns int, sizediff double, tags array<string>, title string"
    return spark.createDataFrame([(1, 0, d * DAY // 24 if isinstance(d, int) else int(d * DAY), ns, float(s), tags, "t") for d, ns, s, tags in rows], schema)


def test_look_back_is_half_open(spark):
    rows = _events(spark, [(-1.0, 0, 5, []), (0.0, 0, 5, []), (-7.0, 3, -5, ["x"]), (-7.5, 118, 1, None)])
    f = T.aggregate_all(rows, ["u"], T.lookback_features([1, 7]), T.history_features()).first()
    assert (f.n_edits_1d, f.n_edits_7d, f.n_usertalk_7d, f.n_edits_all, f.draft_ratio_all) == (1, 2, 1, 3, pytest.approx(1 / 3))
    assert f.avg_sizediff_7d == 0 and f.std_sizediff_all == pytest.approx(np.std([5, -5, 1]))
    assert f.hours_since_last_edit == 24 and f.active_span_hours == pytest.approx(6.5 * 24)


def test_no_events(spark):
    rows = spark.createDataFrame([(1, 0, None, None, None, None, None)], "u int, q long, us long, ns int, sizediff double, tags array<string>, title string")
    f = T.aggregate_all(rows, ["u"], T.lookback_features([1]), T.history_features(), T.retention_outcomes(), T.continuous_outcomes(), T.tag_features()).first()
    assert (f.n_edits_1d, f.avg_sizediff_1d, f.hours_since_last_edit, f.days_to_first_post_edit, f.days_to_5th, f.last_edit_days_post_q, f.tag_mobile) == (0, 0, -1, 60, 37, 0, 0)


def test_outcome_windows(spark):
    rows = _events(spark, [(7.0, 0, 0, []), (14.0, 0, 0, []), (8.0, 3, 0, []), (36.99, 2, 0, ["mw-reverted"])])
    o = T.aggregate_all(rows, ["u"], T.retention_outcomes(), T.quality_outcomes()).first()
    assert (o.ret_7d_count, o.ret_14d_count, o.ret_30d_count, o.ret_7d, o.ret_14_28d) == (1, 2, 3, 1, 0)
    assert (o.reverted_count, o.productive_edits, o.unique_ns) == (1, 2, 2)
    a = T.aggregate_all(rows.withColumn("anchor", F.lit(0)), ["u"], T.anchor_outcomes(), T.anchor_windows()).first()
    assert (a.primary, a.n_mainspace_edits_14d, a.sec2, a.cross_day_any_14d, a.mainspace_7d, a.th_1plus_15_28d) == (1, 2, 0, 1, 1, 0)


def test_streaks_and_gaps(spark):
    days = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("a", 3), ("a", 9), ("b", 5), ("c", 1), ("c", 8)], "k string, day long")
    assert {r.k: r.streak for r in T.max_streak(days, ["k"]).collect()} == {"a": 3, "b": 1, "c": 1}
    assert {r.k: r.returned for r in T.returned_after_gap(days, ["k"], 7).collect()} == {"a": 0, "b": 0, "c": 1}


def test_snapshot_replay_gives_the_last_snapshot(spark):
    rng = random.Random(1)
    sets = [{rng.randint(0, 9) for _ in range(rng.randint(0, 6))} for _ in range(12)]
    members = spark.createDataFrame([(k, m) for k, s in enumerate(sets) for m in s], "seq long, member int")
    snaps = spark.createDataFrame([(k, k * 10) for k in range(len(sets))], "seq long, us long")
    active = set()
    for r in Q.snapshot_events(members, snaps).orderBy("seq").collect():
        (active.add if r.event == "joined" else active.remove)(r.member)
        assert r.us == r.seq * 10
    assert active == sets[-1]


def test_map_snapshots(spark):
    e = spark.createDataFrame([(0, "a", None, True), (1, "a", 1, True), (2, "a", 1, False), (4, "a", 2, False)], "seq long, uid string, weight int, auto boolean")
    s = spark.createDataFrame([(k, k) for k in range(5)], "seq long, us long")
    got = sorted((r.seq, r.event) for r in Q.map_snapshot_events(e, s).collect())
    assert got == [(0, "joined"), (1, "weight_change"), (2, "auto_assigned_change"), (3, "left"), (4, "joined")]


def test_look_ahead_of_twenty_rows(spark):
    rows = spark.createDataFrame([(1, k, "m" if k in (21, 42) else "x") for k in range(45)], "p int, k int, who string")
    got = {r.k: r.found for r in Q.next_by(rows, ["p"], "k", F.col("who") == "m", "k").collect()}
    assert (got[0], got[1], got[20], got[21], got[22]) == (None, 21, 21, None, 42)


def test_first_and_last_wins(spark):
    a = spark.createDataFrame([("k", 5, "a5"), ("k", 3, "a3")], "k string, pos int, v string")
    b = spark.createDataFrame([("k", 1, "b1"), ("z", 1, "bz")], "k string, pos int, v string")
    assert {r.k: r.v for r in Q.first_wins([a, b], ["k"], "pos").collect()} == {"k": "a3", "z": "bz"}
    assert [r.v for r in Q.last_valid(a, "k", "pos", F.col("pos") < 5).collect()] == ["a3"]
    got = {r.k: r.v for r in Q.override(b.select("k", "v"), spark.createDataFrame([("k", None), ("n", "n")], "k string, v string"), "k").collect()}
    assert got == {"k": None, "z": "bz", "n": "n"}


def test_null_keys_meet(spark):
    probe = spark.createDataFrame([(None,), ("x",)], "k string")
    build = spark.createDataFrame([(None, 1, 1), (None, 2, 2), ("y", 3, 3)], "k string, v int, pos int")
    assert {r.k: r.v for r in Q.lookup_last(probe, build, ["k"], "v", "pos").collect()} == {None: 2, "x": None}


@pytest.mark.parametrize("seed", range(3))
def test_qcut_equals_pandas(spark, seed):
    import pandas as pd

    x = np.random.default_rng(seed).normal(size=997).round(seed)
    want = pd.qcut(x, 10, labels=False, duplicates="drop")
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double")
    got = [r.b for r in S.qcut(df, "x", 10, "b").orderBy("i").collect()]
    assert got == want.tolist()


def test_qcut_of_a_constant(spark):
    assert {r.b for r in S.qcut(spark.createDataFrame([(1.0,)] * 5, "x double"), "x", 3, "b").collect()} == {None}


def test_kappa(spark):
    rows = spark.createDataFrame([("Y", "Y")] * 4 + [("N", "N")] * 3 + [("Y", "N")] * 2 + [("N", "Y")], "a string, b string")
    c = S.confusion(rows, {"ab": ("a", "b"), "aa": ("a", "a")}).withColumn("k", S.kappa(F.col("yy"), F.col("yn"), F.col("ny"), F.col("nn")))
    got = {r.dimension: r.k for r in c.collect()}
    assert got["aa"] == 1 and got["ab"] == pytest.approx((0.7 - (0.6 * 0.5 + 0.4 * 0.5)) / 0.5)
    all_y = S.confusion(spark.createDataFrame([("Y", "Y")], "a string, b string"), {"ab": ("a", "b")})
    assert all_y.select(S.kappa(*[F.col(c) for c in ("yy", "yn", "ny", "nn")])).first()[0] == 1


def _units(spark, n=4000, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=n)
    d = (r.uniform(size=n) < 1 / (1 + np.exp(-0.8 * x))).astype(int)
    y = 0.5 * d + x + r.normal(size=n) * 0.5
    return spark.createDataFrame([(i, i % 200, int(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(d, x, y))], "id long, cluster int, d int, x double, y double")


def test_effect_is_found(spark):
    units = L.propensity(_units(spark), ["x"])
    auc = S.auc(units).first().auc
    rows = S.qcut(units, "ps", 20, "stratum").cache()
    sums = S.stratum_sums(rows, ["y"])
    att, naive = S.strat_att(sums, ["outcome"]).first().att, S.naive_difference(sums, ["outcome"]).first().naive
    dr = L.strat_dr(rows, ["x"], ["y"]).first().dr
    assert 0.65 < auc < 0.75 and naive > 1 and abs(att - 0.5) < 0.08 and abs(dr - 0.5) < 0.05
    ci = S.cluster_bootstrap(rows, ["y"], replicates=200).first()
    assert ci.ci_low < att < ci.ci_high and ci.ci_high - ci.ci_low < 0.2
    b = S.balance(rows, ["x"]).first()
    assert b.raw > 0.5 and b.strat < 0.1


def test_thin_strata_are_left_out(spark):
    rows = spark.createDataFrame([(0, 1, 1.0), (0, 0, 0.0), (0, 0, 0.0)], "stratum int, d int, y double")
    assert S.strat_att(S.stratum_sums(rows, ["y"]), ["outcome"]).first().att is None


def test_ols_and_ridge(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 2))
    y = 1 + x @ [2.0, -1.0] + r.normal(size=300)
    df = spark.createDataFrame([(i, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "i int, a double, b double, y double")
    design = np.column_stack([x, np.ones(300)])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    got = {v.variable: v for v in L.ols(df, ["a", "b"], "y").collect()}
    assert got["a"].beta == pytest.approx(beta[0]) and got["b"].beta == pytest.approx(beta[1]) and got["a"].p < 1e-10
    assert L.student_tail(2.0, 10) == pytest.approx(0.0733880, abs=1e-6) and L.student_tail(0.0, 5) == pytest.approx(1.0)
    assert L.independent_columns(df.withColumn("c", F.col("a") + F.col("b")).withColumn("k", F.lit(2.0)), ["a", "k", "b", "c"]) == ["a", "b"]
    assert L.ridge_cv_r2(df, ["a", "b"], "y", 10.0, "i") > 0.75


def test_logistic_equals_newton(spark):
    units = _units(spark, 500)
    rows = units.collect()
    x, d = np.array([[r.x, 1.0] for r in rows]), np.array([r.d for r in rows])
    b = np.zeros(2)
    for _ in range(30):
        m = 1 / (1 + np.exp(-x @ b))
        b += np.linalg.solve((x.T * (m * (1 - m))) @ x + np.diag([1.0, 0]), x.T @ (d - m) - np.diag([1.0, 0]) @ b)
    assert L.logistic_beta(units, ["x"], "d") == pytest.approx(b, abs=1e-6)


def test_mixed_model_finds_the_group_share(spark):
    r = np.random.default_rng(5)
    g = np.repeat(np.arange(100), 20)
    x = r.normal(size=2000)
    y = 0.3 * x + r.normal(size=100)[g] + r.normal(size=2000)
    df = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(g, x, y)], "g int, x double, y double")
    m = L.mixed_model(df, ["x"], "y", "g").first()
    assert abs(m.beta - 0.3) < 0.07 and 0.35 < m.icc < 0.65


def test_spearman_with_ties(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (2, 3), (4, 2)], "x int, y int")
    rx, ry = np.array([1, 2.5, 2.5, 4]), np.array([1.5, 1.5, 4, 3])
    assert S.spearman(df, "x", "y").first().rho == pytest.approx(np.corrcoef(rx, ry)[0, 1])
    assert S.spearman(spark.createDataFrame([(1, 1), (1, 2)], "x int, y int"), "x", "y").first().rho is None


def test_normal_tail_and_e_value(spark):
    row = spark.range(1).select(S.normal_tail(F.lit(1.96)).alias("a"), S.normal_tail(F.lit(-1.0)).alias("b"), *[c.alias(k) for k, c in S.e_value(F.lit(0.2), F.lit(-0.1)).items()]).first()
    assert row.a == pytest.approx(0.0249979, abs=1e-6) and row.b == pytest.approx(0.8413447, abs=1e-6)
    assert row.e_value == pytest.approx(1.2 + math.sqrt(1.2 * 0.2)) and row.e_value_low == 1


def test_merging_and_coherence(spark):
    labels = spark.createDataFrame([(x,) for x in (-1, 2, 3, 5, 7, 9)], "label int")
    edges = spark.createDataFrame([(3, 5), (5, 9)], "a int, b int")
    assert {r.label: r.merged for r in C.merged_labels(labels, edges).collect()} == {-1: -1, 2: 0, 3: 1, 5: 1, 9: 1, 7: 2}
    r = np.random.default_rng(0)
    v = r.normal(size=(6, 4))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = np.mean([u[i] @ u[j] for i in range(6) for j in range(i)])
    df = spark.createDataFrame([(1, row.tolist()) for row in v], "label int, e array<double>")
    assert C.coherence(df, "label", "e").first().coherence == pytest.approx(want)
    assert {x.label for x in C.dissolved(df, "label", "e").collect()} == ({-1} if want < 0.35 else {1})


def test_corpus(spark):
    schema = "id int, mentee string, mentor string, question string, reply string, asked_us long, replied_us long, has_reply boolean, signer string, responders array<string>"
    s = 1_000_000
    rows = [(1, "n", "m", "q", "r", 1000 * s, 700 * s, True, "assigned_mentor", ["m"]), (2, "n", "m", "q", "r", 1000 * s, 699 * s, True, "assigned_mentor", ["m"]), (3, "", "m", "q", "r", None, None, True, "x", []),
            (4, "p", "m", "q", " ", None, None, True, "assigned_mentor", ["m"]), (5, "p", "m", "q", "r", None, None, True, "other_only", ["m", "o"])]
    c = K.clean_conversations(spark.createDataFrame(rows, schema))
    c = c.withColumn("speaker", K.reply_speaker(F.col("signer"), F.col("responders"), F.col("mentor")))
    assert {r.id: r.has_reply for r in c.collect()} == {1: True, 2: False, 4: False, 5: True}
    total = K.totals(K.utterances(c), K.speakers(c)).first()
    assert (total.conversations, total.utterances, total.replies, total.mentees, total.mentors, total.other_responders) == (4, 6, 2, 2, 1, 1)


def test_files(spark, tmp_path):
    path = str(tmp_path / "x")
    io.write(spark.createDataFrame([('{"cid": 1, "Q0": "Y"}',), ("{bad",)], "value string"), path, "text")
    assert [r.cid for r in io.read_json(spark, path, io.SCHEMAS["annotation"], tolerant=True).filter("cid IS NOT NULL").collect()] == [1]
    with pytest.raises(Exception, match="(?i)malformed"):
        io.read_json(spark, path, io.SCHEMAS["annotation"]).collect()
    scores = str(tmp_path / "s")
    io.write(spark.createDataFrame([(1, 0.5, None), (2, None, None)], "conversation_id long, A double, B double"), scores, "csv")
    assert [(r.conversation_id, r.A, r.B) for r in io.read_scores(spark, scores, ["A", "B"]).collect()] == [(1, 0.5, None)]
    io.export_corpus(str(tmp_path / "c"), utterances=spark.range(3))
    assert spark.read.json(str(tmp_path / "c" / "utterances")).count() == 3


@pytest.mark.parametrize(("text", "us"), [("1970-01-02T00:00:00Z", DAY), ("1970-01-01 00:00:01", 1_000_000), ("1970-01-01T00:00:01+00:00", 1_000_000), ("", None), ("2024-13-01T00:00:00Z", None), (None, None)])
def test_parse_ts(spark, text, us):
    assert spark.createDataFrame([(text,)], "t string").select(parse_ts(F.col("t"))).first()[0] == us


def test_one_hot_drops_no_value(spark):
    rows = spark.range(10_001).select(F.col("id").cast("string").alias("v"))
    with pytest.raises(ValueError, match="v has more than 10000 distinct values"):
        L.one_hot(rows, "v", "is_")
    assert L.one_hot(rows.limit(4), "v", "is_", most=4).columns[1:] == ["is_1", "is_2", "is_3"]


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(31)
    rows = [(g, float(x)) for g in ("a", None) for x in rng.choice([0.0, 1.5, *rng.normal(size=60)], 151)] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    at = [0.0, 0.05, 1 / 3, 0.5, 0.9, 1.0]
    got = {r.g: r.q for r in S.quantiles(df, "x", at, ["g"], "q").collect()}
    assert set(got) == {"a", None}
    for g, q in got.items():
        assert q == pytest.approx(np.quantile([x for k, x in rows if k == g and x is not None], at))
    assert S.quantiles(df.limit(0), "x", at).count() == 0


def test_anchor_lags_are_observed_ones(spark):
    lags = spark.createDataFrame([(k * k,) for k in range(30_000)], "lag long")
    out = S.anchor_lags(lags, spark.range(500), draws=3)
    drawn = [r.lag for r in out.filter("strategy IN ('sample', 'mean20')").collect()]
    assert len(drawn) == 2000 and all(int(x**0.5 + 0.5) ** 2 == x for x in drawn) and len(set(drawn)) > 1500
    assert {r.lag for r in out.filter("strategy = 'median'").collect()} == {float(np.median([k * k for k in range(30_000)]))}


def test_gram_of_many_columns(spark):
    rng = np.random.default_rng(32)
    x = rng.normal(size=(300, 41))
    df = spark.createDataFrame([(int(i % 3), *map(float, r)) for i, r in enumerate(x)], ["part", *[f"c{k}" for k in range(41)]])
    for r in L.gram(df, [f"c{k}" for k in range(40)], "c40", ["part"]).collect():
        own = np.insert(x[np.arange(300) % 3 == r.part], 40, 1.0, axis=1)
        assert np.allclose(L.unpack(r[1], 42), own.T @ own)


def test_sub_cells_find_blobs(spark):
    rng = np.random.default_rng(33)
    rows = [(g, k, float(4 * (k % 3) + rng.normal(scale=0.1)), float(4 * (k % 3) + rng.normal(scale=0.1))) for g in (0, 1) for k in range(60)] + [(7, 0, 0.0, 0.0)]
    got = C.sub_cells(spark.createDataFrame(rows, "label int, id int, a double, b double"), "label", ["a", "b"], "id").collect()
    cells = {}
    for r in got:
        cells.setdefault((r.label, r.cell), set()).add(r.id % 3 if r.label < 7 else 0)
    assert all(len(v) == 1 for v in cells.values()) and len(cells) == 7


def test_threshold_groups_equal_brute_force(spark):
    rng = np.random.default_rng(34)
    base = rng.normal(size=(40, 16))
    v = [*base, *(b + rng.normal(scale=s, size=16) for b in base for s in (0.3, 0.45, 0.6)), *base[:5]]
    got = {r.i: r.merged for r in C.threshold_groups(spark.createDataFrame([(i, [float(z) for z in x]) for i, x in enumerate(v)], "i long, v array<double>"), "i", "v", least=0.9, bits=6).collect()}
    u = np.array([x / np.linalg.norm(x) for x in v])
    root = list(range(len(v)))
    for _ in range(len(v)):
        root = [min(root[j] for j in np.flatnonzero(u @ u[i] >= 0.9)) if (u @ u[i] >= 0.9).any() else i for i in range(len(v))]
    names = {c: k for k, c in enumerate(sorted(set(root)))}
    assert got == {i: names[c] for i, c in enumerate(root)} and 40 < len(names) < 160


def test_recent_mentees_are_steps_in_time(spark):
    rng = np.random.default_rng(35)
    day = 86_400_000_000
    rows = [(i, int(rng.integers(2)), int(rng.integers(6)), int(rng.integers(120)) * day // 2, bool(rng.integers(2))) for i in range(300)]
    got = {r.id: r.m_mentees_30d for r in T.mentor_history(spark.createDataFrame(rows, "id long, mentor int, mentee int, us long, replied boolean")).collect()}
    for i, m, _, at, _ in rows:
        assert got[i] == len({w for _, m2, w, t, _ in rows if m2 == m and t < at and (at - t) // day <= 30})


def test_moderation_equals_least_squares_with_stratum_dummies(spark):
    rng = np.random.default_rng(36)
    n = 1200
    s, c, d = rng.integers(4, size=n), rng.integers(150, size=n), rng.integers(2, size=n)
    m, k = rng.normal(size=n), (rng.uniform(size=n) < 0.4).astype(float)
    y = 0.4 * d + 0.7 * d * m - 0.2 * m + s + rng.normal(size=n)
    rows = [(int(a), int(b), int(e), float(f), float(g), float(h)) for a, b, e, f, g, h in zip(s, c, d, m, k, y)] + [(None, 1, 1, 0.0, 0.0, 9.0), (1, 1, 1, None, 0.0, 9.0)]
    df = spark.createDataFrame(rows, "stratum int, cluster int, d int, m double, k double, y double").withColumn("z", F.col("y") * 2)
    got = {(r.moderator, r.outcome): r for r in D.moderation(df, ["m", "k"], ["y", "z"], replicates=200).collect()}
    dummies = (s[:, None] == np.arange(4)).astype(float)
    for name, x in (("m", m), ("k", k)):
        beta = np.linalg.lstsq(np.column_stack([d, x, d * x, dummies]), y, rcond=None)[0]
        r = got[name, "y"]
        assert (r.beta_d, r.beta_dxm) == pytest.approx((beta[0], beta[2])) and got[name, "z"].beta_dxm == pytest.approx(2 * beta[2])
        assert r.ci_low < beta[2] < r.ci_high and abs(r.boot_mean - beta[2]) < r.boot_se
    assert got["m", "y"].significant and 0.04 < got["m", "y"].boot_se < 0.08  # 1 / sqrt(n var(d)) is 0.058
    constant = D.moderation(df.withColumn("m", F.lit(1.0)), ["m"], ["y"]).first()
    assert constant.beta_d is None and constant.boot_se is None
    w = D.multiplicities(np.arange(5000), 40)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.03 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.05


def test_ablation_equals_one_set_at_a_time(spark):
    units = _units(spark, 1500).withColumns({"noise": F.sin(F.col("id") * 12.9), "u": F.col("x") + F.col("noise")}).cache()
    unions = {"x": ["x"], "noise": ["noise"], "both": ["u", "noise"]}
    got = {r.model: r for r in D.ablation(units, unions, "y", replicates=100).collect()}
    for name, columns in unions.items():
        rows = S.qcut(L.propensity(units, columns), "ps", 5, "stratum").cache()
        balance = S.balance(rows.drop(*columns).join(units.select("id", *columns), "id"), columns).collect()
        r = got[name]
        assert r.p == len(columns) and r.smd_above == sum(b.strat > 0.1 for b in balance)
        assert r.auc == pytest.approx(S.auc(rows).first().auc) and r.att == pytest.approx(S.strat_att(S.stratum_sums(rows, ["y"]), ["outcome"]).first().att)
        assert r.ci_low < r.att < r.ci_high and r.sig == "*"
    assert got["noise"].att > got["x"].att + 0.3


def test_mixed_models_of_many_outcomes_equal_single_ones(spark):
    rng = np.random.default_rng(37)
    g = np.repeat(np.arange(40), 12)
    x = rng.normal(size=480)
    df = spark.createDataFrame([(int(a), float(b), float(0.3 * b + rng.normal() + a % 5), float(rng.normal())) for a, b in zip(g, x)], "g int, x double, y double, z double")
    both = {r.outcome: r for r in L.mixed_models(df, ["x"], ["y", "z"], "g").collect()}
    for y in ("y", "z"):
        one = L.mixed_model(df, ["x"], y, "g").first()
        assert (both[y].beta, both[y].se, both[y].icc) == pytest.approx((one.beta, one.se, one.icc))
    assert both["y"].icc > 0.4 and both["z"].icc < 0.1
    assert L.mixed_models(df.filter("false"), ["x"], ["y"], "g").count() == 0


def test_reply_lag_without_reply_and_at_halves(spark, tmp_path):
    """A question without a reply has a clipped lag of 0; lags just short of a half round as the SQL does."""
    import datetime

    from oracle import connection, rows_of_spark, rows_of_sql
    from threadloom.plans import registry

    start = datetime.datetime(2024, 2, 1)
    lags = [None, *(datetime.timedelta(microseconds=900_000_000_000 + 9 * k) for k in range(400))]
    rows = [(2 * u, u, "signup", start, 1.0, "{}") for u in range(len(lags))]
    rows += [(2 * u + 1, u, "purchase", start + lag, 1.0, "{}") for u, lag in enumerate(lags) if lag is not None]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    name = "i10_reply_lag"
    assert rows_of_sql(connection(str(tmp_path)), "SELECT * FROM (" + registry.oracle_sql()[name] + ") WHERE lag_hours IS NULL")[1]
    c = connection(str(tmp_path))
    exact = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    q = registry.queries()[name](spark, str(tmp_path))
    assert exact(q.collect()) == exact(c.sql(f"SELECT {', '.join(q.columns)} FROM ({registry.oracle_sql()[name]})").fetchall())
    assert rows_of_spark(q) == rows_of_sql(c, registry.oracle_sql()[name])


def test_threshold_groups_hold_no_pairs(spark):
    """Many vectors that are all alike, in tiles of a few rows: one group, found without a row for each pair of them."""
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.normal(size=6) + np.zeros((150, 6)), rng.normal(size=6) + np.zeros((150, 6))]) + rng.normal(size=(300, 6)) * 0.02
    table = spark.createDataFrame([(i, [float(z) for z in x]) for i, x in enumerate(v)], "i long, v array<double>")
    written, real = [], C.cut
    C.cut = lambda rows: written.append(real(rows)) or written[-1]
    try:
        got = {r.i: r.merged for r in C.threshold_groups(table, "i", "v", least=0.95, bits=2, tile=40).collect()}
    finally:
        C.cut = real
    assert [got[i] for i in range(300)] == [0] * 150 + [1] * 150
    edges = [t for t in written if set(t.columns) == {"a", "b"}]
    tables, tiles = C.hash_tables(0.95, 2), 300 // 40 + 1
    assert len(edges) == 1 and edges[0].count() <= 300 * tables * tiles and edges[0].count() < 150 * 149 / 2
