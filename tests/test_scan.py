"""Running values by ranges against plain loops, with a key that holds half of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from threadloom.functions.scalar import DAY
from threadloom.operators import scan as S
from threadloom.operators import sequence as seq
from threadloom.operators import temporal as T


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small partitions stay apart, so that keys do cross the borders of ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def hot_rows(n, seed=1):
    """Rows (k, t, id, v): key 0 and the null key hold three quarters of all; times tie, some values are null."""
    rng = random.Random(seed)
    return [(rng.choice([0, 0, 0, 0, None, None, 1, 2]), rng.randint(0, n // 3), i, rng.choice([None, None, *range(9)])) for i in range(n)]


@pytest.mark.parametrize("inclusive", [True, False])
def test_scan_equals_a_loop(spark, inclusive):
    rows = hot_rows(600)
    df = spark.createDataFrame(rows, "k int, t long, id long, v int").repartition(5)
    kinds = ["sum", "max", "min", "last", "first"]
    got = S.scan(df, ["k"], ["t", "id"], {x: (x, F.col("v")) for x in kinds}, inclusive, whole={"all_" + x: (x, F.col("v")) for x in kinds}).collect()
    assert len(got) == len(rows)
    by = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        by.setdefault(r[0], []).append(r)
    take = {"sum": sum, "max": max, "min": min, "last": lambda x: x[-1], "first": lambda x: x[0]}
    for g in got:
        own = by[g.k]
        at = own.index((g.k, g.t, g.id, g.v))
        so_far, whole = ([x[3] for x in part if x[3] is not None] for part in (own[: at + inclusive], own))
        assert [g[x] for x in kinds] == [take[x](so_far) if so_far else None for x in kinds]
        assert [g["all_" + x] for x in kinds] == [take[x](whole) for x in kinds]


def test_a_hot_key_is_spread_over_ranges(spark, monkeypatch):
    df = spark.createDataFrame([(7, t) for t in range(4000)], "k int, t long")
    seen = []
    real = S.cut
    monkeypatch.setattr(S, "cut", lambda rows: seen.append(real(rows)) or seen[-1])
    out = S.scan(df, ["k"], ["t"], {"n": ("sum", F.lit(1))})
    assert out.filter("n <> t + 1").count() == 0
    sizes = [r["count"] for r in seen[0].groupBy("__range").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2000
    windows = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in line]
    by_row = [line for line in windows if "sum(__in_n" in line]
    assert by_row and all("__range" in line.split("],")[1] for line in by_row)


def test_scan_of_no_rows_and_clashing_names(spark):
    df = spark.createDataFrame([], "k int, t long, n string")
    assert S.scan(df, ["k"], ["t"], {"x": ("sum", F.lit(1))}).count() == 0
    out = S.scan(spark.createDataFrame([(1, 1, "a")], "k int, t long, n string"), ["k"], ["t"], {"n": ("last", F.col("n"))})
    assert out.columns == ["k", "t", "n"] and out.first().n == "a"


@pytest.mark.parametrize("clamp", [False, True])
def test_as_of_equals_a_loop(spark, clamp):
    rng = random.Random(3)
    key = lambda: rng.choice([0, 0, 0, 1, 2, None])
    history = [(key(), rng.randint(0, 99), rng.choice([None, 1, 2, 3])) for _ in range(200)]
    probe = [(rng.choice([0, 0, 0, 1, 3, None]), rng.randint(-5, 120), i) for i in range(300)]
    got = T.as_of(spark.createDataFrame(probe, "k int, us long, id int"), spark.createDataFrame(history, "k int, us long, w int"), "k", "w", clamp).collect()
    assert len(got) == len(probe)
    for g in got:
        known = sorted((us, w) for k, us, w in history if k == g.k and w is not None)
        before = [x for x in known if x[0] <= g.us]
        first = [w for us, w in known if us == known[0][0]] if known else []
        assert g.w == (before[-1][1] if before else max(first) if clamp and first else None)


def test_carry_forward_equals_a_loop(spark):
    rows = hot_rows(300, 5)
    got = seq.carry_forward(spark.createDataFrame(rows, "k int, t long, id long, v int"), "k", ["t", "id"], "v", F.lit(-1)).collect()
    for g in got:
        known = [r for r in rows if r[0] == g.k and (r[1], r[2]) <= (g.t, g.id) and r[3] is not None]
        assert g.v == (max(known, key=lambda r: (r[1], r[2]))[3] if known else -1)


def test_window_measures_equal_pairs(spark):
    """Many questions a key, ties with events, values that come again inside and outside of a window, nulls, keys without events."""
    rng = random.Random(9)
    key = lambda: rng.choice([0, 0, 0, 1, 2, None])
    events = [(key(), rng.randint(0, 60), rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b", "c", "d"])) for _ in range(300)]
    events += events[:20]
    asked = sorted({(rng.choice([0, 0, 1, 2, 5]), rng.randint(0, 60)) for _ in range(80)})
    windows = {"back": (-10, 0), "wide": (-25, 0), "later": (3, 13), "around": (-4, 6)}
    q, e = spark.createDataFrame(asked + asked[:5], "u int, q long"), spark.createDataFrame(events, "u int, us long, x int, page string")
    got = S.window_measures(q, e, "u", "q", "us", windows, {"n": F.lit(1).cast("long"), "x": F.col("x").cast("long")}, {"pages": F.col("page"), "some": F.when(F.col("x") > 1, F.col("page"))})
    rows = {(r.u, r.q): r for r in got.collect()}
    assert sorted(rows) == asked
    for (u, at), r in rows.items():
        for name, (a, b) in windows.items():
            inside = [x for x in events if x[0] == u and at + a <= x[1] < at + b]
            want = (len(inside), sum(x[2] or 0 for x in inside), len({x[3] for x in inside if x[3]}), len({x[3] for x in inside if x[3] and (x[2] or 0) > 1}))
            assert tuple(r[f"{k}_{name}"] for k in ("n", "x", "pages", "some")) == want
    assert S.window_measures(q.limit(0), e, "u", "q", "us", windows, {"n": F.lit(1)}).count() == 0


def test_no_join_of_questions_and_histories(spark):
    """The plan of windows joins nothing but what ranges hand on."""
    e = spark.createDataFrame([(1, 5, 0, 1.0, "a")], "user_id int, us long, ns int, sizediff double, title string")
    q = spark.createDataFrame([(1, 9 * DAY)], "user_id int, q long")
    out = T.lookback_table(q, e, [1, 14])
    assert out.first().n_edits_14d == 1 and out.first().n_edits_1d == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "NestedLoop" not in plan


def test_mentor_history_equals_pairs(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([0, 0, 0, 1, None]), rng.randint(0, 12), rng.randint(0, 90) * DAY // 2, rng.random() < 0.5) for i in range(300)]
    got = {r.id: r for r in T.mentor_history(spark.createDataFrame(rows, "id int, mentor int, mentee int, us long, replied boolean")).collect()}
    assert len(got) == len(rows)
    for i, mentor, _, us, _ in rows:
        before = [r for r in rows if r[1] == mentor and r[3] < us]
        recent = [r for r in before if (us - r[3]) // DAY <= 30]
        rate = lambda x: sum(r[4] for r in x) / len(x) if x else 0.0
        days = (us - min(r[3] for r in before)) // DAY if before else 0
        want = (len({r[2] for r in before}), len(before), rate(before), days, len({r[2] for r in recent}), len(recent), rate(recent))
        assert tuple(got[i])[1:] == pytest.approx(want)
