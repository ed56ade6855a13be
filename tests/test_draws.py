"""The bootstrap's draws by md5 and its sums in tasks."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from threadloom.operators import stats as S
from threadloom.operators.draws import POISSON, poisson_draws


def _draw(seed, r, key):
    text = f"{seed}-{r}" + ("" if key is None else f"-{key}")
    return sum(int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 16**13 >= t for t in POISSON)


def test_draws_are_md5():
    keys = ["0", "17", "-5", "", None, "é" * 9, "x" * 47, "x" * 48, "y" * 49, "z" * 200, *map(str, range(10**9, 10**9 + 90))]
    drawn = poisson_draws(keys, 120)
    assert drawn.tolist() == [[_draw(42, r, k) for r in range(1, 121)] for k in keys]


def test_bootstrap_makes_no_row_per_replicate_before_sums(spark):
    """Equal to plain sums, with null clusters, keys and outcomes; tasks hand on a row for each key and stratum, not for each cluster and replicate."""
    rng = np.random.default_rng(3)
    rows = [(None if k % 50 == 0 else int(rng.integers(40)), int(rng.integers(3)), int(rng.integers(2)), None if k % 9 == 0 else float(rng.normal()), float(k % 4), None if k % 7 == 0 else "ab"[k % 2]) for k in range(900)]
    table = spark.createDataFrame(rows, "cluster long, stratum int, d int, y double, y2 double, part string")
    out = S.bootstrap_effects(table, ["y", "y2"], replicates=30, keys=["part"])
    assert "sequence(" not in out._jdf.queryExecution().analyzed().toString()
    found = {(r.part, r.outcome, r.r): r.att for r in out.collect()}
    for part in (None, "a", "b"):
        for at, outcome in ((3, "y"), (4, "y2")):
            for r in (1, 12, 30):
                total = weight = 0.0
                for s in range(3):
                    arms = {}
                    for d in (0, 1):
                        own = [(x[at], _draw(42, r, x[0])) for x in rows if x[1] == s and x[2] == d and x[5] == part and x[at] is not None]
                        arms[d] = sum(m for _, m in own), sum(y * m for y, m in own)
                    if min(arms[0][0], arms[1][0]) >= 2:
                        total += arms[1][0] * (arms[1][1] / arms[1][0] - arms[0][1] / arms[0][0])
                        weight += arms[1][0]
                assert abs(found[part, outcome, r] - total / weight) < 1e-9
    assert table.filter(F.col("cluster").isNull()).count() == 18
