"""Linear models from sums: Gram matrices are aggregated where the rows are, and only p x p systems reach the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.operators.scan import scan
from threadloom.operators.stats import quantiles
from threadloom.sources.io import cut


def standardise(rows: DataFrame, columns: Sequence[str], group: list[str] = ()) -> DataFrame:
    """Columns less their mean over their population deviation; constant columns are centred only."""
    stats = rows.groupBy(*group).agg(*[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"__s_{c}") for c in columns])
    out = rows.join(stats, list(group)) if group else rows.crossJoin(F.broadcast(stats))  # one row of means
    z = {c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") > 1e-12, F.col(f"__s_{c}")).otherwise(1.0) for c in columns}
    return out.withColumns(z).drop(*[f"__{k}_{c}" for c in columns for k in "ms"])


def scales(rows: DataFrame, columns: dict[str, Column]) -> dict[str, tuple[float, float]]:
    """(mean, population deviation) of each column, a deviation of 1 for constant ones: what standardise() takes off and divides by, as one fetched row."""
    row = rows.agg(*[F.avg(c).alias(f"m_{n}") for n, c in columns.items()], *[F.stddev_pop(c).alias(f"s_{n}") for n, c in columns.items()]).first()
    return {n: (row[f"m_{n}"] or 0.0, row[f"s_{n}"] if (row[f"s_{n}"] or 0) > 1e-12 else 1.0) for n in columns}


def _added(rows: DataFrame, schema: str, run, keys: list[str]) -> DataFrame:
    """The arrays g that run() makes of each task's rows, added up cell by cell within keys."""
    cells = rows.mapInArrow(run, schema).select(*keys, F.posexplode("g").alias("k", "x"))
    return cells.groupBy(*keys, "k").agg(F.sum("x").alias("x")).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("g"))


def _vector(columns: Sequence[str | Column]) -> Column:
    return F.array(*[(F.col(c) if isinstance(c, str) else c).cast("double") for c in columns])


def gram_of(rows: DataFrame, vector: Column, p: int, group: list[str] = ()) -> DataFrame:
    """Sums of all products of an array column's p cells, row-major upper triangle in an array g, per group.

    A task multiplies blocks of its rows as matrices and sends p x p numbers for each group, so that rows are read once and never
    multiplied, however many columns there are. Rows with a null among the cells are left out; no rows give no row.
    """
    group = list(group)
    picked = rows.select(*group, vector.alias("__v"))
    fields = [picked.schema[c] for c in group]
    upper = np.triu_indices(p)

    def run(batches):
        import pyarrow as pa

        held: dict = {}

        def out():
            keys = list(held)
            return pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], t) for i, t in enumerate(kinds)), pa.array([held[k][upper] for k in keys], pa.list_(pa.float64()))], names=[*group, "g"])

        kinds = []
        for batch in batches:
            kinds = [batch.column(i).type for i in range(len(group))]
            x = batch.column(len(group)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, p)
            codes, names = np.zeros(len(x), np.int64), [()]
            for i in range(len(group)):
                d = batch.column(i).dictionary_encode()
                values = [*d.dictionary.to_pylist(), None]
                code = d.indices.fill_null(len(values) - 1).to_numpy(zero_copy_only=False).astype(np.int64)
                both, codes = np.unique(codes * len(values) + code, return_inverse=True)
                names = [(*names[b // len(values)], values[b % len(values)]) for b in both.tolist()]
            fine = ~np.isnan(x).any(1)
            x, codes = x[fine], codes[fine]
            for k in np.unique(codes).tolist():
                own = x if len(names) == 1 else x[codes == k]
                held[names[k]] = held.get(names[k], 0) + own.T @ own
            if len(held) * p * p > 50_000_000:
                yield out()
                held.clear()
        if held:
            yield out()

    return _added(picked, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "g array<double>"]), run, group).filter(F.size("g") > 0)


def gram(rows: DataFrame, columns: Sequence[str], y: str, group: list[str] = ()) -> DataFrame:
    """gram_of() of (columns, 1, y)."""
    return gram_of(rows, _vector([*columns, F.lit(1.0), y]), len(columns) + 2, group)


def unpack(g: Sequence[float], p: int) -> np.ndarray:
    out = np.zeros((p, p))
    out[np.triu_indices(p)] = g
    return out + np.triu(out, 1).T


def group_betas(rows: DataFrame, vector: Column, p: int, y: str, group: str, alpha: float = 0.0) -> DataFrame:
    """(group, n, beta, intercept, r2): least squares (or ridge) of y on an array column's p cells within each group; a singular system has nulls.

    Gram matrices are added up by group, and each is solved in the task that has its row: nothing is gathered, however many groups there are. Rows
    with a null among the cells are left out.
    """
    q = p + 2
    whole = F.concat(vector.cast("array<double>"), _vector([F.lit(1.0), y]))
    sums = gram_of(rows.withColumn("__group", F.col(group)), whole, q, ["__group"])

    def solve(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for cells in batch.column(1).to_pylist():
                g = unpack(cells, q)
                try:
                    beta = np.linalg.solve(g[: p + 1, : p + 1] + alpha * np.diag([1.0] * p + [0.0]), g[: p + 1, p + 1])
                    rss = g[q - 1, q - 1] - 2 * beta @ g[: p + 1, q - 1] + beta @ g[: p + 1, : p + 1] @ beta
                    tss = g[q - 1, q - 1] - g[p, q - 1] ** 2 / g[p, p]
                    out.append((int(g[p, p]), beta[:p].tolist(), float(beta[p]), float(1 - rss / tss) if tss > 0 else None))
                except np.linalg.LinAlgError:
                    out.append((int(g[p, p]), None, None, None))
            columns = list(zip(*out)) or [()] * 4
            kinds = (pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), k) for c, k in zip(columns, kinds)]], names=[group, "n", "beta", "intercept", "r2"])

    kind = sums.schema["__group"].dataType.simpleString()
    return sums.mapInArrow(solve, f"`{group}` {kind}, n long, beta array<double>, intercept double, r2 double")


def whitened(rows: DataFrame, vector: str, p: int, out: str) -> DataFrame:
    """rows with an array column's p cells times the inverse Cholesky factor of their covariance (population): Euclidean distances of the result are
    Mahalanobis distances. Rows with a null among the cells have null; a singular covariance is an error."""
    row = gram_of(rows, F.concat(F.col(vector).cast("array<double>"), _vector([F.lit(1.0)])), p + 1).first()
    if row is None:
        return rows.withColumn(out, F.lit(None).cast("array<double>"))
    g = unpack(row.g, p + 1)
    n, mean = g[p, p], g[p, :p] / g[p, p]
    inverse = np.linalg.inv(np.linalg.cholesky(g[:p, :p] / n - np.outer(mean, mean)))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index("__white_in")
            flat = [None if v is None or None in v else v for v in batch.column(at).to_pylist()]
            fine = [k for k, v in enumerate(flat) if v is not None]
            made: list = [None] * len(flat)
            if fine:
                for k, z in zip(fine, (np.array([flat[k] for k in fine]) @ inverse.T).tolist()):
                    made[k] = z
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.float64()))], names=[*batch.schema.names, "__white_out"])

    cast = rows.withColumn("__white_in", F.col(vector).cast("array<double>"))
    made = cast.mapInArrow(run, cast.withColumn("__white_out", F.col("__white_in")).schema)
    return made.withColumn(out, F.col("__white_out")).drop("__white_in", "__white_out")


def student_tail(t: float, df: float) -> float:
    """Two-sided p-value of Student's t, by the continued fraction of the incomplete beta function."""
    if not math.isfinite(t) or df <= 0:
        return float("nan")
    x, a, b = df / (df + t * t), df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(max(x, 1e-300)) + b * math.log(max(1 - x, 1e-300)))

    def fraction(x: float, a: float, b: float) -> float:
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d or 1e-30)
        h = d
        for m in range(1, 300):
            for e in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 / ((1 + e * d) or 1e-30), (1 + e / c) or 1e-30
                h *= d * c
            if abs(d * c - 1) < 1e-12:
                break
        return h

    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def ols(rows: DataFrame, columns: Sequence[str], y: str, report: Sequence[str] | None = None) -> DataFrame:
    """beta, se, t and p per column (or those reported), with an intercept; a singular system gives NaN."""
    spark, p = rows.sparkSession, len(columns) + 1
    row = gram(rows, columns, y).first()
    shape = "variable string, beta double, se double, t double, p double"
    if row is None:
        return spark.createDataFrame([], shape)
    g = unpack(row.g, p + 1)
    xx, xy, yy, n = g[:p, :p], g[:p, p], g[p, p], g[p - 1, p - 1]
    try:
        inverse = np.linalg.inv(xx)
        beta = inverse @ xy
        s2 = (yy - beta @ xy) / (n - p)
        se = np.sqrt(np.maximum(np.diag(inverse) * s2, 0))
    except np.linalg.LinAlgError:
        beta = se = np.full(p, np.nan)
    out = []
    for k, c in enumerate(columns):
        if report is None or c in report:
            t = beta[k] / se[k] if se[k] > 0 else float("nan")
            out.append((c, float(beta[k]), float(se[k]), float(t), student_tail(float(t), float(n - p))))
    return spark.createDataFrame(out, shape)


def ridge_beta(rows: DataFrame, columns: Sequence[str], y: str, alpha: float) -> np.ndarray:
    """Ridge coefficients (intercept last, not penalised)."""
    p = len(columns) + 1
    row = gram(rows, columns, y).first()
    g = unpack(row.g, p + 1)
    return np.linalg.solve(g[:p, :p] + alpha * np.diag([1.0] * (p - 1) + [0.0]), g[:p, p])


def linear_value(columns: Sequence[str], beta: Sequence[float]) -> Column:
    out = F.lit(float(beta[len(columns)]))
    for c, b in zip(columns, beta):
        out = out + F.col(c) * F.lit(float(b))
    return out


def residual(rows: DataFrame, columns: Sequence[str], y: str, alpha: float, out: str) -> DataFrame:
    """rows with y less its ridge prediction from the columns (Frisch-Waugh step)."""
    return rows.withColumn(out, F.col(y) - linear_value(columns, ridge_beta(rows, columns, y, alpha)))


def ridge_cv_r2(rows: DataFrame, columns: Sequence[str], y: str, alpha: float, order: str, folds: int = 5) -> float:
    """Mean R2 over contiguous folds in the given order; sums are taken per fold, so one pass serves all fits."""
    p = len(columns) + 1
    found = quantiles(rows, order, [k / folds for k in range(1, folds)]).first()
    edges = list(found[0]) if found else [0.0]
    fold = sum(((F.col(order) > F.lit(e)).cast("int") for e in edges), F.lit(0))
    parts = {r.fold: unpack(r.g, p + 1) for r in gram(rows.withColumn("fold", fold), columns, y, ["fold"]).collect()}  # folds rows
    whole, scores = sum(parts.values()), []
    for g in parts.values():
        train = whole - g
        b = np.linalg.solve(train[:p, :p] + alpha * np.diag([1.0] * (p - 1) + [0.0]), train[:p, p])
        m = g[p - 1, p - 1]
        rss, tss = g[p, p] - 2 * b @ g[:p, p] + b @ g[:p, :p] @ b, g[p, p] - g[p - 1, p] ** 2 / m
        scores.append(1 - rss / tss if tss > 0 else float("nan"))
    return float(np.mean(scores))


def strat_dr(rows: DataFrame, covariates: Sequence[str], outcomes: Sequence[str], stratum: str = "stratum") -> DataFrame:
    """Coefficient of d in each stratum's regression of an outcome on d, covariates and 1, weighted by stratum size."""
    columns, out = ["d", *covariates], []
    p = len(columns) + 1
    for o in outcomes:
        total = weight = 0.0
        for r in gram(rows.filter(F.col(stratum).isNotNull()), columns, o, [stratum]).collect():  # a row for each stratum
            g = unpack(r.g, p + 1)
            n, t = g[p - 1, p - 1], g[0, p - 1]
            if t < 2 or n - t < 2:
                continue
            beta = np.linalg.lstsq(g[:p, :p], g[:p, p], rcond=None)[0]
            total, weight = total + n * beta[0], weight + n
        out.append((o, float(total / weight) if weight else float("nan")))
    return rows.sparkSession.createDataFrame(out, "outcome string, dr double")


def stratified_folds(rows: DataFrame, folds: int = 5, treatment: str = "d", id_column: str = "id", group: Sequence[str] = (), seed: int = 42, out: str = "fold") -> DataFrame:
    """rows with a fold from 0 on, shuffled and stratified by treatment within groups: both the sizes of the folds of a group and their
    treated rows differ by one at most.

    Rows of a group are numbered by treatment, then by the md5 of seed and id (ties by the id), and dealt in turn. The numbers come
    from ranges (scan()), so no task sees a whole group. Rows without a treatment are dealt first; repeated ids go one after another.
    """
    marked = rows.withColumn("__md5", _shuffled(id_column, seed))
    ranked = scan(marked, list(group), [treatment, "__md5", id_column], {"__place": ("sum", F.lit(1).cast("long"))})
    return ranked.withColumn(out, F.pmod(F.col("__place") - 1, F.lit(folds)).cast("int")).drop("__md5", "__place")


def _shuffled(id_column: str, seed: int) -> Column:
    """The md5 of seed and id as bytes, which order as its digits do."""
    return F.unhex(F.md5(F.concat_ws("-", F.lit(seed), F.col(id_column))))


def overlapping_folds(rows: DataFrame, groups: dict[str, Column], folds: int = 5, treatment: str = "d", id_column: str = "id", seed: int = 42, out: str = "folds", keep: Sequence[str] | None = None) -> DataFrame:
    """rows (or their columns `keep`) with the folds of stratified_folds() in each of several groups that may overlap: an array in the groups' order,
    null where a row is not in a group. Rows are put in order once, not once for each group, as all groups go by the same order."""
    keep = rows.columns if keep is None else list(keep)
    inside = [F.coalesce(rule.cast("boolean"), F.lit(False)) for rule in groups.values()]
    bits = sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(inside)), F.lit(0)).cast("long")
    marked = rows.withColumns({"__md5": _shuffled(id_column, seed), "__in": bits}).select("__md5", "__in", *dict.fromkeys([treatment, id_column, *keep]))
    member = [F.col("__in").bitwiseAND(F.lit(1 << i)) != 0 for i in range(len(inside))]
    ranked = scan(marked, [], [treatment, "__md5", id_column], {f"__p{i}": ("sum", m.cast("byte")) for i, m in enumerate(member)})
    each = [F.when(m, F.pmod(F.col(f"__p{i}") - 1, F.lit(folds)).cast("int")) for i, m in enumerate(member)]
    return ranked.select(*keep, F.array(*each).alias(out))


#: The fold of a row in a group that it is not in.
OUTSIDE = -2


def logistic_subsets(
    rows: DataFrame, columns: Sequence[str], y: str, subsets: Sequence[Sequence[int]], folds: int, fold: Column, c: float = 1.0, steps: int = 100, tolerance: float = 1e-8
) -> list[list[np.ndarray]]:
    """L2 logistic regressions by Newton steps (intercept last, not penalised): for each subset of the columns one over the rows outside of each fold."""
    return [x[None] for x in logistic_groups(rows, columns, y, subsets, folds, fold, None, [None], c, steps, tolerance)]


def logistic_groups(
    rows: DataFrame, columns: Sequence[str], y: str, subsets: Sequence[Sequence[int]], folds: int, fold: Column, group: Column | None, names: Sequence, c: float = 1.0, steps: int = 100, tolerance: float = 1e-8
) -> list[dict]:
    """For each subset of the columns and each named group, L2 logistic regressions over the group's rows outside of each fold (a list by fold).

    The rows are cut once; a step is one pass for all models that have not settled: a task adds up gradients and second derivatives
    of its rows as matrices. A step is halved until the likelihood does not fall, and a model that has not settled after `steps` is an error.
    """
    p, places = len(columns) + 1, {n: i for i, n in enumerate(names)}
    own = [fold.cast("int") if group is None else F.when(group == F.lit(n), fold.cast("int")) for n in names]
    base = cut(rows.select(_vector([*columns, F.lit(1.0), y]).alias("v"), F.array(*[F.coalesce(f, F.lit(OUTSIDE)) for f in own]).alias("folds")))
    models = [(np.array([*s, p - 1]), g, k) for s in subsets for g in range(len(places)) for k in range(folds)]
    at = iter(logistic_models(base, p, models, None, c, steps, tolerance))
    return [{n: [next(at) for _ in range(folds)] for n in places} for _ in subsets]


def logistic_models(base: DataFrame, p: int, models: Sequence[tuple[np.ndarray, int, int]], scales: Sequence[tuple[np.ndarray, np.ndarray]] | None = None, c: float = 1.0, steps: int = 100, tolerance: float = 1e-8) -> list[np.ndarray]:
    """The regressions of logistic_groups() over a stored table: v, an array of the columns, 1 and y, and folds, the row's fold in each group (OUTSIDE
    where it is in none). A model is its cells of v, a group and the fold that it leaves out; scales are means and deviations of v by group."""
    base = base.select("v", "folds")
    betas = [np.zeros(len(at)) for at, _, _ in models]
    widths = [1 + len(at) + len(at) * (len(at) + 1) // 2 for at, _, _ in models]

    def run_with(open_now, betas):
        def run(batches):
            import pyarrow as pa

            total = {i: np.zeros(widths[i]) for i in open_now}
            for batch in batches:
                v = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, p + 1)
                own = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
                fine = ~np.isnan(v).any(1)
                parts = {(g, k): v[fine & (own[:, g] != OUTSIDE) & (own[:, g] != k)] for _, g, k in {(0, *models[i][1:]) for i in open_now}}
                for (g, _), part in parts.items() if scales else ():
                    part[:, :p] = (part[:, :p] - scales[g][0]) / scales[g][1]
                for i in open_now:
                    at, g, k = models[i]
                    part = parts[g, k]
                    x, q = part[:, at], len(at)
                    z = np.clip(x @ betas[i], -700, 700)
                    m = 1 / (1 + np.exp(-z))
                    total[i][0] += (part[:, p] * z - np.logaddexp(0, z)).sum()
                    total[i][1 : 1 + q] += x.T @ (part[:, p] - m)
                    total[i][1 + q :] += (x.T @ (x * (m * (1 - m))[:, None]))[np.triu_indices(q)]
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(list(total.values()))], pa.list_(pa.float64()))], names=["g"])

        return run

    open_now, last = list(range(len(models))), {}  # last: likelihood, coefficients and move of the step that is being tried
    for _ in range(steps):
        row = _added(base, "g array<double>", run_with(open_now, betas), []).first()
        sums = np.split(np.array(row.g if row and row.g else [0.0] * sum(widths[i] for i in open_now)), np.cumsum([widths[i] for i in open_now])[:-1])
        still = []
        for i, g in zip(open_now, sums):
            q = len(betas[i])
            penalty = np.diag([1.0 / c] * (q - 1) + [0.0])
            value = g[0] - betas[i] @ penalty @ betas[i] / 2
            if i in last and value < last[i][0] - 1e-9 * max(1, abs(value)):
                move = last[i][2] / 2
                last[i] = (last[i][0], last[i][1], move)
                betas[i] = last[i][1] + move
                still.append(i)
                continue
            move = np.linalg.solve(unpack(g[1 + q :], q) + penalty + 1e-12 * np.eye(q), g[1 : 1 + q] - penalty @ betas[i])
            last[i] = (value, betas[i], move)
            betas[i] = betas[i] + move
            if np.abs(move).max() >= tolerance:
                still.append(i)
        open_now = still
        if not open_now:
            break
    if open_now:
        raise ArithmeticError(f"{len(open_now)} of {len(models)} logistic regressions have not settled after {steps} steps")
    return betas


def logistic_betas(rows: DataFrame, columns: Sequence[str], y: str, folds: int, fold: Column, c: float = 1.0, steps: int = 100, tolerance: float = 1e-8) -> list[np.ndarray]:
    """L2 logistic regressions on all columns, each over the rows that are not in its fold."""
    return logistic_subsets(rows, columns, y, [range(len(columns))], folds, fold, c, steps, tolerance)[0]


def logistic_beta(rows: DataFrame, columns: Sequence[str], y: str, c: float = 1.0, steps: int = 100, tolerance: float = 1e-8) -> np.ndarray:
    """L2 logistic regression over all rows (intercept last, not penalised)."""
    return logistic_betas(rows, columns, y, 1, F.lit(-1), c, steps, tolerance)[0]


def propensity(rows: DataFrame, columns: Sequence[str], treatment: str = "d", folds: int = 5, c: float = 1.0, id_column: str = "id") -> DataFrame:
    """rows with ps, the out-of-fold probability of treatment. Columns are standardised once; folds are those of stratified_folds()."""
    z = cut(stratified_folds(standardise(rows, columns), folds, treatment, id_column, out="__fold"))
    score = F.lit(None).cast("double")
    for k, beta in enumerate(logistic_betas(z, columns, treatment, folds, F.col("__fold"), c)):
        score = F.when(F.col("__fold") == k, 1 / (1 + F.exp(-linear_value(columns, beta)))).otherwise(score)
    return z.withColumn("ps", score).drop("__fold")


def group_propensity(rows: DataFrame, columns: Sequence[str], groups: dict[str, Column], treatment: str = "d", folds: int = 5, c: float = 1.0, id_column: str = "id", least: int = 50, label: str = "subgroup") -> DataFrame:
    """A row for each row and group it is in (groups may overlap): the row, the group's name, its fold there, and ps, the probability
    of treatment by models of that group alone, out of fold.

    Columns are scaled within the group, folds stratified within it, and the regressions of all groups and folds take their steps in
    the same passes. Groups with less than `least` treated or untreated rows are left out. The columns keep their own values; rows with a null
    among them have no ps.
    """
    long = rows.withColumn(label, F.explode(F.array_compact(F.array(*[F.when(rule, F.lit(n)) for n, rule in groups.items()]))))
    sizes = long.groupBy(label).agg(F.sum(treatment).alias("t"), F.count(treatment).alias("n")).collect()  # a row for each group
    names = sorted(r[label] for r in sizes if r.t >= least and r.n - r.t >= least)
    scaled = [f"__z_{k}" for k in range(len(columns))]
    kept = long.filter(F.col(label).isin(names)).withColumns({z: F.col(c) for z, c in zip(scaled, columns)})
    z = cut(stratified_folds(standardise(kept, scaled, [label]), folds, treatment, id_column, [label]))
    score = F.lit(None).cast("double")
    if names:
        for n, betas in logistic_groups(z, scaled, treatment, [range(len(columns))], folds, F.col("fold"), F.col(label), names, c)[0].items():
            for k, beta in enumerate(betas):
                score = F.when((F.col(label) == n) & (F.col("fold") == k), 1 / (1 + F.exp(-linear_value(scaled, beta)))).otherwise(score)
    return z.withColumn("ps", score).drop(*scaled)


def pca(rows: DataFrame, vector: str, k: int, out: str) -> DataFrame:
    """First k principal components of an array column, centred, not scaled; a component's largest loading is positive.

    The covariance is summed per pair of dimensions from partial sums in each task; the driver solves the d x d problem.
    """
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = rows.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    centred = StandardScaler(inputCol="__v", outputCol="__c", withMean=True, withStd=False).fit(v).transform(v)
    model = PCA(k=k, inputCol="__c", outputCol="__p").fit(centred)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(0), np.arange(k)])
    signed = F.zip_with(vector_to_array("__p"), F.array(*[F.lit(float(s)) for s in signs]), lambda a, b: a * b)
    return model.transform(centred).withColumn(out, signed).drop("__v", "__c", "__p")


def one_hot(rows: DataFrame, column: str, prefix: str, drop_first: bool = True, most: int = 10_000) -> DataFrame:
    """0/1 columns for the sorted values of a column of few values, without the first; an error where there are over most values."""
    values = [r[0] for r in rows.select(column).distinct().orderBy(column).limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{column} has more than {most} distinct values")
    values = values[1 if drop_first else 0 :]
    return rows.withColumns({f"{prefix}{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values})


def independent_columns(rows: DataFrame, columns: Sequence[str], least_std: float = 1e-10, relative: float = 1e-10) -> list[str]:
    """Columns with spread that are not combinations of earlier ones, by Gram-Schmidt on the centred Gram matrix."""
    p = len(columns) + 1
    g = unpack(gram(rows.withColumn("__y", F.lit(0.0)), columns, "__y").first().g, p + 1)
    n = g[p - 1, p - 1]
    cov = g[: p - 1, : p - 1] / n - np.outer(g[p - 1, : p - 1], g[p - 1, : p - 1]) / n**2
    kept: list[int] = []
    for k in range(p - 1):
        if math.sqrt(max(cov[k, k], 0)) < least_std:
            continue
        rest = cov[k, k]
        if kept:
            a = cov[np.ix_(kept, kept)]
            rest = cov[k, k] - cov[k, kept] @ np.linalg.lstsq(a, cov[kept, k], rcond=None)[0]
        if rest > relative * cov[k, k] + 1e-300:
            kept.append(k)
    return [columns[k] for k in kept]


def mixed_groups(
    rows: DataFrame, columns: dict[str, Column], ys: dict[str, Column], group: str, subgroups: dict[str, Column], products: dict[str, tuple[str, str, float, float]] | None = None, least: int = 0, label: str = "subgroup"
) -> DataFrame:
    """For each subgroup and outcome a linear model with a random intercept per group by REML: beta, se, z, p, and the share of variance between groups (icc).

    For a variance ratio r, a group of n rows adds X'X - c (sum x)(sum x)' with c = r / (1 + n r), which is the same for all groups of one size: Gram
    matrices, and for each size that occurs the sum of (sum x)(sum x)', are all that is needed. Rows are sorted into ranges of the group once, and each
    range adds up these for all of the (overlapping) subgroups in one pass. The profile, for the ratios of all outcomes and subgroups at once, reads the
    table of sizes only; it is refined around each outcome's best point. A group of any size is spread over ranges: one that a range begins or ends with
    hands on its sums. Rows with a null among the columns or outcomes are left out, subgroups of less than `least` rows (these included) too.

    products: name to (a, b, mean, deviation), further columns (a * b - mean) / deviation of two of the columns; tasks multiply them, rows do not carry them.
    """
    products = products or {}
    if len(subgroups) > 62:
        raise ValueError("62 subgroups at most in one call")
    spark, xs, outcomes, own_columns = rows.sparkSession, [*columns, *products], list(ys), len(columns)
    p, q, sent = len(xs) + 1, len(xs) + 1 + len(ys), len(columns) + 1 + len(ys)
    left, right = ([list(columns).index(pair[at]) for pair in products.values()] for at in (0, 1))
    mean, deviation = (np.array([pair[at] for pair in products.values()], float)[:, None] for at in (2, 3))
    upper, n_groups = np.triu_indices(q), len(subgroups)
    n_cells = len(upper[0])
    shape = f"outcome string, variable string, beta double, se double, z double, p double, icc double, `{label}` string"
    near = rows.repartitionByRange(group, F.xxhash64(*rows.columns)).sortWithinPartitions(group)  # only equal rows are never split
    picked = near.select(F.col(group).alias("__key"), _vector([*columns.values(), F.lit(1.0), *ys.values()]).alias("__v"), sum((F.when(c, F.lit(1 << k).cast("long")).otherwise(0) for k, c in enumerate(subgroups.values())), F.lit(0)).alias("__in"))
    key_kind = picked.schema["__key"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        whole, n_rows, by_size, waiting = np.zeros((n_groups, q, q)), np.zeros(n_groups, np.int64), {}, [[] for _ in range(n_groups)]
        kind = key = None
        carried, first, seen = np.zeros((n_groups, q)), True, False  # the sums of the key that the last batch ended with

        def out(table):
            columns = list(zip(*table))
            kinds = (kind, pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["key", "k", "n", "m", "g", "edge"])

        def edge():
            return [(key, k, 0, 0, s, True) for k, s in enumerate(carried) if s[p - 1]]

        def settle():
            for k, found in enumerate(waiting):
                if not found:
                    continue
                s = np.concatenate(found)
                s = s[s[:, p - 1].argsort(kind="stable")]
                sizes, starts = np.unique(s[:, p - 1], return_index=True)
                for n, own in zip(sizes.astype(int).tolist(), np.split(s, starts[1:])):
                    m, g = by_size.get((k, n), (0, 0))
                    by_size[k, n] = (m + len(own), g + own.T @ own)
                found.clear()

        def sized():
            table = [(None, k, n, m, g[upper], False) for (k, n), (m, g) in by_size.items()]
            by_size.clear()
            return [out(table[i : i + 2_000]) for i in range(0, len(table), 2_000)]

        for batch in batches:
            if not len(batch):
                continue
            kind, keys = batch.column(0).type, batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
            turn = np.append(True, keys[1:] != keys[:-1])
            place, n_keys = turn.cumsum() - 1, int(turn.sum())
            marks, mark, counts = np.unique(batch.column(2).to_numpy(), return_inverse=True, return_counts=True)
            member = (marks >> np.arange(n_groups)[:, None] & 1).astype(float)  # subgroups by sets of subgroups
            n_rows += (member @ counts).astype(np.int64)
            order = mark.argsort(kind="stable")
            given = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, sent).T[:, order]
            x = np.concatenate([given[:own_columns], (given[left] * given[right] - mean) / deviation, given[own_columns:]])
            fine = ~np.isnan(x).any(0)
            x, mark, place = (x, mark[order], place[order]) if fine.all() else (x[:, fine], mark[order][fine], place[order][fine])
            sums, bounds = np.zeros((n_groups, q, n_keys)), np.searchsorted(mark, np.arange(len(marks) + 1))
            step = max(1, 4 * len(batch) // n_keys)  # sets at a time, each row being in one
            for at in range(0, len(marks), step):
                sets = min(step, len(marks) - at)
                own = slice(bounds[at], bounds[at + sets])
                cell = (mark[own] - at) * n_keys + place[own]
                cells = np.array([np.bincount(cell, c, sets * n_keys) for c in x[:, own]]).reshape(q, sets, n_keys)
                sums += np.tensordot(member[:, at : at + sets], cells, (1, 1))
            grams = np.array([x[:, a:b] @ x[:, a:b].T for a, b in zip(bounds[:-1], bounds[1:])])
            whole += np.tensordot(member, grams, (1, 0))
            sums = sums.transpose(0, 2, 1)
            begins, ends = batch.column(0)[0].as_py(), batch.column(0)[len(batch) - 1].as_py()
            if seen and begins == key:
                sums[:, 0] += carried
            elif seen:
                if first:
                    if ready := edge():
                        yield out(ready)
                    first = False
                else:
                    for k in range(n_groups):
                        waiting[k].append(carried[k : k + 1])
            if n_keys > 1 and first:
                key, carried = begins, sums[:, 0]
                if ready := edge():
                    yield out(ready)
                first, sums = False, sums[:, 1:]
            for k in range(n_groups):
                done = sums[k, :-1]
                waiting[k].append(done[done[:, p - 1] > 0])
            seen, key, carried = True, ends, sums[:, -1].copy()
            if sum(len(s) for found in waiting for s in found) > 100_000:
                settle()
                if len(by_size) * q * q > 20_000_000:
                    yield from sized()
        if seen:
            settle()
            yield from sized()
            yield out(edge() + [(None, k, -1, int(n_rows[k]), whole[k][upper], False) for k in range(n_groups) if n_rows[k]])

    parts = cut(picked.mapInArrow(run, f"key {key_kind}, k int, n long, m long, g array<double>, edge boolean"))

    def met(table):
        """A group that lies in several ranges: its sums are added up, which is a size like those of all other groups."""
        import pyarrow as pa

        ks, parts = table["k"].to_numpy(), table["g"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, q)
        found = np.unique(ks).tolist()
        sums = [parts[ks == k].sum(0) for k in found]
        squares = pa.array([np.outer(s, s)[upper] for s in sums], pa.list_(pa.float64()))
        return pa.table([pa.array(found, pa.int32()), pa.array([int(s[p - 1]) for s in sums], pa.int64()), pa.array([1] * len(sums), pa.int64()), squares], names=["k", "n", "m", "g"])

    def added(table):
        import pyarrow as pa

        g = table["g"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, n_cells).sum(0)
        return pa.table([table["k"][:1], table["n"][:1], pa.array([table["m"].to_numpy().sum()], pa.int64()), pa.array([g], pa.list_(pa.float64()))], names=["k", "n", "m", "g"])

    cells = "k int, n long, m long, g array<double>"
    over = parts.filter("edge").groupBy("key").applyInArrow(met, cells)
    sizes = cut(parts.filter("NOT edge").select("k", "n", "m", "g").unionByName(over).groupBy("k", "n").applyInArrow(added, cells))
    whole = {r.k: unpack(r.g, q) for r in sizes.filter("n = -1").collect() if r.m >= least}
    whole = {k: g for k, g in whole.items() if g[p - 1, p - 1]}
    if not whole:
        return spark.createDataFrame([], shape)
    sizes = sizes.filter("n > 0")

    def profile(ratios: dict[tuple[int, int], list[float]]) -> dict:
        """For each subgroup and outcome the best of its ratios: likelihood, ratio, beta, variance, inverse."""
        distinct = {k: sorted({r for (of, _), rs in ratios.items() if of == k for r in rs}) for k in whole}

        def weigh(batches):
            import pyarrow as pa

            out: dict = {}
            for batch in batches:
                ks, n, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                g = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, n_cells)
                for k in set(ks.tolist()) & set(distinct):
                    r, at = np.array(distinct[k])[:, None], ks == k
                    out[k] = out.get(k, 0) + np.hstack([(r / (1 + n[at] * r)) @ g[at], np.log1p(n[at] * r) @ m[at, None]])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([x.ravel() for x in out.values()], pa.list_(pa.float64()))], names=["__k", "g"])

        sums = {r["__k"]: np.array(r.g).reshape(-1, n_cells + 1) for r in _added(sizes, "__k int, g array<double>", weigh, ["__k"]).collect()}
        best = {}
        for (k, j), rs in ratios.items():
            found, total, y = [], whole[k][p - 1, p - 1], p + j
            for r in rs:
                own = sums[k][distinct[k].index(r)]
                g = whole[k] - unpack(own[:n_cells], q)
                beta = np.linalg.solve(g[:p, :p], g[:p, y])
                s2 = max((g[y, y] - beta @ g[:p, y]) / (total - p), 1e-300)
                value = -0.5 * ((total - p) * math.log(s2) + own[n_cells] + np.linalg.slogdet(g[:p, :p])[1])
                found.append((value, r, beta, s2, np.linalg.inv(g[:p, :p])))
            best[k, j] = max(found, key=lambda x: x[0])
        return best

    best = profile({(k, j): [0.0, *(10.0**e for e in range(-6, 3))] for k in whole for j in range(len(ys))})
    for _ in range(4):
        finer = profile({at: [b[1] * f for f in (0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0)] if b[1] else [0.0, 1e-7] for at, b in best.items()})
        best = {at: max(b, finer[at], key=lambda x: x[0]) for at, b in best.items()}
    out, names = [], list(subgroups)
    for (at, j), (_, r, beta, s2, inverse) in sorted(best.items(), key=lambda x: x[0]):
        for k, c in enumerate(xs):
            se = math.sqrt(max(inverse[k, k] * s2, 0))
            z = beta[k] / se if se else float("nan")
            out.append((outcomes[j], c, float(beta[k]), se, float(z), math.erfc(abs(z) / math.sqrt(2)), float(r / (1 + r)), names[at]))
    return spark.createDataFrame(out, shape)


def mixed_models(rows: DataFrame, columns: Sequence[str], ys: Sequence[str], group: str) -> DataFrame:
    """mixed_groups() of all rows: for each outcome beta, se, z, p and icc."""
    return mixed_groups(rows, {c: F.col(c) for c in columns}, {y: F.col(y) for y in ys}, group, {"all": F.lit(True)}).drop("subgroup")


def mixed_model(rows: DataFrame, columns: Sequence[str], y: str, group: str) -> DataFrame:
    """mixed_models() of one outcome."""
    return mixed_models(rows, columns, [y], group).drop("outcome")


def direction(rows: DataFrame, vector: str, y: str, controls: Sequence[str], alpha: float = 1.0) -> tuple[np.ndarray, DataFrame]:
    """Unit vector of the ridge regression of y on an array column, both less their ridge predictions from controls, and projections.

    All coefficients come from one Gram matrix of (controls, dimensions, y): residual sums follow by matrix algebra.
    """
    d = len(rows.select(vector).first()[0])
    q = len(controls)
    p = q + d + 1
    whole = F.concat(_vector(controls), F.col(vector).cast("array<double>"), _vector([F.lit(1.0), y])) if controls else F.concat(F.col(vector).cast("array<double>"), _vector([F.lit(1.0), y]))
    g = unpack(gram_of(rows, whole, p + 1).first().g, p + 1)
    ctrl, rest = [*range(q), p - 1], [*range(q, p - 1), p]
    cc, cr, rr = g[np.ix_(ctrl, ctrl)], g[np.ix_(ctrl, rest)], g[np.ix_(rest, rest)]
    b = np.linalg.solve(cc + alpha * np.diag([1.0] * q + [0.0]), cr)
    res = rr - cr.T @ b - b.T @ cr + b.T @ cc @ b
    w = np.linalg.solve(res[:d, :d] + alpha * np.eye(d), res[:d, d])
    w = w / (np.linalg.norm(w) + 1e-12)
    dot = F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(x)) for x in w]), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return w, rows.withColumn("projection", dot)


def rank_by_size(table: DataFrame, value: str, n: int, tie: str) -> DataFrame:
    return table.orderBy(F.abs(value).desc(), tie).limit(n)


def centred(rows: DataFrame, x: str, group: list[str]) -> DataFrame:
    return rows.withColumn(x, F.col(x) - F.avg(x).over(W.partitionBy(*group)))
