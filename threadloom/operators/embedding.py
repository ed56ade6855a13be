"""Neighbour embedding: a layout of few dimensions that keeps rows near their neighbours.

Neighbour distances become weights of one scale, weights of both directions are united, the leading smooth coordinates of that graph are a start,
and rounds of attraction along edges and repulsion from drawn rows make the layout. All tables are of nodes, edges or draws; a
round is joins and one aggregation.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.density import ORDERS, RUN, neighbours, nodes_of
from threadloom.operators.stats import cumulative, meet
from threadloom.sources.io import cut


def curve(min_dist: float = 0.1, spread: float = 1.0) -> tuple[float, float]:
    """a and b by which 1 / (1 + a d ** (2 b)) is nearest to 1 below min_dist and to exp(-(d - min_dist) / spread) beyond (Gauss-Newton steps)."""
    x = np.linspace(1e-3, 3 * spread, 300)
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    a, b = 1.0, 1.0
    for _ in range(200):
        u = x ** (2 * b)
        f = 1 / (1 + a * u)
        step = np.linalg.lstsq(np.c_[-u * f * f, -a * u * 2 * np.log(x) * f * f], y - f, rcond=None)[0]
        a, b = max(1e-3, a + 0.3 * step[0]), max(1e-2, b + 0.3 * step[1])
    return float(a), float(b)


def calibrated(near: DataFrame, k: int) -> DataFrame:
    """(a, b, w): weights exp(-(d - nearest) / s) of each node's neighbours, s such that they sum to log2(k); 1 for the nearest and for ties with it.

    A node's neighbours are k numbers; s is found by halving, for all nodes of a batch at once.
    """
    lists = near.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("d", "b"))).alias("x"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = batch.column(1).to_pylist()
            if not rows:
                continue
            d = np.full((len(rows), max(map(len, rows))), np.inf)
            for i, x in enumerate(rows):
                d[i, : len(x)] = [y["d"] for y in x]
            over = np.maximum(d - d[:, :1], 0)
            low, high = np.zeros(len(rows)), np.full(len(rows), np.inf)
            s = np.maximum(np.where(np.isfinite(over), over, 0).max(1), 1e-12)
            for _ in range(64):
                total = np.exp(-over / s[:, None]).sum(1)
                large = total > math.log2(k)
                high, low = np.where(large, s, high), np.where(large, low, s)
                s = np.where(np.isfinite(high), (low + high) / 2, s * 2)
                s = np.clip(s, 1e-12, 1e12)
            w = np.exp(-over / s[:, None])
            sizes = [len(x) for x in rows]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), sizes)), pa.array([y["b"] for x in rows for y in x], pa.int64()),
                pa.array(np.concatenate([w[i, :n] for i, n in enumerate(sizes)])),
            ], names=["a", "b", "w"])

    return lists.mapInArrow(run, "a long, b long, w double")


def united(weights: DataFrame) -> DataFrame:
    """(a, b, w) in both directions: u + v - u v of the two directed weights, 0 where one is missing."""
    pairs = weights.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg((F.sum("w") - (F.sum("w") * F.sum("w") - F.sum(F.col("w") * F.col("w"))) / 2).alias("w"))
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def _centred(y: DataFrame, names: list[str], weight: Column) -> DataFrame:
    """Coordinates made orthogonal to the constant and to each other under a weight, by one row of sums (Cholesky)."""
    m = len(names)
    sums = y.agg(F.sum(weight).alias("n"), *[F.sum(weight * F.col(c)).alias(f"s_{c}") for c in names], *[F.sum(weight * F.col(names[i]) * F.col(names[j])).alias(f"p_{i}_{j}") for i in range(m) for j in range(i, m)]).first()
    mean = np.array([sums[f"s_{c}"] / sums.n for c in names])
    g = np.array([[sums[f"p_{min(i, j)}_{max(i, j)}"] / sums.n for j in range(m)] for i in range(m)]) - np.outer(mean, mean)
    inverse = np.linalg.inv(np.linalg.cholesky(g + 1e-12 * np.eye(m) * max(np.trace(g), 1e-12)))
    made = [sum(((F.col(c) - float(mean[j])) * float(inverse[i, j]) for j, c in enumerate(names) if inverse[i, j]), F.lit(0.0)) for i in range(m)]
    return y.withColumns(dict(zip(names, made)))


def smooth_start(nodes: DataFrame, edges: DataFrame, dims: int, steps: int = 8, seed: int = 7) -> DataFrame:
    """(node, y0, y1 ...): the smoothest coordinates of the graph beside the constant, by block power iteration of its random walk (half of each step stays).

    It begins with projections of the vectors, so that few steps serve.
    """
    names = [f"y{k}" for k in range(dims)]
    d = len(nodes.select("v").first()[0])
    planes = np.random.default_rng(seed).standard_normal((dims, d))
    dot = lambda p: F.aggregate(F.zip_with("v", F.array(*[F.lit(float(x)) for x in p]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    degree = edges.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("degree"))
    y = cut(nodes.select("node", *[dot(p).alias(c) for p, c in zip(planes, names)]).join(degree, "node"))
    for _ in range(steps):
        y = _centred(y, names, F.col("degree"))
        told = edges.join(y.select(F.col("node").alias("b"), *names), "b").groupBy(F.col("a").alias("node")).agg(*[F.sum(F.col("w") * F.col(c)).alias(f"n_{c}") for c in names])
        y = cut(y.join(told, "node").select("node", "degree", *[((F.col(c) + F.col(f"n_{c}") / F.col("degree")) / 2).alias(c) for c in names]))
    y = _centred(y, names, F.lit(1.0))
    return nodes.select("node").join(y.drop("degree"), "node", "left").fillna(0.0, names)


def neighbour_embedding(
    rows: DataFrame, key: str, vector: str, dims: int = 2, k: int = 15, rounds: int = 30, negatives: int = 5, min_dist: float = 0.1, orders: int = ORDERS, run: int = RUN, seed: int = 7
) -> DataFrame:
    """(key, y): a layout of the rows in `dims` dimensions as an array.

    key: a whole number for each row. Neighbours are those of density.neighbours() by Euclidean distance. A round moves every node along the
    united weights of its edges and away from `negatives` nodes drawn by a hash of node and round; moves are bounded and shrink with the rounds.
    Equal vectors share one place; null vectors have none; a single vector lies at 0; an empty table gives an empty result. Results
    repeat but for the order of sums.
    """
    names, (a, b) = [f"y{i}" for i in range(dims)], curve(min_dist)
    nodes = cut(nodes_of(rows, key, vector))
    n = nodes.count()
    by_vector = rows.select(key, F.col(vector).cast("array<double>").alias("v"))
    if n < 3:
        place = F.when(F.col("v").isNotNull(), F.array(*[F.lit(0.0)] * dims))
        return by_vector.select(key, place.alias("y"))
    edges = cut(united(calibrated(cut(neighbours(nodes, k, orders, run, seed)), k)))
    y = smooth_start(nodes, edges, dims, seed=seed)
    numbered = cumulative(nodes.select("node", F.lit(1).cast("long").alias("one")), "node", ["one"]).select("node", F.col("below_one").alias("number"))
    y = cut(meet(y, numbered, ["node"]).select("node", "number", *[(F.col(c) * 10).alias(c) for c in names]))
    force = edges.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("force"))
    y = cut(y.join(force, "node"))

    def gaps(side: str) -> Column:
        return sum(((F.col(c) - F.col(f"{side}_{c}")) * (F.col(c) - F.col(f"{side}_{c}")) for c in names), F.lit(0.0))

    def bounded(x: Column, most: float) -> Column:
        return F.greatest(F.lit(-most), F.least(F.lit(most), x))

    for r in range(rounds):
        rate = 1 - r / rounds
        other = y.select(F.col("node").alias("b"), *[F.col(c).alias(f"o_{c}") for c in names])
        ends = edges.join(y.select(F.col("node").alias("a"), *names), "a").join(other, "b").withColumn("g", gaps("o"))
        pull = F.when(F.col("g") > 0, -2 * a * b * F.pow("g", F.lit(b - 1)) / (1 + a * F.pow("g", F.lit(b)))).otherwise(0.0)
        pulls = ends.select(F.col("a").alias("node"), *[(F.col("w") * bounded(pull * (F.col(c) - F.col(f"o_{c}")), 4.0)).alias(c) for c in names])
        drawn = y.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(negatives)))).withColumn("number", F.pmod(F.xxhash64("node", F.lit(r), "j", F.lit(seed)), F.lit(n)))
        met = drawn.join(y.select("number", *[F.col(c).alias(f"o_{c}") for c in names]), "number").withColumn("g", gaps("o"))
        push = 2 * b / ((0.001 + F.col("g")) * (1 + a * F.pow("g", F.lit(b))))
        pushes = met.filter("g > 0").select("node", *[(F.col("force") * bounded(push * (F.col(c) - F.col(f"o_{c}")), 4.0)).alias(c) for c in names])
        moves = pulls.unionByName(pushes).groupBy("node").agg(*[F.sum(c).alias(f"m_{c}") for c in names])
        moved = [(F.col(c) + bounded(F.coalesce(f"m_{c}", F.lit(0.0)) * (0.3 * rate), 2.0 * rate)).alias(c) for c in names]
        y = cut(y.join(moves, "node", "left").select("node", "number", "force", *moved))
    found = nodes.select("node", "v").join(y, "node").select("v", F.array(*names).alias("y"))
    return by_vector.join(found, "v", "left").select(key, "y")
