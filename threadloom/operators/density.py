"""Density clustering: neighbours from sorted orders, mutual reachability, a spanning forest by Boruvka's rounds, condensed by excess of mass.

Equal vectors are one node with a weight. Every step is a join, an aggregation or a task over a bounded run of rows; no task sees a whole
cluster: the forest is contracted level by level, and a contracted part is one row.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.operators.cluster import merged_labels
from threadloom.operators.scan import scan
from threadloom.operators.stats import cumulative, meet
from threadloom.sources.io import cut

#: Sorted orders of the rows, rows of an order that are compared with each other, and edges of the forest that one task condenses.
ORDERS, RUN, LIMIT = 12, 1024, 100_000
#: Edges between parts that one task joins, all remaining rounds at once.
EDGES = 1 << 20
#: Runs that one task compares, about.
RUNS = 32
#: The least distance that counts as one; closer rows have its density.
CLOSEST = 1e-12

# What tasks call travels with them: executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def nodes_of(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(node, v, weight): each distinct vector, its least key and how many rows have it. Null vectors are left out."""
    v = rows.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL")
    return v.groupBy("v").agg(F.min("k").alias("node"), F.count("*").alias("weight")).select("node", "v", "weight")


def _sorted_runs(nodes: DataFrame, handle, schema: str, columns: list[str], orders: int, run: int, seed: int) -> DataFrame:
    """handle(ids, vectors, columns) of overlapping runs of rows that stand near each other in each of several orders.

    An order sorts the rows by the signs of 62 random projections about the mean; sorting is by ranges, so tasks are bounded.
    """
    mean = nodes.select(F.posexplode("v").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("x")).orderBy("k").collect()  # a row for each dimension
    centre = np.array([r.x for r in mean])
    d = len(centre)

    def codes(batches):
        import pyarrow as pa

        planes = [np.random.default_rng([seed, t]).standard_normal((d, 62)) for t in range(orders)]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d) - centre
            for t, p in enumerate(planes):
                code = ((x @ p > 0).astype(np.int64) << np.arange(61, -1, -1)).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(code), *batch.columns], names=["order", "code", *batch.schema.names])

    def compare(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def runs():
            held, at = None, None
            for batch in batches:
                t = pa.Table.from_batches([batch])
                for order in sorted(set(t.column("order").to_pylist())):
                    part = t.filter(pc.equal(t.column("order"), order))
                    if at != order and held is not None:
                        yield held
                        held = None
                    held, at = (part if held is None else pa.concat_tables([held, part])), order
                    while held.num_rows >= run:
                        yield held.slice(0, run)
                        held = held.slice(run // 2)
            if held is not None:
                yield held

        for t in runs():
            t = t.combine_chunks()
            if t.num_rows > 1:
                x = t.column("v").chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, d)
                found = handle(t.column("node").to_numpy(), x, [t.column(c).to_numpy() for c in columns])
                if found is not None and len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(f) for f in found], names=["a", "b", "d"])

    rest = [f"`{c}` {nodes.schema[c].dataType.simpleString()}" for c in columns]
    spread = nodes.select("node", "v", *columns).mapInArrow(codes, ", ".join(["order int", "code long", "node long", "v array<double>", *rest]))
    ranges = max(1, -(-nodes.count() * orders // (RUNS * run)))
    return spread.repartitionByRange(ranges, "order", "code", "node").sortWithinPartitions("order", "code", "node").mapInArrow(compare, schema)


def _distances(x: np.ndarray) -> np.ndarray:
    q = (x * x).sum(1)
    out = q[:, None] + q[None]
    out -= 2 * x @ x.T
    np.maximum(out, 0, out=out)
    np.sqrt(out, out=out)
    np.fill_diagonal(out, np.inf)
    return out


def neighbours(nodes: DataFrame, k: int = 15, orders: int = ORDERS, run: int = RUN, seed: int = 7) -> DataFrame:
    """(a, b, d): for each node (node, v) the k nearest others that any order shows, by Euclidean distance; fewer where there are fewer.

    All rows of a run are compared; up to run / 2 rows that is every pair, beyond it a node may miss neighbours that no order brings
    near it (a test measures the recall).
    """

    def nearest(ids, x, _):
        d = _distances(x)
        m = min(k, len(ids) - 1)
        at = np.argpartition(d, m - 1, axis=1)[:, :m]
        far = np.take_along_axis(d, at, 1)
        # The formula above loses digits for near vectors; what is kept is measured again.
        exact = np.sqrt(((x[:, None] - x[at]) ** 2).sum(2)) if len(ids) * m * x.shape[1] < 1 << 24 else far
        return np.repeat(ids, m), ids[at].ravel(), exact.ravel()

    found = _sorted_runs(nodes, nearest, "a long, b long, d double", [], orders, run, seed)
    first = W.partitionBy("a").orderBy("d", "b")
    return found.groupBy("a", "b").agg(F.min("d").alias("d")).withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= k).drop("__n")


def core_distances(nodes: DataFrame, near: DataFrame, min_samples: int) -> DataFrame:
    """(node, weight, core): the distance within which min_samples other rows lie, copies included; the farthest known where there are fewer."""
    held = near.join(nodes.select(F.col("node").alias("b"), F.col("weight").alias("w")), "b")
    so_far = F.sum("w").over(W.partitionBy("a").orderBy("d", "b").rowsBetween(W.unboundedPreceding, 0))  # the neighbours of a node
    counted = held.withColumn("n", so_far).join(nodes.select(F.col("node").alias("a"), F.col("weight").alias("own")), "a")
    enough = F.min(F.when(F.col("n") + F.col("own") - 1 >= min_samples, F.col("d")))
    core = counted.groupBy("a").agg(F.coalesce(enough, F.max("d")).alias("core"))
    out = nodes.select("node", "weight").join(core.withColumnRenamed("a", "node"), "node", "left")
    return out.withColumn("core", F.when(F.col("weight") > min_samples, 0.0).otherwise(F.coalesce("core", F.lit(0.0))))


def reachability(near: DataFrame, cores: DataFrame) -> DataFrame:
    """(a, b, w), a < b: the mutual reachability of neighbours, the largest of their distance and both core distances."""
    pairs = near.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("d").alias("d"))
    one, other = (cores.select(F.col("node").alias(x), F.col("core").alias(f"core_{x}")) for x in "ab")
    return pairs.join(one, "a").join(other, "b").select("a", "b", F.greatest("d", "core_a", "core_b", F.lit(CLOSEST)).alias("w"))


def joined_parts(pa: np.ndarray, pb: np.ndarray, w: np.ndarray, a: np.ndarray, b: np.ndarray, parts: np.ndarray, bounds: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Boruvka's rounds in one task, as spanning_forest() has them: the places of the taken edges, and the name of each part after.

    parts are sorted; bounds has one for each part, NaN for none, which takes no edge.
    """
    order = np.lexsort((b, a, w))
    x, y = np.searchsorted(parts, pa[order]), np.searchsorted(parts, pb[order])
    weight, left = w[order], np.arange(len(order))
    name, bound, taken = np.arange(len(parts)), bounds, []
    while len(left):
        # Edges stand in order: of the edges of a part the first one is the least.
        least = np.full(len(parts), len(order))
        np.minimum.at(least, x[left], left)
        np.minimum.at(least, y[left], left)
        own = np.flatnonzero(least < len(order))
        if bound is not None:
            own = own[weight[least[own]] <= bound[own]]
        if not len(own):
            break
        edge = least[own]
        taken.append(np.unique(edge))
        up = np.arange(len(parts))
        up[own] = x[edge] + y[edge] - own
        # Of two parts that chose the same edge the lesser one is the root.
        root = (up[up] == np.arange(len(parts))) & (np.arange(len(parts)) < up)
        up[root] = np.flatnonzero(root)
        while (up[up] != up).any():
            up = up[up]
        if bound is not None:
            new = np.full(len(parts), np.nan)
            np.fmin.at(new, up, bound)
            bound = new
        name, x, y = up[name], up[x], up[y]
        left = left[x[left] != y[left]]
    return order[np.concatenate([np.zeros(0, np.int64), *taken])], parts[name]


def _at_once(open_edges: DataFrame, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """joined_parts() of bounded edges (a, b, w, pa, pb) with the parts' bounds (part, bound): the taken edges, and (part, up)."""
    bounded = known is not None

    def run(edges, limits):
        import pyarrow as pa

        edges = {c: edges.column(c).to_numpy() for c in ("pa", "pb", "w", "a", "b")}
        parts = np.unique(np.concatenate([edges["pa"], edges["pb"]]))
        bounds = None
        if bounded:
            bounds = np.full(len(parts), np.nan)
            bounds[np.searchsorted(parts, limits.column("part").to_numpy())] = limits.column("bound").to_numpy()
        taken, names = joined_parts(*edges.values(), parts, bounds)
        moved = np.flatnonzero(parts != names)
        ends = [pa.chunked_array([pa.array(edges[c][taken], k), pa.nulls(len(moved), k)]) for c, k in (("a", pa.int64()), ("b", pa.int64()), ("w", pa.float64()))]
        ups = [pa.chunked_array([pa.nulls(len(taken), pa.int64()), pa.array(x[moved], pa.int64())]) for x in (parts, names)]
        return pa.table([*ends, *ups], names=["a", "b", "w", "part", "up"])

    one = F.lit(0).alias("one")
    if not bounded:
        limits = open_edges.select(F.col("pa").alias("part"), F.lit(None).cast("double").alias("bound"), one).limit(0)
    else:  # of the parts that have edges
        ends = open_edges.select(F.col("pa").alias("part")).union(open_edges.select("pb")).distinct()
        limits = known.join(ends, "part").select("part", "bound", one)
    out = cut(open_edges.select("*", one).groupBy("one").cogroup(limits.groupBy("one")).applyInArrow(run, "a long, b long, w double, part long, up long"))
    return out.filter("a IS NOT NULL").select("a", "b", "w"), out.filter("part IS NOT NULL").select("part", "up")


def spanning_forest(labels: DataFrame, edges: DataFrame, bounds: DataFrame | None = None, rounds: int | None = None, at_once: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The edges (a, b, w) of least forests that join the parts in labels (node, part), and the labels after.

    Boruvka's rounds: every part takes its least edge to another part (ties by its ends, so that no circle closes), parts that are so
    joined get one name by following pointers, and edges within a part go. bounds: (node, bound), the least w that an edge of the node may have
    which is not among the edges; a part whose least edge lies above one of its bounds takes none. The number of
    rounds grows as the logarithm of the nodes; without a limit to them, once at most at_once (EDGES) edges lie between parts, a task takes those that remain.
    """
    at_once = EDGES if at_once is None else at_once
    names = {x: labels.select(F.col("node").alias(x), F.col("part").alias(f"p{x}")) for x in "ab"}
    open_edges = cut(edges.join(names["a"], "a").join(names["b"], "b").filter("pa <> pb"))
    taken = None
    while rounds is None or rounds > 0:
        if rounds is None and open_edges.count() <= at_once:
            known = None if bounds is None else labels.join(bounds, "node").groupBy("part").agg(F.min("bound").alias("bound"))
            more, up = _at_once(open_edges, known)
            taken = more if taken is None else taken.unionByName(more)
            labels = cut(labels.join(up, "part", "left").select("node", F.coalesce("up", "part").alias("part")))
            break
        both = open_edges.select(F.col("pa").alias("part"), F.col("pb").alias("to"), "w", "a", "b").unionByName(open_edges.select(F.col("pb").alias("part"), F.col("pa").alias("to"), "w", "a", "b"))
        best = both.groupBy("part").agg(F.min(F.struct("w", "a", "b", "to")).alias("x")).select("part", "x.*")
        if bounds is not None:
            known = labels.join(bounds, "node").groupBy("part").agg(F.min("bound").alias("bound"))
            best = best.join(known, "part").filter("w <= bound").drop("bound")
        best = cut(best)
        if best.isEmpty():
            break
        rounds = None if rounds is None else rounds - 1
        chosen = best.select("a", "b", "w").distinct()
        taken = chosen if taken is None else taken.unionByName(chosen)
        # Of two parts that chose the same edge the lesser one is the root.
        back = best.select(F.col("part").alias("to"), F.col("to").alias("back"))
        up = best.join(back, "to", "left").select("part", F.when((F.col("back") == F.col("part")) & (F.col("part") < F.col("to")), F.col("part")).otherwise(F.col("to")).alias("up"))
        while True:
            above = up.select(F.col("part").alias("up"), F.col("up").alias("above"))
            new = cut(up.join(above, "up", "left").select("part", F.coalesce("above", "up").alias("up"), (F.col("above") != F.col("up")).alias("moved")))
            up = new.select("part", "up")
            if new.filter("moved").isEmpty():
                break
        labels = cut(labels.join(up, "part", "left").select("node", F.coalesce("up", "part").alias("part")))
        renamed = {x: up.select(F.col("part").alias(f"p{x}"), F.col("up").alias(f"u{x}")) for x in "ab"}
        moved = open_edges.join(renamed["a"], "pa", "left").join(renamed["b"], "pb", "left")
        open_edges = cut(moved.select("a", "b", "w", F.coalesce("ua", "pa").alias("pa"), F.coalesce("ub", "pb").alias("pb")).filter("pa <> pb"))
    return (cut(taken) if taken is not None else edges.limit(0)), labels


def spanning_tree(nodes: DataFrame, near: DataFrame, cores: DataFrame, orders: int = ORDERS, run: int = RUN, seed: int = 7) -> DataFrame:
    """(a, b, w): a least spanning tree by mutual reachability.

    The neighbours' edges serve while a part's least one is proven to be its least of all: no row beyond a node's neighbours is nearer than
    the last of them. Where no part has such an edge, each node's nearest row of another part is looked for in the runs of all orders, every part takes
    one edge, and the neighbours serve again; until one part is left or no run shows two.
    """
    labels = nodes.select("node", F.col("node").alias("part"))
    edges = cut(reachability(near, cores))
    last = near.groupBy(F.col("a").alias("node")).agg(F.max("d").alias("d"))
    bounds = cut(last.join(cores, "node").select("node", F.greatest("d", "core", F.lit(CLOSEST)).alias("bound")))
    tree = edges.limit(0)
    while True:
        more, labels = spanning_forest(labels, edges, bounds)
        tree = tree.unionByName(more)
        if labels.select("part").distinct().limit(2).count() < 2:
            return tree
        named = nodes.join(labels, "node").join(cores.select("node", "core"), "node")

        def foreign(ids, x, columns):
            part, core = columns
            if (part == part[0]).all():
                return None
            d = np.maximum(_distances(x), np.maximum(core[:, None], core[None]))
            d[part[:, None] == part[None]] = np.inf
            at = d.argmin(1)
            fine = np.isfinite(d[np.arange(len(ids)), at])
            return ids[fine], ids[at][fine], np.sqrt(((x - x[at]) ** 2).sum(1))[fine]

        shown = _sorted_runs(named, foreign, "a long, b long, d double", ["part", "core"], orders, run, seed)
        more, labels = spanning_forest(labels, cut(reachability(shown, cores)), rounds=1)
        if more.isEmpty():
            return tree
        tree = tree.unionByName(more)


class _Tree:
    """Kruskal's merges of nodes into clusters, from the bottom up: what a set of nodes is, in a few numbers."""

    def __init__(self, name: str, least: int):
        self.name, self.least, self.made, self.closed, self.placed = name, least, 0, [], {}
        self.up: dict[int, int] = {}
        self.state: dict[int, tuple] = {}  # root: size, cluster or None, sum of densities, best below
        self.members: dict[int, list[int]] = {}  # of sets that are no cluster yet

    def add(self, node: int, size: int, cluster: str | None, total: float, below: float) -> None:
        self.up[node], self.state[node], self.members[node] = node, (size, cluster, total, below), [node]
        if cluster is not None:
            self.placed[node], self.members[node] = cluster, []

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def new(self) -> str:
        self.made += 1
        return f"{self.name}.{self.made}"

    def close(self, state: tuple, density: float, parent: str | None) -> float:
        """The cluster is born at a density: the best that it or those below it hold."""
        size, cluster, total, below = state
        own = total - density * size
        self.closed.append((cluster, parent, own, below, own >= below))
        return max(own, below)

    def merge(self, pairs: list[tuple[int, int]], w: float) -> None:
        """All merges at one distance, at once: the result does not depend on their order."""
        density, sets = 1 / max(w, CLOSEST), {}
        for x in {self.root(y) for pair in pairs for y in pair}:
            sets[x] = [x]
        for a, b in pairs:
            a, b = self.root(a), self.root(b)
            if a != b:
                a, b = min(a, b), max(a, b)
                self.up[b] = a
                sets[a] += sets.pop(b)
        for root, own in sets.items():
            if len(own) < 2:
                continue
            states = [self.state.pop(x) for x in own]
            members = [n for x in own for n in self.members.pop(x)]
            big, size = [x for x in states if x[1] is not None], sum(x[0] for x in states)
            if len(big) > 1:
                cluster = self.new()
                state = (size, cluster, density * size, sum(self.close(x, density, cluster) for x in big))
            elif big:
                state = (size, big[0][1], big[0][2] + density * (size - big[0][0]), big[0][3])
            elif size >= self.least:
                state = (size, self.new(), density * size, 0.0)
            else:
                state = (size, None, 0.0, 0.0)
            if state[1] is not None:
                self.placed.update((n, state[1]) for n in members)
                members = []
            self.state[root], self.members[root] = state, members


_STATE = "node long, size long, cluster string, total double, below double"
_CONDENSED = f"{_STATE}, kind string, into long, parent string, own double, keep boolean"


def _condense(level: int, least: int, last: bool):
    def run(key, edges, states):
        import pandas as pd

        tree = _Tree(f"{level}.{key[0]}", least)
        for r in states.itertuples():
            tree.add(int(r.node), int(r.size), None if pd.isna(r.cluster) else r.cluster, r.total, r.below)
        for w, same in edges.groupby("w", sort=True):
            tree.merge(list(zip(same["a"].tolist(), same["b"].tolist())), float(w))
        rows = []
        roots = sorted(tree.state)
        if last:  # parts that nothing joins meet at a density of 0; a cluster that is all there is, is none
            clusters = [r for r in roots if tree.state[r][1] is not None]
            for r in clusters:
                if len(clusters) > 1:
                    tree.close(tree.state[r], 0.0, None)
                else:
                    tree.closed.append((tree.state[r][1], None, 0.0, tree.state[r][3], False))
        else:
            rows += [(r, *tree.state[r], "state", None, None, None, None) for r in roots]
        rows += [(n, None, tree.placed.get(n), None, None, "place", tree.root(n), None, None, None) for n in tree.up]
        rows += [(None, None, c, None, below, "cluster", None, parent, own, keep) for c, parent, own, below, keep in tree.closed]
        columns = [x.split()[0] for x in _CONDENSED.split(", ")]
        out = pd.DataFrame(rows, columns=columns)
        return out.astype({"node": "Int64", "size": "Int64", "into": "Int64", "total": float, "below": float, "own": float, "keep": "boolean"})

    return run


def condensed(nodes: DataFrame, tree: DataFrame, min_cluster_size: int, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(node, cluster): the smallest cluster that each node (node, weight) belongs to, null for none; and the clusters (cluster, parent, own, keep).

    own is a cluster's excess of mass, keep whether it is at least that of the best clusters below it. Merges go up the
    tree in the order of the edges, those of one length at once; a level takes a share of them (half, or less) by which no part has more than `limit` edges, and
    a task condenses each part to one row, so that the next level has those rows for nodes. Of one length only more edges than a
    level takes are split, by their ends.
    """
    limit = LIMIT if limit is None else limit
    left = cut(scan(tree, [], ["w", "a", "b"], {"rank": ("sum", F.lit(1).cast("long"))}))
    mine = F.col("weight") >= min_cluster_size
    name = F.when(mine, F.concat(F.lit("node."), F.col("node").cast("string")))
    states = nodes.select("node", F.col("weight").cast("long").alias("size"), name.alias("cluster"), F.when(mine, F.col("weight") / CLOSEST).otherwise(0.0).alias("total"), F.lit(0.0).alias("below"))
    places, clusters, level = nodes.select("node", F.col("node").alias("at"), name.alias("cluster")), None, 0
    while True:
        n, level = left.count(), level + 1
        last, share = n <= limit, max(limit, n // 2)
        if last:
            edges, held = left.withColumn("part", F.lit(0).cast("long")), states.withColumn("part", F.lit(0).cast("long"))
        else:
            base = left.agg(F.min("rank")).first()[0]
            while True:
                # Edges of one length stay together, but where there are more of them than a level takes.
                edge = left.filter(F.col("rank") == base + share).first()["w"]
                before = left.filter(F.col("w") < edge).agg(F.max("rank")).first()[0]
                stop = before + 1 if before is not None else base + share
                first = left.filter(F.col("rank") < stop)
                ends = first.select(F.col("a").alias("label")).union(first.select("b"))
                parts = cut(merged_labels(ends, first.select("a", "b")).select(F.col("label").alias("node"), F.col("merged").cast("long").alias("part")))
                edges = first.join(parts.withColumnRenamed("node", "a"), "a")
                if share <= limit or edges.groupBy("part").count().filter(F.col("count") > limit).isEmpty():
                    break
                share = max(limit, share // 2)
            held = states.join(parts, "node")
        out = cut(edges).groupBy("part").cogroup(cut(held).groupBy("part")).applyInPandas(_condense(level, min_cluster_size, last), _CONDENSED)
        out = cut(out)
        closed = out.filter("kind = 'cluster'").select("cluster", "parent", "own", "keep")
        clusters = closed if clusters is None else clusters.unionByName(closed)
        moved = out.filter("kind = 'place'").select(F.col("node").alias("at"), "into", F.col("cluster").alias("now"))
        places = cut(places.join(moved, "at", "left").select("node", F.coalesce("into", "at").alias("at"), F.coalesce("cluster", "now").alias("cluster")))
        if last:
            return places.select("node", "cluster"), cut(clusters)
        joined = {x: moved.select(F.col("at").alias(x), F.col("into").alias(f"n{x}")) for x in "ab"}
        rest = left.filter(F.col("rank") >= stop).join(joined["a"], "a", "left").join(joined["b"], "b", "left")
        left = cut(rest.select("rank", "w", F.coalesce("na", "a").alias("a"), F.coalesce("nb", "b").alias("b")))
        untouched = states.join(parts, "node", "left_anti")
        states = cut(untouched.unionByName(out.filter("kind = 'state'").select(*[c.split()[0] for c in _STATE.split(", ")])))


def chosen_clusters(clusters: DataFrame) -> DataFrame:
    """(cluster, chosen): the topmost kept cluster at or above each, null for none; by following parents, in as many rounds as the logarithm of their depth."""
    up = cut(clusters.select("cluster", F.when(F.col("keep"), F.col("cluster")).alias("chosen"), F.col("parent").alias("above")))
    while not up.filter("above IS NOT NULL").isEmpty():
        step = up.select(F.col("cluster").alias("above"), F.col("chosen").alias("c2"), F.col("above").alias("a2"))
        up = cut(up.join(step, "above", "left").select("cluster", F.coalesce("c2", "chosen").alias("chosen"), F.col("a2").alias("above")))
    return up.select("cluster", "chosen")


def density_clusters(rows: DataFrame, key: str, vector: str, min_cluster_size: int = 20, min_samples: int = 5, k: int = 15, orders: int = ORDERS, run: int = RUN, limit: int | None = None, seed: int = 7) -> DataFrame:
    """(key, label): hierarchical density clusters with excess-of-mass selection; labels are numbered by their least key, noise is -1.

    key: a whole number for each row. Neighbours come from sorted orders (neighbours(), k at least min_samples); with run at twice the
    rows every pair is compared and the result is exact. Copies count as rows of their own but are one node. A row in no cluster, and all
    rows where nothing splits into two clusters, are noise, as are null vectors. Ties of reachability go by key. An empty table gives an empty result.
    """
    nodes = cut(nodes_of(rows, key, vector))
    if nodes.isEmpty():
        return rows.select(key, F.lit(-1).alias("label"))
    near = cut(neighbours(nodes, max(k, min_samples), orders, run, seed))
    cores = cut(core_distances(nodes, near, min_samples))
    tree = cut(spanning_tree(nodes, near, cores, orders, run, seed))
    places, clusters = condensed(nodes, tree, min_cluster_size, limit)
    found = places.join(chosen_clusters(clusters), "cluster", "left").select("node", "chosen")
    by_vector = nodes.select("node", "v").join(found, "node").select("v", "chosen")
    out = rows.select(key, F.col(vector).cast("array<double>").alias("__v")).join(by_vector.withColumnRenamed("v", "__v"), "__v", "left").select(key, "chosen")
    out = cut(out)
    first = out.filter("chosen IS NOT NULL").groupBy("chosen").agg(F.min(key).alias("__first"))
    numbers = meet(first, cumulative(first.select("__first").withColumn("n", F.lit(1)), "__first", ["n"]), ["__first"]).select("chosen", F.col("below_n").cast("int").alias("label"))
    return out.join(numbers, "chosen", "left").select(key, F.coalesce("label", F.lit(-1)).alias("label"))
