"""Groups of embeddings: centroids, cosine edges, component merging, coherence, profiles, sub-cells, matched neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.operators.stats import cumulative, meet
from threadloom.sources.io import cut


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a)) + 1e-12


def centroids(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector and size of each label: cells are averaged by (label, position) with partial sums."""
    cells = rows.select(label, F.posexplode(vector).alias("k", "x")).groupBy(label, "k").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    return cells.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("centroid"), F.max("n").alias("n"))


def cosine_matrix(centres: DataFrame, label: str) -> DataFrame:
    """(a, b, cosine) for a < b. One row per cluster label on each side: the product is of labels, not of rows."""
    a = centres.select(F.col(label).alias("a"), F.col("centroid").alias("x"))
    b = centres.select(F.col(label).alias("b"), F.col("centroid").alias("y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", (dot(F.col("x"), F.col("y")) / (norm(F.col("x")) * norm(F.col("y")))).alias("cosine"))


def merged_labels(labels: DataFrame, edges: DataFrame, label: str = "label") -> DataFrame:
    """(label, merged): components of the edges, numbered densely by their least label; noise (-1) stays.

    Least labels spread along edges, with jumps to the labels' labels, until nothing changes; tables are of labels, not of rows.
    """
    own = labels.select(F.col(label).alias("l")).distinct().filter("l <> -1")
    both = edges.select(F.col("a").alias("l"), F.col("b").alias("to")).union(edges.select("b", "a"))
    current = own.withColumn("c", F.col("l"))
    while True:
        told = both.join(current, "l").select(F.col("to").alias("l"), "c").union(current)
        spread = told.groupBy("l").agg(F.min("c").alias("c"))
        above = spread.select(F.col("l").alias("c"), F.col("c").alias("above"))
        new = spread.join(above, "c", "left").select("l", F.least("c", "above").alias("c"))
        new = cut(new)
        if new.join(current.withColumnRenamed("c", "old"), "l").filter("c <> old").isEmpty():
            break
        current = new
    places = cumulative(new.select("c").distinct().withColumn("n", F.lit(1)), "c", ["n"])
    numbered = meet(new, places, ["c"]).select(F.col("l").alias(label), F.col("below_n").cast("int").alias("merged"))
    noise = labels.select(label).distinct().filter(F.col(label) == -1).withColumn("merged", F.lit(-1))
    return numbered.union(noise)


def coherence(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean cosine over pairs of each label's members, from the sum of their unit vectors: (|sum|^2 - n) / (n (n - 1))."""
    unit = rows.select(label, F.transform(vector, lambda x: x / norm(F.col(vector))).alias("u"))
    cells = unit.select(label, F.posexplode("u").alias("k", "x")).groupBy(label, "k").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    out = cells.groupBy(label).agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").alias("n"))
    return out.select(label, "n", F.when(F.col("n") > 1, (F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("coherence"))


def dissolved(rows: DataFrame, label: str, vector: str, least: float = 0.35, size: int = 5) -> DataFrame:
    """rows with labels of incoherent clusters of some size turned into noise."""
    bad = coherence(rows, label, vector).filter((F.col("coherence") < least) & (F.col("n") >= size)).select(F.col(label), F.lit(True).alias("__bad"))
    return rows.join(bad, label, "left").withColumn(label, F.when(F.col("__bad").isNotNull(), -1).otherwise(F.col(label))).drop("__bad")


def profile(rows: DataFrame, label: str, outcomes: list[str], text: str, key: str, samples: int = 5, digits: int = 4) -> DataFrame:
    """Size, mean outcomes and some texts of each label; texts of the least hashes of the key, so that a run can be repeated."""
    ranked = rows.withColumn("__r", F.row_number().over(W.partitionBy(label).orderBy(F.md5(F.col(key).cast("string")), key)))
    picked = ranked.filter(F.col("__r") <= samples).groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", text))), lambda s: s[text]).alias("t"))
    means = rows.groupBy(label).agg(F.count("*").alias("n"), *[F.bround(F.avg(o), digits).alias(o) for o in outcomes])
    return means.join(picked, label).withColumn("samples", F.array_join("t", " ||| ")).drop("t")


def sub_cells(
    rows: DataFrame, label: str, columns: list[str], key: str, seed: int = 42, least: int = 40, per_cell: int = 20, most: int = 5, starts: int = 10, steps: int = 300, whole: int = 100_000, together: int = 500
) -> DataFrame:
    """rows with their columns standardised and cell, k-means cells within each label of at least so many rows: k = min(max(2, n / per_cell), most);
    other labels have one cell.

    Start s begins with the k rows from place s * k on in the order of a hash of the key (ties by the key; from the first again where a label has fewer); of the
    starts the one with the least sum of squares counts, the first on ties. A label of up to `whole` rows is one task's; larger ones
    take their steps together, `together` labels at a time, each task adding up its own rows by nearest centre. Null labels are a
    label; rows with a null among the columns are left out; an empty table gives an empty result. Steps that have not settled are told by a warning.
    """
    import numpy as np

    from threadloom.operators.linear import standardise

    p = len(columns)
    z = standardise(rows.withColumns({c: F.col(c).cast("double") for c in columns}), columns).dropna(subset=columns)
    z = cut(z.withColumn("__h", F.xxhash64(F.lit(seed), F.col(key))))
    size = z.groupBy(label).agg(F.count("*").alias("__n"))
    parts = meet(z, size, [label])
    cells_of = lambda n: min(max(2, n // per_cell), most)
    out_schema = z.drop("__h").withColumn("cell", F.lit(0)).schema

    def squares(x, c):
        """rows x starts x cells"""
        return np.maximum((x * x).sum(1)[:, None, None] + (c * c).sum(2)[None] - 2 * np.einsum("np,skp->nsk", x, c), 0)

    def sums(x, c):
        """Of the rows of each start's cells: sums, numbers, squares to the centre."""
        total = np.zeros((starts, c.shape[1], p + 2))
        for a in range(0, len(x), 20_000):
            part = x[a : a + 20_000]
            d = squares(part, c)
            one = (d.argmin(2)[:, :, None] == np.arange(c.shape[1])).astype(float)
            total[:, :, :p] += np.einsum("nsk,np->skp", one, part)
            total[:, :, p] += one.sum(0)
            total[:, :, p + 1] += (one * d).sum(0)
        return total

    def moved(total, c):
        return np.where(total[:, :, p, None] > 0, total[:, :, :p] / np.maximum(total[:, :, p, None], 1), c)

    def begin(x, k):
        m = min(len(x), most * starts)
        return np.array([[x[(s * k + j) % m] for j in range(k)] for s in range(starts)])

    def one_label(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        n = table.num_rows
        cell = np.zeros(n, np.int32)
        if n >= least:
            table = table.take(pc.sort_indices(table, [("__h", "ascending"), (key, "ascending")]))
            x = np.stack([table.column(c).to_numpy() for c in columns], axis=1)
            c = begin(x, cells_of(n))
            for _ in range(steps):
                total = sums(x, c)
                new = moved(total, c)
                still = np.allclose(new, c, atol=1e-9)
                c = new
                if still:
                    break
            best = c[total[:, :, p + 1].sum(1).round(9).argmin()]
            cell = squares(x, best[None])[:, 0].argmin(1).astype(np.int32)
        return table.drop_columns(["__h"]).append_column("cell", pa.array(cell))

    small = parts.filter(F.col("__n") <= whole).drop("__n").groupBy(label).applyInArrow(one_label, out_schema)
    large = [r[0] for r in size.filter(F.col("__n") > whole).select(label).collect()]  # at most rows / whole
    for a in range(0, len(large), together):
        some = large[a : a + together]
        mine = F.lit(False)
        for g in some:
            mine = mine | F.col(label).eqNullSafe(F.lit(g))
        own = cut(parts.filter(mine).withColumn("__x", F.array(*columns)))
        first = W.partitionBy(label).orderBy("__h", key)
        heads = own.withColumn("__r", F.row_number().over(first)).filter(F.col("__r") <= most * starts).select(label, "__r", "__x", "__n").collect()  # so many rows of each label
        centres = {}
        for g in some:
            mine = sorted((r["__r"], r["__x"], r["__n"]) for r in heads if r[label] == g)
            centres[g] = begin(np.array([x for _, x, _ in mine]), cells_of(mine[0][2]))

        def add_up(centres):
            def run(batches):
                import pyarrow as pa

                held, kind = {}, None
                for batch in batches:
                    kind = batch.column(0).type
                    codes = batch.column(0).dictionary_encode()
                    names, x = [*codes.dictionary.to_pylist(), None], batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
                    at = codes.indices.fill_null(len(names) - 1).to_numpy(zero_copy_only=False)
                    order = np.argsort(at, kind="stable")
                    for place in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                        if len(place):
                            g = names[at[place[0]]]
                            held[g] = held.get(g, 0) + sums(x[place], centres[g])
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(list(held), kind), pa.array([h.ravel() for h in held.values()], pa.list_(pa.float64()))], names=["label", "g"])

            return run

        kind, settled = z.schema[label].dataType.simpleString(), False
        for _ in range(steps):
            added = own.select(F.col(label).alias("label"), "__x").mapInArrow(add_up(centres), f"label {kind}, g array<double>").select("label", F.posexplode("g").alias("k", "x")).groupBy("label", "k").agg(F.sum("x").alias("x"))
            totals = {r[0]: np.array(r[1]).reshape(starts, -1, p + 2) for r in added.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"])).collect()}  # a row for each label
            new = {g: moved(t, centres[g]) for g, t in totals.items()}
            settled = all(np.allclose(new[g], centres[g], atol=1e-9) for g in new)
            centres = new
            if settled:
                break
        if not settled:
            import warnings

            warnings.warn(f"k-means of {len(some)} labels has not settled after {steps} steps", stacklevel=2)
        best = {g: c[totals[g][:, :, p + 1].sum(1).round(9).argmin()] for g, c in centres.items()}

        def assign(batches, best=best):
            import pyarrow as pa

            for batch in batches:
                at = batch.schema.get_field_index(label)
                labels = np.array(batch.column(at).to_pylist(), dtype=object)
                x = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in columns], axis=1)
                cell = np.zeros(len(x), np.int32)
                for g, c in best.items():
                    own = np.flatnonzero(labels == g) if g is not None else np.flatnonzero([v is None for v in labels])
                    if len(own):
                        cell[own] = squares(x[own], c[None])[:, 0].argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

        small = small.unionByName(own.drop("__h", "__n", "__x").mapInArrow(assign, out_schema))
    return small


def hash_tables(least: float, bits: int, miss: float = 1e-4) -> int:
    """How many tables of so many random signs it takes until rows at the least cosine share no block with a chance of miss at most."""
    import math

    together = (1 - math.acos(least) / math.pi) ** bits
    return max(1, math.ceil(math.log(miss) / math.log(1 - together)))


def threshold_groups(rows: DataFrame, key: str, vector: str, least: float = 0.9, bits: int = 12, miss: float = 1e-4, seed: int = 5, tile: int = 8192) -> DataFrame:
    """A stand-in for density clustering: components of the graph of rows whose cosine is at least so much.

    Equal vectors are one node first, so that copies make no pairs. Signs of random projections give blocks; there are as many tables of
    blocks as it takes to miss a link at the bound with a chance of miss at most. A task multiplies a block's vectors with each other and hands
    on a forest of the links it finds, one edge for a row at most: neither candidates nor links are ever rows. Blocks over `tile` rows
    are dealt to pairs of tiles, so that a task holds two of them. Where very many different vectors are alike, products are many: take
    more bits.
    """
    import numpy as np

    tables = hash_tables(least, bits, miss)
    v = rows.select(F.col(key).alias("__key"), F.col(vector).cast("array<double>").alias("__v"))
    nodes = cut(v.groupBy("__v").agg(F.min("__key").alias("__k")))

    def run(batches):
        import pyarrow as pa

        planes = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
            if planes is None:
                planes = np.random.default_rng(seed).standard_normal((x.shape[1], tables * bits))
            signs = (x @ planes > 0).reshape(n, tables, bits)
            code = (signs << np.arange(bits)).sum(2) + (np.arange(tables) << bits)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), tables)), pa.array(code.ravel())], names=["__k", "block"])

    def forest(table):
        import pyarrow as pa

        keys, side = table.column("__k").to_numpy(), table.column("side").to_numpy()
        x = table.column("__v").combine_chunks().flatten().to_numpy().reshape(len(keys), -1)
        x = x / (np.sqrt((x * x).sum(1)) + 1e-12)[:, None]
        own = np.arange(len(keys))
        left, right = (own, own) if (side == 0).all() else (own[side == 1], own[side == 2])
        root = own.copy()
        for a in range(0, len(left), 512):
            at, to = np.nonzero(x[left[a : a + 512]] @ x[right].T >= least)
            at, to = left[a + at], right[to]
            while True:
                one, other = root[at], root[to]
                apart = one != other
                if not apart.any():
                    break
                at, to, one, other = at[apart], to[apart], one[apart], other[apart]
                np.minimum.at(root, np.maximum(one, other), np.minimum(one, other))
                while (root != root[root]).any():
                    root = root[root]
        linked = root != own
        return pa.table({"a": pa.array(keys[linked], table.schema.field("__k").type), "b": pa.array(keys[root[linked]], table.schema.field("__k").type)})

    kind = nodes.schema["__k"].dataType.simpleString()
    blocks = nodes.select("__k", "__v").mapInArrow(run, f"__k {kind}, block long")
    sizes = blocks.groupBy("block").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    placed = meet(meet(blocks, sizes, ["block"]), nodes.select("__k", "__v"), ["__k"]).withColumn("own", F.pmod(F.xxhash64("__k"), "tiles").cast("int"))
    placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    order = F.when(F.col("own") == F.col("with"), 0).when(F.col("own") < F.col("with"), 1).otherwise(2)
    placed = placed.select("block", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "__k", "__v", order.alias("side"))
    edges = cut(placed.groupBy("block", "i", "j").applyInArrow(forest, f"a {kind}, b {kind}").distinct())
    groups = merged_labels(nodes.select(F.col("__k").alias("label")), edges, "label")
    named = nodes.join(groups, nodes["__k"] == groups["label"]).select("__v", "merged")
    return v.join(named, "__v").select(F.col("__key").alias(key), "merged")


def matched_groups(rows: DataFrame, cell: list[str], columns: list[str], anchor: Column, key: str, n: int = 3) -> DataFrame:
    """For the anchor of each cell (the row where anchor is true, least key) its nearest rows by Mahalanobis distance (diagonal)."""
    spread = rows.agg(*[F.greatest(F.var_pop(c), F.lit(1e-12)).alias(f"__v_{c}") for c in columns])
    first = rows.filter(anchor).groupBy(*cell).agg(F.min(F.struct(key, *columns)).alias("__a"))
    d2 = sum(((F.col(c) - F.col(f"__a.{c}")) * (F.col(c) - F.col(f"__a.{c}")) / F.col(f"__v_{c}") for c in columns), F.lit(0.0))
    near = rows.join(first, cell).crossJoin(F.broadcast(spread)).withColumn("distance", F.sqrt(d2))  # one row of variances
    w = W.partitionBy(*cell).orderBy("distance", key)
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select(*cell, key, "distance", "rank")


def covariance_matches(rows: DataFrame, cell: list[str], vector: str, p: int, anchor: Column, key: str, age: str | None = None, tiers: int = 3, n: int = 3) -> DataFrame:
    """For the anchor of each cell (the row where anchor is true, of the least key) the n nearest rows by Mahalanobis distance with the full covariance.

    With age, rows match only within quantile tiers of it (over all rows), so that a tier is part of the cell. The n nearest of a task go
    on, so no task sorts a whole cell. An anchor is its own nearest row; ties go by key; cells without an anchor have no rows.
    """
    from threadloom.operators.linear import whitened
    from threadloom.operators.stats import qcut

    rows = qcut(rows, age, tiers, "tier") if age else rows
    cell = [*cell, "tier"] if age else list(cell)
    w = whitened(rows, vector, p, "__w").filter("__w IS NOT NULL")
    first = w.filter(anchor).groupBy(*cell).agg(F.min(F.struct(key, "__w")).alias("__a"))
    near = meet(w.select(*cell, key, "__w"), first, cell).withColumn("distance", F.sqrt(F.aggregate(F.zip_with("__w", "__a.__w", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)))
    order = W.partitionBy(*cell).orderBy("distance", key)
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select(*cell, F.col(f"__a.{key}").alias("anchor"), key, "distance", "rank")
