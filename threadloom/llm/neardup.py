"""Near duplicates by an LSH forest: sorted signature orders, longest-common-prefix neighbours, adaptive depth."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import documents, free, release, saved, ship
from threadloom.llm.text import grams, mix, pieces

#: Sorted orders, and the MinHash values by which each is sorted.
TREES, DEPTH = 16, 6
#: Neighbours share so many leading values at least; where more than CROWD texts do, regions are cut deeper, to so many at
#: most. Both are less where a link at the least similarity would else part in all orders with a chance over MISS.
FIRST, LAST, CROWD, MISS = 3, 5, 64, 3e-4
#: Rows of a range, of which a task holds one.
RANGE_ROWS = 50_000
#: In regions of up to so many texts all pairs are looked at, in larger ones those with a rare shingle in common.
FEW = 8
#: The chance that a link at the least similarity has too low an estimate.
UNDERRATED = 2e-5
#: Words in a shingle; documents of which 100 * common shingles >= PERCENT * all shingles of both are linked.
SIZE, PERCENT = 5, 80
#: Buckets in which shingles of texts in larger regions are counted, to know the rare ones.
BUCKETS = 1 << 21

_K = TREES * DEPTH
_rng = np.random.default_rng(77)
_A = _rng.integers(0, 1 << 63, _K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, _K, dtype=np.uint64)


class Limits:
    """Depths of regions (first, last) and the least estimate of candidates (estimate) that go with a least similarity."""

    def __init__(self, percent: int):
        p = self.similarity = percent / 100
        deep = [d for d in range(1, LAST + 1) if (1 - p**d) ** TREES <= MISS] or [1]
        self.last = deep[-1]
        self.first = min(FIRST, self.last)
        # Of _K values of 4 bits each, so many agree: binomial, as values agree by chance once in 16.
        q, below, at = p + (1 - p) / 16, 0.0, 0
        while at < _K and (below := below + math.comb(_K, at) * q**at * (1 - q) ** (_K - at)) <= UNDERRATED:
            at += 1
        self.estimate = (at / _K - 1 / 16) / (15 / 16)


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes; with fewer words the whole sequence is one shingle."""
    n = len(words)
    if n == 0:
        return words
    g = grams(words, size) if n >= size else mix(grams(words, n) + np.uint64(n))
    return np.unique(g)


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    for _, _, words in pieces(column, True):
        for k in range(len(words)):
            yield shingle_set(words.of(k), size)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the shingles, upper 32 bits."""
    low = np.full(_K, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 4096):
        part = shingles[a : a + 4096, None] * _A[None, :] + _B[None, :]
        np.minimum(low, part.min(0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def signed(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, digest of the shingle set, signature (big-endian, tree after tree; empty for empty sets)."""

    def run(batches):
        for batch in batches:
            counts, digests, signatures = [], [], []
            for s in shingle_sets(batch.column(1), size):
                counts.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                signatures.append(signature(s).astype(">u4").tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())],
                names=["doc_id", "n_shingles", "digest", "signature"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, signature binary")


def forest(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """The nodes once for each tree, sorted by their signature in the tree's order, in ranges.

    key: the tree's number and values; sketch: 4 bits of every value, to estimate similarities. Ranges are cut by
    the whole key, so that a region shared by very many texts spreads over tasks. At the cut between two ranges of
    one order neighbours may be parted; the other orders cut elsewhere.
    """
    extra = [nodes.schema[c] for c in columns]

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u4").astype(np.uint32).reshape(n, TREES, DEPTH)
            low = (mix(raw.reshape(n, _K).astype(np.uint64)) & np.uint64(15)).astype(np.uint8)
            sketch = (low[:, 0::2] << 4 | low[:, 1::2]).view(f"V{_K // 2}").ravel()
            sketches = pa.array([x.tobytes() for x in sketch], pa.binary())
            for t in range(TREES):
                keys = [bytes([t]) + x.tobytes() for x in raw[:, t].astype(">u4").view(f"V{4 * DEPTH}").ravel()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(keys, pa.binary()), sketches, *batch.columns[2:]], names=["node", "key", "sketch", *columns]
                )

    shape = "node long, key binary, sketch binary" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in extra)
    rows = nodes.filter("n_shingles > 0").select("node", "signature", *columns).mapInArrow(run, shape)
    ranges = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), nodes.count() * TREES // RANGE_ROWS + 1)
    return rows.repartitionByRange(ranges, "key", "node").sortWithinPartitions("key", "node")


class Range:
    """The rows of one range: nodes, sketches (a byte for each value) and regions as runs [starts, ends)."""

    def __init__(self, batches: list[pa.RecordBatch], percent: int):
        table = pa.Table.from_batches(batches)
        self.table, self.limits = table, Limits(percent)
        self.node = table.column("node").to_numpy()
        n = len(self.node)
        keys = np.frombuffer(b"".join(table.column("key").to_pylist()), np.uint8).reshape(n, 1 + 4 * DEPTH)
        packed = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(n, _K // 2)
        self.sketch = np.empty((n, _K), np.uint8)
        self.sketch[:, 0::2], self.sketch[:, 1::2] = packed >> 4, packed & 15
        values = np.ascontiguousarray(keys[:, 1:]).view(">u4")
        same = np.ones((n - 1, DEPTH + 1), bool)
        same[:, 0] = keys[1:, 0] == keys[:-1, 0]
        same[:, 1:] = values[1:] == values[:-1]
        #: Leading values that a row shares with the one before it; -1 between trees.
        self.common = np.concatenate([[-1], np.logical_and.accumulate(same, 1).sum(1) - 1])
        self.starts, self.ends = self._regions(0, n, self.limits.first)

    def _regions(self, a: int, b: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Runs whose rows share depth leading values; crowded ones are cut deeper."""
        cut = np.flatnonzero(self.common[a:b] < depth) + a
        starts = np.union1d(cut, [a])
        ends = np.append(starts[1:], b)
        if depth >= self.limits.last:
            return starts, ends
        crowded = np.flatnonzero(ends - starts > CROWD)
        if not len(crowded):
            return starts, ends
        fine = np.ones(len(starts), bool)
        fine[crowded] = False
        deeper = [self._regions(int(starts[k]), int(ends[k]), depth + 1) for k in crowded]
        starts = np.concatenate([starts[fine], *(d[0] for d in deeper)])
        ends = np.concatenate([ends[fine], *(d[1] for d in deeper)])
        order = np.argsort(starts)
        return starts[order], ends[order]

    def estimate(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Estimated similarities of rows a and b; 4-bit values agree by chance once in 16."""
        out = np.empty(len(a))
        for k in range(0, len(a), 20_000):
            out[k : k + 20_000] = (self.sketch[a[k : k + 20_000]] == self.sketch[b[k : k + 20_000]]).mean(1)
        return (out - 1 / 16) / (15 / 16)

    def pairs(self, wanted, crowded=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row pairs of regions with a sufficient estimate among those that wanted(a, b) admits, in bounded portions.

        crowded(start, end) gives the pairs to look at in a large region; without it all are looked at.
        """
        size = self.ends - self.starts
        small = size <= FEW
        region = np.repeat(np.arange(len(size)), size)
        last = self.ends[region] if len(region) else region
        for offset in range(1, int(size[small].max(initial=1))):
            a = np.flatnonzero((np.arange(len(region)) + offset < last) & small[region])
            b = a + offset
            fine = wanted(a, b)
            yield self._near(a[fine], b[fine])
        for s, e in zip(self.starts[~small].tolist(), self.ends[~small].tolist()):
            if crowded:
                for a, b in crowded(s, e):
                    yield self._near(a, b)
                continue
            for a in range(s, e - 1):
                b = np.arange(a + 1, e)
                b = b[wanted(np.full(len(b), a), b)]
                if len(b):
                    yield self._near(np.full(len(b), a), b)

    def _near(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fine = self.estimate(a, b) >= self.limits.estimate
        return a[fine], b[fine]

    def leaders(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows with a leader of their region: the least node, and in larger regions the one nearest to the most frequent values."""
        size = self.ends - self.starts
        region = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((self.node, region))
        yield np.arange(len(region)), order[self.starts][region]
        for s, e in zip(self.starts[size > 8].tolist(), self.ends[size > 8].tolist()):
            part = self.sketch[s:e]
            votes = np.stack([(part == v).sum(0) for v in range(16)])
            yield np.arange(s, e), np.full(e - s, s + int((part == votes.argmax(0)).sum(1).argmax()))


def _whole(batches, percent: int) -> Range | None:
    batches = [b for b in batches if b.num_rows]
    return Range(batches, percent) if batches else None


def first_partners(rows: DataFrame, percent: int) -> DataFrame:
    """For each node with a candidate: its best partner so far (or none) and whether it lies in a larger region."""

    def run(batches):
        r = _whole(batches, percent)
        if r is None:
            return
        crowd = np.repeat(r.ends - r.starts > FEW, r.ends - r.starts)
        known = np.zeros(len(r.node), bool)
        for a, b in r.pairs(lambda a, b: ~known[a] | ~known[b]):
            known[a] = known[b] = True
        near = np.arange(1, len(r.node))
        near = near[r.common[1:] >= r.limits.first]
        for kind, (a, b) in [(1, x) for x in r.leaders()] + [(0, (near, near - 1)), (0, (near - 1, near))]:
            fine = r.node[a] != r.node[b]
            a, b = a[fine], b[fine]
            value = r.estimate(a, b)
            fine = value >= r.limits.estimate
            a, b, value = a[fine], b[fine], value[fine]
            known[a] = known[b] = True
            leads = np.full(len(a), kind) * (value >= r.limits.similarity - 0.05)
            yield pa.RecordBatch.from_arrays(
                [pa.array(r.node[a]), pa.array(r.node[b]), pa.array(leads), pa.array(value), pa.array(crowd[a])], names=["node", "partner", "leads", "value", "crowd"]
            )
        at, zero = np.flatnonzero(known), np.zeros(int(known.sum()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(r.node[at]), pa.nulls(len(at), pa.int64()), pa.array(zero.astype(np.int64)), pa.array(zero), pa.array(crowd[at])], names=["node", "partner", "leads", "value", "crowd"]
        )

    found = rows.mapInArrow(run, "node long, partner long, leads long, value double, crowd boolean")
    # The text from which others derive leads in most orders and for most texts; a neighbour is the second choice.
    votes = found.groupBy("node", "partner").agg(F.sum("leads").alias("leads"), F.max("value").alias("value"), F.max("crowd").alias("crowd"))
    votes = saved(votes, "votes")
    led = saved(votes.filter("leads > 0").groupBy("partner").agg(F.count("*").alias("led")), "leaders")
    ranked = votes.join(led, "partner", "left").withColumn("led", F.when(F.col("leads") > 0, F.col("led")).otherwise(0))
    # A node's rows are a few for each order.
    best = ranked.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("led", "leads", "value", "partner")), asc=False).alias("best"), F.max("crowd").alias("crowd"))
    return best.select("node", F.transform(F.slice("best", 1, 2), lambda b: b["partner"]).alias("partners"), "crowd")


def further_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """All candidates (a, b) of different components.

    In a large region only pairs with a rare shingle in common are looked at: the others cannot be links. Where many texts
    derive from one, those too far from it have rare shingles of their own and hardly meet. The sets of texts in large
    regions travel with them, so that only pairs which are similar enough leave the task.
    """

    def run(batches):
        r = _whole(batches, percent)
        if r is None:
            return
        component, n = r.table.column("component").to_numpy(), r.table.column("n_shingles").to_numpy()
        rare, full = r.table.column("rare").to_pylist(), r.table.column("full").to_pylist()

        def may(a: int, b: int) -> bool:
            """Whether the sets, as far as they are known here, are similar enough: 32 bits of a hash can only add to what is common."""
            if full[a] is None or full[b] is None:
                return True
            both = np.concatenate([np.frombuffer(full[a], np.uint32), np.frombuffer(full[b], np.uint32)])
            both.sort()
            return (100 + percent) * int((both[1:] == both[:-1]).sum()) >= percent * int(n[a] + n[b])

        def crowded(s: int, e: int):
            # Texts whose rare shingles are not known (their region was cut elsewhere before) meet all others.
            for a in [a for a in range(s, e) if rare[a] is None]:
                b = np.arange(s, e)
                b = b[component[b] != component[a]]
                yield np.full(len(b), a), b
            known = np.array([a for a in range(s, e) if rare[a] is not None], np.int64)
            if not len(known):
                return
            keys = [np.frombuffer(rare[a], np.uint64) for a in known]
            padded = np.full((len(known), max(map(len, keys))), np.iinfo(np.uint64).max)
            for i, k in enumerate(keys):
                padded[i, : len(k)] = k
            least, sizes, own = int(n[known].min()), n[known], component[known]
            # Of partners with m shingles or more, this many of n must be common: percent * (n + m) / (100 + percent).
            m = np.maximum(least, -(-percent * sizes // 100))
            first = np.maximum(1, sizes - -(-percent * (sizes + m) // (100 + percent)) + 1)
            owner = np.concatenate([np.full(min(len(k), f), i) for i, (k, f) in enumerate(zip(keys, first.tolist()))])
            tokens = np.concatenate([k[:f] for k, f in zip(keys, first.tolist())])
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            counts = np.diff(np.append(starts, len(tokens)))
            c = own[owner]
            mixed = np.maximum.reduceat(c, starts) != np.minimum.reduceat(c, starts)
            for k, m in zip(starts[mixed].tolist(), counts[mixed].tolist()):
                who = np.unique(owner[k : k + m])
                names, size = np.unique(own[who], return_counts=True)
                few = who[own[who] != names[size.argmax()]]
                for row in np.array_split(few, -(-len(few) * len(who) // 1_000_000)):
                    a, b = np.repeat(row, len(who)), np.tile(who, len(row))
                    fine = own[a] != own[b]
                    a, b = a[fine], b[fine]
                    fine = may_link(padded, sizes, a, b, percent)
                    yield known[a[fine]], known[b[fine]]

        seen = np.zeros(0, np.int64)
        for a, b in r.pairs(lambda a, b: component[a] != component[b], crowded):
            code = np.minimum(a, b) * len(r.node) + np.maximum(a, b)
            code = np.setdiff1d(code, seen)
            if len(code):
                seen = np.union1d(seen, code) if len(seen) < 1_000_000 else code
                code = code[[may(i, j) for i, j in zip((code // len(r.node)).tolist(), (code % len(r.node)).tolist())]]
                x, y = r.node[code // len(r.node)], r.node[code % len(r.node)]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").filter("a < b").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough. Hot nodes are split by adaptive skew joins."""
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    def run(batches):
        for batch in batches:
            fine = []
            for x, y in zip(shingle_sets(batch.column(2), size), shingle_sets(batch.column(3), size)):
                if len(x) * percent > len(y) * 100 or len(y) * percent > len(x) * 100:
                    fine.append(False)
                    continue
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                fine.append(common > 0 and 100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(fine, pa.bool_()))

    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a long, b long")


def bucket_counts(texts: DataFrame, size: int) -> np.ndarray:
    """How many shingles of the texts fall into each of BUCKETS buckets; one row for each bucket a task has seen."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for s in shingle_sets(batch.column(0), size):
                np.add.at(total, (s % np.uint64(BUCKETS)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    sums = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int32)  # at most BUCKETS rows, for any corpus
    out[sums.column("bucket").to_numpy()] = np.minimum(sums.column("n").to_numpy(), np.iinfo(np.int32).max)
    return out


def rarest(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, rare, full): full has 32 bits of every shingle's hash, sorted; rare holds so many of each text's rarest shingles that any two linked texts have one of them in common.

    Keys are the count of a shingle's bucket, then 32 bits of its hash, and are sorted: one order for all texts. Of n
    shingles a partner must share percent in 100 at least, so among the n - that + 1 first ones there is a common one.
    Cutting hashes to 32 bits can only add candidates.
    """
    counts = texts.sparkSession.sparkContext.broadcast(bucket_counts(texts, size))  # of fixed size

    def run(batches):
        for batch in batches:
            out, full = [], []
            for s in shingle_sets(batch.column(1), size):
                full.append(np.sort((mix(s) >> np.uint64(32)).astype(np.uint32)).tobytes())
                keys = counts.value[(s % np.uint64(BUCKETS)).astype(np.int64)].astype(np.uint64) << np.uint64(32) | mix(s) >> np.uint64(32)
                keys.sort()
                out.append(keys[: len(s) - -(-percent * len(s) // 100) + 1].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(full, pa.binary())], names=["node", "rare", "full"])

    return texts.select("node", "text").mapInArrow(run, "node long, rare binary, full binary")


def may_link(rare: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets a and b can be similar enough, from their first keys (rows of rare, padded with the largest number).

    Up to the smaller of the two last keys, w, all of both sets is known. Beyond it, no more can be common than the smaller rest.
    """
    top = np.iinfo(np.uint64).max
    out = np.empty(len(a), bool)
    for k in range(0, len(a), 20_000):
        x, y, n, m = rare[a[k : k + 20_000]], rare[b[k : k + 20_000]], sizes[a[k : k + 20_000]], sizes[b[k : k + 20_000]]
        last = lambda r: np.where(r == top, np.uint64(0), r).max(1)
        w = np.minimum(last(x), last(y))[:, None]
        both = np.sort(np.concatenate([x, y], 1), 1)
        common = ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] <= w)).sum(1)
        rest = np.minimum(n - (x <= w).sum(1), m - (y <= w).sum(1))
        out[k : k + 20_000] = (100 + percent) * (common + rest) >= percent * (n + m)
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the least node that edges lead to. Labels spread along edges and jump to their labels' labels.

    Every step is written to the shared folder; the driver sees only whether a label changed.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("to")).union(edges.select(F.col(b), F.col(a)))
    both = saved(both.distinct(), "edges")
    labels = saved(both.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("component")), "labels")
    while True:
        told = both.join(labels, "node").select(F.col("to").alias("node"), "component").union(labels)
        spread = saved(told.groupBy("node").agg(F.min("component").alias("component")), "labels")
        above = spread.select(F.col("node").alias("component"), F.col("component").alias("above"))
        jumped = saved(spread.join(above, "component", "left").select("node", F.least("component", "above").alias("component")), "labels")
        old = labels.select("node", F.col("component").alias("old"))
        done = jumped.join(old, "node").filter("component <> old").isEmpty()
        release(spread, labels)
        if done:
            release(both)
            return jumped
        labels = jumped


def near_groups(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept (doc_id = component_id).

    Words are lower-cased (A-Z). Documents with equal shingle sets are one node. An LSH forest proposes pairs and full
    sets confirm them, in two rounds: first each node with the two best of its regions' leaders and prefix neighbours, which
    joins most groups without looking at their pairs; then all further candidates between different components.
    In larger regions only texts with a rare shingle in common become candidates, as links must have: this is exact,
    not a cap.

    Null and empty texts have no shingles and are linked with nothing. Rows of one doc_id are one document; a null
    doc_id is linked with nothing and has a null component_id. Empty tables give empty results; other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = saved(signed(docs, size), "signatures")
    nodes = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(
        F.min(F.struct("doc_id", "n_shingles", "signature")).alias("x")
    )
    nodes = saved(nodes.select("digest", F.col("x.doc_id").alias("node"), "x.n_shingles", "x.signature"), "nodes")
    partners = saved(first_partners(forest(nodes, []), percent), "partners")
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(partners.select("node"), "node", "left_semi")
    texts = saved(texts, "texts")
    pairs = partners.select("node", F.explode("partners").alias("partner")).filter("partner IS NOT NULL")
    pairs = pairs.select(F.least("node", "partner").alias("a"), F.greatest("node", "partner").alias("b"))
    links = saved(confirmed(saved(pairs.distinct(), "pairs"), texts, size, percent), "links")
    first = components(links)

    crowded = saved(texts.join(partners.filter("crowd").select("node"), "node", "left_semi"), "crowded")
    rare = saved(rarest(crowded, size, percent), "rare")
    open_nodes = (
        nodes.join(partners.select("node"), "node")
        .join(first, "node", "left")
        .join(rare, "node", "left")
        .select("node", "n_shingles", "signature", F.coalesce("component", "node").alias("component"), "rare", "full")
    )
    more = saved(further_pairs(forest(saved(open_nodes, "open"), ["n_shingles", "component", "rare", "full"]), percent), "pairs")
    links = links.union(confirmed(more, texts, size, percent))
    groups = components(saved(links, "links"))
    named = saved(nodes.select("digest", "node").join(groups, "node", "left").select("digest", F.coalesce("component", "node").alias("component")), "groups")
    out = rows.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    return out.select(
        "doc_id",
        "n_shingles",
        F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """docs without the rows whose component has a smaller doc_id; columns unchanged, whatever their names.

    Null and empty texts and null doc_ids are linked with nothing and stay; rows that share a doc_id stay if any of them does; an
    empty table stays empty.
    """
    (name,) = free(docs.columns, "kept_id")
    kept = near_groups(docs, size, percent).filter("kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(saved(kept, "kept"), F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir), size=3, percent=85)


OP2_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: hash(w[i], w[i + 1], w[i + 2])))
        WHEN len(w) > 0 THEN [hash(w)] ELSE [] END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n, list_sort(s) AS s FROM s),
f AS (SELECT min(doc_id) AS node, any_value(n) AS n, s FROM n WHERE n > 0 GROUP BY s),
e AS (SELECT node, n, unnest(s) AS x FROM f),
c AS (SELECT a.node AS a, b.node AS b, any_value(a.n) AS an, any_value(b.n) AS bn, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.node < b.node AND a.n * 100 >= 85 * b.n AND b.n * 100 >= 85 * a.n GROUP BY 1, 2),
l AS (SELECT a, b FROM c WHERE 100 * k >= 85 * (an + bn - k)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(node, root) AS (SELECT node, node FROM f UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node WHERE r.root < u.b),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node),
g AS (SELECT f.s, m.root FROM f JOIN m USING (node))
SELECT doc_id, n AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept
FROM n LEFT JOIN g ON n.s = g.s
"""
