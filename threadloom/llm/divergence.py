"""Which sources of a language differ, and by which terms: exact divergences of smoothed term shares for all pairs of sources.

Counts are packed into vectors over chunks of the vocabulary; vectors are replicated to tasks that each take one block of
groups against another, chunk after chunk, and add up their part of the matrix of pairs.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.llm.common import documents, saved, ship

#: Shares are whole numbers of this part.
SCALE = 1_000_000_000
#: A term is kept if so many documents of its language have it.
LEAST_DOCUMENTS = 3
#: A task sends on what it has counted once it holds so many terms.
HELD_TERMS = 400_000
#: Terms in a chunk of the vocabulary, chunks that a task takes one after another, groups in a block.
CHUNK, SPAN, BLOCK = 16_384, 8, 32
#: Ranks of the part `term`.
TERM_RANKS = 200
#: Texts are searched in slices of about so many bytes.
SLICE_BYTES = 1 << 22

# Terms over bytes: letters and all bytes of characters beyond ASCII; A-Z are lower-cased before.
_TERM, _GAP = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in lists, one for each slice; slices end where no term does."""
    text, a = text.lower(), 0  # of bytes: A-Z alone
    while a < len(text):
        b = len(text)
        if b - a > SLICE_BYTES and (gap := _GAP.search(text, a + SLICE_BYTES)):
            b = gap.start()
        yield _TERM.findall(text, a, b)
        a = b


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """Rows (lang, source, term, docs, n): in how many documents and how often, added up over what one task has seen.

    A combination comes once for each task that has met it, or more often where a task has sent on its counts in between.
    Nulls count as empty strings; texts without terms give no row.
    """
    ship(docs.sparkSession)
    schema = "lang string, source string, term string, docs long, n long"

    def run(batches):
        counts: dict = defaultdict(lambda: (Counter(), Counter()))

        def out():
            for (lang, source), (n, seen) in counts.items():
                terms = list(n)
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()),
                    pa.array([seen[t] for t in terms], pa.int64()), pa.array(list(n.values()), pa.int64()),
                ], names=["lang", "source", "term", "docs", "n"])
            counts.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                n, seen = counts[lang, source]
                found: set = set()
                for terms in terms_of(text):
                    n.update(terms)
                    found.update(terms)
                seen.update(found)
                if len(n) > HELD_TERMS or sum(len(x) for x, _ in counts.values()) > HELD_TERMS:
                    yield from out()
        yield from out()

    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((lang, "lang"), (source, "source"), (text, "text"))]).mapInArrow(run, schema)


def kept_terms(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST_DOCUMENTS) -> DataFrame:
    """Rows (lang, term, total, entries): terms in at least `least` documents of their language, entries (source, n) of those that have it.

    The counts of tasks are dealt by language and term once; both sums are made there.
    """
    counted = term_counts(docs, lang, source, text).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("entries"))
    return kept.where(F.col("docs") >= least).drop("docs")


def share(count: Column, whole: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / whole), by long division in thousands: exact for wholes below 9e15."""
    out, rest = F.lit(0).cast("long"), count + 1
    for _ in range(3):
        out, rest = out * 1000 + F.call_function("div", rest * 1000, whole), (rest * 1000) % whole
    # a share of 1 has a quotient of 1000 in the first step, which the same sum carries
    return out + 1


def shares(counts: np.ndarray, whole: int) -> np.ndarray:
    """As share(), over an array."""
    rest = counts.astype(np.int64) + 1
    out = np.zeros(len(rest), np.int64)
    for _ in range(3):
        rest *= 1000
        step, rest = np.divmod(rest, whole)
        out = out * 1000 + step
    return out + 1


def group_table(docs: DataFrame, kept: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """A row for each (lang, source): n and v (occurrences of kept terms, kept terms of the language), lang_n, its place and the blocks.

    Groups are numbered within a language; the pairs of its groups are a result's rows, so one task takes their names.
    """
    groups = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).distinct()
    per_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    per_group = kept.select("lang", F.explode("entries").alias("e")).groupBy("lang", F.col("e.source").alias("source")).agg(F.sum("e.n").alias("n"))
    out = groups.join(per_group, ["lang", "source"], "left").join(per_lang, "lang", "left").fillna(0, ["n", "v", "lang_n"])
    out = out.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1)
    size = F.count(F.lit(1)).over(W.partitionBy("lang"))
    return out.withColumn("blocks", F.ceil(size / BLOCK).cast("int")).withColumn("block", F.floor(F.col("place") / BLOCK).cast("int"))


def packed_vectors(kept: DataFrame) -> DataFrame:
    """Rows (lang, span, chunk, width, source, at, counts): a source's counts over the terms of a chunk that it has.

    A chunk is CHUNK terms of a language as a task reads them from the table of kept terms, so no shuffle numbers them; a span
    is SPAN chunks of one task. at and counts are packed 4-byte places and 8-byte numbers.
    """
    schema = "lang string, span long, chunk long, width int, source string, at binary, counts binary"

    def run(batches):
        first = TaskContext.get().partitionId() << 33
        held: dict = {}  # by language: terms so far, and pieces (places, sources, counts)
        made: Counter = Counter()

        def out(lang):
            width, parts = held.pop(lang)
            places, names, counts = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(names, kind="stable")
            edges = np.flatnonzero(names[order][1:] != names[order][:-1]) + 1
            rows = [(names[x[0]], places[x].astype("<u4").tobytes(), counts[x].astype("<i8").tobytes()) for x in np.split(order, edges)]
            k = made[lang]
            made[lang] += 1
            n = len(rows)
            return pa.RecordBatch.from_arrays([
                pa.array([lang] * n, pa.string()), pa.array([first + k // SPAN] * n, pa.int64()), pa.array([first + k] * n, pa.int64()), pa.array([width] * n, pa.int32()),
                pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary()),
            ], names=["lang", "span", "chunk", "width", "source", "at", "counts"])

        for batch in batches:
            langs, lists = np.array(batch.column(0).to_pylist(), dtype=object), batch.column(1)
            row = np.repeat(np.arange(len(langs)), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            names, counts = np.array(flat.field(0).to_pylist(), dtype=object), flat.field(1).to_numpy()
            for lang in dict.fromkeys(langs.tolist()):
                mine = np.flatnonzero(langs == lang)
                for a in range(0, len(mine), CHUNK):
                    some = mine[a : a + CHUNK]
                    width, parts = held.get(lang, (0, []))
                    if width and width + len(some) > CHUNK:
                        yield out(lang)
                        width, parts = 0, []
                    place = np.full(len(langs), -1)
                    place[some] = np.arange(width, width + len(some))
                    use = np.flatnonzero(place[row] >= 0)
                    parts.append((place[row[use]], names[use], counts[use]))
                    held[lang] = (width + len(some), parts)
        for lang in list(held):
            yield out(lang)

    return kept.select("lang", "entries").mapInArrow(run, schema)


def _tile(table: pa.Table) -> pa.Table:
    """The pairs of one block of groups with another, over the chunks of one span."""
    x = {c: table.column(c).to_pylist() for c in ("lang", "left", "right", "block", "place", "whole", "chunk", "width", "at", "counts")}
    left, right = x["left"][0], x["right"][0]
    heads = {}
    for block, place, whole in zip(x["block"], x["place"], x["whole"]):
        heads[place] = (block, whole)
    rows = sorted(p for p, (b, _) in heads.items() if b == left)
    columns = sorted(p for p, (b, _) in heads.items() if b == right)
    there, back = np.zeros((2, len(rows), len(columns)), np.uint64)
    chunks = defaultdict(dict)
    for place, chunk, width, at, counts in zip(x["place"], x["chunk"], x["width"], x["at"], x["counts"]):
        if chunk is not None:
            chunks[chunk, width][place] = (at, counts)
    for (_, width), vectors in chunks.items():

        def matrix(places, width=width, vectors=vectors):
            out = np.empty((len(places), width), np.int64)
            for k, p in enumerate(places):
                whole = heads[p][1]
                out[k] = shares(np.zeros(1, np.int64), whole)
                if p in vectors:
                    at, counts = vectors[p]
                    out[k, np.frombuffer(at, "<u4")] = shares(np.frombuffer(counts, "<i8"), whole)
            return out

        p = matrix(rows)
        q = p if left == right else matrix(columns)
        q_unsigned = q.view(np.uint64)
        for k in range(len(rows)):
            squares = p[k] - q
            squares *= squares  # below 2^60, as shares are at most SCALE + 1
            squares = squares.view(np.uint64)
            there[k] += (squares // q_unsigned).sum(axis=1)
            if left != right:
                back[k] += (squares // p[k].view(np.uint64)).sum(axis=1)
    a, b = np.repeat(rows, len(columns)), np.tile(columns, len(rows))
    pairs = [(a, b, there.ravel())] + ([(b, a, back.ravel())] if left != right else [])
    a, b, value = (np.concatenate(z) for z in zip(*pairs))
    use = a != b
    return pa.table({"lang": pa.array([x["lang"][0]] * int(use.sum()), pa.string()), "place": a[use].astype(np.int32), "other": b[use].astype(np.int32), "value": value[use].astype(np.int64)})


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (lang, place, other, value) for each ordered pair of groups of a language, by tiles of blocks.

    Every vector goes to as many tasks as its language has blocks. Groups without a vector in a chunk, and languages without
    kept terms, take part by rows that carry only the group.
    """
    vectors = packed_vectors(kept)
    vectors = saved(vectors, "op11-vectors")
    head = groups.select("lang", "source", "place", "block", "blocks", (F.col("n") + F.col("v")).alias("whole"))
    spans = vectors.select("lang", "span").distinct()
    # one span without chunks, numbered -1, makes a tile of zeros for every pair of blocks
    heads = head.select("*", F.lit(-1).cast("long").alias("span")).unionByName(head.join(spans, "lang"))
    heads = heads.withColumns({"chunk": F.lit(None).cast("long"), "width": F.lit(None).cast("int"), "at": F.lit(None).cast("binary"), "counts": F.lit(None).cast("binary")})
    rows = heads.unionByName(vectors.join(head, ["lang", "source"])).drop("source")
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"left": F.least("block", "with"), "right": F.greatest("block", "with")}).drop("with", "blocks")
    tiles = rows.groupBy("lang", "left", "right", "span").applyInArrow(_tile, "lang string, place int, other int, value long")
    return tiles.groupBy("lang", "place", "other").agg(F.sum("value").alias("value"))


def divergences(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST_DOCUMENTS, term_ranks: int = TERM_RANKS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): how far each source is from the others of its language, and its marking terms.

    Part `pair` has each other source of the language and the divergence from it, summed over all kept terms; part `term`
    the terms that the source uses more than its language does, the first term_ranks of them. Shares are whole numbers, add
    one occurrence to each kept term, and all arithmetic is exact for groups of less than 9e15 occurrences.

    Nulls count as empty strings; a group without texts or terms takes part with the share that no occurrences give; a
    language without kept terms has pairs of value 0 and no terms; the only source of a language has no pairs. Repeated rows
    are documents of their own. Ties of value are ordered by the item's UTF-8. Other columns are ignored; an empty table gives
    an empty result. A task holds the terms it has counted (HELD_TERMS) and one text.
    """
    kept = saved(kept_terms(docs, lang, source, text, least), "op11-terms")
    groups = saved(group_table(docs, kept, lang, source), "op11-groups")
    names = groups.select("lang", F.col("place").alias("other"), F.col("source").alias("item"))
    pairs = pair_values(kept, groups).join(groups.select("lang", "place", "source"), ["lang", "place"]).join(names, ["lang", "other"])
    order = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms = kept.select("lang", F.col("term").alias("item"), "total", F.explode("entries").alias("e")).select("lang", "item", "total", F.col("e.source").alias("source"), F.col("e.n").alias("count"))
    terms = terms.join(groups.select("lang", "source", "n", "v", "lang_n"), ["lang", "source"])
    terms = terms.select("lang", "source", "item", share(F.col("count"), F.col("n") + F.col("v")).alias("p"), share(F.col("total"), F.col("lang_n") + F.col("v")).alias("q")).where("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", F.expr("(p - q) * (p - q) div q").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= term_ranks)
    return pairs.unionByName(terms)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(documents(spark, sf_dir))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (gn.n + v.v)::HUGEINT AS p FROM gn JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
q AS (SELECT k.lang, k.term, 1 + (1000000000::HUGEINT * (k.n + 1)) // (v.n + v.v)::HUGEINT AS q FROM k JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
