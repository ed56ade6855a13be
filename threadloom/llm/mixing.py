"""Mixing sources: shares are raised to a temperature's exponent, and weights become budgeted permutations of blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.llm.common import WORD_GAP, documents, free, quoted, saved, text_or_empty

#: No document is used more often than this by the registered query.
MAX_REPEATS = 2.0
SEED = 7
#: A source's documents fall into BLOCKS blocks of as many parts each; budgets are met to a part.
BLOCKS = 1024
#: Plans of up to so many sources are broadcast.
BROADCAST_SOURCES = 100_000


def exponent_for_repeats(least: float, largest: float, limit: float) -> float:
    """The least exponent in [0, 1] by which no source is repeated more than limit times while the largest is used once.

    With shares q and weights proportional to q ** t, source s is used (largest / q) ** (1 - t) times.
    """
    low, high = 0.0, 1.0
    used = lambda t: (largest / least) ** (1 - t)
    if used(low) <= limit:
        return low
    while high - low > 1e-15 and low < (middle := (low + high) / 2) < high:
        low, high = (low, middle) if used(middle) <= limit else (middle, high)
    return high


def exponent_for_entropy(shares: DataFrame, target: float, steps: int = 32) -> float:
    """The exponent in [0, 1] whose weights have the entropy (in nats) nearest to target.

    shares has a column q. Entropy falls as the exponent grows; each pass over the sources evaluates steps exponents
    at once, which is worth five bisections, and returns a row for each of them only.
    """
    low, high = 0.0, 1.0
    while high - low > 1e-9:
        grid = [low + (high - low) * k / steps for k in range(1, steps)]
        sums = shares.agg(*[F.sum(F.pow("q", F.lit(t))).alias(f"z{k}") for k, t in enumerate(grid)], *[F.sum(F.pow("q", F.lit(t)) * F.log("q")).alias(f"d{k}") for k, t in enumerate(grid)]).first()
        entropy = [math.log(sums[f"z{k}"]) - t * sums[f"d{k}"] / sums[f"z{k}"] for k, t in enumerate(grid)]
        above = sum(h > target for h in entropy)
        low, high = ([low, *grid][above], [*grid, high][above])
    return (low + high) / 2


def word_count(column: str = "text") -> Column:
    trimmed = F.btrim(text_or_empty(column), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, WORD_GAP))).cast("long")


def place(id_column: str, number: Column, seed: int) -> Column:
    """A document's place in a pass, of BLOCKS ** 2 places: 20 bits of an md5 of its id, the pass and the seed."""
    text = F.concat_ws(":", F.coalesce(F.col(id_column).cast("string"), F.lit("")), number.cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 5), 16, 10).cast("long")


def _cut(sums: DataFrame, keys: list[str], unit: str) -> DataFrame:
    """The first unit at which the sums, added up in order, pass the budget, and what is left of the budget there."""
    w = W.partitionBy(*keys).orderBy(unit)  # BLOCKS rows at most
    over = sums.withColumn("sum", F.sum("tokens").over(w)).filter(F.col("sum") > F.col("left"))
    return over.groupBy(*keys).agg(F.min_by(F.struct(unit, (F.col("left") - F.col("sum") + F.col("tokens")).alias("left")), unit).alias("x")).select(*keys, "x.*")


def source_plan(sizes: DataFrame, exponent: float | None = None, max_repeats: float = MAX_REPEATS, target_entropy: float | None = None, budget: float | None = None, seed: int = SEED) -> DataFrame:
    """One row per source: tokens, weight, uses (budget over tokens), passes (whole ones), cut (places of the last pass in use).

    sizes: (doc_id, source, tokens). Without a budget, it is the least by which every source is used once at least.
    """
    totals = saved(sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents")), "sources")
    whole = totals.agg(F.sum("tokens").alias("t"), F.min(F.when(F.col("tokens") > 0, F.col("tokens"))).alias("least"), F.max("tokens").alias("largest")).first()
    total = float(whole.t or 0)
    if not total:
        return totals.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(1.0).alias("uses"), F.lit(1).cast("long").alias("passes"), F.lit(0).cast("long").alias("cut"))
    shares = totals.filter("tokens > 0").select((F.col("tokens") / total).alias("q"))
    if exponent is None:
        exponent = exponent_for_repeats(whole.least / total, whole.largest / total, max_repeats) if target_entropy is None else exponent_for_entropy(shares, target_entropy)
    z = shares.agg(F.sum(F.pow("q", F.lit(exponent)))).first()[0]
    if budget is None:
        budget = total * z * (whole.largest / total) ** (1 - exponent)
    q = F.col("tokens") / total
    plan = totals.withColumn("weight", F.when(F.col("tokens") > 0, F.pow(q, F.lit(exponent)) / z).otherwise(0.0))
    uses = F.when(F.col("tokens") > 0, budget * F.col("weight") / F.col("tokens")).otherwise(1.0)
    plan = plan.withColumn("uses", F.round(uses, 9)).withColumn("passes", F.floor("uses").cast("long"))
    plan = saved(plan.withColumn("left", (F.col("uses") - F.col("passes")) * F.col("tokens")), "plan")

    def planned(rows: DataFrame) -> DataFrame:
        return small(rows, plan.select("source", "passes", "left"))

    places = planned(sizes).filter("left > 0").select("source", "tokens", "left", place("doc_id", F.col("passes") + 1, seed).alias("place"))
    places = places.withColumn("block", F.floor(F.col("place") / BLOCKS))
    blocks = places.groupBy("source", "block").agg(F.sum("tokens").alias("tokens"), F.first("left").alias("left"))
    edge = saved(_cut(blocks, ["source"], "block"), "edges")
    inside = small(places.drop("left").withColumnRenamed("block", "b"), edge).filter("b = block")
    parts = inside.groupBy("source", "block", (F.col("place") % BLOCKS).alias("part")).agg(F.sum("tokens").alias("tokens"), F.first("left").alias("left"))
    cut = _cut(parts, ["source", "block"], "part").select("source", (F.col("block") * BLOCKS + F.col("part")).cast("long").alias("cut"))
    # A source with a rest whose parts never pass it has all of them in use.
    rest = F.when(F.col("left") > 0, F.lit(BLOCKS * BLOCKS)).otherwise(0).cast("long")
    out = plan.join(saved(cut, "cuts"), "source", "left")
    return saved(out.select("source", "tokens", "weight", "uses", "passes", F.coalesce("cut", rest).alias("cut")), "plan")


def small(rows: DataFrame, side: DataFrame) -> DataFrame:
    """rows joined to a table of sources: broadcast while there are few, else by a join that splits hot sources."""
    return rows.join(F.broadcast(side) if side.count() <= BROADCAST_SOURCES else side, "source")


def mix_sources(docs: DataFrame, seed: int = SEED, tokens: Column | None = None, **plan) -> DataFrame:
    """The rows of docs as often as their source's budget asks for, with pass (from 1), block (its number in that pass's order).

    Every pass is a permutation of its own: documents fall into blocks by a hash of id, pass and seed, and training takes
    the blocks of a pass in order. Whole passes use every document; the last one takes blocks, and parts of the block at
    the edge, while the budget lasts. plan: arguments of source_plan(). tokens: a column, else the number of words.

    Null sources form one source; null texts have no tokens and are used once in each whole pass, once at least if their
    source has no tokens at all. Repeated rows are each used; other columns are kept, but for pass and block, which are
    replaced. Empty tables give empty results.
    """
    docs = docs.drop("pass", "block")
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    sizes = saved(docs.select("doc_id", key.alias("source"), (word_count() if tokens is None else tokens).alias("tokens")), "sizes")
    source, passes, cut = own = free(docs.columns, "plan_source", "plan_passes", "plan_cut")
    of_source = source_plan(sizes, seed=seed, **plan).select(*[F.col(c).alias(n) for c, n in zip(("source", "passes", "cut"), own)])
    rows = docs.withColumn(source, key)
    rows = rows.join(F.broadcast(of_source) if of_source.count() <= BROADCAST_SOURCES else of_source, source)
    last = (place("doc_id", F.col(passes) + 1, seed) < F.col(cut)).cast("long")
    rows = rows.withColumn("pass", F.explode(_passes(F.col(passes) + last)))
    return rows.withColumn("block", F.floor(place("doc_id", F.col("pass"), seed) / BLOCKS)).select(*map(quoted, docs.columns), "pass", "block")


def _passes(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(1).cast("long"), n))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("n_tokens", word_count())
    return mix_sources(docs.select("doc_id", "source", "text", "n_tokens"), max_repeats=MAX_REPEATS).select("doc_id", "source", "n_tokens", "pass", "block")


OP8_SQL = f"""
WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS n FROM documents),
s AS (SELECT source, sum(n)::DOUBLE AS t FROM d GROUP BY source),
x AS (SELECT min(t) AS lo, max(t) AS hi FROM s),
e AS (SELECT CASE WHEN hi / lo <= {MAX_REPEATS} THEN 0 ELSE 1 - ln({MAX_REPEATS}) / ln(hi / lo) END AS e, hi FROM x),
u AS (SELECT source, t, round(pow(hi / t, 1 - e), 9) AS uses FROM s, e),
p AS (SELECT source, t, floor(uses)::BIGINT AS passes, (uses - floor(uses)) * t AS rest FROM u),
c AS (SELECT d.*, passes, rest, ('0x' || substr(md5(doc_id || ':' || (passes + 1) || ':{SEED}'), 1, 5))::BIGINT AS place FROM d JOIN p USING (source)),
r AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY place RANGE UNBOUNDED PRECEDING) AS total FROM c),
k AS (SELECT source, min(place) FILTER (total > rest) AS cut FROM r GROUP BY source),
f AS (SELECT c.*, unnest(range(1, passes + CASE WHEN rest > 0 AND (cut IS NULL OR place < cut) THEN 2 ELSE 1 END)) AS pass FROM c JOIN k USING (source))
SELECT doc_id, source, n AS n_tokens, pass, ('0x' || substr(md5(doc_id || ':' || pass || ':{SEED}'), 1, 5))::BIGINT // {BLOCKS} AS block FROM f
"""
