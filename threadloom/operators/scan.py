"""Running values per key without a window over a whole key: rows are cut into ranges of (key, order), each range is scanned on its own,
and what a key brings along over a range's border comes from a table of one row a range."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.operators.stats import meet
from threadloom.sources.io import cut

# How a running value is taken in a frame, from a range as a whole, and put together from before the range and within it.
_IN_FRAME = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True), "first": lambda c: F.first(c, ignorenulls=True)}


def _of_range(kind: str, c: str, order: list[str]) -> Column:
    if kind in ("last", "first"):
        pick = F.max_by if kind == "last" else F.min_by
        return pick(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*order)))  # rows without an order are passed over
    return _IN_FRAME[kind](c)


def _joined(kind: str, before: Column, within: Column) -> Column:
    if kind == "sum":
        return F.when(before.isNull(), within).otherwise(before + F.coalesce(within, before - before))
    if kind in ("max", "min"):
        return (F.greatest if kind == "max" else F.least)(before, within)  # which pass over nulls
    return F.coalesce(within, before) if kind == "last" else F.coalesce(before, within)


def scan(rows: DataFrame, keys: list[str], order: list[str], measures: dict[str, tuple[str, Column]], inclusive: bool = True, whole: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """rows with running measures over the rows of a key in `order`, up to and with each row, or before it.

    measures: name to (kind, column), kind being sum, max, min, last or first; the last two pass over nulls, and a measure without any
    value so far is null. whole: likewise, over all rows of the key. Rows that tie in the whole order are taken in any sequence,
    each after another; only such ties are never split, so the order should end in something that tells rows apart.

    A key of any size is spread over ranges: rows are sorted into ranges once and stored; a range hands on one row for each of its keys,
    and at most one key of a range has earlier ranges, so that what is handed back has no more rows than there are ranges. Null keys
    are a key of their own; columns keep their names; an empty table gives an empty result.
    """
    whole = whole or {}
    both = {**measures, **whole}
    parts = cut(rows.withColumns({f"__in_{k}": c for k, (_, c) in both.items()}).repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()))
    ends = parts.groupBy(*keys, "__range").agg(*[_of_range(kind, f"__in_{k}", order).alias(f"__end_{k}") for k, (kind, _) in both.items()])
    by = W.partitionBy(*keys).orderBy("__range")  # a row for each range of a key
    earlier, all_of_it = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    handed = ends.select(
        *keys, "__range", F.count(F.lit(1)).over(all_of_it).alias("__ranges"),
        *[_IN_FRAME[kind](f"__end_{k}").over(earlier).alias(f"__before_{k}") for k, (kind, _) in measures.items()],
        *[_IN_FRAME[kind](f"__end_{k}").over(all_of_it).alias(f"__all_{k}") for k, (kind, _) in whole.items()],
    ).filter("__ranges > 1").drop("__ranges")
    met = meet(parts, F.broadcast(handed), [*keys, "__range"], "left")  # two rows a range at most: a key that comes in, one that goes on
    inside = W.partitionBy(*keys, "__range")
    frame = inside.orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    out = {k: _joined(kind, F.col(f"__before_{k}"), _IN_FRAME[kind](f"__in_{k}").over(frame)) for k, (kind, _) in measures.items()}
    for k, (kind, _) in whole.items():
        own = F.max_by if kind == "last" else F.min_by
        within = own(F.col(f"__in_{k}"), F.when(F.col(f"__in_{k}").isNotNull(), F.struct(*order))).over(inside) if kind in ("last", "first") else _IN_FRAME[kind](f"__in_{k}").over(inside)
        out[k] = F.coalesce(F.col(f"__all_{k}"), within)
    return met.select(*[c for c in rows.columns if c not in out], *[c.alias(k) for k, c in out.items()])


def totals_before(events: DataFrame, probes: DataFrame, keys: list[str], time: str, sums: list[str]) -> DataFrame:
    """probes (keys, time and other columns) with the totals of the events' columns `sums` at times strictly before each; 0 without any.

    Both are scanned as one sequence in which a probe stands before the events of its time. Ties are spread by a hash of the row.
    """
    rest = [c for c in probes.columns if c not in (*keys, time)]
    tie = lambda columns: F.xxhash64(*columns) if columns else F.lit(0).cast("long")
    left = probes.select(*keys, time, F.lit(0).alias("__side"), tie(rest).alias("__tie"), F.struct(F.lit(True).alias("__probe"), *rest).alias("__row"), *[F.lit(0).cast(events.schema[c].dataType).alias(c) for c in sums if c not in rest])
    right = events.select(*keys, time, F.lit(1).alias("__side"), tie(sums).alias("__tie"), F.lit(None).cast(left.schema["__row"].dataType).alias("__row"), *[F.coalesce(F.col(c), F.lit(0)).cast(events.schema[c].dataType).alias(c) for c in sums])
    out = scan(left.unionByName(right), keys, [time, "__side", "__tie"], {c: ("sum", F.col(c)) for c in sums}).filter("__side = 0")
    return out.select(*keys, time, *[F.col(f"__row.{c}").alias(c) for c in rest], *sums)


def next_time(rows: DataFrame, keys: list[str], time: str, tie: str, out: str) -> DataFrame:
    """rows with the time of the next row of the same keys; null for the last one. tie tells rows of one time apart."""
    back = rows.withColumns({"__back": -F.col(time), "__tie": -F.xxhash64(tie)})
    return scan(back, keys, ["__back", "__tie"], {out: ("last", F.col(time))}, inclusive=False).drop("__back", "__tie")


def window_measures(
    questions: DataFrame, events: DataFrame, key: str, at: str, time: str, windows: dict[str, tuple[int, int]],
    sums: dict[str, Column], distinct: dict[str, Column] | None = None,
) -> DataFrame:
    """For each question (key, at) and window [at + a, at + b) the sums and numbers of distinct values of its key's events, as name_window.

    sums: columns over the events, nulls count as 0. distinct: columns over the events, nulls are left out. Sums are differences of two
    running totals. A value counts in a window of width w from an event until the value's next event, w at most: a step up
    and a step down, which the running total at the window's end adds up. Work grows with events and questions times
    windows, never with pairs of them. Questions that repeat a (key, at) count once; floating sums are differences of totals, so
    give decimals where that matters. Questions without events have zeros; an empty table gives an empty result.
    """
    distinct = distinct or {}
    widths = sorted({b - a for a, b in windows.values()})
    offsets = sorted({x for w in windows.values() for x in w})
    base = events.filter(F.col(key).isNotNull()).select(F.col(key).alias("__k"), F.col(time).alias("__t"), *[F.coalesce(c, F.lit(0)).alias(f"__s_{k}") for k, c in sums.items()])
    columns = [f"__s_{k}" for k in sums]
    steps = []
    for name, value in distinct.items():
        seen = events.select(F.col(key).alias("__k"), F.col(time).alias("__t"), value.alias("__v"), F.monotonically_increasing_id().alias("__id")).filter("__k IS NOT NULL AND __v IS NOT NULL")
        seen = next_time(seen, ["__k", "__v"], "__t", "__id", "__next")
        down = {w: F.least(F.col("__next"), F.col("__t") + w) for w in widths}
        marks = [F.struct(F.col("__t").alias("__t"), *[F.lit(1).cast("long").alias(f"__d_{name}_{w}") for w in widths])]
        marks += [F.struct(down[w].alias("__t"), *[F.lit(-1 if v == w else 0).cast("long").alias(f"__d_{name}_{v}") for v in widths]) for w in widths]
        own = [f"__d_{name}_{w}" for w in widths]
        at_once = seen.select("__k", F.explode(F.array(*marks)).alias("__m")).select("__k", "__m.*").groupBy("__k", "__t").agg(*[F.sum(c).alias(c) for c in own])
        # Where a value comes again inside of a window its step down meets the next step up, and nothing is left to count.
        steps.append(at_once.filter(" OR ".join(f"{c} <> 0" for c in own)))
        columns += own
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [base, *steps])
    rows = rows.select("__k", "__t", *[F.coalesce(F.col(c), F.lit(0)).cast(rows.schema[c].dataType).alias(c) for c in columns])
    asked = questions.select(F.col(key).alias("__k"), F.col(at).alias("__q")).distinct()
    probes = asked.withColumn("__o", F.explode(F.array(*[F.lit(o).cast("long") for o in offsets]))).withColumn("__t", F.col("__q") + F.col("__o"))
    totals = totals_before(rows, probes, ["__k"], "__t", columns)
    value = lambda c, o: F.sum(F.when(F.col("__o") == o, F.col(c)))  # noqa: E731  one row each
    out = {f"{k}_{w}": value(f"__s_{k}", b) - value(f"__s_{k}", a) for w, (a, b) in windows.items() for k in sums}
    out |= {f"{k}_{w}": value(f"__d_{k}_{b - a}", b) for w, (a, b) in windows.items() for k in distinct}
    return totals.groupBy(F.col("__k").alias(key), F.col("__q").alias(at)).agg(*[c.alias(k) for k, c in out.items()])
