"""Ordered and set operators: snapshot differences, carried values, first and last wins, top-k, resumed scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.operators.scan import scan


def first_per_key(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in a total order; null sorts last if the order says so."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def first_wins(sources: list[DataFrame], keys: list[str], position: str) -> DataFrame:
    """Union of sources where a key keeps its row of the earliest source, then of the least position."""
    ranked = [s.withColumn("__source", F.lit(k)) for k, s in enumerate(sources)]
    out = ranked[0]
    for s in ranked[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return first_per_key(out, keys, F.col("__source"), F.col(position)).drop("__source")


def last_valid(rows: DataFrame, key: str, position: str, valid: Column) -> DataFrame:
    """Per key the valid row of the greatest position; keys without a valid row are left out."""
    return first_per_key(rows.filter(valid), [key], F.col(position).desc())


def override(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Full outer merge by key in which the new row takes the place of the old one as a whole."""
    columns = [c for c in old.columns if c != key]
    a = old.select(key, F.struct(*columns).alias("__old"))
    b = new.select(key, F.struct(*columns).alias("__new"))
    return a.join(b, key, "full").select(key, F.coalesce("__new", "__old").alias("__row")).select(key, *[F.col(f"__row.{c}").alias(c) for c in columns])


def resumed_scan(seen: DataFrame, fetched: DataFrame, key: str, time: str) -> DataFrame:
    """What was seen, with the fetched rows from the high-water mark on that were not seen, once each."""
    mark = seen.agg(F.max(time).alias("__mark"))
    fresh = fetched.join(F.broadcast(mark), F.col("__mark").isNull() | (F.col(time) >= F.col("__mark"))).drop("__mark")  # one row
    return seen.unionByName(fresh.join(seen.select(key), key, "left_anti").dropDuplicates([key]))


def todo(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return wanted.join(done.select(key), key, "left_anti")


def snapshot_events(members: DataFrame, snapshots: DataFrame) -> DataFrame:
    """joined and left events between consecutive snapshots of sets.

    members: (seq, member), seq numbering the snapshots without gaps; snapshots: (seq, us), all of them, empty ones included.
    A member of snapshot n that n - 1 lacks joined at n; a member of n that n + 1 lacks left at n + 1.
    """
    m = members.select("seq", "member").distinct()
    before = m.select((F.col("seq") + 1).alias("seq"), "member")
    joined = m.join(before, ["seq", "member"], "left_anti").withColumn("event", F.lit("joined"))
    left = before.join(m, ["seq", "member"], "left_anti").withColumn("event", F.lit("left"))
    return joined.union(left).join(snapshots, "seq").select("us", "seq", "member", "event")


def map_snapshot_events(entries: DataFrame, snapshots: DataFrame) -> DataFrame:
    """joined, left, weight_change and auto_assigned_change between consecutive snapshots of maps.

    entries: (seq, uid, weight, auto). A null and a value differ. Events of one entry and snapshot are separate rows.
    """
    new = entries.select("seq", "uid", F.col("weight").alias("weight_to"), F.col("auto").alias("auto_to"), F.lit(True).alias("__now"))
    old = entries.select((F.col("seq") + 1).alias("seq"), "uid", F.col("weight").alias("weight_from"), F.col("auto").alias("auto_from"), F.lit(True).alias("__was"))
    both = new.join(old, ["seq", "uid"], "full").join(snapshots, "seq")
    now, was = F.col("__now").isNotNull(), F.col("__was").isNotNull()
    kinds = F.array_compact(
        F.array(
            F.when(now & ~was, "joined"),
            F.when(was & ~now, "left"),
            F.when(now & was & ~F.col("weight_to").eqNullSafe(F.col("weight_from")), "weight_change"),
            F.when(now & was & ~F.col("auto_to").eqNullSafe(F.col("auto_from")), "auto_assigned_change"),
        )
    )
    return both.select("us", "seq", "uid", F.explode(kinds).alias("event"), "weight_from", "weight_to", "auto_from", "auto_to")


def carry_forward(rows: DataFrame, key: str, order: list[str], value: str, default: Column) -> DataFrame:
    """The last known value up to each row, else a default; a key of any size is spread over ranges of the order."""
    out = scan(rows.withColumn("__default", default), [key], order, {value: ("last", F.col(value))})
    return out.withColumn(value, F.coalesce(value, "__default")).select(*rows.columns)


def mark_exits(events: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """exited on leave events of keys that are not listed now."""
    listed = current.select(key).distinct().withColumn("__listed", F.lit(True))
    return events.join(listed, key, "left").withColumn("exited", (F.col("event") == "left") & F.col("__listed").isNull()).drop("__listed")


def roster(events: DataFrame, current: DataFrame) -> DataFrame:
    """Per member: first join, last leave, counts, pools ever seen, sources, history of weights, exited.

    events: (uid, us, event, weight, source). One member's events are its own history and bounded by it.
    """
    at = lambda e: F.when(F.col("event") == e, F.col("us"))
    weighed = F.when(F.col("event") != "left", F.struct("us", "weight"))
    out = events.groupBy("uid").agg(
        F.min(at("joined")).alias("first_joined"),
        F.max(at("left")).alias("last_left"),
        F.count(at("joined")).alias("join_count"),
        F.count(at("left")).alias("leave_count"),
        F.coalesce(F.bool_or(F.col("weight") >= 1), F.lit(False)).alias("ever_auto"),
        F.coalesce(F.bool_or(F.col("weight") < 1), F.lit(False)).alias("ever_manual"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.array_sort(F.collect_list(weighed)).alias("weight_history"),
        F.count("*").alias("total_events"),
    )
    listed = current.select("uid").distinct().withColumn("__listed", F.lit(True))
    out = out.join(listed, "uid", "left").withColumn("is_current", F.col("__listed").isNotNull()).drop("__listed")
    return out.withColumn("exited", ~F.col("is_current") & (F.col("leave_count") > 0))


def next_by(rows: DataFrame, keys: list[str], order: str, who: Column, value: str, n: int = 20) -> DataFrame:
    """The value of the first of the next n rows for which who holds."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(1, n)
    return rows.withColumn("found", F.first(F.when(who, F.col(value)), ignorenulls=True).over(w))


def nth_event(rows: DataFrame, keys: list[str], order: Column, n: int) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") == n).drop("__n")


def top_per_group(rows: DataFrame, group: list[str], n: int, *order: Column) -> DataFrame:
    w = W.partitionBy(*group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def both_tails(rows: DataFrame, n: int, value: str, tie: str) -> DataFrame:
    """The n greatest and the n least rows, by two sorts with a limit each; the label tells them apart."""
    top = rows.orderBy(F.desc(value), tie).limit(n).withColumn("tail", F.lit("top"))
    return top.union(rows.orderBy(F.asc(value), tie).limit(n).withColumn("tail", F.lit("bottom")))


def coverage_tiers(tags: DataFrame, parsed: DataFrame, owner: str, name: str, minute: str) -> DataFrame:
    """tags with tier: matched (owner, name and minute), name_only (owner and name) or missing. Two joins on distinct keys."""
    strict = parsed.select(owner, name, minute).distinct().withColumn("__strict", F.lit(True))
    loose = parsed.select(owner, name).distinct().withColumn("__loose", F.lit(True))
    out = tags.join(strict, [owner, name, minute], "left").join(loose, [owner, name], "left")
    return out.withColumn("tier", F.when(F.col("__strict").isNotNull(), "matched").when(F.col("__loose").isNotNull(), "name_only").otherwise("missing")).drop("__strict", "__loose")


def coverage_report(tiers: DataFrame, owner: str, reverted: str) -> DataFrame:
    """Counts per owner with a total row (null owner) and guarded percentages."""
    n = lambda c: F.count_if(c)
    tier = F.col("tier")
    out = tiers.rollup(owner).agg(
        F.count("*").alias("total"), n(tier == "matched").alias("matched"), n(tier == "name_only").alias("name_only"), n(tier == "missing").alias("missing"),
        n((tier == "missing") & F.coalesce(reverted, F.lit(False))).alias("missing_reverted"), n((tier == "missing") & ~F.coalesce(reverted, F.lit(False))).alias("missing_not_reverted"),
    )
    return out.withColumn("matched_pct", F.bround(100 * F.col("matched") / F.greatest("total", F.lit(1)), 1))


def lookup_last(probe: DataFrame, build: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """Left lookup where repeated build keys keep their last row, and null keys meet null keys."""
    last = build.groupBy(*keys).agg(F.max_by(value, position).alias(value))
    right = last.select(*[F.col(k).alias(f"__{k}") for k in keys], value)
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return probe.join(right, condition, "left").drop(*[f"__{k}" for k in keys])


def resolve_ids(names: DataFrame, *sources: DataFrame) -> DataFrame:
    """(name, id) by the first source that knows the exact name; unknown names are dropped."""
    out = names.select("name").distinct()
    for k, s in enumerate(sources):
        out = out.join(s.groupBy("name").agg(F.min("id").alias(f"__{k}")), "name", "left")
    return out.select("name", F.coalesce(*[f"__{k}" for k in range(len(sources))]).alias("id")).filter("id IS NOT NULL")


def role_union(mentors: list[DataFrame], mentees: DataFrame) -> DataFrame:
    """Distinct names with their roles, sorted."""
    rows = [m.select("name", F.lit("mentor").alias("role")) for m in mentors] + [mentees.select("name", F.lit("mentee").alias("role"))]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.filter("name IS NOT NULL").groupBy("name").agg(F.array_sort(F.collect_set("role")).alias("roles"))
