"""As-of and interval joins, look-back windows and outcomes as one conditional aggregation over each user's events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.scalar import DAY, HOUR, day, hour, safe_div, weekday
from threadloom.operators.scan import next_time, scan, totals_before, window_measures
from threadloom.operators.stats import meet

# Namespaces counted apart, look-back days, outcome windows (days after the question), tags counted.
NAMESPACES = {"mainspace": 0, "userpage": 2, "usertalk": 3, "project": 4, "draft": 118}
LOOKBACK = [1, 7, 14, 30, 60]
RETENTION = {"ret_7d": (7, 14), "ret_14d": (7, 21), "ret_30d": (7, 37), "ret_60d": (7, 67), "ret_14_28d": (21, 35)}
REVERTED = "mw-reverted"
TAGS = {
    "tag_visualeditor": "visualeditor",
    "tag_wikieditor": "wikieditor",
    "tag_mobile": "mobile edit",
    "tag_mobile_web": "mobile web edit",
    "tag_mobile_app": "mobile app edit",
    "tag_newcomer_task": "newcomer task",
    "tag_newcomer_copyedit": "newcomer task copyedit",
    "tag_newcomer_addlink": "newcomer task add link",
    "tag_newcomer_references": "newcomer task references",
    "tag_newcomer_expand": "newcomer task expand",
    "tag_newcomer_update": "newcomer task update",
    "tag_newcomer_links": "newcomer task links",
    "tag_newcomer_revisetone": "newcomer task revise tone",
    "tag_editcheck_newref": "editcheck-newreference",
    "tag_editcheck_newcontent": "editcheck-newcontent",
    "tag_editcheck_references": "editcheck-references",
    "tag_editcheck_tone": "editcheck-tone",
    "tag_mw_reverted": "mw-reverted",
    "tag_discussion": "discussiontools-added-comment",
    "tag_app_suggestededit": "app-suggestededit",
}


def as_of(probe: DataFrame, history: DataFrame, key: str, value: str, clamp: bool = False) -> DataFrame:
    """probe with the history's latest value at or before its time `us`, per key; null values of the history are passed over.

    Both sides are put in one sequence per key, where a history row at a probe's time comes first, and the last value is carried
    forward by scan(): no pairs, and a key of any size is spread over ranges. Of values at one time the greatest counts. clamp: a
    probe before the first value gets the first one. Null keys meet null keys.
    """
    columns = [c for c in probe.columns if c not in (key, "us")]
    left = probe.select(key, "us", F.lit(1).alias("__side"), F.xxhash64(*(columns or ["us"])).alias("__tie"), F.struct(F.lit(0).alias("__none"), *columns).alias("__row"), F.lit(None).cast(history.schema[value].dataType).alias("__v"))
    known = history.filter(F.col(value).isNotNull()).groupBy(key, "us").agg(F.max(value).alias("__v"))
    right = known.select(key, "us", F.lit(0).alias("__side"), F.lit(0).cast("long").alias("__tie"), F.lit(None).cast(left.schema["__row"].dataType).alias("__row"), "__v")
    out = scan(left.unionByName(right), [key], ["us", "__side", "__tie"], {"__found": ("last", F.col("__v"))}, whole={"__first": ("first", F.col("__v"))} if clamp else None).filter("__side = 1")
    found = F.coalesce("__found", "__first") if clamp else F.col("__found")
    return out.select(key, "us", *[F.col(f"__row.{c}").alias(c) for c in columns], found.alias(value))


def pool(weight: Column) -> Column:
    """Null is unknown, from 1 on auto, else manual."""
    return F.when(weight.isNull(), "unknown").when(weight >= 1, "auto").otherwise("manual")


def events_around(questions: DataFrame, edits: DataFrame, user: str = "user_id") -> DataFrame:
    """Each question (user, q) with its user's events (us, ns, sizediff, tags, title); questions without events stay.

    The join is by user only and is aggregated at once; no window is joined on its own.
    """
    return questions.join(edits, user, "left")


def _count(condition: Column) -> Column:
    return F.coalesce(F.count_if(condition), F.lit(0)).cast("long")


def _distinct(values: Column) -> Column:
    """How many different values: a set for each group, so that rows are not multiplied as by several count(DISTINCT)."""
    return F.size(F.collect_set(values)).cast("long")


def _active_days(condition: Column, origin: Column, first: int = 0) -> Column:
    """Different days of events that meet a condition, as bits of one number: days from the origin's day + first on, 62 at most."""
    bit = day(F.col("us")) - day(origin) - first
    return F.coalesce(F.bit_count(F.bit_or(F.when(condition, F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))))), F.lit(0)).cast("long")


def lookback_features(days: list[int] = LOOKBACK, pages: str = "title") -> dict[str, Column]:
    """Ten measures for each look-back window [q - days, q): aggregates over events_around(), by question."""
    out = {}
    for w in days:
        inside = (F.col("us") < F.col("q")) & (F.col("us") >= F.col("q") - w * DAY)
        n, s = _count(inside), f"_{w}d"
        main, draft = _count(inside & (F.col("ns") == 0)), _count(inside & (F.col("ns") == 118))
        out |= {
            f"n_edits{s}": n,
            f"n_mainspace{s}": main,
            f"n_usertalk{s}": _count(inside & (F.col("ns") == 3)),
            f"n_draft{s}": draft,
            f"n_unique_ns{s}": _distinct(F.when(inside, F.col("ns"))),
            f"mainspace_ratio{s}": safe_div(main, n),
            f"draft_ratio{s}": safe_div(draft, n),
            f"avg_sizediff{s}": F.coalesce(F.avg(F.when(inside, F.col("sizediff"))), F.lit(0.0)),
            f"neg_sizediff_ratio{s}": safe_div(_count(inside & (F.col("sizediff") < 0)), n),
            f"n_unique_articles{s}": _distinct(F.when(inside, F.col(pages))),
        }
    return out


def lookback_table(questions: DataFrame, edits: DataFrame, days: list[int] = LOOKBACK, pages: str = "title", user: str = "user_id", size_unit: float = 1e-6) -> DataFrame:
    """The measures of lookback_features() for each question (user, q), from running totals instead of a join with histories.

    Sizes are added up as whole numbers of size_unit, so that differences of totals are exact.
    """
    one = lambda c: c.cast("long")
    sums = {
        "n": F.lit(1).cast("long"), "main": one(F.col("ns") == 0), "usertalk": one(F.col("ns") == 3), "draft": one(F.col("ns") == 118),
        "smaller": one(F.col("sizediff") < 0), "sized": one(F.col("sizediff").isNotNull()), "size": F.round(F.col("sizediff") / size_unit).cast("long"),
    }
    t = window_measures(questions, edits, user, "q", "us", {f"{w}d": (-w * DAY, 0) for w in days}, sums, {"ns": F.col("ns"), "pages": F.col(pages)})
    out = {}
    for w in days:
        c = lambda k, w=w: F.col(f"{k}_{w}d")
        out |= {
            f"n_edits_{w}d": c("n"), f"n_mainspace_{w}d": c("main"), f"n_usertalk_{w}d": c("usertalk"), f"n_draft_{w}d": c("draft"), f"n_unique_ns_{w}d": c("ns"),
            f"mainspace_ratio_{w}d": safe_div(c("main"), c("n")), f"draft_ratio_{w}d": safe_div(c("draft"), c("n")), f"avg_sizediff_{w}d": safe_div(c("size") * size_unit, c("sized")),
            f"neg_sizediff_ratio_{w}d": safe_div(c("smaller"), c("n")), f"n_unique_articles_{w}d": c("pages"),
        }
    return t.select(user, "q", *[c.alias(k) for k, c in out.items()])


def recency_table(questions: DataFrame, edits: DataFrame, days: list[int] = (7, 1), user: str = "user_id") -> DataFrame:
    """The counts of recency_counts() for each question, from running totals."""
    return window_measures(questions, edits, user, "q", "us", {f"{w}d": (1 - (w + 1) * DAY, 0) for w in days}, {"n_recent": F.lit(1).cast("long")})


def retention_table(questions: DataFrame, edits: DataFrame, windows: dict[str, tuple[int, int]] = RETENTION, user: str = "user_id") -> DataFrame:
    """The outcomes of retention_outcomes() for each question, from running totals; a window that starts at q leaves q itself out."""
    even = F.col("ns") % 2 == 0
    spans = {k: (max(a * DAY, 1), b * DAY) for k, (a, b) in windows.items()}
    t = window_measures(questions, edits, user, "q", "us", spans, {"n": even.cast("long")}, {"days": F.when(even, day(F.col("us")))})
    out = {}
    for k in windows:
        n, days = F.col(f"n_{k}"), F.col(f"days_{k}")
        out |= {k: (n >= 1).cast("int"), f"{k}_count": n, f"{k}_5plus": (n >= 5).cast("int"), f"{k}_active_days": days, f"{k}_crossday": (days >= 2).cast("int")}
    return t.select(user, "q", *[c.alias(k) for k, c in out.items()])


def anchor_window_table(anchors: DataFrame, edits: DataFrame, user: str = "user_id") -> DataFrame:
    """The flags of anchor_windows() for each (user, anchor), from running totals of main-space events."""
    spans = {f"{w}d": (0, w) for w in (7, 14, 21, 28, 30, 60, 180)} | {"15_28d": (14, 28), "29_60d": (28, 60), "61_180d": (60, 180)}
    t = window_measures(anchors, edits, user, "anchor", "us", {k: (a * DAY + 1, b * DAY + 1) for k, (a, b) in spans.items()}, {"n": (F.col("ns") == 0).cast("long")})
    flag = lambda k, least: (F.col(f"n_{k}") >= least).cast("int")
    out = {f"mainspace_{k}" if a == 0 else f"th_{least}plus_{k}": flag(k, least) for k, (a, _) in spans.items() for least in ((1,) if a == 0 else (1, 5))}
    return t.select(user, "anchor", *[c.alias(k) for k, c in out.items()])


def history_features() -> dict[str, Column]:
    """Measures over all events before q: counts, sizes, recency (-1 without events), span and time patterns."""
    inside = F.col("us") < F.col("q")
    own = lambda c: F.when(inside, c)
    n = _count(inside)
    last, first = F.max(own(F.col("us"))), F.min(own(F.col("us")))
    return {
        "n_edits_all": n,
        "n_unique_ns_all": _distinct(own(F.col("ns"))),
        "mainspace_ratio_all": safe_div(_count(inside & (F.col("ns") == 0)), n),
        "draft_ratio_all": safe_div(_count(inside & (F.col("ns") == 118)), n),
        "avg_sizediff_all": F.coalesce(F.avg(own(F.col("sizediff"))), F.lit(0.0)),
        "std_sizediff_all": F.when(n > 1, F.stddev_pop(own(F.col("sizediff")))).otherwise(0.0),
        "max_abs_sizediff_all": F.coalesce(F.max(own(F.abs("sizediff"))), F.lit(0.0)),
        "neg_sizediff_ratio_all": safe_div(_count(inside & (F.col("sizediff") < 0)), n),
        "hours_since_last_edit": F.coalesce((F.first("q") - last) / HOUR, F.lit(-1.0)),
        "active_span_hours": F.when(n > 1, (last - first) / HOUR).otherwise(0.0),
        "weekend_ratio": safe_div(_count(inside & (weekday(F.col("us")) >= 5)), n),
        "night_ratio": safe_div(_count(inside & (hour(F.col("us")) < 6)), n),
        "burstiness": safe_div(n, _distinct(own(day(F.col("us"))))),
        "n_reverts_pre": _count(inside & F.array_contains("tags", REVERTED)),
        "revert_rate_pre": safe_div(_count(inside & F.array_contains("tags", REVERTED)), n),
    }


def tag_features(tags: dict[str, str] = TAGS, once: bool = False) -> dict[str, Column]:
    """How often each tag stands on events before q; a tag repeated on an event counts each time, or once."""
    inside = F.col("us") < F.col("q")
    n = lambda t: F.array_contains("tags", t).cast("long") if once else F.size(F.filter("tags", lambda x: x == t)).cast("long")
    return {k: F.coalesce(F.sum(F.when(inside & F.col("tags").isNotNull(), n(t))), F.lit(0)) for k, t in tags.items()}


def recency_counts(days: list[int] = (7, 1)) -> dict[str, Column]:
    """Events before q whose elapsed whole days are at most w, so that nearly w + 1 days count."""
    return {f"n_recent_{w}d": _count((F.col("us") < F.col("q")) & (F.floor((F.col("q") - F.col("us")) / DAY) <= w)) for w in days}


def retention_outcomes(windows: dict[str, tuple[int, int]] = RETENTION) -> dict[str, Column]:
    """For each window [q + a, q + b) of events in even namespaces: any, count, five or more, active days, two days or more."""
    out = {}
    for name, (a, b) in windows.items():
        inside = (F.col("us") > F.col("q")) & (F.col("ns") % 2 == 0) & (F.col("us") >= F.col("q") + a * DAY) & (F.col("us") < F.col("q") + b * DAY)
        n, days = _count(inside), _active_days(inside, F.col("q"), a)
        out |= {name: (n >= 1).cast("int"), f"{name}_count": n, f"{name}_5plus": (n >= 5).cast("int"), f"{name}_active_days": days, f"{name}_crossday": (days >= 2).cast("int")}
    return out


def registration_retention(days: tuple[int, int] = (30, 60)) -> dict[str, Column]:
    """Any event (all namespaces) in [registered + a, registered + b), and whether q came within a days of registration."""
    a, b = days
    inside = (F.col("us") >= F.col("registered") + a * DAY) & (F.col("us") < F.col("registered") + b * DAY)
    return {
        "ret_wmf": (_count(inside) >= 1).cast("int"),
        "ret_wmf_valid": F.coalesce(((F.first("q") - F.first("registered")) < a * DAY).cast("int"), F.lit(0)),
    }


def continuous_outcomes(cap_first: int = 60, cap_fifth: int = 37) -> dict[str, Column]:
    """log1p of the 7-37 day count; days to the first, fifth and last event in even namespaces, capped; any event; weeks with one."""
    after = (F.col("us") > F.col("q")) & (F.col("ns") % 2 == 0)
    own = F.when(after, F.col("us"))
    q = F.first("q")
    inside = after & (F.col("us") >= F.col("q") + 7 * DAY) & (F.col("us") < F.col("q") + 37 * DAY)
    # Later events are cut to the cap anyway, so the list holds those of cap_fifth days only.
    fifth = F.get(F.array_sort(F.collect_list(F.when(after & (F.col("us") < F.col("q") + cap_fifth * DAY), F.col("us")))), 4)
    elapsed = F.floor((F.col("us") - F.col("q")) / DAY)
    return {
        "log1p_edits_7_37": F.log1p(_count(inside)),
        "days_to_first_post_edit": F.least(F.lit(float(cap_first)), F.coalesce((F.min(own) - q) / DAY, F.lit(float(cap_first)))),
        "days_to_5th": F.least(F.lit(float(cap_fifth)), F.coalesce((fifth - q) / DAY, F.lit(float(cap_fifth)))),
        "last_edit_days_post_q": F.coalesce((F.max(own) - q) / DAY, F.lit(0.0)),
        "any_edit_post": (_count(F.col("us") > F.col("q")) >= 1).cast("int"),
        "session_weeks_60d": F.bit_count(F.coalesce(F.bit_or(F.when(after & (elapsed < 60), F.call_function("shiftleft", F.lit(1).cast("long"), F.floor(elapsed / 7).cast("int")))), F.lit(0).cast("long"))).cast("long"),
    }


def quality_outcomes() -> dict[str, Column]:
    """Reverted and productive events and their diversity in [q + 7 d, q + 37 d), even namespaces."""
    inside = (F.col("us") > F.col("q")) & (F.col("ns") % 2 == 0) & (F.col("us") >= F.col("q") + 7 * DAY) & (F.col("us") < F.col("q") + 37 * DAY)
    n, bad = _count(inside), _count(inside & F.array_contains("tags", REVERTED))
    return {
        "reverted_any": (bad >= 1).cast("int"),
        "reverted_count": bad,
        "revert_rate_post": safe_div(bad, n),
        "productive_edits": n - bad,
        "unique_ns": _distinct(F.when(inside, F.col("ns"))),
        "unique_articles": _distinct(F.when(inside, F.col("title"))),
        "mainspace_ratio_post": safe_div(_count(inside & (F.col("ns") == 0)), n),
    }


def anchor_outcomes() -> dict[str, Column]:
    """Fifteen outcomes after an anchor: (anchor, anchor + w], main space or even namespaces, with and without reverted events."""
    t = F.col("us") - F.col("anchor")
    within = lambda a, b: (t > a * DAY) & (t <= b * DAY)
    main, even = F.col("ns") == 0, F.col("ns") % 2 == 0
    bad = F.coalesce(F.array_contains("tags", REVERTED), F.lit(False))
    days = lambda c: _active_days(c, F.col("anchor"))  # noqa: E731  60 days at most
    flag = lambda c: (_count(c) >= 1).cast("int")
    return {
        "primary": flag(main & within(0, 14)),
        "n_mainspace_edits_14d": _count(main & within(0, 14)),
        "primary_constructive": flag(main & ~bad & within(0, 14)),
        "sec2": flag(main & within(14, 28)),
        "constructive_edit_15_60d": flag(main & ~bad & within(14, 60)),
        "reverted_any": flag(even & bad & within(0, 14)),
        "active_days_14d": days(even & within(0, 14)),
        "active_days_30d": days(even & within(0, 30)),
        "constructive_days_30d": days(even & ~bad & within(0, 30)),
        "unique_ns": _distinct(F.when(even & within(0, 14), F.col("ns"))),
        "cross_day_constructive_14d": (days(main & ~bad & within(0, 14)) >= 2).cast("int"),
        "cross_day_any_14d": (days(main & within(0, 14)) >= 2).cast("int"),
        "mainspace_15_30d": flag(main & within(14, 30)),
        "n_mainspace_15_30d": _count(main & within(14, 30)),
        "active_days_15_30d": days(even & within(14, 30)),
    }


def anchor_windows() -> dict[str, Column]:
    """Main-space flags within 7 to 180 days of the anchor, and one or five events in the windows after 14, 28 and 60 days."""
    t, main = F.col("us") - F.col("anchor"), F.col("ns") == 0
    within = lambda a, b: main & (t > a * DAY) & (t <= b * DAY)
    out = {f"mainspace_{w}d": (_count(within(0, w)) >= 1).cast("int") for w in (7, 14, 21, 28, 30, 60, 180)}
    for name, a, b in (("15_28d", 14, 28), ("29_60d", 28, 60), ("61_180d", 60, 180)):
        n = _count(within(a, b))
        out |= {f"th_1plus_{name}": (n >= 1).cast("int"), f"th_5plus_{name}": (n >= 5).cast("int")}
    return out


def log_counts(kinds: dict[str, tuple[str, str | None]]) -> dict[str, Column]:
    """Log events before q by type and action (null: any action)."""
    before = F.col("us") < F.col("q")
    return {k: _count(before & (F.col("type") == t) & (F.lit(True) if a is None else F.col("action") == a)) for k, (t, a) in kinds.items()}


def abuse_counts() -> dict[str, Column]:
    """Filter hits before q, those that warned and those that disallowed; a missing result counts as neither."""
    before, result = F.col("us") < F.col("q"), F.lower(F.coalesce("result", F.lit("")))
    return {"abuse_count": _count(before), "abuse_warn": _count(before & result.contains("warn")), "abuse_disallow": _count(before & result.contains("disallow"))}


def mentor_history(conversations: DataFrame) -> DataFrame:
    """For each conversation (id, mentor, mentee, us, replied) its mentor's record strictly before it, and over the last 30 days.

    Running totals of each mentor's conversations, at each conversation and 31 days before it, give all. A mentee counts once from its
    first conversation on; for the last 30 days (elapsed whole days) it counts from each conversation until its next one or the window's
    end, as a step up and a step down. Peers at the same time do not count. A mentor of any size is spread over ranges.
    """
    window = 31 * DAY - 1
    marked = next_time(conversations.select("id", "mentor", "mentee", "us", "replied"), ["mentor", "mentee"], "us", "id", "__next")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    here = F.struct(F.col("us").alias("at"), one.alias("n"), F.col("replied").cast("long").alias("replied"), zero.alias("mentees"), one.alias("step"))
    gone = F.struct(F.least(F.col("__next"), F.col("us") + window).alias("at"), zero.alias("n"), zero.alias("replied"), zero.alias("mentees"), F.lit(-1).cast("long").alias("step"))
    met_first = conversations.groupBy("mentor", "mentee").agg(F.min("us").alias("at"))
    events = marked.select("mentor", F.explode(F.array(here, gone)).alias("e")).select("mentor", "e.*")
    events = events.unionByName(met_first.select("mentor", "at", zero.alias("n"), zero.alias("replied"), one.alias("mentees"), zero.alias("step")))
    probes = conversations.select("mentor", "id", "us", F.explode(F.array(F.col("us"), F.col("us") - window)).alias("at"))
    began = conversations.groupBy("mentor").agg(F.min("us").alias("__began"))
    totals = totals_before(events, probes, ["mentor"], "at", ["n", "replied", "mentees", "step"])
    now, old = F.col("at") == F.col("us"), F.col("at") < F.col("us")
    value = lambda c, when: F.sum(F.when(when, F.col(c)))  # noqa: E731  one row each
    out = totals.groupBy("id", "mentor", "us").agg(*[value(c, w).alias(f"{c}_{k}") for c in ("n", "replied", "mentees", "step") for k, w in (("now", now), ("old", old))])
    out = meet(out, began, ["mentor"], "left")
    recent, replied = F.col("n_now") - F.col("n_old"), F.col("replied_now") - F.col("replied_old")
    return out.select(
        "id",
        F.col("mentees_now").alias("m_prior_mentees"),
        F.col("n_now").alias("m_prior_conversations"),
        safe_div(F.col("replied_now"), F.col("n_now")).alias("m_prior_reply_rate"),
        F.when(F.col("n_now") > 0, F.floor((F.col("us") - F.col("__began")) / DAY)).otherwise(0).alias("m_days_active"),
        F.col("step_now").alias("m_mentees_30d"),
        recent.alias("m_conversations_30d"),
        safe_div(replied, recent).alias("m_reply_rate_30d"),
    )


def entropy_of(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Entropy in bits of the counts of each key; groups without counts have 0."""
    total = F.sum(n).over(W.partitionBy(*keys))
    p = F.col("__p")
    return counts.withColumn("__p", F.col(n) / total).groupBy(*keys).agg(F.coalesce(-F.sum(F.when(p > 0, p * F.log2(p))), F.lit(0.0)).alias("entropy"))


def max_streak(days: DataFrame, keys: list[str], date: str = "day") -> DataFrame:
    """The longest run of consecutive days per key (gaps and islands), from rows that may repeat."""
    w = W.partitionBy(*keys).orderBy(date)
    islands = days.select(*keys, date).distinct().withColumn("__island", F.col(date) - F.row_number().over(w))
    return islands.groupBy(*keys, "__island").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max("n").alias("streak"))


def returned_after_gap(days: DataFrame, keys: list[str], gap: int = 7, date: str = "day") -> DataFrame:
    """Whether two neighbouring days of a key lie gap days or more apart."""
    w = W.partitionBy(*keys).orderBy(date)
    steps = days.select(*keys, date).distinct().withColumn("__step", F.col(date) - F.lag(date).over(w))
    return steps.groupBy(*keys).agg(F.coalesce(F.max((F.col("__step") >= gap).cast("int")), F.lit(0)).alias("returned"))


def aggregate_all(rows: DataFrame, keys: list[str], *groups: dict[str, Column], digits: int = 9) -> DataFrame:
    """One aggregation with all groups of measures; doubles are rounded so that results do not depend on the order of sums."""
    columns = reduce(lambda a, b: a | b, groups)
    return rounded(rows.groupBy(*keys).agg(*[c.alias(k) for k, c in columns.items()]), digits)


def rounded(rows: DataFrame, digits: int = 9) -> DataFrame:
    return rows.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])
