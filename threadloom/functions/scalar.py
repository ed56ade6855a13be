"""Scalar building blocks as Column expressions: safe division, time in integer microseconds, calendar, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR, DAY = 3_600_000_000, 86_400_000_000


def safe_div(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b where b is positive, else default."""
    return F.when(b > 0, a / b).otherwise(F.lit(default))


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without a zone; exact, and free of the session's zone."""
    seconds = F.date_part(F.lit("SECONDS"), ts) * 1_000_000
    return F.unix_date(F.to_date(ts)).cast("long") * DAY + F.hour(ts) * F.lit(HOUR) + F.minute(ts) * F.lit(60_000_000).cast("long") + seconds.cast("long")


def parse_ts(text: Column) -> Column:
    """ISO-8601 text to microseconds in UTC; a zero offset may follow; malformed and empty texts give null."""
    pattern = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?)(?:Z|[+-]00:?00)?$"
    m = lambda k: F.regexp_extract(text, pattern, k)
    return micros(F.when(m(1) != "", F.concat(m(1), F.lit(" "), m(2))).try_cast("timestamp_ntz"))


def day(us: Column) -> Column:
    """Days since 1970."""
    return F.floor(us / DAY)


def hour(us: Column) -> Column:
    return F.pmod(F.floor(us / HOUR), F.lit(24)).cast("int")


def weekday(us: Column) -> Column:
    """Monday is 0."""
    return F.pmod(day(us) + 3, F.lit(7)).cast("int")


def whole_days(later: Column, earlier: Column) -> Column:
    """Elapsed days, rounded down; not the number of midnights."""
    return F.floor((later - earlier) / DAY)


def calendar(ts: Column) -> dict[str, Column]:
    """weekday (Monday 0), hour, is_weekend, year, quarter label, month, year-month."""
    us = micros(ts)
    return {
        "weekday": weekday(us),
        "hour": hour(us),
        "is_weekend": (weekday(us) >= 5).cast("int"),
        "year": F.year(ts),
        "quarter": F.concat(F.year(ts).cast("string"), F.lit("Q"), F.quarter(ts).cast("string")),
        "month": F.month(ts),
        "year_month": F.date_format(ts, "yyyy-MM"),
    }


def finite(x: Column) -> Column:
    """NaN, infinities and null become 0."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def clip(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(x, high))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def scaled_round(value: Column, digits: int) -> Column:
    """A double rounded as SQL engines do that scale it in binary first: halves of the scaled double go away from zero.

    F.round() rounds the shortest decimal instead, which differs where the product falls just short of a half.
    """
    return F.round(value * F.lit(10.0**digits)) / F.lit(10.0**digits)


def reply_lag_hours(asked: Column, replied: Column) -> Column:
    """Signed hours between two microsecond columns; null where either is missing."""
    return (replied - asked) / HOUR


def account_age_hours(asked: Column, registered: Column) -> Column:
    """Hours since registration, -1 where it is unknown."""
    return F.coalesce((asked - registered) / HOUR, F.lit(-1.0))
