"""Week keys, rolling windows and countdowns. The present moment is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def paris_week_start(at: Column) -> Column:
    """Monday, in Paris, of the week that holds an instant."""
    return F.date_trunc("week", F.from_utc_timestamp(at, "Europe/Paris")).cast("date")


def utc_week_start(at: Column) -> Column:
    """Monday of the week in UTC; the calendar grid's key, deliberately not the Paris one."""
    return F.date_trunc("week", at).cast("date")


def window_start(key: Column, now: Column) -> Column:
    """Start of a rolling window: 7d, 30d, ytd; null for all and for anything unknown."""
    return F.when(key == "7d", now - F.expr("INTERVAL 7 DAYS")).when(key == "30d", now - F.expr("INTERVAL 30 DAYS")).when(key == "ytd", F.date_trunc("year", now))


def parse_week(text: Column) -> Column:
    """Monday of the week of a strict YYYY-MM-DD; null for anything else, impossible dates included."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.date_trunc("week", F.try_to_date(text, "yyyy-MM-dd")).cast("date"))


def paris_timestamp(day: Column, clock: Column) -> Column:
    """The instant of a wall-clock day and time in Paris; null if it can't be read."""
    return F.to_utc_timestamp(F.try_to_timestamp(F.concat_ws(" ", day, clock), F.lit("yyyy-MM-dd HH:mm")), "Europe/Paris")


def parse_countdown(text: Column, now: Column) -> Column:
    """`[[d:]h:]m:s` from now on as an instant; days may end in a d; a part that begins with no digit counts as 0; null for
    any other number of parts or if nothing is left to wait."""
    p = F.split(F.trim(text), ":")
    n = F.size(p)
    # by place from the end: seconds, minutes, hours, days
    part = lambda k: F.coalesce(F.regexp_extract(F.get(p, n - k), r"^\s*(\d+)", 1).try_cast("bigint"), F.lit(0))
    seconds = ((F.when(n == 4, part(4)).otherwise(0) * 24 + F.when(n >= 3, part(3)).otherwise(0)) * 60 + part(2)) * 60 + part(1)
    return F.when(n.between(2, 4) & (seconds > 0), F.timestamp_seconds(F.unix_timestamp(now) + seconds))
