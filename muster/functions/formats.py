"""Dates, numbers and bands as readers see them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for an unknown value, and the bounds of the bands.
UNKNOWN = "—"
GOOD_RATE, FAIR_RATE, BAD_READ, POOR_READ = 80, 50, 0.2, 0.4


def _paris(at: Column | str) -> Column:
    return F.from_utc_timestamp(F.col(at) if isinstance(at, str) else at, "Europe/Paris")


def event_time(at: Column | str) -> Column:
    """Day, short month, year and time in Paris."""
    return F.date_format(_paris(at), "dd MMM yyyy, HH:mm")


def updated_at(at: Column) -> Column:
    return F.coalesce(F.date_format(_paris(at), "dd/MM/yyyy, HH:mm"), F.lit(UNKNOWN))


def short_day(at: Column) -> Column:
    """A calendar day in UTC."""
    return F.coalesce(F.date_format(at, "dd MMM yyyy"), F.lit(UNKNOWN))


def week_label(start: Column) -> Column:
    """A period's first day as a calendar day, without regard to any zone."""
    return F.when(start.isNull(), UNKNOWN).otherwise(F.concat(F.lit("Week of "), F.date_format(start, "d MMMM yyyy")))


def period_label(start: Column, end: Column) -> Column:
    return F.concat(F.date_format(start, "dd MMMM yyyy"), F.lit(" to "), F.date_format(end, "dd MMMM yyyy"))


def honor(value: Column) -> Column:
    """Whole numbers with commas between thousands."""
    return F.coalesce(F.format_number(value, 0), F.lit(UNKNOWN))


def percent(value: Column) -> Column:
    return F.when(value.isNull(), UNKNOWN).otherwise(F.concat(F.format_string("%.1f", value.cast("double")), F.lit("%")))


def rate_band(percent_: Column) -> Column:
    """unknown, good, fair or poor."""
    return F.when(percent_.isNull(), "unknown").when(percent_ >= GOOD_RATE, "good").when(percent_ >= FAIR_RATE, "fair").otherwise("poor")


def confidence_band(confidence: Column) -> Column:
    """unknown, bad, poor or fair: the lower the read, the louder it is shown."""
    return F.when(confidence.isNull(), "unknown").when(confidence < BAD_READ, "bad").when(confidence < POOR_READ, "poor").otherwise("fair")
