"""Numbers from text as read from images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_number(text: Column) -> Column:
    """Whole number after dropping commas and white space, else null."""
    return F.regexp_replace(text, r"[,\s]", "").try_cast("bigint")


def parse_float(text: Column) -> Column:
    """Commas and spaces stand for the point; runs of points are one."""
    return F.regexp_replace(F.translate(F.trim(text), ", ", ".."), r"\.{2,}", ".").try_cast("double")


def points_cell(text: Column) -> Column:
    """Only dashes: did not take part (null); digits: the score; anything else null."""
    t = F.trim(text)
    return F.when(~t.rlike(r"^[-‐-―]+$"), parse_number(t))


def clean_rank(text: Column) -> Column:
    return F.concat(F.lit("R"), F.nullif(F.regexp_extract(text, r"[Rr]([1-5])", 1), F.lit("")))


def strip_leading_rank(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s*\d{1,2}\s+", "")


def strip_trailing_power(text: Column) -> Column:
    """Drops a trailing run of digits and separators that holds 7 digits or more."""
    tail = F.regexp_extract(text, r"([\d.,\s]+)$", 1)
    return F.when(F.length(F.regexp_replace(tail, r"\D", "")) >= 7, F.rtrim(F.left(text, F.length(text) - F.length(tail)))).otherwise(text)
