"""Accuracy of extracted rows against expected ones, and against a baseline."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from muster.functions.names import name_key


@pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="float64")


def names_match(a: Column, b: Column, least: float = 0.70) -> Column:
    """Keys of 4 characters or fewer must be equal, longer ones close."""
    short = F.least(F.length(a), F.length(b)) <= 4
    return F.coalesce(F.when(short | (a == b), a == b).otherwise(ratio(F.when(~short & (a != b), a), F.when(~short & (a != b), b)) >= least), F.lit(False))


def stats_match(a: Column, b: Column, within: float = 0.05) -> Column:
    return a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= within + 1e-9, F.lit(False))


def compare(expected: DataFrame, actual: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Per first key: expected rows and, of each field, how many of them match the row at the same place."""
    e, a = expected.alias("e"), actual.alias("a")
    j = e.join(a, keys, "left")
    same = [F.count_if(F.col(f"e.{f}").eqNullSafe(F.col(f"a.{f}"))).alias(f) for f in fields]
    return j.groupBy(keys[0]).agg(F.count("*").alias("rows"), *same)


def regressions(now: DataFrame, baseline: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields that match fewer rows than in the baseline."""
    j = now.alias("n").join(baseline.alias("b"), key)
    worse = F.filter(F.array(*(F.when(F.col(f"n.{f}") < F.col(f"b.{f}"), F.lit(f)) for f in fields)), lambda f: f.isNotNull())
    return j.select(key, F.explode(worse).alias("field"))


def audit_verdicts(cases: DataFrame, rows: DataFrame, least: float = 0.70) -> DataFrame:
    """Cases (case_id, capture_id, name, stored, true) against a capture's rows: pass if a matching row holds the true
    value, fail if the stored one, other if neither. Rows of a case are those of its capture."""
    j = cases.join(rows, "capture_id", "left")
    known = names_match(name_key(F.col("name")), name_key(F.col("player_name")), least)
    hit = F.col("honor").isin(F.col("stored"), F.col("true")) | known
    found = j.withColumn("hit", hit).groupBy("case_id").agg(F.bool_or(F.col("hit") & (F.col("honor") == F.col("true"))).alias("right"), F.bool_or(F.col("hit") & (F.col("honor") == F.col("stored"))).alias("wrong"))
    return found.select("case_id", F.when(F.col("right"), "pass").when(F.col("wrong"), "fail").otherwise("other").alias("verdict"))
