"""Ranks by counts against ranks by a window."""

from __future__ import annotations

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from muster.operators.ranking import ranked


def test_ranks_equal_those_of_a_window(spark):
    draw = random.Random(1)
    values = lambda: draw.choice([None, 0, -1, 5, draw.randint(-50, 50), draw.randint(-(1 << 40), 1 << 40), draw.randint(-(1 << 62), 1 << 62), 1 << 21, (1 << 42) + 3, -(1 << 63)])
    rows = [(k, draw.choice(["a", "a", "b", None]), values()) for k in range(3000)]
    df = spark.createDataFrame(rows, "k int, g string, v bigint")
    want = df.withColumn("rank", F.rank().over(Window.partitionBy("g").orderBy(F.desc_nulls_first("v"))).cast("bigint"))
    assert sorted(ranked(df, "g", "v").collect(), key=str) == sorted(want.collect(), key=str)
    assert ranked(df.where("false"), "g", "v").count() == 0


def test_no_window_orders_the_rows_of_a_group(spark):
    """A value that a group has a hundred thousand times is one row of every window."""
    df = spark.range(100_000).select(F.lit("g").alias("g"), (F.col("id") % 3).alias("v"))
    out = ranked(df, "g", "v")
    assert {(r.v, r.rank) for r in out.select("v", "rank").distinct().collect()} == {(2, 1), (1, 33334), (0, 66667)}
    assert out.count() == 100_000
