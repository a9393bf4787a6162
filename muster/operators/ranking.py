"""Ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Binary digits of a value that are told apart at a time; three times as many make a bigint.
DIGITS = 21


def ranked(rows: DataFrame, group: str, value: str, name: str = "rank") -> DataFrame:
    """`rows` with their rank within the group by a whole number, the largest first and null before all (as the largest
    bigint): one more than how many rows have a larger value, so ties share a rank and leave a gap.

    Rows are counted by value, which combines before the shuffle; how many rows have a larger value is added up over the
    values that share all digits but the last 21, then over those that share all but the last 42, and so on. So a window
    orders 2**21 counts at most (2**22 by the first digits), never the rows of a group, and a value that many rows have is
    counted in every task.
    """
    key = F.coalesce(F.col(value).cast("bigint"), F.lit((1 << 63) - 1)).alias("__key")
    counts = rows.groupBy(group, key).agg(F.count("*").alias("__n"))
    above, level = F.lit(0), counts
    out = counts.select(F.col(group).alias("__group"), "__key")
    for n in range(3):
        mine, over = F.shiftright("__key", DIGITS * n), F.shiftright("__key", DIGITS * (n + 1))
        outer = [group, "__over"] if n < 2 else [group]
        larger = Window.partitionBy(*outer).orderBy(F.desc("__digit")).rowsBetween(Window.unboundedPreceding, -1)
        level = counts.groupBy(group, mine.alias("__digit"), over.alias("__over")).agg(F.sum("__n").alias("__n")) if n else counts.select(group, mine.alias("__digit"), over.alias("__over"), "__n")
        before = level.select(F.col(group).alias(f"__g{n}"), F.col("__digit").alias(f"__d{n}"), F.coalesce(F.sum("__n").over(larger), F.lit(0)).alias(f"__above{n}"))
        out = out.join(before, F.col("__group").eqNullSafe(F.col(f"__g{n}")) & (mine == F.col(f"__d{n}")))
        above = above + F.col(f"__above{n}")
    found = out.select("__group", F.col("__key").alias("__of"), (above + 1).cast("bigint").alias(name))
    return rows.withColumn("__key", key).join(found, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__key") == F.col("__of"))).drop("__key", "__group", "__of")
