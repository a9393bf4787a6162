"""Places and running sums of rows within ordered groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.llm.tables import written


def matched(a: DataFrame, b: DataFrame, names: Sequence[str], on: dict[str, Column] | None = None) -> DataFrame:
    """`a` joined to `b` on the named columns, nulls equal to nulls, and on columns of `b` being equal to given values;
    of `b` all other columns are added."""
    other = b.withColumnsRenamed({n: f"_b_{n}" for n in [*names, *(on or {})]})
    condition = F.lit(True)
    for n in names:
        condition = condition & F.col(n).eqNullSafe(F.col(f"_b_{n}"))
    for n, value in (on or {}).items():
        condition = condition & (value == F.col(f"_b_{n}"))
    return a.join(other, condition).drop(*(f"_b_{n}" for n in [*names, *(on or {})]))


def placed(df: DataFrame, groups: Sequence[str], order: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """`df` with `place` (bigint, from 0) of each row within its group by `order`, nulls first, and for each name of `sums`
    the sum of that column over the group's earlier rows as `<name>_before`.

    Rows are dealt out by ranges of (groups, order), so a group of any size is cut over many tasks; a stretch of a group
    within one task is counted there, and stretches are added up over the group's tasks, of which there are no more rows
    than tasks and groups. Rows that are equal in all of `order` are spread as well and stand in any order. The dealt rows
    are written once to the shared folder, so that a lost executor never sees them dealt otherwise.
    """
    spread = df.withColumn("_row", F.monotonically_increasing_id())
    by = [*groups, *order, "_row"]
    kept = written(spread.repartitionByRange(*by).sortWithinPartitions(*by).drop("_row").withColumn("_at", F.monotonically_increasing_id()), "placed")
    kept = kept.withColumn("_part", F.shiftright("_at", 33))
    keys = [*groups, "_part"]
    runs = kept.groupBy(*keys).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"), *(F.sum(s).alias(f"_sum_{s}") for s in sums))
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    until = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    runs = runs.select(*keys, "_first", until("_n").alias("_n_until"), *(until(f"_sum_{s}").alias(f"_until_{s}") for s in sums))
    here = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    for s in sums:
        kept = kept.withColumn(f"_here_{s}", F.coalesce(F.sum(s).over(here), F.lit(0)))
    return matched(kept, runs, keys).select(
        *df.columns,
        (F.col("_at") - F.col("_first") + F.col("_n_until")).alias("place"),
        *((F.col(f"_here_{s}") + F.col(f"_until_{s}")).alias(f"{s}_before") for s in sums),
    )
