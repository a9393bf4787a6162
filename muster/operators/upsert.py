"""Keyed writes as functions of a state and a batch: latest wins, first wins, audit, membership, corrections.

A batch has an ordinal, its order of arrival; the state counts as earlier than any batch. Nothing is written in place:
the result is the next state, with side outputs as tables of their own. One row of a key is chosen by an aggregate that
combines before the shuffle, so that no key, however often it occurs, is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.operators.kept import unsent


def best_by(rows: DataFrame, keys: list[str], by: Column) -> DataFrame:
    """Of each key the row with the largest `by` (a struct compares field by field, nulls first)."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), by).alias("__row"))
    return best.select(*(F.col(c) if c in keys else F.col("__row").getField(c).alias(c) for c in rows.columns))


def highest_confidence(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key: the highest confidence, the first on ties."""
    return best_by(rows, keys, F.struct("confidence", -F.col("ordinal")))


def latest_wins(state: DataFrame, batch: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """On conflict do update: the batch's latest row of a key sets `columns` (those that the batch has, if not given);
    the state's other columns keep what they held, and are null in new rows."""
    set_ = [c for c in (columns or batch.columns) if c in state.columns and c not in keys]
    new = best_by(batch.select(*keys, *set_, "ordinal"), keys, F.struct("ordinal")).drop("ordinal")
    if not [c for c in state.columns if c not in keys and c not in set_]:
        return state.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*state.columns))
    new = new.select(*keys, *(F.col(c).alias(f"__{c}") for c in set_), F.lit(True).alias("__new"))
    value = lambda c: F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in set_ else F.col(c)
    return state.join(new, keys, "full").select(*(value(c) for c in state.columns))


def first_wins(state: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """On conflict do nothing."""
    new = best_by(batch, keys, F.struct(-F.col("ordinal"))).drop("ordinal").join(unsent(state.select(*keys)), keys, "left_anti")
    return state.unionByName(new)


def insert_outcomes(state: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Each row of the batch as inserted, reset or duplicate: a key already processed blocks, any other state is retried;
    of several rows of one key in the batch only the first counts."""
    first = batch.groupBy(*keys).agg(F.min("ordinal").alias("__first"))
    seen = first.join(state.select(*keys, F.col("status").alias("held")), keys, "left")
    outcome = F.when((F.col("held") == "processed") | (F.col("ordinal") > F.col("__first")), "duplicate").when(F.col("held").isNotNull(), "reset").otherwise("inserted")
    return batch.join(seen, keys).withColumn("outcome", outcome).drop("__first", "held")


def reversal_audit(state: DataFrame, batch: DataFrame, corrections: DataFrame, keys: list[str], fields: dict[str, bool]) -> DataFrame:
    """Audit rows for corrected rows whose re-read value differs. `fields`: whether nulls on either side are skipped.

    Where corrections name a field, only that field of a row counts as corrected. A row that the batch reads several
    times (by ordinal, if it has one) is compared with its reading before.
    """
    by_field = "field" in corrections.columns
    marked = corrections.select("target_id", *(["field"] if by_field else [])).distinct()
    old = state.join(marked.select("target_id").distinct(), F.col("row_id") == F.col("target_id"), "left_semi")
    order = F.col("n.ordinal") if "ordinal" in batch.columns else F.lit(0)
    pair = old.alias("o").join(batch.alias("n"), keys)
    parts = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"o.{f}").cast("bigint").alias("old_value"), F.col(f"n.{f}").cast("bigint").alias("new_value"), F.lit(skip).alias("skip")) for f, skip in fields.items()))
    out = pair.select(F.col("o.row_id").alias("target_id"), order.alias("ordinal"), F.explode(parts).alias("c")).select("target_id", "ordinal", "c.*")
    if "ordinal" in batch.columns:
        before = F.lag(F.struct("new_value")).over(Window.partitionBy("target_id", "field").orderBy("ordinal"))
        out = out.withColumn("__before", before).withColumn("old_value", F.when(F.col("__before").isNull(), F.col("old_value")).otherwise(F.col("__before.new_value")))
    if by_field:
        out = out.join(marked, ["target_id", "field"], "left_semi")
    differs = ~F.col("old_value").eqNullSafe(F.col("new_value")) & ~(F.col("skip") & (F.col("old_value").isNull() | F.col("new_value").isNull()))
    return out.where(differs).select("target_id", "field", "old_value", "new_value", F.lit("auto:ocr-reingest").alias("corrected_by"))


def membership_sync(memberships: DataFrame, seen: DataFrame) -> DataFrame:
    """New memberships for players seen without an active one: (alliance_id, player_id, joined_at). They join when they
    were first seen, in order of arrival where `seen` has an ordinal."""
    active = memberships.where("left_at is null").select("alliance_id", "player_id")
    at = F.min_by("at", "ordinal") if "ordinal" in seen.columns else F.min("at")
    return seen.groupBy("alliance_id", "player_id").agg(at.alias("joined_at")).join(active, ["alliance_id", "player_id"], "left_anti")


#: The columns of each table that may be corrected.
CORRECTABLE = {"at_participations": ("points", "power"), "at_donations": ("honor",)}


def apply_corrections(tables: dict[str, DataFrame], corrections: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The corrected tables (each with row_id and its correctable columns) and the audit rows.

    Corrections (ordinal, target_table, target_id, field, new_value) apply in order of their ordinal; the last of a
    field of a row stays, also if it is null. An audit row's old value is what the field held just before. A correction
    of a missing row is an error row with code P0002, of a column that may not be corrected one with 22023; neither
    changes anything or counts as a value before.
    """
    # a narrow row of numbers a row of the tables: rows of long names that repeat look small where they are dealt, and aren't
    own = {name: [f for f in CORRECTABLE.get(name, ()) if f in df.columns] for name, df in tables.items()}
    every = sorted({f for fields in own.values() for f in fields})
    held, number, legal = None, F.lit(None).cast("int"), F.lit(False)
    for k, (name, df) in enumerate(tables.items()):
        stored = (F.col(f).cast("bigint") if f in own[name] else F.lit(None).cast("bigint") for f in every)
        part = df.select(F.lit(k).alias("__table"), F.col("row_id").alias("target_id"), *(c.alias(f"__{f}") for c, f in zip(stored, every)))
        held = part if held is None else held.unionByName(part)
        number = F.when(F.col("target_table") == name, k).otherwise(number)
        legal = legal | ((F.col("target_table") == name) & F.col("field").isin(*own[name]))
    place = ["target_table", "target_id", "field"]
    known = corrections.withColumn("__table", number).join(held.withColumn("__there", F.lit(True)), ["__table", "target_id"], "left")
    known = known.withColumn("stored", F.coalesce(*(F.when(F.col("field") == f, F.col(f"__{f}")) for f in every), F.lit(None).cast("bigint"))).drop(*(f"__{f}" for f in every))
    known = known.withColumn("error", F.when(~F.coalesce(legal, F.lit(False)), "22023").when(F.col("__there").isNull(), "P0002"))
    before = F.lag(F.struct("new_value")).over(Window.partitionBy(*place).orderBy("ordinal"))
    good = known.where("error is null").withColumn("__before", before)
    good = good.withColumn("old_value", F.when(F.col("__before").isNull(), F.col("stored")).otherwise(F.col("__before.new_value")))
    columns = ["ordinal", *place, "old_value", "new_value", "error"]
    audit = good.select(*columns).unionByName(known.where("error is not null").withColumn("old_value", F.lit(None).cast("bigint")).select(*columns))
    last = known.where("error is null").groupBy(*place).agg(F.max_by(F.struct("new_value"), "ordinal").alias("fixed"))
    out = {}
    for name, df in tables.items():
        fields = own[name]
        fixed = last.where(F.col("target_table") == name).groupBy(F.col("target_id").alias("row_id"))
        fixed = fixed.agg(*(F.max(F.when(F.col("field") == f, F.col("fixed"))).alias(f"__{f}") for f in fields))
        value = lambda f: F.when(F.col(f"__{f}").isNull(), F.col(f)).otherwise(F.col(f"__{f}.new_value").cast(df.schema[f].dataType))  # noqa: B023, E731
        out[name] = df.join(fixed, "row_id", "left").withColumns({f: value(f) for f in fields}).select(*df.columns)
    return out, audit


def apply_correction(target: DataFrame, corrections: DataFrame, field: str = "points") -> tuple[DataFrame, DataFrame]:
    """`apply_corrections` for a table (row_id, value) of one field's values."""
    table = next(name for name, fields in CORRECTABLE.items() if field in fields)
    out, audit = apply_corrections({table: target.withColumnRenamed("value", field)}, corrections.withColumn("target_table", F.lit(table)))
    return out[table].withColumnRenamed(field, "value"), audit.select("target_id", "field", "old_value", "new_value", "error")


def merge_players(rows: DataFrame, mapping: DataFrame, keys: list[str], policy: str, value: str, version: str) -> DataFrame:
    """Rows after players are merged by (player_id, canonical_id): where two rows of a key meet, `keep` keeps the
    canonical's, `latest` the one with the largest version, `max` the largest value. Versions are numbers."""
    moved = rows.join(mapping, "player_id", "left").withColumn("own", F.col("canonical_id").isNull()).withColumn("player_id", F.coalesce("canonical_id", "player_id")).drop("canonical_id")
    order = {"keep": F.struct("own", -F.col(version)), "latest": F.struct(version), "max": F.struct(value, -F.col(version))}[policy]
    return best_by(moved, [*keys, "player_id"], order).drop("own")
