"""Roster maintenance: renames, memberships, aliases, cascades, and rewrites of stored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.operators.kept import kept
from muster.operators.upsert import best_by, latest_wins


def rename_plan(roster: DataFrame, normal: Column) -> DataFrame:
    """Players whose normalised name differs: rename, or collision where another player has that name already or several
    would take it. A player moving away does not free its name in the same plan."""
    keys = ["alliance_id", "new_name"]
    wanted = roster.withColumn("new_name", normal).where("new_name <> player_name and new_name <> ''")
    taken = roster.select("alliance_id", F.col("player_name").alias("new_name"), F.lit(True).alias("taken")).distinct()
    several = wanted.groupBy(*keys).agg((F.count("*") > 1).alias("several"))
    out = wanted.join(taken, keys, "left").join(several, keys)
    clash = F.coalesce("taken", F.lit(False)) | F.col("several")
    return out.select("player_id", "alliance_id", "player_name", "new_name", F.when(clash, "collision").otherwise("rename").alias("action"))


def tagged_names(roster: DataFrame) -> DataFrame:
    """Players whose name starts with a tag in brackets: the tag, the bare name, and the player of that name if there is one."""
    pattern = r"^\s*[\[(]\s*([A-Za-z0-9]{1,5})\s*[\])]\s*(\S.*?)\s*$"
    found = roster.where(F.col("player_name").rlike(pattern)).select(
        "player_id", "alliance_id", F.regexp_extract("player_name", pattern, 1).alias("tag"), F.regexp_extract("player_name", pattern, 2).alias("new_name")
    )
    other = roster.groupBy("alliance_id", F.col("player_name").alias("new_name")).agg(F.min("player_id").alias("canonical_id"))
    return found.join(other, ["alliance_id", "new_name"], "left").withColumn("action", F.when(F.col("canonical_id").isNotNull(), "merge").otherwise("rename"))


def leave(memberships: DataFrame, leavers: DataFrame) -> DataFrame:
    """Closes the latest active membership of each leaver (alliance_id, player_id, left_at)."""
    keys = ["alliance_id", "player_id"]
    active = memberships.where("left_at is null")
    latest = best_by(active, keys, F.struct("joined_at")).select(*keys, "joined_at").join(leavers.withColumnRenamed("left_at", "closes"), keys)
    return memberships.join(latest, [*keys, "joined_at"], "left").withColumn("left_at", F.coalesce("left_at", "closes")).drop("closes")


def set_aliases(aliases: DataFrame, changes: DataFrame) -> DataFrame:
    """Applies (alliance_id, raw_name, player_id, ordinal) in order; a null player removes the alias."""
    return latest_wins(aliases, changes, ["alliance_id", "raw_name"]).where("player_id is not null")


def append_if_absent(array: Column, value: Column) -> Column:
    known = F.coalesce(array, F.array().cast("array<string>"))
    return F.when(F.array_contains(known, value), known).otherwise(F.array_append(known, value))


def cascade(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """What is left of children once their parents' table is what it is; children without a parent key stay."""
    return children.where(F.col(key).isNull()).unionByName(children.join(parents.select(key).distinct(), key, "left_semi"))


def orphans(roster: DataFrame, *uses: DataFrame) -> DataFrame:
    """Players that no table of uses mentions."""
    for u in uses:
        roster = roster.join(u.select("player_id").distinct(), "player_id", "left_anti")
    return roster


def join_alliance(memberships: DataFrame, joiners: DataFrame) -> DataFrame:
    """Memberships after players joined (alliance_id, player_id, joined_at, ordinal): one that began at the same instant is
    open again, any other is a new row."""
    return latest_wins(memberships, joiners.withColumn("left_at", F.lit(None).cast(memberships.schema["left_at"].dataType)), ["alliance_id", "player_id", "joined_at"], ["left_at"])


def list_aliases(aliases: DataFrame, roster: DataFrame, alliance_id: int) -> DataFrame:
    """An alliance's aliases with the names of their players, by raw name."""
    own = aliases.where(F.col("alliance_id") == alliance_id).join(roster.select("player_id", "player_name"), "player_id", "left")
    return own.select("raw_name", "player_id", "player_name").orderBy("raw_name")


def delete_where(rows: DataFrame, gone: Column) -> DataFrame:
    """Rows without those for which `gone` holds; unknown is not gone."""
    return rows.where(~F.coalesce(gone, F.lit(False)))


def insert_rows(rows: DataFrame, new: DataFrame, id_col: str = "event_id") -> DataFrame:
    """Rows with new ones under ids of their own, above all present ones: a new row's id follows from its `ordinal`, of
    which no two are equal."""
    top = rows.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("__top"))  # one row
    made = new.crossJoin(F.broadcast(top)).withColumn(id_col, (F.col("__top") + 1 + F.col("ordinal")).cast(rows.schema[id_col].dataType))
    return rows.unionByName(made.select(*(F.col(c) if c in made.columns else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns)))


def update_rows(rows: DataFrame, changes: DataFrame, id_col: str = "event_id") -> DataFrame:
    """Rows with the columns of `changes` (an id, columns, an ordinal) replaced where an id is there; others are ignored."""
    known = changes.join(rows.select(id_col), id_col, "left_semi")
    return latest_wins(rows, known, [id_col])


def delete_and_restore(rows: DataFrame, gone: Column, id_col: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """Rows without those that are gone, and rows with them inserted again under new ids, as an undo does. A new id is the
    largest one plus the old: no two meet, and no row has to be numbered."""
    kept = delete_where(rows, gone)
    back = rows.where(gone).withColumn("ordinal", F.col(id_col) - 1)
    top = rows.agg(F.max(id_col).alias("__top"))  # one row
    again = back.crossJoin(F.broadcast(top)).withColumn(id_col, (F.col("__top") + F.col(id_col)).cast(rows.schema[id_col].dataType)).select(*rows.columns)
    return kept, kept.unionByName(again)


def final_targets(mapping: DataFrame) -> DataFrame:
    """(player_id, canonical_id) where every canonical player stays: chains of merges are followed to their ends, by
    doubling, so a chain of n merges takes log n joins. Merges that lead back to themselves are refused."""
    to = kept(mapping.select("player_id", "canonical_id").where("player_id <> canonical_id").groupBy("player_id").agg(F.min("canonical_id").alias("canonical_id")))
    n = to.count()
    for _ in range(max(1, n.bit_length() + 1)):
        further = to.select(F.col("player_id").alias("canonical_id"), F.col("canonical_id").alias("__next"))
        moved = to.join(further, "canonical_id", "left")
        if moved.where("__next is not null").isEmpty():
            return to
        to = kept(moved.select("player_id", F.coalesce("__next", "canonical_id").alias("canonical_id")))
    raise ValueError("merges lead back to a player that is merged")


def merge_duplicate_players(tables: dict[str, DataFrame], mapping: DataFrame) -> dict[str, DataFrame]:
    """Players merged by (player_id, canonical_id): `roster`, `participations` (event_id), `memberships` (joined_at),
    `aliases`, `corrections` and `donations` after it.

    Participations and memberships go to the canonical player, unless that one has a row of the same event or start:
    then the duplicate's row is dropped, of several duplicates' rows the one with the smallest player stays. The
    duplicate's name becomes an alias; its corrections name the canonical player; its donations go with it.
    """
    to = final_targets(mapping)
    gone = to.select("player_id")

    def moved(rows: DataFrame, keys: list[str]) -> DataFrame:
        joined = rows.withColumn("__old", F.col("player_id")).join(to, "player_id", "left")
        joined = joined.withColumn("__own", F.col("canonical_id").isNull()).withColumn("player_id", F.coalesce("canonical_id", "player_id")).drop("canonical_id")
        return best_by(joined, [*keys, "player_id"], F.struct("__own", -F.col("__old"))).select(*rows.columns)

    roster = tables["roster"]
    named = roster.join(to, "player_id").select("alliance_id", F.col("player_name").alias("raw_name"), F.col("canonical_id").alias("player_id"), F.lit(0).cast("bigint").alias("ordinal"))
    pointed = lambda rows: rows.join(to, "player_id", "left").withColumn("player_id", F.coalesce("canonical_id", "player_id")).select(*rows.columns)
    return tables | {
        "roster": roster.join(gone, "player_id", "left_anti"),
        "participations": moved(tables["participations"], ["event_id"]),
        "memberships": moved(tables["memberships"], ["alliance_id", "joined_at"]),
        "aliases": latest_wins(pointed(tables["aliases"]), named, ["alliance_id", "raw_name"]),
        "corrections": pointed(tables["corrections"]),
        "donations": tables["donations"].join(gone, "player_id", "left_anti"),
    }


def merged_roster(roster: DataFrame, mapping: DataFrame) -> DataFrame:
    """Players after duplicates (player_id, canonical_id) are merged: the canonical one has the largest power and the
    latest sight of all, and the rank of the one seen last (its own on ties and where nobody was seen)."""
    joined = roster.join(final_targets(mapping), "player_id", "left").withColumn("__own", F.col("canonical_id").isNull())
    to = F.coalesce("canonical_id", "player_id")
    best = joined.groupBy(to.alias("player_id")).agg(F.max("last_power").alias("__power"), F.max("last_seen_at").alias("__seen"), F.max_by(F.struct("last_rank"), F.struct("last_seen_at", "__own")).alias("__rank"))
    stay = joined.where("__own").join(best, "player_id")
    return stay.withColumns({"last_power": F.col("__power"), "last_seen_at": F.col("__seen"), "last_rank": F.col("__rank.last_rank")}).select(*roster.columns)


def apply_name_fixes(tables: dict[str, DataFrame], plan: DataFrame) -> dict[str, DataFrame]:
    """Applies a plan of `tagged_names`: renames and merges players whose names hold a tag, and gives their donations the
    tag. Merged participations keep the canonical player's row; of donations in one period the latest wins."""
    merges = plan.where("action = 'merge'").select("player_id", "canonical_id")
    renames = plan.where("action = 'rename'").select("player_id", "new_name")
    tags = plan.select("player_id", "tag")
    donations = tables["donations"].join(tags, "player_id", "left").withColumn("alliance_tag", F.coalesce("alliance_tag", "tag")).drop("tag")
    joined = donations.join(merges, "player_id", "left").withColumn("player_id", F.coalesce("canonical_id", "player_id")).drop("canonical_id")
    merged = merge_duplicate_players(tables, merges)
    roster = merged["roster"].join(renames, "player_id", "left").withColumn("player_name", F.coalesce("new_name", "player_name")).select(*tables["roster"].columns)
    return merged | {"roster": roster, "donations": best_by(joined, ["period_id", "player_id"], F.struct("updated_at", "donation_id")).select(*donations.columns)}


def swap_columns(rows: DataFrame) -> DataFrame:
    """Stored rows whose power and points stand in each other's column: power under 10 000 and points above 100 000."""
    swapped = F.coalesce((F.col("power") < 10_000) & (F.col("points") > 100_000), F.lit(False))
    return rows.withColumns({"power": F.when(swapped, F.col("points")).otherwise(F.col("power")), "points": F.when(swapped, F.col("power")).otherwise(F.col("points")), "swapped": swapped})


def refresh_last_power(roster: DataFrame, repaired: DataFrame) -> DataFrame:
    """Players of rows that `swap_columns` changed take the power of their latest row (by created_at) as last_power."""
    touched = repaired.where("swapped").select("player_id").distinct()
    latest = repaired.join(touched, "player_id", "left_semi").groupBy("player_id").agg(F.max_by(F.struct("power"), "created_at").alias("__p"))
    return roster.join(latest, "player_id", "left").withColumn("last_power", F.when(F.col("__p").isNull(), F.col("last_power")).otherwise(F.col("__p.power"))).select(*roster.columns)


def short_names(roster: DataFrame, participations: DataFrame, longest: int = 3) -> DataFrame:
    """Players with names of `longest` characters at most, and how often they took part."""
    n = participations.groupBy("player_id").agg(F.count("*").alias("n"))
    short = roster.where(F.length("player_name") <= longest)
    return short.join(n, "player_id", "left").select("player_id", "player_name", F.coalesce("n", F.lit(0)).alias("participations"))


def raw_value(raw: Column, path: str) -> Column:
    """A whole number out of a row's stored reading (JSON text); null if it is not there."""
    return F.get_json_object(raw, f"$.{path}").try_cast("bigint")


def stored_value(raw: Column, path: str, kind: str = "bigint") -> Column:
    """A value out of a row's stored reading (a variant); null if it is not there or of another kind."""
    return F.try_variant_get(raw, f"$.{path}", kind)


def reset(tables: dict[str, DataFrame], keep: set[str]) -> dict[str, DataFrame]:
    """Every table emptied but those to keep."""
    return {name: df if name in keep else df.limit(0) for name, df in tables.items()}
