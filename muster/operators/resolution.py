"""Names of a batch of captures resolved in order of arrival, as if captures were worked on one after the other.

A capture sees the roster and the aliases that all captures before it have left: a name that one capture makes a player is
a candidate for every later one, and a variant that was once credited is an alias from then on. What a name comes to
depends only on names one edit away that arrived earlier; so a batch is a graph of such names, and names are settled in
rounds, each of which settles all names whose earlier neighbours are settled. There are as many rounds as the longest
chain of names has in which each is a variant of one that came before it and may have made a player; most names have no
such neighbour at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.functions.names import name_key
from muster.operators.duplicates import resolve, within_one
from muster.operators.kept import kept, unsent

NAME = ["alliance_id", "raw_name"]


@dataclass
class Resolved:
    """rows: (alliance_id, raw_name, capture, resolution, player_id); created: (alliance_id, raw_name, player_id, capture) of
    players that the batch makes; aliases: the same of aliases that it adds."""

    rows: DataFrame
    created: DataFrame
    aliases: DataFrame


def _attempts(seen: DataFrame, first: DataFrame) -> DataFrame:
    """The captures at which an unknown name is looked up until it makes a player: all that make none, up to the first that
    does. With how many players of the roster are one edit away (two for more), and the only one."""
    made = seen.where("creates").groupBy(*NAME).agg(F.min("capture").alias("made_at"))
    open_ = first.where("resolution in ('fuzzy', 'ambiguous', 'new')")
    near = F.when(F.col("resolution") == "fuzzy", 1).when(F.col("resolution") == "ambiguous", 2).otherwise(0)
    rows = seen.join(unsent(open_.select(*NAME, near.alias("near"), F.col("player_id").alias("near_id"))), NAME).join(unsent(made), NAME, "left")
    return rows.where("made_at is null or capture <= made_at")


def _verdicts(attempts: DataFrame, edges: DataFrame | None, settled: DataFrame | None) -> DataFrame:
    """Attempts with `verdict`: one, many or none candidates, null where that isn't known yet; and the only candidate."""
    if edges is None:
        n, open_, id_ = F.col("near"), F.lit(0), F.col("near_id")
        rows = attempts
    else:
        found = edges.join(unsent(settled.withColumnRenamed("raw_name", "earlier")), ["alliance_id", "earlier"], "left")
        found = found.groupBy(*NAME, "capture").agg(F.count_if("is_new").alias("n_new"), F.count_if(F.col("is_new").isNull()).alias("n_open"), F.min(F.when(F.col("is_new"), F.col("earlier_id"))).alias("new_id"))
        rows = attempts.join(unsent(found), [*NAME, "capture"], "left")
        n, open_, id_ = F.col("near") + F.coalesce("n_new", F.lit(0)), F.coalesce("n_open", F.lit(0)), F.coalesce("near_id", "new_id")
    verdict = F.when(n >= 2, "many").when((open_ == 0) & (n == 1), "one").when((open_ == 0) & (n == 0), "none")
    return rows.withColumn("verdict", verdict).withColumn("candidate", F.when(F.col("verdict") == "one", id_)).select(*attempts.columns, "verdict", "candidate")


def _settled(verdicts: DataFrame) -> DataFrame:
    """Names of which it is known whether they make a player: those that match one at any attempt don't."""
    names = verdicts.groupBy(*NAME).agg(F.max(F.col("verdict").eqNullSafe("one")).alias("matched"), F.max(F.col("verdict").isNull()).alias("open"), F.max("made_at").isNotNull().alias("makes"))
    return names.where("matched or not open").select(*NAME, (~F.col("matched") & F.col("makes")).alias("is_new"))


def resolve_in_order(seen: DataFrame, roster: DataFrame, aliases: DataFrame, shortest: int) -> Resolved:
    """`seen`: (alliance_id, raw_name, capture, creates), a row for each capture that shows a name; captures that don't
    create players (`creates` false) leave aliases alone. A new player's id is a hash of alliance and name."""
    seen = kept(seen.groupBy(*NAME, "capture").agg(F.max("creates").alias("creates")))
    first = kept(resolve(seen.select(*NAME), roster, aliases, shortest))
    attempts = kept(_attempts(seen, first))
    own_id = F.xxhash64("alliance_id", "raw_name")
    # a name of five characters or more, and those one edit away that made a player earlier, if they did
    keyed = attempts.select(*NAME, "made_at").distinct().withColumn("key", name_key(F.col("raw_name"))).where(F.length("key") >= shortest).withColumn("id", F.col("raw_name"))
    near = within_one(keyed, keyed.where("made_at is not null"), ["alliance_id"]).where("l_id <> r_id")
    near = near.select("alliance_id", F.col("l_id").alias("raw_name"), F.col("r_id").alias("earlier"))
    made = attempts.where("capture = made_at").select("alliance_id", F.col("raw_name").alias("earlier"), F.col("made_at").alias("earlier_at"), own_id.alias("earlier_id"))
    edges = near.join(unsent(made), ["alliance_id", "earlier"]).join(unsent(attempts.select(*NAME, "capture")), NAME).where("earlier_at < capture")
    edges = kept(edges.select(*NAME, "capture", "earlier", "earlier_id"))
    edges = _telling(attempts, edges)
    if edges.isEmpty():
        verdicts = _verdicts(attempts, None, None)
    else:
        names = attempts.select(*NAME).distinct().count()
        settled = kept(_settled(_verdicts(attempts.join(edges, [*NAME, "capture"], "left_anti"), None, None).unionByName(_open(attempts, edges))))
        while settled.count() < names:
            settled = kept(_settled(_verdicts(attempts, edges, settled)))
        verdicts = kept(_verdicts(attempts, edges, settled))
    aliased = verdicts.where("verdict = 'one'").groupBy(*NAME).agg(F.min("capture").alias("aliased_at"), F.min_by("candidate", "capture").alias("alias_id"))
    new = verdicts.where("capture = made_at").join(aliased, NAME, "left_anti").select(*NAME, F.col("capture").alias("new_at"))
    at = F.col("capture")
    known = F.col("resolution").isin("alias", "exact")
    credited, exists = F.coalesce(at >= F.col("aliased_at"), F.lit(False)), F.coalesce(at >= F.col("new_at"), F.lit(False))
    label = (
        F.when(known, F.col("resolution")).when(credited & (at == F.col("aliased_at")), "fuzzy").when(credited, "alias")
        .when(exists & (at > F.col("new_at")), "exact").when(F.col("verdict") == "many", "ambiguous").otherwise("new")
    )
    player = F.when(known, F.col("player_id")).when(credited, F.col("alias_id")).otherwise(own_id)
    rows = seen.join(unsent(first), NAME).join(unsent(verdicts.select(*NAME, "capture", "verdict")), [*NAME, "capture"], "left").join(unsent(aliased), NAME, "left").join(unsent(new), NAME, "left")
    rows = kept(rows.select(*NAME, "capture", label.alias("resolution"), player.alias("player_id")))
    added = aliased.select(*NAME, F.col("alias_id").alias("player_id"), F.col("aliased_at").alias("capture"))
    return Resolved(rows, new.select(*NAME, own_id.alias("player_id"), F.col("new_at").alias("capture")), added)


def _telling(attempts: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges from names that may make a player. A name with one player of the roster one edit away makes one only if an
    earlier neighbour has; so only names that others lead to, from one without or with several such players, are asked about."""
    reached = kept(attempts.where("near <> 1").select(*NAME).distinct())
    n, before = reached.count(), 0
    while n > before:
        led = edges.join(unsent(reached.withColumnRenamed("raw_name", "earlier")), ["alliance_id", "earlier"], "left_semi").select(*NAME)
        reached = kept(reached.unionByName(led).distinct())
        n, before = reached.count(), n
    return kept(edges.join(unsent(reached.withColumnRenamed("raw_name", "earlier")), ["alliance_id", "earlier"], "left_semi"))


def _open(attempts: DataFrame, edges: DataFrame) -> DataFrame:
    """Attempts with earlier neighbours, none of which is settled yet: only more than one player of the roster decides."""
    rows = attempts.join(unsent(edges.select(*NAME, "capture").distinct()), [*NAME, "capture"])
    none = F.lit(None).cast(attempts.schema["near_id"].dataType)
    return rows.select(*attempts.columns, F.when(F.col("near") >= 2, "many").alias("verdict"), none.alias("candidate"))
