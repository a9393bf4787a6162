"""The analytic views: leaderboards, participation, donations, stats, import completeness, review worklists.

Each takes domain tables and returns a DataFrame. Integers that come from averages are rounded half away from zero
before the cast; percentages are rounded in decimal arithmetic; unknown stays null and is never taken for zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.operators.ranking import ranked
from muster.operators.upsert import best_by
from muster.sources.domain import Domain


def whole(value: Column) -> Column:
    return F.round(value).cast("bigint")


def percent(part: Column, of: Column) -> Column:
    """`part` of `of` in percent to one place; null if `of` is null or not positive."""
    share = F.round(part.cast("decimal(18,0)") * 100 / F.when(of > 0, of.cast("decimal(18,0)")), 1)
    return share.cast("double")


def event_leaderboard(d: Domain, alliance_id: int | None = None) -> DataFrame:
    """Ranks within each event by points: ties share a rank and leave a gap."""
    p = d.participations if alliance_id is None else d.participations.where(F.col("alliance_id") == alliance_id)
    named = ranked(p, "event_id", "points").join(d.roster.select("player_id", "player_name"), "player_id")
    return named.select("event_id", "alliance_id", "event_type", F.date_format("event_dt", "yyyy-MM-dd").alias("event_date"), "player_id", "player_name", "points", "power", "confidence", "needs_review", "rank")


def events_from(d: Domain, bounds: DataFrame, strict: bool = False) -> DataFrame:
    """Per player of `bounds` (alliance_id, player_id, at) the number of the alliance's events at `at` or later; only
    later ones, if `strict`.

    Events are counted by alliance and instant before anything is ordered, and bounds are reduced to their different
    instants; one running count over those instants answers all bounds by an equi-join. So what a window orders is
    the instants of an alliance, not its players and events.
    """
    marks = d.events.groupBy("alliance_id", F.col("event_dt").alias("at")).agg(F.count("*").alias("n"))
    asked = bounds.where("at is not null").select("alliance_id", "at", F.lit(0).cast("bigint").alias("n")).distinct()
    instants = marks.unionByName(asked).groupBy("alliance_id", "at").agg(F.sum("n").alias("n"))
    since = F.sum("n").over(Window.partitionBy("alliance_id").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = instants.select("alliance_id", "at", ((since - F.col("n")) if strict else since).cast("bigint").alias("events"))
    return bounds.join(counted, ["alliance_id", "at"]).select("player_id", "events")


def eligible_events(d: Domain) -> DataFrame:
    """Per player the number of the alliance's events since the player was first seen or joined."""
    first = d.participations.groupBy("player_id").agg(F.min("event_dt").alias("first_seen"))
    joined = d.memberships.groupBy("player_id").agg(F.min("joined_at").alias("first_joined"))
    bounds = d.roster.select("player_id", "alliance_id").join(first, "player_id", "left").join(joined, "player_id", "left")
    bounds = bounds.select("alliance_id", "player_id", F.least("first_seen", "first_joined").alias("at"))
    return events_from(d, bounds).withColumnRenamed("events", "eligible")


def participation_rate(d: Domain) -> DataFrame:
    own = d.participations.groupBy("player_id").agg(
        F.countDistinct("event_id").alias("events_played"), F.sum("points").alias("total_points"), whole(F.avg("points")).alias("avg_points"),
        F.max("points").alias("best_points"), F.min("event_dt").alias("first"), F.max("event_dt").alias("last"),
    )
    out = d.roster.select("player_id", "alliance_id", "player_name").join(own, "player_id", "left").join(eligible_events(d), "player_id", "left")
    played, eligible = F.coalesce("events_played", F.lit(0)), F.coalesce("eligible", F.lit(0))
    return out.select(
        "player_id", "alliance_id", "player_name", played.alias("events_played"), eligible.alias("eligible_events"), "total_points", "avg_points", "best_points",
        F.date_format("first", "yyyy-MM-dd").alias("first_event"), F.date_format("last", "yyyy-MM-dd").alias("last_event"), percent(played, eligible).alias("participation_pct"),
    )


def probable_leavers(d: Domain, missed: int = 3) -> DataFrame:
    """Players with an active membership whose alliance has had `missed` events or more since they were last seen.
    Players never seen do not count."""
    active = d.memberships.where("left_at is null").select("player_id").distinct()
    p = d.players.select("player_id", "alliance_id", "player_name", "last_seen_at").join(active, "player_id", "left_semi")
    later = events_from(d, p.select("alliance_id", "player_id", F.col("last_seen_at").alias("at")), strict=True)
    counted = p.join(later.where(F.col("events") >= missed), "player_id")
    return counted.select("player_id", "alliance_id", "player_name", F.date_format("last_seen_at", "yyyy-MM-dd").alias("last_seen"), F.col("events").alias("events_missed"))


def donation_leaderboard(d: Domain) -> DataFrame:
    named = ranked(d.donations, "period_id", "honor").join(d.roster.select("player_id", "player_name"), "player_id")
    return named.select("period_id", "alliance_id", F.col("period_start").cast("string").alias("period_start"), F.date_add("period_start", 6).cast("string").alias("period_end"), "player_id", "player_name", "honor", "leaderboard_position", "rank")


def donation_totals(d: Domain) -> DataFrame:
    own = d.donations.groupBy("player_id").agg(F.countDistinct("period_id").alias("n"), F.sum("honor").alias("s"), F.max("honor").alias("m"), F.avg("honor").alias("a"), F.max("period_start").alias("last"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    out = d.roster.join(own, "player_id", "left")
    return out.select("player_id", "alliance_id", "player_name", zero(F.col("n")).alias("periods"), zero(F.col("s")).alias("total_honor"), F.col("m").alias("best_honor"), zero(F.round("a")).alias("avg_honor"), F.col("last").cast("string").alias("last_period"))


def _stat_columns() -> list[Column]:
    return [F.col("recorded_date").cast("string").alias("recorded_date"), *(F.col(c).cast("double").alias(c) for c in ("attack_pct", "hp_pct", "defense_pct"))]


def stats_latest(d: Domain) -> DataFrame:
    return best_by(stats_history(d), ["alliance_id", "player_id"], F.struct("recorded_date"))


def stats_history(d: Domain) -> DataFrame:
    return d.stats.select("alliance_id", "player_id", "player_name", *_stat_columns())


def event_import_delta(d: Domain) -> DataFrame:
    """Declared against imported participants of each event; unknown stays unknown."""
    p = d.participations.groupBy("event_id").agg(F.count("participation_id").alias("imported"), F.count_if(F.col("points") > 0).alias("scoring"), F.count_if(F.col("needs_review")).alias("flagged"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    e = d.events.join(p, "event_id", "left").withColumn("imported", zero(F.col("imported")))
    return e.select("event_id", "alliance_id", F.date_format("event_dt", "yyyy-MM-dd").alias("event_date"), F.col("total_battlers").alias("declared"), "imported", zero(F.col("scoring")).alias("scoring"), zero(F.col("flagged")).alias("flagged"), (F.col("total_battlers") - F.col("imported")).alias("delta"), percent(F.col("imported"), F.col("total_battlers")).alias("coverage_pct"))


def import_verdict(coverage: Column) -> Column:
    return F.when(coverage.isNull(), "unknown").when(coverage > 100.5, "over").when(coverage >= 99.5, "complete").when(coverage >= 90, "partial").otherwise("poor")


def needs_review(d: Domain) -> DataFrame:
    """Rows to look at, of both kinds; what one kind lacks is null."""
    p = d.participations.where("needs_review").select(
        F.lit("participation").alias("kind"), F.col("participation_id").alias("row_id"), "event_id", F.lit(None).cast("string").alias("period_id"), "alliance_id", "player_id",
        "confidence", F.col("points").alias("value"), "power", F.date_format("event_dt", "yyyy-MM-dd").alias("label"),
    )
    g = d.donations.where("needs_review").select(
        F.lit("donation").alias("kind"), F.col("donation_id").alias("row_id"), F.lit(None).cast("string").alias("event_id"), "period_id", "alliance_id", "player_id",
        "confidence", F.col("honor").alias("value"), F.lit(None).cast("bigint").alias("power"), F.date_format("period_start", "yyyy-MM-dd").alias("label"),
    )
    return p.unionByName(g).join(d.roster.select("player_id", "player_name"), "player_id")


def null_header_report(d: Domain) -> DataFrame:
    """Events whose header lacks something; each missing name is followed by a space."""
    names = ("alliance_rank", "total_battlers", "total_points")
    missing = F.concat(*(F.when(F.col(c).isNull(), f"{c} ").otherwise("") for c in names))
    return d.events.select("event_id", "alliance_id", missing.alias("missing")).where("missing <> ''")


def count_mismatch_report(d: Domain) -> DataFrame:
    p = d.participations.groupBy("event_id").agg(F.count("*").alias("n"))
    e = d.events.join(p, "event_id", "left").select("event_id", F.coalesce("total_battlers", F.lit(0)).alias("declared"), F.coalesce("n", F.lit(0)).alias("recorded"))
    return e.where("recorded <> declared").withColumn("difference", F.col("recorded") - F.col("declared")).orderBy(F.desc(F.abs("difference")), "event_id")
