"""The driver's star schema read as alliances, players, events, participations, donations and stat posts.

Nations are alliances, customers players; an event is an alliance's quarter of one order priority, a participation a
customer's orders in it; a donation period is a week of orders, a donation a customer's orders in that week; the event
stream gives stat posts. Confidences, header totals and the sentinel -1 are derived from keys, so that all cases occur.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.operators.kept import kept


def needs_review(confidence: Column) -> Column:
    """Low confidence; -1 marks an accepted correction, which never needs review."""
    return (confidence >= 0) & (confidence < 0.5)


class Domain:
    """Domain tables of one directory, each a DataFrame that reads only the columns it needs."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def alliances(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_nationkey").cast("bigint").alias("alliance_id"), F.col("n_name").alias("alliance_name"))

    @cached_property
    def roster(self) -> DataFrame:
        c = self.raw("customer")
        return c.select(
            F.col("c_custkey").cast("bigint").alias("player_id"),
            F.col("c_nationkey").cast("bigint").alias("alliance_id"),
            F.col("c_name").alias("player_name"),
            (F.round(F.col("c_acctbal") * 100).cast("bigint") * 10).alias("last_power"),
        )

    @cached_property
    def _orders(self) -> DataFrame:
        o = self.raw("orders").select(
            F.col("o_orderkey").cast("bigint").alias("order_key"),
            F.col("o_custkey").cast("bigint").alias("player_id"),
            F.substring("o_orderpriority", 1, 1).alias("event_type"),
            F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),  # whole numbers: sums depend on no order
            F.col("o_orderdate").cast("timestamp").alias("at"),
        )
        return o.join(self.roster.select("player_id", "alliance_id"), "player_id")

    @staticmethod
    def _event_id() -> Column:
        return F.concat_ws("-", F.col("alliance_id").cast("string"), "event_type", F.date_format("event_dt", "yyyy-MM-dd"))

    @cached_property
    def participations(self) -> DataFrame:
        o = self._orders.where("player_id % 17 <> 0").withColumn("event_dt", F.date_trunc("quarter", "at"))
        g = o.groupBy("alliance_id", "event_type", "event_dt", "player_id").agg(
            F.floor(F.sum("cents") / 2500000).cast("bigint").alias("points"), F.max("order_key").alias("k"), F.count("*").alias("n")
        )
        confidence = F.when(F.col("k") % 11 == 0, F.lit(-1.0)).otherwise((F.col("k") % 100) / 100.0)
        return g.select(
            F.col("k").alias("participation_id"), self._event_id().alias("event_id"), "alliance_id", "event_type", "event_dt", "player_id", "points",
            F.when(F.col("k") % 5 > 0, F.col("k") * 1000).alias("power"), confidence.alias("confidence"), needs_review(confidence).alias("needs_review"),
        )

    @cached_property
    def stored_participations(self) -> DataFrame:
        """Participations worked out once, for what reads them from many sides."""
        return kept(self.participations)

    @cached_property
    def events(self) -> DataFrame:
        o = self._orders.withColumn("event_dt", F.date_trunc("quarter", "at")).groupBy("alliance_id", "event_type", "event_dt").agg(F.countDistinct(F.when(F.col("player_id") % 17 != 0, F.col("player_id"))).alias("n"))
        kind = F.col("alliance_id") + F.col("event_type").cast("bigint")
        declared = F.when(kind % 7 == 0, None).otherwise(F.greatest(F.lit(0), F.col("n") + kind % 3 - F.when(kind % 5 == 0, 1).otherwise(0)))
        return o.select(
            self._event_id().alias("event_id"), "alliance_id", "event_type", "event_dt", declared.cast("bigint").alias("total_battlers"),
            F.when(kind % 4 > 0, kind % 30).cast("bigint").alias("alliance_rank"), F.when(kind % 6 > 0, kind * 100000).cast("bigint").alias("total_points"),
        )

    @cached_property
    def players(self) -> DataFrame:
        seen = self.participations.groupBy("player_id").agg(F.max("event_dt").alias("last_seen_at"))
        return self.roster.join(seen, "player_id", "left")

    @cached_property
    def memberships(self) -> DataFrame:
        """One interval a player; every seventh has left."""
        first = self._orders.groupBy("player_id", "alliance_id").agg(F.min("at").alias("joined_at"), F.max("at").alias("last"))
        return first.select("alliance_id", "player_id", "joined_at", F.when(F.col("player_id") % 7 == 0, F.col("last")).alias("left_at"))

    @cached_property
    def donations(self) -> DataFrame:
        o = self._orders.withColumn("period_start", F.date_trunc("week", "at").cast("date"))
        g = o.groupBy("alliance_id", "period_start", "player_id").agg(F.floor(F.sum("cents") / 100).cast("bigint").alias("honor"), F.max("order_key").alias("k"))
        confidence = F.when(F.col("k") % 13 == 0, F.lit(-1.0)).otherwise((F.col("k") % 100) / 100.0)
        return g.select(
            F.col("k").alias("donation_id"), F.concat_ws("-", F.col("alliance_id").cast("string"), F.col("period_start").cast("string")).alias("period_id"), "alliance_id", "period_start",
            "player_id", "honor", (F.col("k") % 50 + 1).alias("leaderboard_position"), confidence.alias("confidence"), needs_review(confidence).alias("needs_review"),
        )

    @cached_property
    def stats(self) -> DataFrame:
        """Per player and day the mean value of three kinds of post, as decimal(8,2), rounded half up."""
        e = self.raw("events").select(
            F.col("user_id").cast("bigint").alias("player_id"), F.col("ts").cast("timestamp").cast("date").alias("recorded_date"),
            "event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"),
        )

        def mean(kind: str) -> Column:
            own = F.when(F.col("event_type") == kind, F.col("cents"))
            hundredths = F.floor((2 * F.sum(own) + F.count(own)) / F.nullif(2 * F.count(own), F.lit(0)))
            return (hundredths / 100).cast("decimal(8,2)")

        g = e.groupBy("player_id", "recorded_date").agg(mean("click").alias("attack_pct"), mean("view").alias("hp_pct"), mean("purchase").alias("defense_pct"))
        return g.join(self.roster.select("player_id", "alliance_id", "player_name"), "player_id")


class Secured(Domain):
    """The tables as a user sees them: alliances and their players are those of the user's memberships (alliance_id,
    user_id), and what hangs on them, also through a parent, follows; so every view on top shows the user's rows alone."""

    def __init__(self, spark: SparkSession, sf_dir: str, acl: DataFrame, user: str):
        super().__init__(spark, sf_dir)
        self.allowed = acl.where(F.col("user_id") == user).select("alliance_id").distinct()

    @cached_property
    def alliances(self) -> DataFrame:
        return Domain(self.spark, self.sf_dir).alliances.join(self.allowed, "alliance_id", "left_semi")

    @cached_property
    def roster(self) -> DataFrame:
        return Domain(self.spark, self.sf_dir).roster.join(self.allowed, "alliance_id", "left_semi")
