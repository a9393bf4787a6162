"""Parameterised reads: paging, searches, histories, rolling windows, row-level visibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from muster.functions.formats import event_time
from muster.functions.times import window_start
from muster.operators import views
from muster.sources.domain import Domain


def day(at: str) -> Column:
    return F.date_format(at, "yyyy-MM-dd")


def latest_events(d: Domain, alliance_id: int, n: int = 20) -> DataFrame:
    """The latest events of an alliance, each with its import delta (all of them, however many are listed)."""
    top = d.events.where(F.col("alliance_id") == alliance_id).orderBy(F.desc("event_dt"), "event_id").limit(n)
    delta = views.event_import_delta(d).where(F.col("alliance_id") == alliance_id).select("event_id", "imported", "delta", "coverage_pct")
    return top.join(delta, "event_id", "left").select("event_id", day("event_dt").alias("event_date"), "event_type", "total_battlers", "imported", "delta", "coverage_pct")


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page `number`, from 0, of rows in a total order, with the number of pages (1 at least)."""
    pages = F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("bigint").alias("pages")
    return rows.orderBy(*order).offset(number * size).limit(size).crossJoin(F.broadcast(rows.agg(pages)))  # one row


def player_history(d: Domain, player_id: int, alliance_id: int) -> DataFrame:
    """A player's participations; the event is embedded where it belongs to the alliance, else null, and the row stays."""
    own = d.participations.where(F.col("player_id") == player_id).select("participation_id", "event_id", "points", "power")
    event = d.events.where(F.col("alliance_id") == alliance_id).select("event_id", F.struct(F.col("event_type").alias("event_type"), day("event_dt").alias("event_date")).alias("event"))
    joined = own.join(event, "event_id", "left")
    return joined.select("participation_id", "points", "power", F.col("event.event_type").alias("event_type"), F.col("event.event_date").alias("event_date"))


def donation_history(d: Domain, alliance_id: int, n: int) -> DataFrame:
    """Each player's last `n` donations; only donations of the alliance's periods count (an inner embed)."""
    periods = d.donations.where(F.col("alliance_id") == alliance_id).select("period_id").distinct()
    recent = F.row_number().over(Window.partitionBy("player_id").orderBy(F.desc("period_start"), "donation_id"))
    return d.donations.join(periods, "period_id", "left_semi").withColumn("n", recent).where(F.col("n") <= n).select("player_id", "period_id", "honor", F.col("n").cast("bigint").alias("n"))


def find_player(d: Domain, alliance_id: int, text: str) -> DataFrame:
    """none, found or ambiguous: an exact name without regard to case, else names that contain the text (5 at most)."""
    own = d.roster.where(F.col("alliance_id") == alliance_id)
    exact = own.where(F.lower("player_name") == text.lower()).withColumn("pass", F.lit(1))
    part = own.where(F.contains(F.lower("player_name"), F.lit(text.strip().lower()))).withColumn("pass", F.lit(2))
    both = exact.unionByName(part).withColumn("best", F.min("pass").over(Window.partitionBy("alliance_id"))).where("pass = best")
    rows = both.orderBy("player_name", "player_id").limit(5)
    n = F.count("*")
    return rows.agg(F.when(n == 0, "none").when(n == 1, "found").otherwise("ambiguous").alias("status"), n.alias("matches"), F.min("player_id").alias("first_player"))


def events_since(d: Domain, key: str) -> DataFrame:
    """Events of each alliance in a rolling window that ends with the latest event of all."""
    now = d.events.agg(F.max("event_dt").alias("now"))
    e = d.events.crossJoin(F.broadcast(now))  # one row
    start = window_start(F.lit(key), F.col("now"))
    return e.where(start.isNull() | (F.col("event_dt") >= start)).groupBy("alliance_id").agg(F.count("*").alias("events"))


def period_participation(d: Domain) -> DataFrame:
    """Share of an alliance's events of the year of the latest event that each player took part in; null without events."""
    now = d.events.agg(F.max("event_dt").alias("now"))
    recent = lambda t: t.crossJoin(F.broadcast(now)).where(F.col("event_dt") >= window_start(F.lit("ytd"), F.col("now")))
    of = recent(d.events).groupBy("alliance_id").agg(F.count("*").alias("events"))
    own = recent(d.participations).groupBy("player_id").agg(F.countDistinct("event_id").alias("played"))
    out = d.roster.join(of, "alliance_id", "left").join(own, "player_id", "left").withColumn("played", F.coalesce("played", F.lit(0)))
    rate = F.round(F.col("played") * 100 / F.nullif(F.col("events"), F.lit(0)), 1)
    return out.select("player_id", "events", "played", rate.alias("rate_pct"))


def current_or_latest_period(d: Domain, current: str) -> DataFrame:
    """Of each alliance the period that starts on `current`, else its most recent one."""
    p = d.donations.select("alliance_id", "period_id", "period_start").distinct()
    order = Window.partitionBy("alliance_id").orderBy(F.when(F.col("period_start") == F.lit(current).cast("date"), 0).otherwise(1), F.desc("period_start"))
    return p.withColumn("n", F.row_number().over(order)).where("n = 1").select("alliance_id", "period_id")


def secured(rows: DataFrame, acl: DataFrame, user: str) -> DataFrame:
    """The rows that a user may see: those of alliances of which they are a member. Apply below every view."""
    return rows.join(acl.where(F.col("user_id") == user).select("alliance_id").distinct(), "alliance_id", "left_semi")


def nulls_last(column: str, descending: bool, text: bool = False) -> Column:
    """Sort key of the tables: nulls last both ways, text by the Unicode collation."""
    c = F.collate(F.col(column), "UNICODE") if text else F.col(column)
    return c.desc_nulls_last() if descending else c.asc_nulls_last()


def find_by_pattern(rows: DataFrame, column: str, typed: str, n: int) -> DataFrame:
    """Rows whose column contains what was typed, without regard to case, in its order; all of them for blank input.
    Percent signs and underscores stand for themselves."""
    t = typed.strip()
    return (rows.where(F.contains(F.lower(column), F.lit(t.lower()))) if t else rows).orderBy(column).limit(n)


def suggest_players(d: Domain, alliance_id: int, typed: str, n: int = 25) -> DataFrame:
    """Choices for a name that is being typed: label of 100 characters at most, and id; blank names are left out."""
    own = d.roster.where(F.col("alliance_id") == alliance_id).select("player_name", "player_id")
    found = find_by_pattern(own, "player_name", typed, n).where("trim(player_name) <> ''")
    return found.select(F.left("player_name", F.lit(100)).alias("label"), "player_id")


def suggest_events(d: Domain, alliance_id: int, typed: str, pool: int = 50, n: int = 25) -> DataFrame:
    """Choices for an event: of the latest `pool` events those whose label contains what was typed. The pool is cut
    before the search, as typing only narrows what is on offer."""
    latest = d.events.where(F.col("alliance_id") == alliance_id).orderBy(F.desc("event_dt"), "event_id").limit(pool)
    label = F.left(F.concat_ws(" — ", "event_type", event_time("event_dt")), F.lit(100))
    rows = latest.select("event_id", "event_dt", label.alias("label"))
    return rows.where(F.contains(F.lower("label"), F.lit(typed.strip().lower()))).orderBy(F.desc("event_dt"), "event_id").limit(n).select("event_id", "label")


def suggest_types(event_types: DataFrame, typed: str, n: int = 25) -> DataFrame:
    """Event types whose code or display name contains what was typed, by code."""
    t = F.lit(typed.strip().lower())
    found = event_types.where(F.contains(F.lower("code"), t) | F.contains(F.lower("display_name"), t)).orderBy("code").limit(n)
    return found.select(F.concat(F.col("display_name"), F.lit(" ("), F.col("code"), F.lit(")")).alias("label"), F.col("code").alias("value"))


def by_id_prefix(rows: DataFrame, id_col: str, prefix: str) -> DataFrame:
    """Rows whose id, as text, begins with a prefix; a percent sign is a character like any other."""
    return rows.where(F.startswith(F.col(id_col).cast("string"), F.lit(prefix)))


class NotSingle(ValueError):
    """A read of a single row met none or several."""


def single(rows: DataFrame, optional: bool = False) -> Row | None:
    """The only row; an error for several, and for none unless `optional`, which gives None. Two rows are read at most."""
    found = rows.limit(2).collect()
    if len(found) > 1 or not found and not optional:
        raise NotSingle(f"{len(found) or 'no'} rows where one is expected")
    return found[0] if found else None


def review_order(rows: DataFrame) -> DataFrame:
    """The worst reads first: by confidence, unknown before all, then the latest."""
    return rows.orderBy(F.asc_nulls_first("confidence"), F.desc("label"), "kind", "row_id")


def review_page(d: Domain, alliance_id: int, n: int) -> DataFrame:
    return review_order(views.needs_review(d).where(F.col("alliance_id") == alliance_id)).limit(n)


def rates_in_order(d: Domain, alliance_id: int) -> DataFrame:
    """Participation rates of an alliance, the highest first, unknown ones last."""
    return views.participation_rate(d).where(F.col("alliance_id") == alliance_id).orderBy(nulls_last("participation_pct", True), "player_id")


def with_place(rows: DataFrame, keys: list[str], order: list[Column], n: int | None = None) -> DataFrame:
    """Rows with their place (from 1) in the order of their group; the first `n` only, if given."""
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    return placed if n is None else placed.where(F.col("place") <= n)


def history_by_event(d: Domain, player_id: int, alliance_id: int) -> DataFrame:
    """A player's participations ordered by the time of the embedded event, those without one last."""
    return player_history(d, player_id, alliance_id).orderBy(F.asc_nulls_last("event_date"), "participation_id")


def sorted_board(rows: DataFrame, column: str, descending: bool) -> DataFrame:
    """An event's board by a numeric column: what is unknown counts as the smallest where the largest come first and as
    the largest where the smallest do, so it is last both ways."""
    bound = F.lit(float("-inf") if descending else float("inf"))
    key = F.coalesce(F.col(column).cast("double"), bound)
    return rows.orderBy(key.desc() if descending else key.asc(), "player_id")


def top_scorers(d: Domain, n: int = 3) -> DataFrame:
    """The `n` best of each event; unknown points count as none."""
    rows = d.participations.select("event_id", "player_id", "points")
    return with_place(rows, ["event_id"], [F.coalesce("points", F.lit(0)).desc(), F.asc("player_id")], n)


def top_donors(d: Domain, n: int = 3) -> DataFrame:
    return with_place(d.donations.select("period_id", "player_id", "honor"), ["period_id"], [F.desc("honor"), F.asc("player_id")], n)


def top_attackers(d: Domain, n: int = 5) -> DataFrame:
    """The `n` strongest of each day of posts among rows with some stat; an unknown attack counts as none."""
    rows = d.stats.where("attack_pct is not null or hp_pct is not null or defense_pct is not null")
    rows = rows.select("alliance_id", F.col("recorded_date").cast("string").alias("recorded_date"), "player_id", F.col("attack_pct").cast("double").alias("attack_pct"))
    return with_place(rows, ["alliance_id", "recorded_date"], [F.coalesce("attack_pct", F.lit(0)).desc(), F.asc("player_id")], n)


def first_rows(rows: DataFrame, order: list[Column], all_: bool = False, n: int = 50) -> DataFrame:
    """The first `n` rows of a long table, or all of them."""
    return rows.orderBy(*order) if all_ else rows.orderBy(*order).limit(n)


def recent_participations(rows: DataFrame, player_id: int, n: int = 5) -> DataFrame:
    """A player's last participations in the order in which they were taken in (`created_at`), whenever they were played."""
    return rows.where(F.col("player_id") == player_id).orderBy(F.desc("created_at"), F.desc("participation_id")).limit(n)


def series(d: Domain, player_id: int, value: str) -> DataFrame:
    """A player's values over time for a chart, without unknown ones."""
    own = d.participations.where((F.col("player_id") == player_id) & F.col(value).isNotNull())
    return own.select(day("event_dt").alias("event_date"), F.col(value).alias("value")).orderBy("event_date")


def secured_by_parent(rows: DataFrame, parents: DataFrame, key: str, acl: DataFrame, user: str) -> DataFrame:
    """The rows that a user may see of a table that knows its alliance only through a parent."""
    return rows.join(secured(parents, acl, user).select(key).distinct(), key, "left_semi")
