"""Reads as screens and commands make them: orders, tops, suggestions, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.functions import formats, numbers, times
from muster.operators import reads, views
from muster.plans.oracles import BOARD, RATE, REVIEW, sql
from muster.plans.registry import query
from muster.sources.domain import Domain


@query("review_order", sql("SELECT kind, row_id, confidence, label FROM (SELECT * REPLACE (CASE WHEN row_id % 5 = 0 THEN NULL ELSE confidence END AS confidence) FROM review WHERE alliance_id = 3) ORDER BY confidence NULLS FIRST, label DESC, kind, row_id LIMIT 40", REVIEW))
def review_order(d: Domain) -> DataFrame:
    rows = views.needs_review(d).where("alliance_id = 3").withColumn("confidence", F.when(F.col("row_id") % 5 > 0, F.col("confidence")))
    return reads.review_order(rows).limit(40).select("kind", "row_id", "confidence", "label")


@query("rates_in_order", sql("SELECT player_id, CASE WHEN eligible_events > 0 THEN CAST(floor((2000 * events_played + eligible_events) / (2.0 * eligible_events)) / 10 AS DOUBLE) END AS participation_pct FROM rates WHERE alliance_id = 3 ORDER BY participation_pct DESC NULLS LAST, player_id LIMIT 30", RATE))
def rates_in_order(d: Domain) -> DataFrame:
    return reads.rates_in_order(d, 3).limit(30).select("player_id", "participation_pct")


@query("names_in_order", sql("SELECT player_id, player_name FROM roster ORDER BY player_name DESC LIMIT 30"))
def names_in_order(d: Domain) -> DataFrame:
    return d.roster.orderBy(reads.nulls_last("player_name", True, text=True)).limit(30).select("player_id", "player_name")


@query("history_by_event", sql("SELECT p.participation_id, strftime(e.event_dt, '%Y-%m-%d') AS event_date FROM parts p LEFT JOIN evs e ON e.event_id = p.event_id AND e.alliance_id = 4 WHERE p.player_id = 4 ORDER BY event_date NULLS LAST, participation_id"))
def history_by_event(d: Domain) -> DataFrame:
    return reads.history_by_event(d, 4, 4).select("participation_id", "event_date")


for name, descending in (("board_best_power", True), ("board_least_power", False)):
    order = f"coalesce(power, CAST('{'-' if descending else ''}inf' AS DOUBLE)) {'DESC' if descending else 'ASC'}"
    query(name, sql(f"SELECT event_id, player_id, power FROM board WHERE alliance_id = 3 ORDER BY {order}, player_id LIMIT 25", BOARD))(
        lambda d, descending=descending: reads.sorted_board(views.event_leaderboard(d, 3).select("event_id", "player_id", "power").dropDuplicates(["player_id", "power", "event_id"]), "power", descending).limit(25)
    )


@query("top_scorers", sql("SELECT event_id, player_id, points, place FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY coalesce(points, 0) DESC, player_id) AS place FROM parts) WHERE place <= 3"))
def top_scorers(d: Domain) -> DataFrame:
    return reads.top_scorers(d)


@query("top_donors", sql("SELECT period_id, player_id, honor, place FROM (SELECT *, row_number() OVER (PARTITION BY period_id ORDER BY honor DESC, player_id) AS place FROM dons) WHERE place <= 3"))
def top_donors(d: Domain) -> DataFrame:
    return reads.top_donors(d)


@query("top_attackers", sql("SELECT alliance_id, recorded_date, player_id, attack_pct, place FROM (SELECT *, row_number() OVER (PARTITION BY alliance_id, recorded_date ORDER BY coalesce(attack_pct, 0) DESC, player_id) AS place FROM stats WHERE attack_pct IS NOT NULL OR hp_pct IS NOT NULL OR defense_pct IS NOT NULL) WHERE place <= 5"))
def top_attackers(d: Domain) -> DataFrame:
    return reads.top_attackers(d)


@query("first_fifty", sql("SELECT donation_id, honor FROM dons ORDER BY honor DESC, donation_id LIMIT 50"))
def first_fifty(d: Domain) -> DataFrame:
    return reads.first_rows(d.donations.select("donation_id", "honor"), [F.desc("honor"), F.asc("donation_id")])


@query("recent_participations", sql("SELECT participation_id, points FROM parts WHERE player_id = 4 ORDER BY participation_id % 1000 DESC, participation_id DESC LIMIT 5"))
def recent_participations(d: Domain) -> DataFrame:
    taken_in = d.participations.withColumn("created_at", F.timestamp_seconds(F.col("participation_id") % 1000))
    return reads.recent_participations(taken_in, 4).select("participation_id", "points")


@query("power_series", sql("SELECT strftime(event_dt, '%Y-%m-%d') AS event_date, power AS value FROM parts WHERE player_id = 4 AND power IS NOT NULL"))
def power_series(d: Domain) -> DataFrame:
    return reads.series(d, 4, "power")


@query("suggest_players", sql("SELECT player_name AS label, player_id FROM roster WHERE alliance_id = 2 AND contains(lower(player_name), '0001') ORDER BY player_name LIMIT 25"))
def suggest_players(d: Domain) -> DataFrame:
    return reads.suggest_players(d, 2, " 0001 ")


@query("suggest_events", sql("SELECT event_id, label FROM (SELECT event_id, event_dt, event_type || ' — ' || strftime((event_dt AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Paris', '%d %b %Y, %H:%M') AS label FROM evs WHERE alliance_id = 2 ORDER BY event_dt DESC, event_id LIMIT 50) WHERE contains(lower(label), 'jul') ORDER BY event_dt DESC, event_id LIMIT 25"))
def suggest_events(d: Domain) -> DataFrame:
    return reads.suggest_events(d, 2, "JUL ")


@query("suggest_types", "SELECT n_name || ' (' || n_nationkey || ')' AS label, CAST(n_nationkey AS VARCHAR) AS value FROM nation WHERE contains(CAST(n_nationkey AS VARCHAR), '1') OR contains(lower(n_name), '1') ORDER BY value LIMIT 25")
def suggest_types(d: Domain) -> DataFrame:
    types = d.alliances.select(F.col("alliance_id").cast("string").alias("code"), F.col("alliance_name").alias("display_name"))
    return reads.suggest_types(types, " 1")


@query("by_id_prefix", sql("SELECT event_id, alliance_id FROM evs WHERE starts_with(event_id, '3-2')"))
def by_id_prefix(d: Domain) -> DataFrame:
    return reads.by_id_prefix(d.events, "event_id", "3-2").select("event_id", "alliance_id")


@query("secured_by_parent", sql("SELECT participation_id FROM parts WHERE alliance_id % 4 = 1"))
def secured_by_parent(d: Domain) -> DataFrame:
    acl = d.alliances.select("alliance_id", F.concat(F.lit("u"), (F.col("alliance_id") % 4).cast("string")).alias("user_id"))
    return reads.secured_by_parent(d.participations.drop("alliance_id"), d.events, "event_id", acl, "u1").select("participation_id")


@query("labels", sql("""SELECT donation_id, 'Week of ' || day(period_start) || strftime(period_start, ' %B %Y') AS week, strftime(period_start, '%d %B %Y') || ' to ' || strftime(period_start + INTERVAL 6 DAY, '%d %B %Y') AS period,
  format('{:,}', honor) AS honor, CASE WHEN confidence IS NULL THEN 'unknown' WHEN confidence < 0.2 THEN 'bad' WHEN confidence < 0.4 THEN 'poor' ELSE 'fair' END AS band FROM dons"""))
def labels(d: Domain) -> DataFrame:
    start = F.col("period_start")
    return d.donations.select("donation_id", formats.week_label(start).alias("week"), formats.period_label(start, F.date_add(start, 6)).alias("period"), formats.honor(F.col("honor")).alias("honor"), formats.confidence_band(F.col("confidence")).alias("band"))


@query("moments", "SELECT event_id, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Paris', '%d %b %Y, %H:%M') AS paris, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Paris', '%d/%m/%Y, %H:%M') AS updated, strftime(ts, '%d %b %Y') AS day, printf('%.1f%%', floor(value * 10 + 0.5) / 10) AS value, CASE WHEN value >= 80 THEN 'good' WHEN value >= 50 THEN 'fair' ELSE 'poor' END AS band FROM (SELECT event_id, ts, CAST(event_id % 1000 AS DOUBLE) / 8 AS value FROM events)")
def moments(d: Domain) -> DataFrame:
    at, value = F.col("ts").cast("timestamp"), (F.col("event_id") % 1000).cast("double") / 8
    return d.raw("events").select("event_id", formats.event_time(at).alias("paris"), formats.updated_at(at).alias("updated"), formats.short_day(at).alias("day"), formats.percent(value).alias("value"), formats.rate_band(value).alias("band"))


@query("parsed_numbers", """SELECT o_orderkey, o_orderkey % 100000 AS number, (o_orderkey % 1000) + 0.5::DOUBLE AS decimal, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 50 END AS cell, 'R' || (o_orderkey % 5 + 1) AS rank, 'Bob' AS ranked,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Bob' ELSE 'Bob 123' END AS name FROM orders""")
def parsed_numbers(d: Domain) -> DataFrame:
    k = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    return d.raw("orders").select(
        "o_orderkey", numbers.parse_number(F.concat(F.lit(" "), F.format_number(k % 100000, 0))).alias("number"), numbers.parse_float(F.concat(text(k % 1000), F.when(k % 2 == 0, ",5").otherwise(" 5"))).alias("decimal"),
        numbers.points_cell(F.when(k % 3 == 0, "--").otherwise(text(k % 50))).alias("cell"), numbers.clean_rank(F.concat(F.lit("x r"), text(k % 5 + 1))).alias("rank"), numbers.strip_leading_rank(F.lit(" 12 Bob")).alias("ranked"),
        numbers.strip_trailing_power(F.when(k % 2 == 0, "Bob 12,345,678").otherwise("Bob 123")).alias("name"),
    )


@query("parsed_times", """SELECT event_id, CASE WHEN event_id % 3 > 0 THEN CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) END AS week, CASE WHEN event_id % 4 > 0 THEN strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') END AS at,
  strftime(TIMESTAMP '2026-01-01' + INTERVAL 1 SECOND * ((event_id % 3) * 86400 + 3661), '%Y-%m-%d %H:%M:%S') AS due, CASE event_id % 4 WHEN 0 THEN '2024-02-24' WHEN 1 THEN '2024-02-01' WHEN 2 THEN '2024-01-01' END AS since FROM events""")
def parsed_times(d: Domain) -> DataFrame:
    k, at = F.col("event_id"), F.col("ts").cast("timestamp")
    paris = F.from_utc_timestamp(at, "Europe/Paris")
    now = F.lit("2024-03-02 00:00:00").cast("timestamp")
    window = F.when(k % 4 == 0, "7d").when(k % 4 == 1, "30d").when(k % 4 == 2, "ytd").otherwise("all")
    clock = F.when(k % 4 > 0, F.date_format(paris, "HH:mm")).otherwise("25:99")
    return d.raw("events").select(
        "event_id", times.parse_week(F.when(k % 3 > 0, F.date_format(at, "yyyy-MM-dd")).otherwise("2024-02-30")).cast("string").alias("week"),
        F.date_format(times.paris_timestamp(F.date_format(paris, "yyyy-MM-dd"), clock), "yyyy-MM-dd HH:mm").alias("at"),
        F.date_format(times.parse_countdown(F.concat((k % 3).cast("string"), F.lit("d:1:1:1")), F.lit("2026-01-01 00:00:00").cast("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("due"),
        F.date_format(times.window_start(window, now), "yyyy-MM-dd").alias("since"),
    )
