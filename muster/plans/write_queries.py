"""The write path and upkeep of stored rows, over captures made from the domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.functions.names import duplicate_key
from muster.operators import duplicates, ingestion, maintenance, upsert
from muster.operators.kept import unsent
from muster.plans.oracles import sql
from muster.plans.registry import query
from muster.sources.domain import Domain
from muster.streaming import ingest

MEMBER = "struct<name:string,rank:string,power:bigint,points:bigint,confidence:double,alliance_honor:bigint,alliance_tag:string,leaderboard_position:bigint,attack_pct:double,hp_pct:double,defense_pct:double,attack_kind:string,raw_lines:string>"


def _member(**fields: Column) -> Column:
    kinds = dict(part.split(":") for part in MEMBER[7:-1].split(","))
    return F.struct(*(fields.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in kinds.items()))


def _capture(rows: DataFrame, keys: list[str], **fields) -> DataFrame:
    """Captures out of rows with `member`, one for each group, members in the order of `place`."""
    members = F.transform(F.array_sort(F.collect_list(F.struct("place", "member"))), lambda m: m["member"])
    g = rows.groupBy(*keys).agg(members.alias("members"), F.min("place").alias("ordinal"))
    none = {"error": "string", "event_type": "string", "event_datetime": "timestamp", "period_type": "string", "possible_truncation": "boolean", "expected_rows": "int", "message_at": "timestamp", "alliance_rank": "bigint", "total_battlers": "bigint", "total_points": "bigint"}
    return g.withColumns(fields | {c: F.lit(None).cast(t) for c, t in none.items() if c not in fields and c not in keys})


# outcomes


@query("outcome_routing", """WITH c AS (SELECT o_orderkey AS ordinal, o_custkey % 3 AS alliance_id, o_orderkey % 997 AS file, coalesce((['event', 'donation', 'player_stats'])[o_orderkey % 4 + 1], 'event') AS kind, o_orderkey % 6 AS n, o_orderkey % 10 AS expected,
    CASE WHEN o_orderkey % 11 = 0 THEN 'unknown_event' WHEN o_orderkey % 13 = 0 THEN 'unreadable' END AS error, substr(o_orderpriority, 1, 1) AS type FROM orders),
  s AS (SELECT *, CASE WHEN error = 'unknown_event' THEN 'unknown_event' WHEN error IS NOT NULL THEN 'failed' WHEN kind = 'event' AND ordinal % 5 = 0 THEN 'missing_datetime' END AS early,
    CASE WHEN kind = 'donation' AND ordinal % 3 = 0 THEN 'unsupported_period_type' WHEN kind <> 'event' AND n = 0 THEN 'no_members' WHEN kind <> 'player_stats' AND ordinal % 2 = 0 AND expected > 0 AND n / greatest(expected, 1)::DOUBLE < 0.5 THEN 'possible_truncation_rejected'
    WHEN kind = 'event' AND type = '4' THEN 'unknown_event' ELSE 'processed' END AS late FROM c),
  d AS (SELECT alliance_id, file, min(ordinal) AS done FROM (SELECT alliance_id, file, ordinal FROM s WHERE early IS NULL AND late = 'processed' UNION ALL SELECT 0, k, -1 FROM range(1, 10) r(k)) GROUP BY ALL)
  SELECT ordinal, kind, coalesce(early, CASE WHEN done < ordinal THEN 'duplicate' END, late) AS status, CASE coalesce(early, CASE WHEN done < ordinal THEN 'duplicate' END, late) WHEN 'processed' THEN 'success' WHEN 'duplicate' THEN 'duplicate' WHEN 'unknown_event' THEN 'unknown_event' ELSE 'failed' END AS outcome
  FROM s LEFT JOIN d USING (alliance_id, file)""")
def outcome_routing(d: Domain) -> DataFrame:
    return ingestion.in_order(_routed(d))


def _routed(d: Domain) -> DataFrame:
    k = F.col("ordinal")
    o = d.raw("orders").select(F.col("o_orderkey").alias("ordinal"), (F.col("o_custkey") % 3).alias("alliance_id"), F.substring("o_orderpriority", 1, 1).alias("event_type"))
    kind = F.get(F.array(*(F.lit(x) for x in ("event", "donation", "player_stats", None))), (k % 4).cast("int"))
    members = F.transform(F.slice(F.sequence(F.lit(1), F.lit(6)), F.lit(1), (k % 6).cast("int")), lambda i: _member(name=i.cast("string")))
    c = o.select(
        "*", kind.alias("kind"), F.concat(F.lit("f"), (k % 997).cast("string")).alias("file_hash"), members.alias("members"), (k % 10).cast("int").alias("expected_rows"), (k % 2 == 0).alias("possible_truncation"),
        F.when(k % 11 == 0, "unknown_event").when(k % 13 == 0, "unreadable").alias("error"), F.when(k % 5 > 0, F.timestamp_seconds(k)).alias("event_datetime"), F.when(k % 3 > 0, "weekly").otherwise("daily").alias("period_type"),
    )
    uploads = d.spark.range(1, 10).select(F.lit(0).cast("bigint").alias("alliance_id"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("file_hash"), F.lit("processed").alias("status"))
    types = d.spark.createDataFrame([("1",), ("2",), ("3",), ("5",)], "code string")
    return ingestion.outcomes(c, uploads, types)


@query("outcome_tallies", """SELECT count(*) FILTER (o = 'success') AS success, count(*) FILTER (o = 'duplicate') AS duplicate, count(*) FILTER (o = 'unknown_event') AS unknown_event, count(*) FILTER (o = 'failed') AS failed FROM (
  SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'unknown_event' WHEN o_orderkey % 3 = 0 THEN 'failed' WHEN row_number() OVER (PARTITION BY o_custkey, CASE WHEN o_orderkey % 4 > 0 AND o_orderkey % 3 > 0 THEN 1 ELSE 0 END ORDER BY o_orderkey) > 1 THEN 'duplicate' ELSE 'success' END AS o FROM orders)""")
def outcome_tallies(d: Domain) -> DataFrame:
    k = F.col("ordinal")
    o = d.raw("orders").select(F.col("o_orderkey").alias("ordinal"), F.lit(1).cast("bigint").alias("alliance_id"), F.col("o_custkey").cast("string").alias("file_hash"))
    c = o.select(
        "*", F.lit("event").alias("kind"), F.array(_member(name=F.lit("x"))).alias("members"), F.lit(None).cast("int").alias("expected_rows"), F.lit(False).alias("possible_truncation"), F.lit("1").alias("event_type"),
        F.when(k % 4 == 0, "unknown_event").when(k % 3 == 0, "unreadable").alias("error"), F.timestamp_seconds(k).alias("event_datetime"), F.lit(None).cast("string").alias("period_type"),
    )
    none = d.spark.createDataFrame([], "alliance_id bigint, file_hash string, status string")
    return ingestion.tallies(ingestion.outcomes(c, none, d.spark.createDataFrame([("1",)], "code string")))


# events

#: Captures of events of the domain: every second participation is read again, some of them under a name with a stray letter.
#: Of two fifths of the alliances the files are known; every third alliance's captures are truncated.
EVENT_CAPTURES = """
read0 AS (SELECT *, participation_id AS k FROM parts_r WHERE participation_id % 2 = 0),
caps0 AS (SELECT event_id, alliance_id, event_type, min(k) AS ordinal FROM read0 GROUP BY ALL),
taken AS (SELECT * FROM caps0 WHERE event_type NOT IN ('4', '5') AND alliance_id % 5 > 0 AND alliance_id % 3 > 0),
readings AS (SELECT t.ordinal, r.event_id, r.player_id, r.alliance_id, r.k, CASE WHEN r.k % 7 > 0 THEN r.points + r.k % 4 END AS points, r.power, r.confidence FROM read0 r JOIN taken t USING (event_id))
"""


def _event_state(d: Domain) -> dict[str, DataFrame]:
    none = lambda schema: d.spark.createDataFrame([], schema)
    part = d.stored_participations.where("participation_id % 3 > 0").select(F.col("participation_id").alias("row_id"), "event_id", "player_id", "points", "power", "confidence", "needs_review")
    corrections = d.stored_participations.where("participation_id % 4 = 0").select(F.col("participation_id").alias("target_id"), F.lit("points").alias("field"))
    roster = d.roster.select("alliance_id", "player_id", "player_name", "last_power", F.lit("R0").alias("last_rank"), F.lit(None).cast("timestamp").alias("last_seen_at"))
    return {
        "events": d.events.withColumnRenamed("event_dt", "event_datetime"), "roster": roster, "aliases": none("alliance_id bigint, raw_name string, player_id bigint, created_by string"),
        "memberships": d.memberships, "participations": part, "corrections": corrections,
    }


def _event_decided(d: Domain) -> DataFrame:
    read = d.stored_participations.where("participation_id % 2 = 0").join(unsent(d.roster.select("player_id", "player_name")), "player_id")
    k = F.col("participation_id")
    name = F.when(F.col("player_id") % 5 == 0, F.concat("player_name", F.lit("x"))).otherwise(F.col("player_name"))
    member = _member(name=name, rank=F.lit("R2"), power=F.col("power"), points=F.when(k % 7 > 0, F.col("points") + k % 4), confidence=F.col("confidence"))
    rows = read.select("alliance_id", "event_type", "event_id", "event_dt", k.alias("place"), member.alias("member"))
    c = _capture(rows, ["alliance_id", "event_type", "event_id", "event_dt"], kind=F.lit("event"), file_hash=F.col("event_id"), event_datetime=F.when(F.col("event_type") != "5", F.col("event_dt")), possible_truncation=F.col("alliance_id") % 3 == 0, expected_rows=F.lit(1_000_000))
    uploads = d.alliances.where("alliance_id % 5 = 0").join(d.events.select("alliance_id", "event_id"), "alliance_id").select("alliance_id", F.col("event_id").alias("file_hash"), F.lit("processed").alias("status"))
    return ingestion.outcomes(c, uploads, d.spark.createDataFrame([("1",), ("2",), ("3",), ("5",)], "code string"))


@query("event_upsert", sql("""SELECT event_id, player_id, points, power, confidence, needs_review FROM (
  SELECT event_id, player_id, points, power, confidence, confidence >= 0 AND confidence < 0.5 AS needs_review FROM readings WHERE points IS NOT NULL
  UNION ALL SELECT event_id, player_id, points, power, confidence, needs_review FROM parts_r p WHERE participation_id % 3 > 0 AND NOT EXISTS (SELECT 1 FROM readings r WHERE r.event_id = p.event_id AND r.player_id = p.player_id AND r.points IS NOT NULL))""", EVENT_CAPTURES))
def event_upsert(d: Domain) -> DataFrame:
    state, _ = ingestion.upsert_events(_event_state(d), _event_decided(d), warn=False)
    return state["participations"].select("event_id", "player_id", "points", "power", "confidence", "needs_review")


@query("event_upsert_players", sql("""SELECT r.player_id, CASE WHEN s.player_id IS NULL THEN r.last_power ELSE s.power END AS last_power, CASE WHEN s.player_id IS NULL THEN 'R0' ELSE 'R2' END AS last_rank FROM roster r LEFT JOIN
  (SELECT player_id, power FROM readings QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY ordinal DESC) = 1) s USING (player_id)""", EVENT_CAPTURES))
def event_upsert_players(d: Domain) -> DataFrame:
    state, _ = ingestion.upsert_events(_event_state(d), _event_decided(d), warn=False)
    return state["roster"].select("player_id", "last_power", "last_rank")


@query("event_upsert_audit", sql("SELECT p.participation_id AS target_id, 'points' AS field, p.points AS old_value, r.points AS new_value FROM parts p JOIN readings r USING (event_id, player_id) WHERE participation_id % 3 > 0 AND participation_id % 4 = 0 AND r.points IS NOT NULL AND r.points <> p.points UNION ALL SELECT 0, 'aliases', 0, count(DISTINCT player_id) FROM readings WHERE player_id % 5 = 0", EVENT_CAPTURES))
def event_upsert_audit(d: Domain) -> DataFrame:
    """Audit rows, and how many aliases the fuzzy matches added."""
    state, out = ingestion.upsert_events(_event_state(d), _event_decided(d), warn=False)
    n = lambda v: F.lit(v).cast("bigint")
    added = state["aliases"].agg(n(0).alias("target_id"), F.lit("aliases").alias("field"), n(0).alias("old_value"), F.count("*").alias("new_value"))
    return out["audit"].select("target_id", "field", "old_value", "new_value").unionByName(added)


#: Newcomers that an event shows first, a donation under a name one edit away, and a later event under that and a third one.
RECRUITS = "recruits AS (SELECT alliance_id, player_id, 'Rec' || regexp_replace(CAST(player_id AS VARCHAR), '(.)', '\\1\\1', 'g') AS name FROM roster WHERE player_id % 5 = 0)"


@query("batch_in_order", sql("""SELECT 'player' AS what, name, player_id AS value FROM recruits UNION ALL SELECT 'player', name || 'qz', player_id FROM recruits UNION ALL SELECT 'alias', name || 'q', player_id FROM recruits
  UNION ALL SELECT 'event', name, player_id FROM recruits UNION ALL SELECT 'event', name, player_id + 1 FROM recruits UNION ALL SELECT 'event', name || 'qz', player_id + 2 FROM recruits UNION ALL SELECT 'donation', name, player_id * 2 FROM recruits""", RECRUITS))
def batch_in_order(d: Domain) -> DataFrame:
    """A batch of events and donations in which a newcomer's variant is credited to the player that an earlier capture made,
    and a variant of the variant, which is nobody's, makes a player."""
    k = F.col("player_id")
    named = d.roster.where("player_id % 5 = 0").select("alliance_id", "player_id", F.concat(F.lit("Rec"), F.regexp_replace(k.cast("string"), "(.)", "$1$1")).alias("name"))
    shows = [(1, "event", "", 0), (2, "donation", "q", 0), (3, "event", "q", 1), (3, "event", "qz", 2)]
    rows = None
    for n, kind, ending, more in shows:
        read = _member(name=F.concat("name", F.lit(ending)), rank=F.lit("R1"), power=k, points=k + more, alliance_honor=k * 2, confidence=F.lit(0.9))
        part = named.select("alliance_id", F.lit(n).alias("n"), F.lit(kind).alias("kind"), (k * 10 + n).alias("place"), read.alias("member"))
        rows = part if rows is None else rows.unionByName(part)
    at = F.timestamp_seconds(F.lit(1_704_200_000) + F.col("n") * 86_400)
    c = _capture(rows, ["alliance_id", "n", "kind"], event_type=F.col("n").cast("string"), event_datetime=at, message_at=at, period_type=F.lit("weekly"), file_hash=F.col("n").cast("string"))
    c = c.withColumn("ordinal", F.col("alliance_id") * 10 + F.col("n"))
    state = _event_state(d)
    state |= {
        "events": state["events"].limit(0), "participations": state["participations"].limit(0), "periods": d.donations.select("alliance_id", "period_start").limit(0),
        "donations": d.donations.select(F.col("donation_id").alias("row_id"), "alliance_id", "period_start", "player_id", "honor", F.lit(None).cast("string").alias("alliance_tag"), "leaderboard_position", "confidence", "needs_review").limit(0),
    }
    none = d.spark.createDataFrame([], "alliance_id bigint, file_hash string, status string")
    decided = ingestion.outcomes(c, none, d.spark.createDataFrame([("1",), ("3",)], "code string"))
    out, _ = ingestion.upsert_batch(state, decided, ("event", "donation"), warn=False)
    names = out["roster"].where("player_name like 'Rec%'").select("player_id", F.col("player_name").alias("name"))
    row = lambda df, what, name, value: df.select(F.lit(what).alias("what"), F.col(name).alias("name"), value.cast("bigint").alias("value"))
    owner = named.select("name", F.col("player_id").alias("of"))
    base = lambda c: F.regexp_replace(c, "[qz]+$", "")
    players = row(names.withColumn("base", base("name")).join(owner.withColumnRenamed("name", "base"), "base"), "player", "name", F.col("of"))
    aliases = row(out["aliases"].join(names, "player_id").join(owner, "name"), "alias", "raw_name", F.col("of"))
    return players.unionByName(aliases).unionByName(row(out["participations"].join(names, "player_id"), "event", "name", F.col("points"))).unionByName(row(out["donations"].join(names, "player_id"), "donation", "name", F.col("honor")))


@query("raw_readings", sql("SELECT event_id, player_id, 'R2' AS player_rank, points, power, CASE WHEN player_id % 5 = 0 THEN 1 ELSE 0 END AS misread FROM readings WHERE points IS NOT NULL", EVENT_CAPTURES))
def raw_readings(d: Domain) -> DataFrame:
    """What the stored readings of participations say, and whether they show another name than the player's."""
    state = _event_state(d)
    held = state["participations"].withColumn("player_rank", F.lit("R0")).withColumn("raw_ocr", F.parse_json(F.lit(None).cast("string")))
    out, _ = ingestion.upsert_events(state | {"participations": held}, _event_decided(d), warn=False)
    rows = out["participations"].where("raw_ocr is not null").join(d.roster.select("player_id", "player_name"), "player_id")
    value = lambda path, kind="bigint": maintenance.stored_value(F.col("raw_ocr"), path, kind)
    return rows.select("event_id", "player_id", "player_rank", value("points").alias("points"), value("power").alias("power"), (value("name", "string") != F.col("player_name")).cast("int").alias("misread"))


# donations


def _donation_result(d: Domain) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    read = d.donations.where("donation_id % 2 = 0").join(d.roster.select("player_id", "player_name"), "player_id")
    k = F.col("donation_id")
    # each digit twice, so that no newcomer's name is a variant of another's
    name = F.when(k % 10 == 0, F.concat(F.lit("Newcomer "), F.regexp_replace(k.cast("string"), "(.)", "$1$1"))).otherwise(F.col("player_name"))
    member = _member(name=name, rank=F.lit("R2"), alliance_honor=F.col("honor") + k % 4, confidence=F.col("confidence"), leaderboard_position=F.col("leaderboard_position"))
    rows = read.select("alliance_id", "period_id", "period_start", k.alias("place"), member.alias("member"))
    at = F.col("period_start").cast("timestamp") + F.expr("INTERVAL 2 DAYS")
    c = _capture(rows, ["alliance_id", "period_id", "period_start"], kind=F.lit("donation"), file_hash=F.col("period_id"), message_at=at, period_type=F.when(F.col("alliance_id") % 4 == 0, "daily").otherwise("weekly"))
    state = _event_state(d)
    none = d.spark.createDataFrame([], "alliance_id bigint, file_hash string, status string")
    held = d.donations.where("donation_id % 3 > 0").select(F.col("donation_id").alias("row_id"), "alliance_id", "period_start", "player_id", "honor", F.lit(None).cast("string").alias("alliance_tag"), "leaderboard_position", "confidence", "needs_review")
    corrections = d.donations.where("donation_id % 4 = 0").select(F.col("donation_id").alias("target_id"), F.lit("honor").alias("field"))
    state |= {"donations": held, "corrections": corrections, "periods": held.select("alliance_id", "period_start").distinct()}
    decided = ingestion.outcomes(c, none, d.spark.createDataFrame([("1",)], "code string"))
    return ingestion.upsert_donations(state, decided, warn=False)


def _came_with() -> Column:
    """The donation that a newcomer came with, out of the name."""
    return F.regexp_replace(F.substring_index("player_name", " ", -1), r"(.)\1", "$1").cast("bigint")


DONATION_CAPTURES = "given AS (SELECT * FROM dons_r WHERE donation_id % 2 = 0 AND alliance_id % 4 > 0)"


@query("donation_upsert", sql("""SELECT alliance_id, CAST(period_start AS VARCHAR) AS period_start, player_id, honor, confidence FROM (
  SELECT alliance_id, period_start, player_id, honor + donation_id % 4 AS honor, confidence FROM given WHERE donation_id % 10 > 0
  UNION ALL SELECT alliance_id, period_start, -donation_id, honor + donation_id % 4, confidence FROM given WHERE donation_id % 10 = 0
  UNION ALL SELECT alliance_id, period_start, player_id, honor, confidence FROM dons d WHERE donation_id % 3 > 0 AND NOT EXISTS (SELECT 1 FROM given g WHERE g.donation_id = d.donation_id AND g.donation_id % 10 > 0))""", DONATION_CAPTURES))
def donation_upsert(d: Domain) -> DataFrame:
    """Newcomers' ids are hashes; they are shown as the donation they came with."""
    state, _ = _donation_result(d)
    newcomers = state["roster"].where("player_name like 'Newcomer %'").select("player_id", (-_came_with()).alias("shown"))
    rows = state["donations"].join(newcomers, "player_id", "left").withColumn("player_id", F.coalesce("shown", "player_id"))
    return rows.select("alliance_id", F.col("period_start").cast("string").alias("period_start"), "player_id", "honor", "confidence")


@query("donation_upsert_side", sql("""SELECT 'audit' AS what, donation_id AS row_id, honor AS old_value, honor + donation_id % 4 AS new_value FROM given WHERE donation_id % 4 = 0 AND donation_id % 3 > 0 AND donation_id % 10 > 0 AND donation_id % 4 > 0
  UNION ALL SELECT 'positions', ordinal, NULL, NULL FROM (SELECT period_id, min(donation_id) AS ordinal, bool_or(falls) AS f FROM (SELECT period_id, donation_id, leaderboard_position <= lag(leaderboard_position) OVER (PARTITION BY period_id ORDER BY donation_id) AS falls FROM given) GROUP BY 1) WHERE f
  UNION ALL SELECT 'joined', donation_id, NULL, NULL FROM given WHERE donation_id % 10 = 0""", DONATION_CAPTURES))
def donation_upsert_side(d: Domain) -> DataFrame:
    """Audit rows, captures with falling positions, and newcomers' memberships as the donation they came with."""
    state, out = _donation_result(d)
    none = F.lit(None).cast("bigint")
    newcomers = state["roster"].where("player_name like 'Newcomer %'").join(state["memberships"], ["alliance_id", "player_id"])
    shown = _came_with()
    rows = out["audit"].select(F.lit("audit").alias("what"), F.col("target_id").alias("row_id"), "old_value", "new_value")
    rows = rows.unionByName(out["positions"].select(F.lit("positions").alias("what"), F.col("ordinal").alias("row_id"), none.alias("old_value"), none.alias("new_value")))
    return rows.unionByName(newcomers.select(F.lit("joined").alias("what"), shown.alias("row_id"), none.alias("old_value"), none.alias("new_value")))


# stats


@query("stats_upsert", sql("""SELECT player_id, recorded_date, attack_pct, 'stats' AS what FROM (SELECT player_id, recorded_date, CASE WHEN player_id % 3 > 0 THEN round(attack_pct + 1, 2) ELSE attack_pct END AS attack_pct FROM stats WHERE player_id % 3 > 0 OR player_id % 2 = 0)
  UNION ALL SELECT player_id, recorded_date, NULL, 'rejected' FROM stats WHERE player_id % 3 = 0"""))
def stats_upsert(d: Domain) -> DataFrame:
    """Every second player has rows; two of three are posted again, the others under a name that nobody has."""
    rows = d.stats.select("alliance_id", "player_id", "player_name", "recorded_date", *(F.col(c).cast("double").alias(c) for c in ("attack_pct", "hp_pct", "defense_pct")))
    name = F.when(F.col("player_id") % 3 > 0, F.col("player_name")).otherwise(F.concat(F.lit("Nobody of all "), F.col("player_id").cast("string")))
    post = _member(name=name, attack_pct=F.round(F.col("attack_pct") + 1, 2), hp_pct=F.col("hp_pct"), defense_pct=F.col("defense_pct"), attack_kind=F.lit("lra"), confidence=F.lit(1.0), raw_lines=F.concat_ws(" ", F.col("player_id").cast("string"), F.col("recorded_date").cast("string")))
    place = F.unix_date("recorded_date").cast("bigint") * 1_000_000 + F.col("player_id")
    day = F.col("recorded_date").cast("timestamp") + F.expr("INTERVAL 12 HOURS")
    c = _capture(rows.select("alliance_id", "recorded_date", place.alias("place"), post.alias("member")), ["alliance_id", "recorded_date"], kind=F.lit("player_stats"), file_hash=F.col("recorded_date").cast("string"), message_at=day)
    none = d.spark.createDataFrame([], "alliance_id bigint, file_hash string, status string")
    held = rows.where("player_id % 2 = 0").select("alliance_id", "player_id", "recorded_date", *(F.col(c_).cast("decimal(8,2)").alias(c_) for c_ in ("attack_pct", "hp_pct", "defense_pct")), F.lit("lra").alias("attack_kind"), F.lit(1.0).alias("confidence"), F.lit("").alias("raw_text"))
    state, out = ingestion.upsert_stats(_event_state(d) | {"stats": held}, ingestion.outcomes(c, none, d.spark.createDataFrame([("1",)], "code string")))
    stats = state["stats"].select("player_id", F.col("recorded_date").cast("string").alias("recorded_date"), F.col("attack_pct").cast("double").alias("attack_pct"), F.lit("stats").alias("what"))
    text = F.split("raw_text", " ")
    return stats.unionByName(out["rejected"].select(F.get(text, F.lit(0)).cast("bigint").alias("player_id"), F.get(text, F.lit(1)).alias("recorded_date"), F.lit(None).cast("double").alias("attack_pct"), F.lit("rejected").alias("what")))


# warnings

NEAR_NAMES = """
read1 AS (SELECT player_id, alliance_id, CASE WHEN player_id % 4 = 0 THEN replace(player_name, '#0', '#Z') ELSE player_name END AS raw_name FROM roster),
alike AS (SELECT n.raw_name, n.player_id AS of_id, n.alliance_id, r.player_id AS other_id, levenshtein(lower(replace(n.raw_name, '#', '')), lower(replace(r.player_name, '#', ''))) AS dist, greatest(length(r.player_name), length(n.raw_name)) - 1 AS len FROM read1 n JOIN roster r USING (alliance_id)),
graded AS (SELECT *, 1 - dist / CAST(len AS DOUBLE) AS similarity FROM alike)
"""


@query("roster_collisions", sql("SELECT raw_name, other_id, similarity FROM graded WHERE of_id % 4 > 0 AND other_id <> of_id AND similarity >= 0.6", NEAR_NAMES))
def roster_collisions(d: Domain) -> DataFrame:
    credited = d.roster.where("player_id % 4 > 0").select("alliance_id", F.col("player_name").alias("raw_name"), "player_id")
    return duplicates.roster_collisions(credited, d.roster, ["raw_name", "other_id", "similarity"])


@query("near_duplicates_in_roster", sql("SELECT raw_name, other_id AS player_id, similarity FROM graded WHERE of_id % 4 = 0 AND similarity >= 0.6 QUALIFY row_number() OVER (PARTITION BY alliance_id, raw_name ORDER BY similarity DESC, other_id) = 1", NEAR_NAMES))
def near_duplicates_in_roster(d: Domain) -> DataFrame:
    new = d.roster.where("player_id % 4 = 0").select("alliance_id", F.replace("player_name", F.lit("#0"), F.lit("#Z")).alias("raw_name"))
    return duplicates.nearest_in_roster(new, d.roster).select("raw_name", "player_id", "similarity")


@query("duplicate_keys", "SELECT p_partkey, 'mjolnirake' || lower(replace(p_name, ' ', '')) AS key FROM part")
def duplicate_keys(d: Domain) -> DataFrame:
    return d.raw("part").select("p_partkey", duplicate_key(F.concat(F.lit("ＭＪöＬnir-аКе "), F.col("p_name"))).alias("key"))


# keyed writes


@query("upsert_partial", sql("SELECT player_id, last_power, CASE WHEN player_id % 2 = 0 THEN 'R3' ELSE 'R1' END AS last_rank FROM roster UNION ALL SELECT player_id + 1000000000, NULL, 'R3' FROM roster WHERE player_id % 10 = 0"))
def upsert_partial(d: Domain) -> DataFrame:
    """A batch that has ranks alone leaves powers as they are."""
    state = d.roster.select("player_id", "last_power", F.lit("R1").alias("last_rank"))
    some = d.roster.where("player_id % 2 = 0").select("player_id").unionByName(d.roster.where("player_id % 10 = 0").select((F.col("player_id") + 1_000_000_000).alias("player_id")))
    batch = some.select("player_id", F.explode(F.array(F.struct(F.lit("R2").alias("last_rank"), F.lit(1).alias("ordinal")), F.struct(F.lit("R3").alias("last_rank"), F.lit(2).alias("ordinal")))).alias("c")).select("player_id", "c.*")
    return upsert.latest_wins(state, batch, ["player_id"])


#: Five corrections of every tenth participation: two of points around one that is not allowed, one of power to null, and one of a row that is nowhere.
FIXES = """
fixes AS (SELECT participation_id, c.*, points, power FROM parts, (VALUES (1, 'points', 20, NULL), (2, 'name', 99, '22023'), (3, 'points', 30, NULL), (4, 'power', NULL, NULL), (5, 'honor', 1, '22023')) c(ordinal, field, new_value, error) WHERE participation_id % 10 = 0)
"""


def _corrected(d: Domain) -> tuple[dict[str, DataFrame], DataFrame]:
    target = d.participations.select(F.col("participation_id").alias("row_id"), "points", "power")
    donations = d.donations.select(F.col("donation_id").alias("row_id"), "honor")
    rows = [(1, "points", 20), (2, "name", 99), (3, "points", 30), (4, "power", None), (5, "honor", 1)]
    made = F.array(*(F.struct(F.lit(n).alias("ordinal"), F.lit(f).alias("field"), F.lit(v).cast("bigint").alias("new_value")) for n, f, v in rows))
    fixes = target.where("row_id % 10 = 0").select(F.lit("at_participations").alias("target_table"), F.col("row_id").alias("target_id"), F.explode(made).alias("c")).select("target_table", "target_id", "c.*")
    other = donations.where("row_id % 10 = 0").select(F.lit("at_donations").alias("target_table"), F.col("row_id").alias("target_id"), F.lit(1).alias("ordinal"), F.lit("honor").alias("field"), F.lit(5).cast("bigint").alias("new_value"))
    lost = donations.where("row_id % 10 = 1").select(F.lit("at_donations").alias("target_table"), (-F.col("row_id")).alias("target_id"), F.lit(1).alias("ordinal"), F.lit("honor").alias("field"), F.lit(6).cast("bigint").alias("new_value"))
    return upsert.apply_corrections({"at_participations": target, "at_donations": donations}, fixes.unionByName(other).unionByName(lost))


@query("corrected_rows", sql("SELECT 'p' AS kind, participation_id AS row_id, CASE WHEN participation_id % 10 = 0 THEN 30 ELSE points END AS value, CASE WHEN participation_id % 10 > 0 THEN power END AS power FROM parts UNION ALL SELECT 'd', donation_id, CASE WHEN donation_id % 10 = 0 THEN 5 ELSE honor END, NULL FROM dons"))
def corrected_rows(d: Domain) -> DataFrame:
    tables, _ = _corrected(d)
    p = tables["at_participations"].select(F.lit("p").alias("kind"), "row_id", F.col("points").alias("value"), "power")
    return p.unionByName(tables["at_donations"].select(F.lit("d").alias("kind"), "row_id", F.col("honor").alias("value"), F.lit(None).cast("bigint").alias("power")))


@query("correction_trail", sql("""SELECT participation_id AS target_id, ordinal, field, CASE WHEN error IS NULL THEN CASE WHEN ordinal = 3 THEN 20 WHEN field = 'points' THEN points ELSE power END END AS old_value, CAST(new_value AS BIGINT) AS new_value, error FROM fixes
  UNION ALL SELECT donation_id, 1, 'honor', honor, 5, NULL FROM dons WHERE donation_id % 10 = 0 UNION ALL SELECT -donation_id, 1, 'honor', NULL, 6, 'P0002' FROM dons WHERE donation_id % 10 = 1""", FIXES))
def correction_trail(d: Domain) -> DataFrame:
    return _corrected(d)[1].drop("target_table")


# streams


@query("streaming_replay", "SELECT user_id AS player_id, event_type AS field, event_id, CAST(round(value * 100) AS BIGINT) AS cents FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 2 DESC, event_id DESC) = 1")
def streaming_replay(d: Domain) -> DataFrame:
    """Two batches in order of arrival, then the first one's rows again: content that was taken in stays superseded."""
    rows = d.raw("events").select(F.col("user_id").alias("player_id"), F.col("event_type").alias("field"), "event_id", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    base = ingest.scratch(d.spark)
    keys = ["player_id", "field"]
    for n, part in enumerate(("event_id % 2 = 0", "event_id % 2 = 1", "event_id % 2 = 0")):
        rows.where(part).write.parquet(f"{base}/in/{n}")
        out = ingest.ingest(d.spark, f"{base}/in/*", rows.schema, f"{base}/state", f"{base}/log", keys, [*keys, "event_id", "cents"], ["event_id"], files_per_batch=1000)
    return out.select(*keys, "event_id", "cents")


@query("job_sweep", "SELECT o_orderkey, CASE WHEN kind = 1 AND age > 900 THEN 'error' ELSE (['done', 'pending', 'error'])[kind + 1] END AS status, CASE WHEN kind = 1 AND age > 900 THEN '{\"error\": \"timeout\"}' ELSE 'p' END AS payload FROM (SELECT o_orderkey, o_orderkey % 3 AS kind, o_orderkey % 7000 AS age FROM orders) WHERE NOT (kind <> 1 AND age > 3600)")
def job_sweep(d: Domain) -> DataFrame:
    now = F.lit("2026-01-01 12:00:00").cast("timestamp")
    k = F.col("o_orderkey")
    status = F.get(F.array(*map(F.lit, ("done", "pending", "error"))), (k % 3).cast("int"))
    jobs = d.raw("orders").select("o_orderkey", status.alias("status"), F.lit("p").alias("payload"), F.timestamp_seconds(F.unix_timestamp(now) - k % 7000).alias("created_at"))
    return ingest.sweep_jobs(jobs, now).select("o_orderkey", "status", "payload")


# upkeep


@query("membership_join", sql("SELECT player_id, strftime(joined_at, '%Y-%m-%d %H:%M:%S') AS joined_at, left_at IS NULL OR player_id % 2 = 0 AS active FROM members UNION ALL SELECT player_id, '2002-01-01 00:00:00', true FROM members WHERE player_id % 3 = 0"))
def membership_join(d: Domain) -> DataFrame:
    """Even players join again at the instant they joined first, every third also later."""
    again = d.memberships.where("player_id % 2 = 0").select("alliance_id", "player_id", "joined_at")
    later = d.memberships.where("player_id % 3 = 0").select("alliance_id", "player_id", F.lit("2002-01-01").cast("timestamp").alias("joined_at"))
    out = maintenance.join_alliance(d.memberships, again.unionByName(later).withColumn("ordinal", F.lit(1)))
    return out.select("player_id", F.date_format("joined_at", "yyyy-MM-dd HH:mm:ss").alias("joined_at"), F.col("left_at").isNull().alias("active"))


@query("alias_changes", sql("SELECT 'n' || player_id AS raw_name, CASE WHEN player_id % 3 = 0 THEN player_id + 1 ELSE player_id END AS player_id FROM roster WHERE alliance_id = 3 AND player_id % 3 < 2"))
def alias_changes(d: Domain) -> DataFrame:
    """Every third alias is moved and every third removed."""
    aliases = d.roster.select("alliance_id", F.concat(F.lit("n"), F.col("player_id").cast("string")).alias("raw_name"), "player_id")
    moved = F.when(F.col("player_id") % 3 == 0, F.col("player_id") + 1)
    changes = aliases.where("player_id % 3 <> 1").select("alliance_id", "raw_name", moved.alias("player_id"), F.lit(1).alias("ordinal"))
    return maintenance.list_aliases(maintenance.set_aliases(aliases, changes), d.roster, 3).select("raw_name", "player_id")


@query("title_aliases", "SELECT n_nationkey, list_transform(CASE WHEN n_nationkey % 3 = 0 THEN [n_name] WHEN n_nationkey % 3 = 1 THEN ['x', n_name] ELSE [n_name, 'x'] END, lambda t: t)::VARCHAR AS titles FROM nation")
def title_aliases(d: Domain) -> DataFrame:
    """A title is added to what is there, unless it is there; nothing at all counts as an empty list."""
    k, name = F.col("n_nationkey"), F.col("n_name")
    held = F.when(k % 3 == 1, F.array(F.lit("x"))).when(k % 3 == 2, F.array(name, F.lit("x")))
    out = maintenance.append_if_absent(held, name)
    return d.raw("nation").select("n_nationkey", F.concat(F.lit("["), F.array_join(out, ", "), F.lit("]")).alias("titles"))


def _calendar_rows(d: Domain) -> DataFrame:
    return d.raw("orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderpriority").alias("title"))


@query("calendar_edits", "SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE o_orderpriority END AS title FROM orders WHERE o_orderkey % 5 > 0 UNION ALL SELECT (SELECT max(o_orderkey) FROM orders WHERE o_orderkey % 5 > 0) + 1 + n_nationkey, n_name FROM nation")
def calendar_edits(d: Domain) -> DataFrame:
    rows = maintenance.delete_where(_calendar_rows(d), F.col("event_id") % 5 == 0)
    rows = maintenance.insert_rows(rows, d.raw("nation").select(F.col("n_name").alias("title"), F.col("n_nationkey").alias("ordinal")))
    changes = _calendar_rows(d).where("event_id % 4 = 0").select("event_id", F.lit("new").alias("title"), F.lit(1).alias("ordinal"))
    return maintenance.update_rows(rows, changes.join(d.raw("orders").select(F.col("o_orderkey").alias("event_id")), "event_id"))


@query("calendar_undo", "SELECT CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey ELSE o_orderkey + (SELECT max(o_orderkey) FROM orders) END AS event_id, o_orderpriority AS title FROM orders")
def calendar_undo(d: Domain) -> DataFrame:
    return maintenance.delete_and_restore(_calendar_rows(d), F.col("event_id") % 5 == 0)[1]


@query("reset_tables", sql("SELECT 'roster' AS name, count(*) AS n FROM roster UNION ALL SELECT 'participations', 0 UNION ALL SELECT 'donations', 0"))
def reset_tables(d: Domain) -> DataFrame:
    out = maintenance.reset({"roster": d.roster, "participations": d.participations, "donations": d.donations}, {"roster"})
    parts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in out.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _merge_tables(d: Domain) -> dict[str, DataFrame]:
    return {
        "roster": d.roster.select("player_id", "alliance_id", "player_name"), "participations": d.participations.select("participation_id", "event_id", "player_id"), "memberships": d.memberships.select("alliance_id", "player_id", "joined_at", "left_at"),
        "aliases": d.roster.where("player_id % 10 = 1").select("alliance_id", F.concat(F.lit("n"), F.col("player_id").cast("string")).alias("raw_name"), "player_id"),
        "corrections": d.participations.where("participation_id % 4 = 0").select("participation_id", "player_id"),
        "donations": d.donations.select("donation_id", "period_id", "player_id", F.lit(None).cast("string").alias("alliance_tag"), F.col("period_start").alias("updated_at")),
    }


@query("player_merge", sql("""SELECT 'roster' AS what, player_id AS a, 0 AS b FROM roster WHERE player_id % 10 <> 1
  UNION ALL SELECT 'participations', participation_id, p.player_id - CASE WHEN p.player_id % 10 = 1 THEN 1 ELSE 0 END FROM parts p WHERE NOT (player_id % 10 = 1 AND EXISTS (SELECT 1 FROM parts q WHERE q.event_id = p.event_id AND q.player_id = p.player_id - 1))
  UNION ALL SELECT 'memberships', player_id - CASE WHEN player_id % 10 = 1 THEN 1 ELSE 0 END, player_id % 10 FROM members m WHERE NOT (player_id % 10 = 1 AND EXISTS (SELECT 1 FROM members n WHERE n.alliance_id = m.alliance_id AND n.player_id = m.player_id - 1 AND n.joined_at = m.joined_at))
  UNION ALL SELECT 'aliases', player_id - 1, g FROM roster, range(0, 2) r(g) WHERE player_id % 10 = 1
  UNION ALL SELECT 'corrections', participation_id, player_id - CASE WHEN player_id % 10 = 1 THEN 1 ELSE 0 END FROM parts WHERE participation_id % 4 = 0
  UNION ALL SELECT 'donations', donation_id, player_id FROM dons WHERE player_id % 10 <> 1"""))
def player_merge(d: Domain) -> DataFrame:
    """All tables after every player whose id ends in 1 is merged into the one before."""
    mapping = d.roster.where("player_id % 10 = 1").select("player_id", (F.col("player_id") - 1).alias("canonical_id"))
    tables = _merge_tables(d)
    tables["memberships"] = d.memberships.select("alliance_id", "player_id", "joined_at", "left_at", (F.col("player_id") % 10).alias("digit"))
    out = maintenance.merge_duplicate_players(tables, mapping)
    row = lambda df, what, a, b: df.select(F.lit(what).alias("what"), a.alias("a"), b.cast("bigint").alias("b"))
    c = F.col
    parts = [
        row(out["roster"], "roster", c("player_id"), F.lit(0)), row(out["participations"], "participations", c("participation_id"), c("player_id")), row(out["memberships"], "memberships", c("player_id"), c("digit")),
        row(out["aliases"], "aliases", c("player_id"), F.startswith(c("raw_name"), F.lit("n")).cast("int")), row(out["corrections"], "corrections", c("participation_id"), c("player_id")), row(out["donations"], "donations", c("donation_id"), c("player_id")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows


MERGED = """
held AS (SELECT player_id, CASE WHEN player_id % 10 = 1 THEN player_id - 1 ELSE player_id END AS to_id, last_power, last_seen_at, 'R' || (player_id % 3 + 1) AS last_rank, CASE WHEN player_id % 10 = 1 THEN 1 ELSE 0 END AS dup FROM players)
"""


@query("merged_roster", sql("SELECT to_id AS player_id, max(last_power) AS last_power, strftime(max(last_seen_at), '%Y-%m-%d') AS last_seen, first(last_rank ORDER BY last_seen_at DESC NULLS LAST, dup) AS last_rank FROM held GROUP BY to_id HAVING bool_or(dup = 0)", MERGED))
def merged_roster(d: Domain) -> DataFrame:
    rank = F.concat(F.lit("R"), (F.col("player_id") % 3 + 1).cast("string"))
    mapping = d.roster.where("player_id % 10 = 1").select("player_id", (F.col("player_id") - 1).alias("canonical_id"))
    out = maintenance.merged_roster(d.players.withColumn("last_rank", rank), mapping)
    return out.select("player_id", "last_power", F.date_format("last_seen_at", "yyyy-MM-dd").alias("last_seen"), "last_rank")


@query("name_fixes_applied", sql("""SELECT 'roster' AS what, player_id AS a, player_name AS b FROM roster WHERE player_id % 5 <> 4 OR player_id % 2 = 1
  UNION ALL SELECT 'donations', donation_id, tag FROM (SELECT *, row_number() OVER (PARTITION BY period_id, to_id ORDER BY period_start DESC, donation_id DESC) AS n FROM (
    SELECT donation_id, period_id, period_start, CASE WHEN player_id % 5 = 4 AND player_id % 2 = 0 THEN player_id - 1 ELSE player_id END AS to_id, CASE WHEN player_id % 5 = 4 THEN 'SOD' END AS tag FROM dons)) WHERE n = 1"""))
def name_fixes_applied(d: Domain) -> DataFrame:
    """Names with a tag: those of even players belong to the player before, in the same alliance here; odd ones are renamed."""
    k = F.col("player_id")
    tables = _merge_tables(d)
    roster = d.roster.select("player_id", F.lit(1).cast("bigint").alias("alliance_id"), "player_name")
    before = roster.select((k + 1).alias("player_id"), F.col("player_name").alias("previous"))
    tagged = roster.join(before, "player_id", "left")
    name = F.when((k % 5 == 4) & (k % 2 == 0), F.concat(F.lit("(SOD) "), "previous")).when(k % 5 == 4, F.concat(F.lit("[SOD] "), "player_name")).otherwise(F.col("player_name"))
    tables["roster"] = tagged.select("player_id", "alliance_id", name.alias("player_name"))
    out = maintenance.apply_name_fixes(tables, maintenance.tagged_names(tables["roster"]))
    rows = out["roster"].select(F.lit("roster").alias("what"), k.alias("a"), F.col("player_name").alias("b"))
    return rows.unionByName(out["donations"].select(F.lit("donations").alias("what"), F.col("donation_id").alias("a"), F.col("alliance_tag").alias("b")))


@query("stored_swaps", sql("""SELECT r.player_id, CASE WHEN t.player_id IS NULL THEN last_power ELSE t.power END AS last_power FROM roster r LEFT JOIN (SELECT player_id, arg_max(power, participation_id) FILTER (true) AS power, bool_or(swapped) AS any FROM (
  SELECT participation_id, player_id, swapped, coalesce(CASE WHEN swapped THEN q ELSE p END, -1) AS power FROM (SELECT *, coalesce(p < 10000 AND q > 100000, false) AS swapped FROM (SELECT participation_id, player_id, CASE WHEN participation_id % 3 = 0 THEN points % 10000 ELSE power END AS p, CASE WHEN participation_id % 3 = 0 THEN power ELSE points END AS q FROM parts))) GROUP BY player_id) t ON t.player_id = r.player_id AND t.any"""))
def stored_swaps(d: Domain) -> DataFrame:
    mixed = F.col("participation_id") % 3 == 0
    rows = d.participations.select("player_id", F.col("participation_id").alias("created_at"), F.when(mixed, F.col("points") % 10000).otherwise(F.col("power")).alias("power"), F.when(mixed, F.col("power")).otherwise(F.col("points")).alias("points"))
    fixed = maintenance.swap_columns(rows).withColumn("power", F.coalesce("power", F.lit(-1)))
    return maintenance.refresh_last_power(d.roster, fixed).select("player_id", "last_power")


@query("short_names", sql("SELECT player_id, substr(player_name, 17) AS player_name, (SELECT count(*) FROM parts p WHERE p.player_id = roster.player_id) AS participations FROM roster"))
def short_names(d: Domain) -> DataFrame:
    return maintenance.short_names(d.roster.withColumn("player_name", F.substring("player_name", 17, 3)), d.participations)


@query("raw_values", sql("SELECT participation_id, power, CASE WHEN participation_id % 3 > 0 THEN points END AS points FROM parts"))
def raw_values(d: Domain) -> DataFrame:
    raw = F.to_json(F.struct("power", F.struct(F.when(F.col("participation_id") % 3 > 0, F.col("points").cast("string")).otherwise("x").alias("points")).alias("read")))
    rows = d.participations.select("participation_id", raw.alias("raw"))
    return rows.select("participation_id", maintenance.raw_value(F.col("raw"), "power").alias("power"), maintenance.raw_value(F.col("raw"), "read.points").alias("points"))
