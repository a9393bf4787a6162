"""The write path, reads of a single row, upkeep and streams on small tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from muster.operators import calendar, duplicates, ingestion, maintenance, reads, resolution, upsert
from muster.operators.kept import kept
from muster.plans.write_queries import MEMBER
from muster.streaming import ingest
from tests.test_operators import one

CAPTURE = f"ordinal bigint, alliance_id bigint, file_hash string, kind string, error string, event_type string, event_datetime timestamp, message_at timestamp, period_type string, possible_truncation boolean, expected_rows int, alliance_rank bigint, total_battlers bigint, total_points bigint, members array<{MEMBER}>"
FIELDS = [part.split(":")[0] for part in MEMBER[7:-1].split(",")]


def member(name, **fields):
    return tuple({"name": name, "rank": "R1", "confidence": 0.9, **fields}.get(f) for f in FIELDS)


def captures(spark, *rows):
    names = [c.strip().split(" ")[0] for c in CAPTURE.split(f", members")[0].split(",")] + ["members"]
    kinds = CAPTURE.replace("event_datetime timestamp", "event_datetime string").replace("message_at timestamp", "message_at string")
    full = [tuple({"ordinal": k, "alliance_id": 1, "file_hash": f"f{k}", **r}.get(n) for n in names) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, kinds).withColumns({c: F.col(c).cast("timestamp") for c in ("event_datetime", "message_at")})


def event(*members, at="2026-04-07 15:00:00", **fields):
    return {"kind": "event", "event_type": "void_war", "event_datetime": at, "members": list(members), **fields}


@pytest.fixture(scope="module")
def types(spark):
    return spark.createDataFrame([("void_war",)], "code string")


@pytest.fixture
def state(spark):
    make = spark.createDataFrame
    return {
        "uploads": make([(1, "done", "processed"), (1, "lost", "pending")], "alliance_id bigint, file_hash string, status string"),
        "events": make([], "event_id string, alliance_id bigint, event_type string, event_datetime timestamp, alliance_rank bigint, total_battlers bigint, total_points bigint"),
        "roster": make([(1, 10, "Anna", 5, "R1", None), (1, 11, "ZORRO99", 6, "R2", None), (1, 12, "LEÓN", 7, None, None), (2, 13, "Other", 8, None, None)], "alliance_id bigint, player_id bigint, player_name string, last_power bigint, last_rank string, last_seen_at timestamp"),
        "aliases": make([(1, "Anny", 10, "me")], "alliance_id bigint, raw_name string, player_id bigint, created_by string"),
        "memberships": make([(1, 10, "2026-01-01")], "alliance_id bigint, player_id bigint, joined_at string").select("alliance_id", "player_id", F.col("joined_at").cast("timestamp").alias("joined_at"), F.lit(None).cast("timestamp").alias("left_at")),
        "participations": make([], "row_id bigint, event_id string, player_id bigint, points bigint, power bigint, confidence double, needs_review boolean"),
        "corrections": make([], "target_id bigint, field string"),
        "periods": make([], "alliance_id bigint, period_start date"),
        "donations": make([], "row_id bigint, alliance_id bigint, period_start date, player_id bigint, honor bigint, alliance_tag string, leaderboard_position bigint, confidence double, needs_review boolean"),
        "stats": make([], "alliance_id bigint, player_id bigint, recorded_date date, attack_pct decimal(8,2), hp_pct decimal(8,2), defense_pct decimal(8,2), attack_kind string, confidence double, raw_text string"),
    }


def statuses(decided):
    return [r.status for r in decided.orderBy("ordinal").collect()]


def test_statuses_of_events(spark, types, state):
    m = [member("x")]
    rows = [
        event(*m, file_hash="done"), event(*m, file_hash="lost"), event(*m, file_hash="lost"), event(*m, at=None, file_hash="done"), event(*m, possible_truncation=True, expected_rows=3), event(*m, possible_truncation=True, expected_rows=2),
        event(*m, possible_truncation=True, expected_rows=0), event(*m, possible_truncation=False, expected_rows=99), event(*m, event_type="new_war"), event(*m, event_type="new_war", file_hash="done"), event(*m, file_hash="done", alliance_id=2),
        {"kind": None, "members": m}, {"error": "unknown_event"}, {"error": "crash"},
    ]
    got = statuses(ingestion.outcomes(captures(spark, *rows), state["uploads"], types))
    assert got == ["duplicate", "processed", "duplicate", "missing_datetime", "possible_truncation_rejected", "processed", "processed", "processed", "unknown_event", "duplicate", "processed", "missing_datetime", "unknown_event", "failed"]


def test_statuses_of_donations_and_posts(spark, types, state):
    m, at = [member("x")], "2026-04-30 14:00:00"
    don = lambda **f: {"kind": "donation", "period_type": "weekly", "message_at": at, "members": m, **f}
    post = lambda **f: {"kind": "player_stats", "message_at": at, "members": m, **f}
    rows = [don(), don(period_type="daily"), don(period_type=None), don(members=[]), don(members=None), don(period_type="daily", members=[]), don(possible_truncation=True, expected_rows=12), don(file_hash="done", period_type="daily"), post(), post(members=[]), post(possible_truncation=True, expected_rows=12), post(file_hash="done")]
    decided = ingestion.outcomes(captures(spark, *rows), state["uploads"], types)
    assert statuses(decided) == ["processed", "unsupported_period_type", "unsupported_period_type", "no_members", "no_members", "unsupported_period_type", "possible_truncation_rejected", "duplicate", "processed", "no_members", "processed", "duplicate"]
    assert tuple(ingestion.tallies(decided).first()) == (3, 2, 0, 7)


def test_a_refused_file_does_not_block_a_later_one(spark, types, state):
    rows = [event(member("x"), at=None, file_hash="a"), event(member("x"), file_hash="a"), event(member("x"), file_hash="a"), {"error": "crash", "file_hash": "a"}, {"error": "crash", "file_hash": "b"}, {"error": "crash", "file_hash": "done"}]
    decided = ingestion.outcomes(captures(spark, *rows), state["uploads"], types)
    assert statuses(decided) == ["missing_datetime", "processed", "duplicate", "failed", "failed", "failed"]
    got = {r.file_hash: r.status for r in ingestion.next_uploads(state["uploads"], decided).collect()}
    assert got == {"a": "processed", "b": "failed", "done": "processed", "lost": "pending"}
    assert [r.ordinal for r in ingestion.in_order(decided).collect()] == [0, 1, 2, 3, 4, 5]


def by_name(state):
    return {r.player_name: r for r in state["roster"].collect()}


def test_events_are_written(spark, types, state):
    first = event(member("Anna", power=100, points=7, confidence=0.3), member("Anna", power=200, points=8, confidence=0.8), member("Anny", power=300, points=9), member("ZORRO9", power=1, points=None, rank="R5"), member("Newman", power=2, points=0, confidence=-1.0), member(" ", points=4), total_battlers=50)
    later = event(member("Anna", power=50, points=3), at="2026-04-01 10:00:00")
    out, side = ingestion.upsert_events(state, ingestion.outcomes(captures(spark, first, later), state["uploads"], types))
    players = by_name(out)
    # the last capture to arrive counts, though it shows an earlier day; not taking part refreshes a player too
    assert (players["Anna"].last_power, str(players["Anna"].last_seen_at)) == (50, "2026-04-01 10:00:00") and (players["ZORRO99"].last_power, players["ZORRO99"].last_rank) == (1, "R5")
    assert (players["Newman"].alliance_id, players["Newman"].last_power) == (1, 2) and players["LEÓN"].last_power == 7 and len(players) == 5
    new = players["Newman"].player_id
    rows = {(r.event_id[-16:], r.player_id): (r.points, r.power, r.confidence, r.needs_review) for r in out["participations"].collect()}
    assert rows == {("2026-04-07 15:00", 10): (8, 200, 0.8, False), ("2026-04-07 15:00", new): (0, 2, -1.0, False), ("2026-04-01 10:00", 10): (3, 50, 0.9, False)}
    joined = {(r.player_id, str(r.joined_at)[:10]) for r in out["memberships"].collect()}
    assert joined == {(10, "2026-01-01"), (11, "2026-04-07"), (new, "2026-04-07")}
    assert {(r.raw_name, r.player_id, r.created_by) for r in out["aliases"].collect()} == {("Anny", 10, "me"), ("ZORRO9", 11, "auto:name-resolve")}
    assert out["events"].count() == 2 and out["events"].where("total_battlers = 50").count() == 1
    # the same capture again, as a new file: nothing changes but what it overwrites
    again, side = ingestion.upsert_events(out | {"corrections": out["participations"].where("player_id = 10 and points = 8").select(F.col("row_id").alias("target_id"), F.lit("points").alias("field"))}, ingestion.outcomes(captures(spark, event(member("Anna", power=200, points=77))), state["uploads"], types))
    assert again["events"].count() == 2 and again["participations"].count() == 3 and again["memberships"].count() == 3
    assert [(r.field, r.old_value, r.new_value, r.corrected_by) for r in side["audit"].collect()] == [("points", 8, 77, "auto:ocr-reingest")]


def test_warnings(spark, types, state):
    roster = state["roster"].unionByName(spark.createDataFrame([(1, 20, "LEON", None, None, None), (1, 21, "Big Steel Curtain", None, None, None), (1, 22, "VVVVV1", None, None, None), (1, 23, "VVVVV2", None, None, None)], state["roster"].schema))
    rows = captures(spark, event(member("LEON", points=1), member("BigSteelCartoon", points=1), member("VVVVV3", points=1), member("jani", points=1)))
    out, side = ingestion.upsert_events(state | {"roster": roster}, ingestion.outcomes(rows, state["uploads"], types))
    got = {(r.raw_name, r.player_id, r.other_id, r.warning) for r in side["warnings"].collect()}
    assert got == {("LEON", 20, 12, "collision"), ("BigSteelCartoon", None, 21, "near_duplicate"), ("VVVVV3", None, None, "ambiguous")}
    # several near ones, or none: a new player each; short names are never matched
    assert {"VVVVV3", "BigSteelCartoon", "jani"} <= set(by_name(out))


def test_donations_are_written(spark, types, state):
    don = lambda at, *m: {"kind": "donation", "period_type": "weekly", "message_at": at, "members": list(m)}
    first = don("2026-04-26 22:30:00", member("Anna", alliance_honor=5, leaderboard_position=1, alliance_tag="SOD", rank="R4"), member("Fresh", alliance_honor=4, leaderboard_position=2))
    later = don("2026-04-28 10:00:00", member("Anna", alliance_honor=3, leaderboard_position=9, confidence=0.1), member("Fresh", alliance_honor=6, leaderboard_position=9))
    out, side = ingestion.upsert_donations(state, ingestion.outcomes(captures(spark, first, later), state["uploads"], types))
    players = by_name(out)
    assert (players["Anna"].last_power, players["Anna"].last_rank, players["Anna"].last_seen_at) == (5, "R1", None)  # the rank alone
    got = {r.player_id: (str(r.period_start), r.honor, r.leaderboard_position, r.needs_review) for r in out["donations"].collect()}
    assert got == {10: ("2026-04-27", 3, 9, True), players["Fresh"].player_id: ("2026-04-27", 6, 9, False)}
    assert out["periods"].count() == 1 and [r.ordinal for r in side["positions"].collect()] == [1]
    assert {str(r.joined_at) for r in out["memberships"].where(F.col("player_id") == players["Fresh"].player_id).collect()} == {"2026-04-26 22:30:00"}
    # the second reading of a corrected row is compared with the first
    row = out["donations"].where("player_id = 10").select(F.col("row_id").alias("target_id"), F.lit("honor").alias("field"))
    _, side = ingestion.upsert_donations(out | {"corrections": row}, ingestion.outcomes(captures(spark, first, later), state["uploads"].limit(0), types))
    assert [(r.old_value, r.new_value) for r in side["audit"].collect()] in ([(3, 5), (5, 3)], [(5, 3), (3, 5)])


def test_posts_are_written(spark, types, state):
    post = {"kind": "player_stats", "message_at": "2026-04-30 23:30:00", "members": [member("Anny", attack_pct=412.126, attack_kind="lra", confidence=0.3), member("ZORRO9", hp_pct=1.0, attack_kind="mra", confidence=1.0), member("Nobody there", raw_lines="Nobody there\n363"), member("  ")]}
    out, side = ingestion.upsert_stats(state, ingestion.outcomes(captures(spark, post), state["uploads"], types))
    got = {r.player_id: (str(r.recorded_date), None if r.attack_pct is None else float(r.attack_pct), r.attack_kind) for r in out["stats"].collect()}
    assert got == {10: ("2026-04-30", 412.13, "lra"), 11: ("2026-04-30", None, "mra")}
    assert [r.raw_text for r in side["rejected"].collect()] == ["Nobody there\n363"] and [r.low for r in side["low"].collect()] == [1]
    assert out["roster"].count() == 4 and out["memberships"].count() == 1


# keyed writes


def plain(df, *without):
    rows = df.select(*(c for c in df.columns if c not in without))
    rows = rows.select(*(F.to_json(c).alias(c) if t == "variant" else F.col(c) for c, t in rows.dtypes))
    return sorted((tuple(r) for r in rows.collect()), key=str)


WORDS = ["Bulleit", "Bulleitt", "Bulleittt", "Bullett", "bul leit", "ZORRO99", "ZORRO98", "ZORRO998", "Anny", "Anna", "Annaa", "LEON", "Krampus", "Krampu", "Krampuss"]


def near(a: str, b: str) -> bool:
    a, b = ("".join(c for c in x.lower() if c.isalnum()) for x in (a, b))
    cut = lambda x: {x} | {x[:k] + x[k + 1 :] for k in range(len(x))}
    one_edit = a == b or (len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1) or (len(a) != len(b) and (a in cut(b) or b in cut(a)))
    return min(len(a), len(b)) >= 5 and one_edit


def test_names_resolve_as_one_capture_after_the_other(spark):
    """A hundred alliances, each a batch of its own, of names that are variants of few words; played through in a loop."""
    draw, seen, roster, aliases, want = random.Random(3), [], [], [], {}
    for alliance in range(100):
        players = {w: alliance * 1000 + n for n, w in enumerate(draw.sample(WORDS, draw.randint(0, 3)))}
        known = {"Bullett": 7} if draw.random() < 0.2 else {}
        roster += [(alliance, i, w) for w, i in players.items()]
        aliases += [(alliance, w, i) for w, i in known.items()]
        held, credited = {w: (i, None) for w, i in players.items()}, dict(known)
        for capture in range(draw.randint(1, 7)):
            creates, shown, made, added = draw.random() < 0.7, set(draw.choices(WORDS, k=draw.randint(1, 4))), {}, {}
            for w in shown:
                seen.append((alliance, w, capture, creates))
                close = [v for v in held if near(v, w)]
                if w in credited:
                    got = ("alias", credited[w])
                elif w in held:
                    got = ("exact", held[w][1] or held[w][0])
                elif len(close) == 1:
                    got = ("fuzzy", held[close[0]][1] or held[close[0]][0])
                    added[w] = got[1]
                else:
                    got = ("ambiguous" if close else "new", w)
                    if creates:
                        made[w] = (None, w)
                want[alliance, w, capture] = got
            held |= made
            credited |= added
    make = spark.createDataFrame
    found = resolution.resolve_in_order(make(seen, "alliance_id bigint, raw_name string, capture bigint, creates boolean"), make(roster, "alliance_id bigint, player_id bigint, player_name string"), make(aliases, "alliance_id bigint, raw_name string, player_id bigint"), 5)
    name_of = {(r.alliance_id, r.i): r.w for r in make([(a, w) for a in range(100) for w in WORDS], "alliance_id bigint, w string").select("alliance_id", "w", F.xxhash64("alliance_id", "w").alias("i")).collect()}
    got = {(r.alliance_id, r.raw_name, r.capture): (r.resolution, name_of.get((r.alliance_id, r.player_id), r.player_id)) for r in found.rows.collect()}
    assert got == want
    assert {r[1][0] for r in want.items()} == {"alias", "exact", "fuzzy", "ambiguous", "new"}


def test_a_batch_equals_its_captures_one_by_one(spark, types, state):
    """Mixed captures of all kinds, whole tables."""
    draw = random.Random(1)
    rows = []
    for k in range(3):
        m = [member(w, confidence=draw.random(), power=draw.randint(1, 99), points=draw.choice([None, k, 5]), alliance_honor=draw.randint(1, 9), attack_pct=1.0, raw_lines=w) for w in draw.choices(WORDS, k=6)]
        at = f"2026-04-0{draw.randint(1, 7)} 15:00:00"
        kind = ("event", "donation", "event")[k]
        rows.append({"kind": kind, "event_type": "void_war", "event_datetime": at, "message_at": at, "period_type": "weekly", "members": m, "alliance_id": 1})
    caps = captures(spark, *rows).withColumn("message_id", F.concat(F.lit("m"), F.col("ordinal").cast("string")))
    variant = F.parse_json(F.lit(None).cast("string"))
    state["participations"] = state["participations"].withColumns({"player_rank": F.lit(None).cast("string"), "raw_ocr": variant})
    state["events"] = state["events"].withColumn("source_message_id", F.lit(None).cast("string"))
    state["donations"] = state["donations"].withColumns({"player_rank": F.lit(None).cast("string"), "raw_ocr": variant, "updated_at": F.lit(None).cast("timestamp"), "source_message_id": F.lit(None).cast("string")})
    decided, now = ingestion.outcomes(caps, state["uploads"], types), F.lit("2026-05-01").cast("timestamp")
    whole, _ = ingestion.upsert_batch(state, decided, ("event", "donation"), now, warn=False)
    step = state
    for k in range(len(rows)):
        step, _ = ingestion.upsert_batch(step, decided.where(F.col("ordinal") == k), ("event", "donation"), now, warn=False)
        step = {name: kept(df) for name, df in step.items()}
    for name in ("roster", "aliases", "events", "participations", "memberships", "periods", "donations"):
        assert plain(whole[name]) == plain(step[name]), name
    read = whole["participations"].where("raw_ocr is not null")
    assert read.where(maintenance.stored_value(F.col("raw_ocr"), "points") != F.col("points")).count() == 0


def test_chains_of_merges_reach_their_end(spark):
    make = spark.createDataFrame
    merges = make([(1, 2), (2, 3), (4, 1), (7, 8)], "player_id bigint, canonical_id bigint")
    assert plain(maintenance.final_targets(merges)) == [(1, 3), (2, 3), (4, 3), (7, 8)]
    roster = make([(1, k, f"n{k}", 10 - k, "R1", None) for k in (1, 2, 3, 4, 8)], "alliance_id bigint, player_id bigint, player_name string, last_power bigint, last_rank string, last_seen_at timestamp")
    tables = {"roster": roster.select("alliance_id", "player_id", "player_name"), "participations": make([(9, 1), (8, 2), (9, 4)], "event_id bigint, player_id bigint"), "memberships": make([(1, 1, 5)], "alliance_id bigint, player_id bigint, joined_at bigint"), "aliases": make([(1, "x", 1)], "alliance_id bigint, raw_name string, player_id bigint"), "corrections": make([(1, 2)], "target_id bigint, player_id bigint"), "donations": make([(1, 3)], "donation_id bigint, player_id bigint")}
    out = maintenance.merge_duplicate_players(tables, merges)
    assert plain(out["roster"].select("player_id")) == [(3,), (8,)] and {r.player_id for r in out["participations"].collect()} == {3}
    assert {r.player_id for r in out["aliases"].collect()} == {3} and plain(out["corrections"]) == [(1, 3)]
    assert plain(maintenance.merged_roster(roster, merges).select("player_id", "last_power")) == [(3, 9), (8, 2)]
    with pytest.raises(ValueError):
        maintenance.final_targets(make([(1, 2), (2, 1)], "player_id bigint, canonical_id bigint"))


def test_only_given_columns_are_replaced(spark):
    state = spark.createDataFrame([(1, "R1", 5), (2, "R2", None)], "k int, r string, power int")
    batch = spark.createDataFrame([(1, "R3", 1), (1, "R4", 2), (9, None, 3)], "k int, r string, ordinal int")
    assert {(r.k, r.r, r.power) for r in upsert.latest_wins(state, batch, ["k"]).collect()} == {(1, "R4", 5), (2, "R2", None), (9, None, None)}
    whole = spark.createDataFrame([(1, "R3", 7, 1), (2, None, 8, 2)], "k int, r string, power int, ordinal int")
    assert {(r.k, r.r, r.power) for r in upsert.latest_wins(state, whole, ["k"], ["power"]).collect()} == {(1, "R1", 7), (2, "R2", 8)}
    assert {(r.k, r.r, r.power) for r in upsert.latest_wins(state, whole, ["k"]).collect()} == {(1, "R3", 7), (2, None, 8)}


def test_corrections_in_order(spark):
    target = spark.createDataFrame([(1, 10, 5), (2, None, 6)], "row_id bigint, points bigint, power bigint")
    rows = [(1, 1, "points", 20), (2, 1, "name", 99), (3, 1, "points", 30), (4, 1, "power", None), (5, 2, "points", 1), (6, 7, "points", 1), (7, 1, "honor", 3)]
    fixes = spark.createDataFrame(rows, "ordinal int, target_id bigint, field string, new_value bigint").withColumn("target_table", F.when(F.col("ordinal") == 7, "at_donations").otherwise("at_participations"))
    out, audit = upsert.apply_corrections({"at_participations": target}, fixes)
    assert sorted(map(tuple, out["at_participations"].collect())) == [(1, 30, None), (2, 1, 6)]
    got = [(r.old_value, r.new_value, r.error) for r in audit.orderBy("ordinal").collect()]
    assert got == [(10, 20, None), (None, 99, "22023"), (20, 30, None), (5, None, None), (None, 1, None), (None, 1, "P0002"), (None, 3, "22023")]


# upkeep


def test_merge_of_two_duplicates(spark):
    make = spark.createDataFrame
    tables = {
        "roster": make([(1, 1, "a"), (1, 2, "b"), (1, 3, "c")], "alliance_id int, player_id int, player_name string"), "participations": make([(1, "e", 1), (2, "e", 2), (3, "f", 3), (4, "f", 2), (5, "g", 3)], "id int, event_id string, player_id int"),
        "memberships": make([(1, 2, "x"), (1, 3, "y")], "alliance_id int, player_id int, joined_at string"), "aliases": make([(1, "bb", 2)], "alliance_id int, raw_name string, player_id int"), "corrections": make([(9, 3)], "id int, player_id int"), "donations": make([(1, 1), (2, 2)], "id int, player_id int"),
    }
    out = maintenance.merge_duplicate_players(tables, make([(2, 1), (3, 1)], "player_id int, canonical_id int"))
    rows = lambda name: sorted(map(tuple, out[name].collect()))
    assert rows("participations") == [(1, "e", 1), (4, "f", 1), (5, "g", 1)] and rows("memberships") == [(1, 1, "x"), (1, 1, "y")]
    assert rows("roster") == [(1, 1, "a")] and rows("aliases") == [(1, "b", 1), (1, "bb", 1), (1, "c", 1)] and rows("corrections") == [(9, 1)] and rows("donations") == [(1, 1)]


def test_rows_come_and_go(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (5, None)], "event_id bigint, title string")
    kept, restored = maintenance.delete_and_restore(rows, F.col("title") == "a")
    assert sorted(r.event_id for r in kept.collect()) == [2, 5] and sorted((r.event_id, r.title) for r in restored.collect()) == [(2, "b"), (5, None), (6, "a")]
    new = maintenance.insert_rows(rows, spark.createDataFrame([("x", 0), ("y", 1)], "title string, ordinal int"))
    assert {(r.event_id, r.title) for r in new.collect()} >= {(6, "x"), (7, "y")}
    assert maintenance.insert_rows(rows.limit(0), spark.createDataFrame([("x", 0)], "title string, ordinal int")).first().event_id == 1
    changed = maintenance.update_rows(rows, spark.createDataFrame([(1, "z", 0), (99, "q", 1)], "event_id bigint, title string, ordinal int"))
    assert {(r.event_id, r.title) for r in changed.collect()} == {(1, "z"), (2, "b"), (5, None)}


# reads


def test_single_rows(spark):
    rows = spark.createDataFrame([(1,), (2,)], "k int")
    assert reads.single(rows.where("k = 1")).k == 1 and reads.single(rows.where("k = 3"), optional=True) is None
    for bad, optional in ((rows, False), (rows, True), (rows.where("k = 3"), False)):
        with pytest.raises(reads.NotSingle):
            reads.single(bad, optional)


def test_choices(spark):
    rows = spark.createDataFrame([("100%",), ("100 x",), ("a_b",), ("ab",), (None,)], "n string")
    find = lambda t: [r.n for r in reads.find_by_pattern(rows.where("n is not null"), "n", t, 3).collect()]
    assert find(" % ") == ["100%"] and find("_") == ["a_b"] and find("") == ["100 x", "100%", "a_b"] and find("A") == ["a_b", "ab"]


def test_keys_of_any_length(spark):
    names = spark.createDataFrame([(1, ""), (1, "ab"), (1, "abcdefgh"), (1, None)], "alliance_id int, raw_name string")
    roster = spark.createDataFrame([(1, 1, "abc"), (1, 2, "abcdefghij"), (1, 3, "abXdefgh"), (1, 4, "!")], "alliance_id int, player_id int, player_name string")
    got = {(r.raw_name, r.player_id, r.proximity) for r in duplicates.resembling(names, roster).collect()}
    assert got == {("", 4, "exact-key"), ("ab", 1, "weak"), ("abcdefgh", 2, "weak"), ("abcdefgh", 3, "strong")}


def test_candidates_equal_ranked_pairs(spark):
    rows = [(f"c{c}", k, f"{'Player' if k % 3 else 'Pl'}{k * 7 % 13}x{k % 5}", k * c % 4) for c in range(5) for k in range(30) if (k + c) % 4]
    members = spark.createDataFrame(rows, "context_id string, player_id bigint, player_name string, value bigint")
    ranked = duplicates.rank_candidates(duplicates.duplicate_pairs(members))
    columns = sorted(ranked.columns)
    assert sorted(duplicates.candidates(members).select(columns).collect()) == sorted(ranked.select(columns).collect())


# calendar


def test_ends_before_the_beginning(spark):
    rows = [(1, "daily", "2024-01-01"), (2, "none", "2024-01-01"), (3, None, "2024-01-01"), (4, "odd", "2024-01-01"), (5, "odd", None), (6, "daily", "2024-03-11"), (7, "monthly", None)]
    df = spark.createDataFrame(rows, "event_id int, recurrence string, recurrence_end string").withColumns({"date": F.lit("2024-03-10").cast("date"), "recurrence_end": F.col("recurrence_end").cast("date"), "title": F.lit("t"), "time": F.lit("20:00:00"), "type": F.lit("raid")})
    got = sorted((r.event_id, str(r.occurs_on)) for r in calendar.expand(df, "2024-03-01", "2024-03-31").collect())
    assert got == [(2, "2024-03-10"), (3, "2024-03-10"), (5, "2024-03-10"), (6, "2024-03-10"), (6, "2024-03-11"), (7, "2024-03-10")]
    assert calendar.expand(df, "2024-02-01", "2024-03-09").count() == 0
    assert {r.kind for r in calendar.widget(df, "2024-03-10").collect()} == {"today"} and [r.event_id for r in calendar.widget(df, "2024-03-12").collect()] == [7]
    assert calendar.next_of_type(df, "2024-03-10 20:00").first().event_id == 2 and str(calendar.next_of_type(df, "2024-03-10 20:01").first().occurs_on) == "2024-03-11"
    now = F.lit("2024-03-10 20:00:00").cast("timestamp")
    rows = [("2024-03-10 19:59:59",), ("2024-03-10 20:00:01",), ("2024-03-13 01:02:03",)]
    assert [r[0] for r in one(spark, rows, "t string", c=calendar.countdown(F.col("t").cast("timestamp"), now))] == ["NOW", "00h 00m 01s", "2d 05h 02m 03s"]


def test_addresses_are_encoded(spark):
    rows = [("a b+c&d/é!~*'()-_.",), ("",), (None,)]
    assert [r[0] for r in one(spark, rows, "t string", u=calendar.encoded(F.col("t")))] == ["a%20b%2Bc%26d%2F%C3%A9!~*'()-_.", "", None]


# streams


def test_a_calendar_document_is_its_files_in_order(spark, tmp_path):
    kinds = "event_id int, type string, title string, date string, time string, description string, author string, recurrence string, recurrence_end string"
    rows = [(k, "t", f"T{k}; x", f"2026-03-0{k}", "20:00", "", "me", "daily" if k == 2 else "none", None) for k in range(1, 5)]
    events = spark.createDataFrame(rows, kinds).withColumns({c: F.col(c).cast("date") for c in ("date", "recurrence_end")})

    def document(name, *args):
        calendar.write_document(calendar.vcalendar(*args), str(tmp_path / name))
        return b"".join(p.read_bytes() for p in sorted((tmp_path / name).glob("part-*"))).decode()

    week = document("week", events.repartition(3), "S", "2026-03-02", "2026-03-04")
    lines = week.split("\r\n")
    assert lines[:4] == ["BEGIN:VCALENDAR", "VERSION:2.0", "PRODID:-//Muster//Alliance Events//EN", "CALSCALE:GREGORIAN"] and lines[-2:] == ["END:VCALENDAR", ""]
    assert [x for x in lines if x.startswith("UID:")] == [f"UID:{k}-2026-03-0{d}@muster.example" for d, k in ((2, 2), (3, 2), (3, 3), (4, 2), (4, 4))]
    assert "RRULE" not in week and "SUMMARY:T3\\; x" in lines and "\n" not in week.replace("\r\n", "")
    assert "RRULE:FREQ=DAILY" in document("one", events.where("event_id = 2"), "S")
    assert document("none", events.where("false"), "S").split("\r\n")[-3:] == ["CALSCALE:GREGORIAN", "END:VCALENDAR", ""]


def test_superseded_content_stays_a_duplicate(spark, tmp_path):
    write = lambda rows, name: spark.createDataFrame(rows, "k int, v string, ordinal bigint").coalesce(1).write.parquet(str(tmp_path / "in" / name))
    schema = spark.createDataFrame([], "k int, v string, ordinal bigint").schema
    run = lambda: ingest.ingest(spark, f"{tmp_path}/in/*", schema, f"{tmp_path}/state", f"{tmp_path}/log", ["k"], ["k", "v"], ["ordinal"])
    for name, value in (("one", "a"), ("two", "b"), ("three", "a"), ("four", "c"), ("five", "b")):
        write([(1, value, 0)], name)
        out = run()
    assert [(r.k, r.v) for r in out.collect()] == [(1, "c")]
    assert len(list((tmp_path / "state" / "manifest").iterdir())) == 2
    # a batch that is run again gives the same snapshot
    batch = spark.createDataFrame([(1, "b", 0)], schema)
    ingest.merge_batch(batch, 4, f"{tmp_path}/state", ["k"], ["k", "v"], ["ordinal"])
    assert [(r.k, r.v) for r in ingest.snapshot(spark, f"{tmp_path}/state", out.schema).collect()] == [(1, "c")]


def written(folder):
    return {(int(b.parent.name[2:]), int(b.name[7:])) for b in (folder / "data").glob("v=*/bucket=*")}


def test_a_batch_rewrites_the_buckets_of_its_keys_alone(spark, tmp_path, monkeypatch):
    state, schema = str(tmp_path), "k int, v string, ordinal bigint"
    full = schema + ", batch_id bigint, content_hash string"
    merge = lambda rows, n: ingest.merge_batch(spark.createDataFrame(rows, schema), n, state, ["k"], ["k", "v"], ["ordinal"])
    now = lambda: {r.k: r.v for r in ingest.snapshot(spark, state, full).collect()}
    assert now() == {}
    merge([(k, "a", 0) for k in range(500)], 0)
    assert {v for v, _ in written(tmp_path)} == {0} and len(written(tmp_path)) == ingest.BUCKETS
    merge([(7, "b", 0)], 1)
    assert len([b for v, b in written(tmp_path) if v == 1]) == 1 and now() == {k: "a" for k in range(500)} | {7: "b"}
    # killed after the data and before the commit: readers see the state before, and the batch is run again
    commit = ingest.commit
    monkeypatch.setattr(ingest, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        merge([(7, "c", 0), (8, "c", 0)], 2)
    assert now() == {k: "a" for k in range(500)} | {7: "b"}
    monkeypatch.setattr(ingest, "commit", commit)
    merge([(7, "c", 0), (8, "c", 0)], 2)
    want = {k: "a" for k in range(500)} | {7: "c", 8: "c"}
    assert now() == want
    # content that was ever taken in, also of a batch whose rows were superseded; and a batch without news
    merge([(7, "b", 9), (8, "a", 9)], 3)
    assert now() == want and not [b for v, b in written(tmp_path) if v == 3]
    # what no state of the last two refers to is gone
    held = {(v, b) for m in (2, 3) for b, v in ingest._manifest(spark, state, m).items()}
    assert written(tmp_path) == held and sorted(p.name for p in (tmp_path / "manifest").iterdir()) == ["v=2", "v=3"]


def test_notices_make_readers_read_again(spark, tmp_path):
    notices = spark.createDataFrame([(1,)], "k int")
    seen = []
    for n in (1, 2):
        notices.coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        ingest.follow(spark, f"{tmp_path}/in/*", notices.schema, f"{tmp_path}/log", lambda n=n: spark.range(n), lambda df: seen.append(df.count()))
    assert seen == [1, 2]


def test_order_by_content_needs_no_ledger(spark, tmp_path):
    """Content that comes again never wins where its order is content too; the row kept is that of its first batch."""
    schema = "k int, v bigint, ordinal bigint"
    merge = lambda rows, n, content: ingest.merge_batch(spark.createDataFrame(rows, schema), n, f"{tmp_path}/{len(content)}", ["k"], content, ["ordinal"], by_batch=False)
    for content in (["k", "v", "ordinal"], ["k", "v"]):
        for n, rows in enumerate(([(1, 5, 1), (2, 5, 9)], [(1, 6, 2)], [(1, 5, 1 if len(content) == 3 else 3), (2, 5, 9)])):
            merge(rows, n, content)
        out = ingest.snapshot(spark, f"{tmp_path}/{len(content)}", "k int, v bigint, ordinal bigint, batch_id bigint, content_hash string")
        assert sorted((r.k, r.v, r.batch_id) for r in out.collect()) == [(1, 6, 1), (2, 5, 0)]
        assert (tmp_path / str(len(content)) / "ledger").exists() == (len(content) == 2)
