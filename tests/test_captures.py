"""Readings and repairs of captures against vectors that must hold."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from muster.functions import formats, names, numbers, times
from muster.operators import capture, screens, stats_chat
from muster.sources import messages
from tests.test_operators import one, posts

#: Lines of chat posts with their place, and the slot, value and kind of attack that they say.
READINGS = (
    ("LRA-412", 0, "attack", 412.0, "lra"), ("lra 409", 0, "attack", 409.0, "lra"), ("Lra 339", 0, "attack", 339.0, "lra"), ("mra 938", 0, "attack", 938.0, "mra"), ("MRA 938", 0, "attack", 938.0, "mra"),
    ("1) LRA - 1183.4", 0, "attack", 1183.4, "lra"), ("1) LRA - 498 5%", 0, "attack", 498.5, "lra"), ("LRA : 502.9%", 0, "attack", 502.9, "lra"), ("Wrath 774", 0, "attack", 774.0, "lra"), ("Ira 474", 0, "attack", 474.0, "lra"),
    ("1. LRA 596.9", 0, "attack", 596.9, "lra"), ("1. LRA 620", 0, "attack", 620.0, "lra"), ("MHP-319", 1, "hp", 319.0, None), ("mhp 293", 1, "hp", 293.0, None), ("2) MHP - 1049.3", 1, "hp", 1049.3, None), ("MAP 277.7", 1, "hp", 277.7, None),
    ("Pv 551", 1, "hp", 551.0, None), ("2)370", 1, "hp", 370.0, None), ("MGD-260", 2, "defense", 260.0, None), ("3) MHD - 653.5", 2, "defense", 653.5, None), ("md 251", 2, "defense", 251.0, None), ("MD 379", 2, "defense", 379.0, None),
    ("Defense 339", 2, "defense", 339.0, None), ("Mdf 315", 2, "defense", 315.0, None), ("3)269", 2, "defense", 269.0, None), ("MHD 388", 2, "defense", 388.0, None), ("363", 0, "attack", 363.0, None), ("407", 1, "hp", 407.0, None),
    ("269", 2, "defense", 269.0, None), ("408.5", 1, "hp", 408.5, None), ("482.5", 0, "attack", 482.5, None), ("2713.2", 1, "hp", 713.2, None), ("3443.9", 2, "defense", 443.9, None), ("2713.2", 0, "attack", 2713.2, None),
    ("1049.3", 0, "attack", 1049.3, None), ("3) MHD - 477 1}", 2, "defense", 477.0, None), ("2) MHP - 754 -", 1, "hp", 754.0, None),
)
#: Captures and the name, attack, kind, hp and defense of their members.
CHATS = (
    (["PlayerOne", "LRA-412", "MHP-319", "MGD-260"], [("PlayerOne", 412.0, "lra", 319.0, 260.0)]),
    (["SomeName", "363", "407", "269"], [("SomeName", 363.0, "lra", 407.0, 269.0)]),
    (["scepter", "| 1)887.2", "2713.2 №", "т г = | 3)443.9"], [("scepter", 887.2, "lra", 713.2, 443.9)]),
    (["Bulleit", "1) LRA - 983", "2) MHP - 754 -", "3) MHD - 477 1}"], [("Bulleit", 983.0, "lra", 754.0, 477.0)]),
    (["DarKKnight", "mhp 730", "mra 938", "MD 430"], [("DarKKnight", 938.0, "mra", 730.0, 430.0)]),
    (["05-02 13:20", "PlayerAlpha", "google", "1) LRA - 498 5%", "A", "2)370", "3)269", "05-02 13:21", "PlayerBeta", "LRA : 502.9%", "MAP 277.7", "Mdf 315"], [("PlayerAlpha", 498.5, "lra", 370.0, 269.0), ("PlayerBeta", 502.9, "lra", 277.7, 315.0)]),
    (["PartialPlayer", "LRA-412", "MHP-319"], [("PartialPlayer", 412.0, "lra", 319.0, None)]),
    (["Ichigo_19", "Lra 571", "362", "461"], [("Ichigo_19", 571.0, "lra", 362.0, 461.0)]),
    (["King.gerald", "Wrath 774", "Pv 551", "Defense 339"], [("King.gerald", 774.0, "lra", 551.0, 339.0)]),
    (["Метью", "1) Lra 339", "Mhp-240", "Mgd-233", "google", "Герман", "LRA-412", "MHP-319", "MGD-260", "google", "Bumbelbee", "1) 407", "2) 370", "3) 269"], [("Метью", 339.0, "lra", 240.0, 233.0), ("Герман", 412.0, "lra", 319.0, 260.0), ("Bumbelbee", 407.0, "lra", 370.0, 269.0)]),
    (["RageX_", "Hello everyone JR will be working on a project for me and the alliance", "The 3 things we need from you are 1 Long range attack percent", "Метью", "Lra 339", "Mhp-240", "Mgd-233"], [("Метью", 339.0, "lra", 240.0, 233.0)]),
    (["FATCAT29", "im still using VIP buff", "Bibble", "1) LRA: 712.3", "2) MHP: 514.1", "3) MD: 328.1"], [("Bibble", 712.3, "lra", 514.1, 328.1)]),
    (["Толик", "650", "460", "310"], [("Толик", 650.0, "lra", 460.0, 310.0)]),
    (["Yahoo", "1) LRA - 498 5%", "2) MHP - 327.6%", "3) MHD - 223.4%"], [("Yahoo", 498.5, "lra", 327.6, 223.4)]),
    (["(LOL) City stats", "05-02 13:20", "KlausRider", "363", "368", "318", "google", "LEON", "1 ) 645.7", "2 ) 405", "3 ) 272.6", "google"], [("KlausRider", 363.0, "lra", 368.0, 318.0), ("LEON", 645.7, "lra", 405.0, 272.6)]),
    (["ＬＥＯＮ  x", "363"], [("LEON x", 363.0, "lra", None, None)]),
    ([], []),
    ([None, "", "363"], []),
)


def test_readings_of_single_lines(spark):
    """A line at its place comes after as many readings of the slots before."""
    captures = [["Somebody", *["1)11", "2)22"][:place], line] for line, place, _, _, _ in READINGS]
    for (line, _, slot, value, kind), got in zip(READINGS, posts(spark, captures), strict=True):
        assert getattr(got[0], f"{slot}_pct") == pytest.approx(value), line
        assert kind is None or got[0].attack_kind == kind, line


def test_chats(spark):
    for (lines, want), got in zip(CHATS, posts(spark, [lines for lines, _ in CHATS]), strict=True):
        assert [(m.name, m.attack_pct, m.attack_kind, m.hp_pct, m.defense_pct) for m in got] == want, lines
        assert all(m.confidence == pytest.approx(sum(x is not None for x in (m.attack_pct, m.hp_pct, m.defense_pct)) / 3) for m in got)


def test_classes_of_lines(spark):
    noise = ["05-02 13:20", "2026-05-02 13:20", "13:20", "google", "auto", "Tap to Chat", "send", "A", "AA", "", "Hello everyone JR will be working on a project for me and the alliance"]
    people = ["PlayerName", "Метью", "ZEROHERO", "RageX_", "Герман", "JasmınTソ", "FATCAT29", "King.gerald", "DuyMặtThẹo"]
    readings = ["LRA-412", "408.5", "MHP-319", "363"]
    rows = [(1, k, line) for k, line in enumerate([*noise, *people, *readings])]
    got = [r["class"] for r in stats_chat.classified(spark.createDataFrame(rows, "capture_id int, line_no int, line string")).orderBy("line_no").collect()]
    assert got == ["noise"] * len(noise) + ["name"] * len(people) + ["reading"] * len(readings)


# honor


def honors(spark, *captures):
    rows = [(c, k, h, cand, conf) for c, rows in enumerate(captures) for k, (h, cand, conf) in enumerate(rows)]
    df = spark.createDataFrame(rows, "capture_id int, row_index bigint, honor bigint, candidates array<bigint>, confidence double")
    out = [[] for _ in captures]
    for r in capture.repair_honor(df).orderBy("capture_id", "row_index").collect():
        out[r.capture_id].append((r.honor, r.confidence, (r.lower, r.upper) if r.suspect else None))
    return out


def test_honor_vectors(spark):
    r = lambda h, cand=(), conf=0.9: (h, None if cand is None else list(cand), conf)
    got = honors(
        spark,
        [r(3173), r(2925), r(1785), r(1785)], [r(3173), r(9044, [9044, 2925]), r(2878)], [r(3173), r(9044, [2925], 0.2), r(2878)], [r(2458), r(92256, [92256]), r(2051)],
        [r(2051), r(2, [2035])], [r(4734), r(7, [7])], [r(1000), r(250)], [r(2458), r(92256, [92256]), r(2051, [92256])], [r(350), r(999999, [999999, 0])],
        [r(3173), r(9044, None)], [r(1000), r(9, [9, 900])], [r(1000), r(9500, [950]), r(100, [400])], [r(1000), r(9999, []), r(5000, [])], [r(1000), r(0)],
    )
    assert got[0] == [(h, 0.9, None) for h in (3173, 2925, 1785, 1785)]
    assert got[1][1] == (2925, 0.40, (2878, 3173)) and got[2][1] == (2925, 0.2, (2878, 3173)) and got[3][1] == (92256, 0.0, (2051, 2458))
    assert got[4][1] == (2035, 0.40, (411, 2051)) and got[5][1] == (7, 0.0, (947, 4734)) and got[6][1] == (250, 0.9, None)
    assert got[7][1][2] is not None and got[7][2] == (2051, 0.9, None) and got[8][1] == (0, 0.40, (0, 350))
    assert got[9][1] == (9044, 0.9, (0, 3173)) and got[10][1] == (900, 0.40, (201, 1000))
    assert got[11][1:] == [(950, 0.40, (100, 1000)), (100, 0.9, None)]  # below a repaired row nothing is too small
    assert got[12][2] == (5000, 0.9, None)  # the row above counts as it was read
    assert got[13][1] == (0, 0.9, None)


def test_position_vectors(spark):
    cases = [
        ([60, 61, 62, 3, 64, 65], [60, 61, 62, 63, 64, 65]), ([60, 61, 69, 2, 8, 7, 7, 4], [60, 61, 69, None, None, None, None, None]), ([10, 11, 12, 13], [10, 11, 12, 13]), ([10, None, 12, 13], [10, 11, 12, 13]),
        ([None] * 3, [None] * 3), ([61, 2, 63, 4], [61, 62, 63, 64]), ([9, 10, None, None, None], [9, 10, 11, 12, 13]),
    ]
    rows = [(c, k, p) for c, (read, _) in enumerate(cases) for k, p in enumerate(read)] + [(99, 0, 1), (99, 2, 3), (99, None, 7)]
    got = {(r.capture_id, r.row_index): r.position for r in capture.repair_positions(spark.createDataFrame(rows, "capture_id int, row_index bigint, position bigint")).collect()}
    assert got == {(c, k): p for c, (_, want) in enumerate(cases) for k, p in enumerate(want)} | {(99, 0): 1, (99, 2): 3, (99, None): 7}


# screens


def test_titles_that_come_close(spark):
    known = [*screens.TITLES, ("abc", "short")]
    headers = ["Eiite Wars 12:00 Rank", "12:00 p0lar invas1on", "avoid", "abd", "", "   ", "battle  frenzi", "wars elite", "x " * 300 + "void vvar"]
    rows = [(k, h) for k, h in enumerate(headers)] + [(100, None), (101, "Eiite Wars 12:00 Rank")]
    got = {r.k: (r.kind, r.code) for r in screens.route(spark.createDataFrame(rows, "k int, header string"), known).collect()}
    assert got[0] == got[101] == ("event", "elite_wars") and got[1] == ("event", "polar_invasion") and got[6] == ("event", "battle_frenzy")
    assert all(got[k] == ("unknown_event", None) for k in (2, 3, 4, 5, 7, 100)) and got[8] == ("event", "void_war")


def test_titles_of_a_table(spark):
    table = spark.createDataFrame([("a", ["Alpha Day", "Beta"]), ("b", None)], "code string, title_aliases array<string>")
    assert screens.titles(spark, table) == [("alpha day", "a"), ("beta", "a")]
    assert screens.titles(spark, table.where("code = 'b'")) == list(screens.TITLES) == screens.titles(spark)


# votes, words, headers


def test_votes_and_words(spark):
    rows = [(["R2", "R3", "R3", "R2"],), (["5", "R4", "5"],), (["2", "3", "3"],), (["2", "3"],), ([],), (["", None],)]
    assert [r[0] for r in one(spark, rows, "r array<string>", v=capture.ordered_vote(F.col("r")))] == ["R3", "R4", "R3", "R2", "R1", "R1"]
    word = "w array<struct<text:string,conf:int,x:int>>"
    rows = [([(" b ", 90, 5), ("a", 20, 1), ("", 99, 0), ("c", 19, 9)],), ([],), ([("z", -1, 0)],)]
    assert one(spark, rows, word, t=capture.joined_words(F.col("w")), c=capture.word_confidence(F.col("w"))) == [("ab", pytest.approx(0.43)), ("", 0.0), ("", 0.0)]


def test_rows_that_fit_a_screen(spark):
    rows = [(2400, 411), (2400, 100), (400, 411), (2400, 2400)]
    assert [r[0] for r in one(spark, rows, "h int, t int", n=capture.expected_rows(F.col("h"), F.col("t"), F.lit(179)))] == [12, 12, 0, 1]


# numbers, names, times


def test_cells_and_ranks(spark):
    rows = [("12 Bob",), (" 7  x",), ("123 y",), ("Bob",), (None,)]
    assert [r[0] for r in one(spark, rows, "a string", a=numbers.strip_leading_rank(F.col("a")))] == ["Bob", "x", "123 y", "Bob", None]


def test_cyrillic(spark):
    rows = [("АНА", "Аня", "AHA"), ("КАМНА_", "КАМНА_", "KANHA_"), ("Е (SOD) Momoa", "Мотоя", "x"), ("АНА", "", "A"), ("トド | (500) СЕКАТОР_1000", "x", "| (SOD) CEKATOP_1000"), ("", "я", "x"), (None, "я", "x")]
    got = [r[0] for r in one(spark, rows, "n string, r string, e string", n=names.settle_cyrillic(F.col("n"), F.col("r"), F.col("e")))]
    assert got == ["Аня", "KANHA_", "Е (SOD) Momoa", "АНА", "| (SOD) CEKATOP_1000", "", None]
    rows = [("カナ", "中", "abc1Я")]
    assert one(spark, rows, "a string, b string, c string", a=names.has_kana(F.col("a")), b=names.has_kana(F.col("b")), c=names.has_cjk(F.col("b")), d=names.identity_length(F.col("c"))) == [(True, False, True, 5)]


def test_countdowns(spark):
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    rows = [("1d:00:00:10",), ("1:0:0",), ("2:5",), ("x:1:5",), ("5",), ("0:0",), ("1:2:3:4:5",), ("",), (None,)]
    got = [r[0] for r in one(spark, rows, "c string", c=times.parse_countdown(F.col("c"), now).cast("string"))]
    assert got == ["2026-01-02 00:00:10", "2026-01-01 01:00:00", "2026-01-01 00:02:05", "2026-01-01 00:01:05", None, None, None, None, None]


def test_formats(spark):
    rows = [(None, None, None), (1234567, 12.345, "2026-03-29 00:30:00")]
    got = one(spark, rows, "h bigint, p double, t string", h=formats.honor(F.col("h")), p=formats.percent(F.col("p")), e=formats.event_time(F.col("t").cast("timestamp")), u=formats.updated_at(F.col("t").cast("timestamp")), w=formats.week_label(F.col("t").cast("date")), r=formats.rate_band(F.col("p")), c=formats.confidence_band(F.col("p")))
    assert got == [("—", "—", None, "—", "—", "unknown", "unknown"), ("1,234,567", "12.3%", "29 Mar 2026, 01:30", "29/03/2026, 01:30", "Week of 29 March 2026", "poor", "fair")]


# messages and files


def test_images(spark, tmp_path):
    rows = [("image/png; x=1", "a.txt"), ("text/plain", "a.png"), (None, "A.JPEG"), ("", "b.webp"), (None, "c"), (None, "d.png.txt"), (None, None)]
    assert [r[0] for r in one(spark, rows, "t string, n string", i=messages.is_image(F.col("t"), F.col("n")))] == [True, False, True, True, False, False, False]
    kind = "message_id bigint, created_at bigint, attachments array<struct<content_type:string,filename:string>>"
    df = spark.createDataFrame([(3, 30, [(None, "x.txt"), (None, "y.gif")]), (1, 10, [("image/png", "z")]), (2, 20, []), (4, 5, None)], kind)
    assert [r.message_id for r in messages.image_messages(df).collect()] == [1, 3]
    assert [r.message_id for r in messages.page_before(df, 4, 2).collect()] == [3, 2]
    (tmp_path / "a.png").write_bytes(b"abc")
    (tmp_path / "b.txt").write_bytes(b"abc")
    assert [(r.length, r.file_hash) for r in messages.read_images(spark, str(tmp_path)).collect()] == [(3, "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")]


def test_seed_of_event_types(spark):
    present = spark.createDataFrame([("void_war", "Old", "v0", ["x"]), ("mine", "Mine", "v1", ["m"])], "code string, display_name string, layout_version string, title_aliases array<string>")
    got = {r.code: r.display_name for r in messages.seed_event_types(spark, present).collect()}
    assert len(got) == 7 and got["void_war"] == "Void War" and got["mine"] == "Mine" and messages.seed_event_types(spark).count() == 6
