"""What is done to captures before they are written: answers of a second reader, votes, headers, words of a line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.functions import names
from muster.operators import accuracy, capture
from muster.plans.oracles import sql
from muster.plans.registry import query
from muster.sources import captures
from muster.sources.domain import Domain


@query("asked_again", sql("SELECT donation_id, CASE WHEN donation_id % 3 = 0 THEN 'suspect_honor' WHEN donation_id % 5 = 0 THEN 'misread_name' WHEN confidence < 0.35 THEN 'low_confidence' END AS reason FROM dons"))
def asked_again(d: Domain) -> DataFrame:
    name = F.when(F.col("donation_id") % 5 == 0, "A > №").otherwise("Bulleit")
    return capture.asked_again(d.donations.select("donation_id", "confidence", name.alias("player_name"), (F.col("donation_id") % 3 == 0).alias("suspect"))).select("donation_id", "reason")


@query("reader_given_up", sql("""SELECT donation_id, ask AND NOT failed AND NOT coalesce(bool_or(failed AND streak >= 2) OVER (PARTITION BY period_id, ask ORDER BY donation_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS answered FROM (
  SELECT *, count(*) FILTER (failed) OVER (PARTITION BY period_id, ask, good ORDER BY donation_id) AS streak FROM (
  SELECT *, count(*) FILTER (NOT failed) OVER (PARTITION BY period_id, ask ORDER BY donation_id) AS good FROM (SELECT donation_id, period_id, donation_id % 4 > 0 AS ask, donation_id % 7 < 2 AS failed FROM dons)))"""))
def reader_given_up(d: Domain) -> DataFrame:
    rows = d.donations.select("donation_id", F.col("period_id").alias("capture_id"), (F.col("donation_id") % 4 > 0).alias("ask"), (F.col("donation_id") % 7 < 2).alias("failed"))
    return capture.answered_until(rows, "donation_id", "failed").select("donation_id", "answered")


@query("llm_donation_merge", sql("""SELECT donation_id, CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN honor + 5 ELSE honor END AS honor, CASE WHEN k % 3 = 0 AND k % 2 = 0 OR k % 3 = 1 AND k % 2 = 0 AND k % 5 > 0 THEN CASE WHEN k % 5 = 0 THEN 'old' ELSE 'new' END ELSE 'old' END AS player_name,
  CASE WHEN k % 3 = 2 THEN 0.9 WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN 0.45 ELSE 0.0 END WHEN k % 5 = 0 THEN 0.9 WHEN k % 2 = 0 THEN -1.0 ELSE 0.0 END::DOUBLE AS confidence FROM (SELECT *, donation_id AS k FROM dons)"""))
def llm_donation_merge(d: Domain) -> DataFrame:
    """Every third row is suspect, with a window of ten; every third is not answered; every fifth answer has no name."""
    k = F.col("donation_id")
    rows = d.donations.select("donation_id", F.col("period_id").alias("capture_id"), k.alias("row_index"), F.lit("old").alias("player_name"), "honor", F.lit(0.9).alias("confidence"), F.when(k % 3 == 0, F.col("honor") - 10).alias("lower"), F.when(k % 3 == 0, F.col("honor") + 10).alias("upper"))
    score = F.when(k % 2 > 0, F.col("honor") + 50).when(k % 3 == 0, F.col("honor") + 5).otherwise(F.col("honor"))
    answers = rows.where("donation_id % 3 < 2").select("capture_id", "row_index", F.when(k % 5 > 0, "ｎｅｗ ").alias("name"), score.alias("score"))
    return capture.merge_donation_answers(rows, answers).select("donation_id", "honor", "player_name", "confidence")


@query("llm_event_merge", sql("SELECT participation_id, CASE WHEN participation_id % 2 = 0 AND participation_id % 3 > 0 THEN 'new' ELSE 'old' END AS player_name, CASE WHEN participation_id % 2 = 0 THEN -1.0::DOUBLE ELSE confidence END AS confidence FROM parts"))
def llm_event_merge(d: Domain) -> DataFrame:
    k = F.col("participation_id")
    rows = d.participations.select("participation_id", F.col("event_id").alias("capture_id"), k.alias("row_index"), F.lit("old").alias("player_name"), "confidence")
    answers = rows.where("participation_id % 2 = 0").select("capture_id", "row_index", F.when(k % 3 > 0, "new").alias("name"))
    return capture.merge_event_answers(rows, answers).select("participation_id", "player_name", "confidence")


@query("llm_stat_merge", sql("SELECT player_id, recorded_date, CASE WHEN player_id % 3 = 0 AND player_id % 2 = 0 THEN 7.0 ELSE attack_pct END AS attack_pct, hp_pct, CASE WHEN player_id % 3 = 0 AND player_id % 2 = 0 THEN -1.0 WHEN player_id % 2 = 0 THEN 0.5 ELSE 0.8 END::DOUBLE AS confidence FROM stats"))
def llm_stat_merge(d: Domain) -> DataFrame:
    """Answers for every third player, the later of two counts; only rows of low confidence take them."""
    k = F.col("player_id")
    rows = d.stats.select("player_id", F.col("recorded_date").cast("string").alias("recorded_date"), "player_name", *(F.col(c).cast("double").alias(c) for c in capture.STATS), F.when(k % 2 == 0, 0.5).otherwise(0.8).alias("confidence"))
    rows = rows.withColumn("capture_id", F.col("recorded_date"))
    none = F.lit(None).cast("double")
    answers = rows.where("player_id % 3 = 0").select("capture_id", F.explode(F.array(F.struct(F.lit(1).alias("ordinal"), F.lit(5.0).alias("attack_pct")), F.struct(F.lit(2).alias("ordinal"), F.lit(7.0).alias("attack_pct")))).alias("a"), F.concat(F.lit(" "), F.col("player_name")).alias("name"))
    answers = answers.select("capture_id", "name", "a.ordinal", "a.attack_pct", none.alias("hp_pct"), none.alias("defense_pct"))
    return capture.merge_stat_answers(rows, answers).select("player_id", "recorded_date", "attack_pct", "hp_pct", "confidence")


@query("header_fields", """SELECT o_orderkey, CASE WHEN three THEN rank3 END AS alliance_rank, CASE WHEN three THEN battlers3 ELSE 20 END AS total_battlers, CASE WHEN three THEN 300 ELSE 200 END AS total_points FROM (
  SELECT *, CASE WHEN code IN ('polar_invasion', 'elite_wars') THEN true WHEN code = 'void_war' THEN false ELSE coalesce(rank3 BETWEEN 1 AND 9999, false) AND coalesce(battlers3 <= 999, true) END AS three FROM (
  SELECT o_orderkey, (['polar_invasion', 'elite_wars', 'void_war', 'other', NULL])[o_orderkey % 5 + 1] AS code, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 7 - 1 END AS rank3, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 1500 END AS battlers3 FROM orders))""")
def header_fields(d: Domain) -> DataFrame:
    k = F.col("o_orderkey")
    code = F.get(F.array(*(F.lit(c) for c in ("polar_invasion", "elite_wars", "void_war", "other", None))), (k % 5).cast("int"))
    rows = d.raw("orders").select("o_orderkey", code.alias("event_type"), F.when(k % 7 > 0, k % 7 - 1).alias("rank3"), F.when(k % 3 > 0, k % 1500).alias("battlers3"), F.lit(300).cast("bigint").alias("points3"), F.lit(20).cast("bigint").alias("battlers2"), F.lit(200).cast("bigint").alias("points2"))
    return capture.header_fields(rows).select("o_orderkey", "alliance_rank", "total_battlers", "total_points")


@query("ordered_vote", "SELECT o_orderkey, (['R3', 'R2', 'R4', 'R5', 'R1'])[o_orderkey % 5 + 1] AS rank FROM orders")
def ordered_vote(d: Domain) -> DataFrame:
    """The first read twice; a single strong reading before weak ones; the commoner digit; the earlier on ties; nothing."""
    forms = F.array(*(F.array(*map(F.lit, x)) for x in (("R2", "R3", "xR3", "R2"), ("5", "5", "R2"), ("3", "4", "4"), ("5", "", "1"), ("", "R", "9"))))
    return d.raw("orders").select("o_orderkey", capture.ordered_vote(F.get(forms, (F.col("o_orderkey") % 5).cast("int"))).alias("rank"))


@query("line_words", "SELECT l_orderkey, string_agg('w' || l_linenumber, ' ' ORDER BY -l_linenumber, l_linenumber) FILTER (l_quantity >= 20) AS text, coalesce(avg(CAST(l_quantity AS BIGINT)) FILTER (l_quantity >= 10) / 100, 0) AS confidence FROM (SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS l_linenumber, l_quantity FROM lineitem) GROUP BY l_orderkey")
def line_words(d: Domain) -> DataFrame:
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    rows = d.raw("lineitem").select("l_orderkey", n.alias("n"), F.col("l_quantity").cast("bigint").alias("conf"))
    word = F.struct(F.concat(F.lit(" w"), F.col("n").cast("string")).alias("text"), "conf", (-F.col("n")).alias("x"))
    lines = rows.groupBy("l_orderkey").agg(F.collect_list(word).alias("words"))
    return lines.select("l_orderkey", F.nullif(capture.joined_words(F.col("words"), sep=" "), F.lit("")).alias("text"), capture.word_confidence(F.col("words")).alias("confidence"))


@query("tab_outlier", "SELECT l_orderkey, CASE WHEN greatest(abs(a - m), abs(b - m), abs(c - m)) >= 15 THEN CASE WHEN abs(a - m) >= abs(b - m) AND abs(a - m) >= abs(c - m) THEN 0 WHEN abs(b - m) >= abs(c - m) THEN 1 ELSE 2 END END AS tab FROM (SELECT *, list_sort([a, b, c])[2] AS m FROM (SELECT l_orderkey, min(l_quantity) AS a, max(l_quantity) AS b, min(l_discount) * 100 AS c FROM lineitem GROUP BY 1))")
def tab_outlier(d: Domain) -> DataFrame:
    g = d.raw("lineitem").groupBy("l_orderkey").agg(F.min("l_quantity").alias("a"), F.max("l_quantity").alias("b"), (F.min("l_discount") * 100).alias("c"))
    return g.select("l_orderkey", capture.tab_outlier(F.array("a", "b", "c")).cast("int").alias("tab"))


@query("expected_rows", "SELECT o_orderkey, CAST(greatest(0, least(12, floor((2400 - o_orderkey % 2600) / 175.0) + 1)) AS INTEGER) AS expected FROM orders")
def expected_rows(d: Domain) -> DataFrame:
    return d.raw("orders").select("o_orderkey", capture.expected_rows(F.lit(2400), F.col("o_orderkey") % 2600, F.lit(175)).alias("expected"))


@query("valid_donations", sql("SELECT donation_id, donation_id % 4 > 0 AND donation_id % 3 > 0 AS valid FROM dons"))
def valid_donations(d: Domain) -> DataFrame:
    k = F.col("donation_id")
    rows = d.donations.select("donation_id", F.when(k % 4 > 0, "x").otherwise(" ").alias("player_name"), F.when(k % 3 > 0, F.col("honor")).otherwise(-1).alias("honor"))
    return rows.select("donation_id", capture.valid_donation_row().alias("valid"))


@query("cyrillic_names", "SELECT o_orderkey, (['Аня', 'KANHA_', 'АНА', 'Momoa', 'ЖAAA'])[o_orderkey % 5 + 1] AS name FROM orders")
def cyrillic_names(d: Domain) -> DataFrame:
    """Russian readings with a letter of their own win, then English ones that are long enough."""
    at = lambda *x: F.get(F.array(*map(F.lit, x)), (F.col("o_orderkey") % 5).cast("int"))
    settled = names.settle_cyrillic(at("АНА", "КАМНА_", "АНА", "Momoa", "ЖAAA"), at("Аня", "КАМНА_", "", "Мотоя", "x"), at("AHA", "KANHA_", "A", "x", "y"))
    return d.raw("orders").select("o_orderkey", settled.alias("name"))


@query("accuracy_regressions", "SELECT l_returnflag, field FROM (SELECT l_returnflag, count(*) FILTER (l_linenumber % 2 = 0) AS a, count(*) FILTER (l_linenumber % 3 = 0) AS b, count(*) FILTER (l_linenumber % 3 = 0) AS a0, count(*) FILTER (l_linenumber % 2 = 0) AS b0 FROM lineitem GROUP BY 1), (VALUES ('a'), ('b')) v(field) WHERE field = 'a' AND a < a0 OR field = 'b' AND b < b0")
def accuracy_regressions(d: Domain) -> DataFrame:
    count = lambda n, name: F.count_if(F.col("l_linenumber") % n == 0).alias(name)
    g = d.raw("lineitem").groupBy("l_returnflag")
    return accuracy.regressions(g.agg(count(2, "a"), count(3, "b")), g.agg(count(3, "a"), count(2, "b")), "l_returnflag", ["a", "b"])


@query("audit_verdicts", sql("SELECT donation_id AS case_id, CASE donation_id % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' ELSE 'other' END AS verdict FROM dons"))
def audit_verdicts(d: Domain) -> DataFrame:
    """Cases whose capture holds one row: the true honor, the stored one, or neither under a name that comes close."""
    k = F.col("donation_id")
    cases = d.donations.select(k.alias("case_id"), k.alias("capture_id"), F.lit("Somebody").alias("name"), (F.col("honor") + 1).alias("stored"), F.col("honor").alias("true"))
    rows = d.donations.select(k.alias("capture_id"), F.lit("Somebodi").alias("player_name"), F.when(k % 3 == 0, F.col("honor")).when(k % 3 == 1, F.col("honor") + 1).otherwise(-5).alias("honor"))
    return accuracy.audit_verdicts(cases, rows)


@query("stats_matched", sql("SELECT player_id, recorded_date, attack_pct IS NULL OR player_id % 2 = 0 AS same FROM stats"))
def stats_matched(d: Domain) -> DataFrame:
    a = F.col("attack_pct").cast("double")
    return d.stats.select("player_id", F.col("recorded_date").cast("string").alias("recorded_date"), accuracy.stats_match(a, a + F.when(F.col("player_id") % 2 == 0, 0.05).otherwise(0.06)).alias("same"))


@query("model_answers", """SELECT p_partkey, n, CASE WHEN n > 0 THEN p_name END AS name, CASE WHEN n > 0 AND p_partkey % 3 < 2 THEN p_size END AS score, CASE WHEN n > 0 AND p_partkey % 2 = 0 THEN 'R2' END AS rank
  FROM (SELECT *, CASE WHEN p_partkey % 5 = 4 THEN 0 ELSE 1 END AS n FROM part)""")
def model_answers(d: Domain) -> DataFrame:
    """What a language model's answers list: an object, a bare array, an object within prose that has braces of its own, and
    answers that are broken; scores as numbers, as texts and as neither; entries without a name."""
    k = F.col("p_partkey")
    score = F.when(k % 3 == 0, F.col("p_size").cast("string")).when(k % 3 == 1, F.concat(F.lit('"'), F.col("p_size").cast("string"), F.lit('"'))).otherwise(F.lit('"many"'))
    rank = F.when(k % 2 == 0, F.lit('"R2"')).otherwise(F.lit("2"))
    rows = F.concat(F.lit('[{"name": " '), F.col("p_name"), F.lit(' ", "score": '), score, F.lit(', "rank": '), rank, F.lit('}, {"name": " "}, 7]'))
    whole = F.concat(F.lit('{"members": '), rows, F.lit("}"))
    text = F.when(k % 5 == 0, whole).when(k % 5 == 1, rows).when(k % 5 == 4, F.concat(F.lit("{broken "), rows)).otherwise(F.concat(F.lit("As asked: "), whole, F.lit(" {that} is all")))
    listed = d.raw("part").select("p_partkey", captures.answer_members(text).alias("m"))
    first = F.get("m", F.lit(0))
    return listed.select("p_partkey", F.size("m").alias("n"), first["name"].alias("name"), first["score"].alias("score"), first["rank"].alias("rank"))
