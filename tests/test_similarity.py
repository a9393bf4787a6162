"""The join of keys by edit distance against all pairs, and how many rows it compares."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from muster.functions.names import proximity, similarity
from muster.operators.duplicates import resolve, within_one
from muster.operators.similarity import compared, similar


def variant(draw: random.Random, key: str) -> str:
    letters = list(key)
    for _ in range(draw.randint(0, 7)):
        at, kind = draw.randint(0, len(letters)), draw.random()
        if kind < 0.33:
            letters.insert(at, draw.choice("abcd"))
        elif at < len(letters):
            letters[at : at + 1] = [] if kind < 0.66 else [draw.choice("abcdé日😀")]
    return "".join(letters)


@pytest.mark.parametrize("begin", ["", "xy", "customer0000"])
def test_similar_keys_equal_all_pairs(spark, begin):
    draw = random.Random(4)
    base = ["".join(draw.choices("abcdefgh", k=draw.randint(0, 18))) for _ in range(25)]
    rows = lambda: spark.createDataFrame([(draw.choice([0, 1]), begin + variant(draw, draw.choice(base))) for _ in range(300)] + [(0, None), (0, ""), (1, "only")], "g int, key string")
    left, right = rows().cache(), rows().cache()
    x, y = F.col("l_key"), F.col("r_key")
    pairs = left.distinct().withColumnRenamed("key", "l_key").join(right.distinct().withColumnRenamed("key", "r_key"), "g")
    want = pairs.select("g", "l_key", "r_key", proximity(x, y).alias("proximity"), similarity(x, y).alias("similarity")).where("proximity <> 'none'").collect()
    for least in (0.6, 0.8):
        got = [tuple(r) for r in similar(left, right, ["g"], least).collect()]
        assert sorted(got) == sorted(tuple(r) for r in want if r.similarity >= least)


def test_rows_compared_follow_near_pairs(spark):
    """800 members of one group make 319 600 pairs; names that are not alike are hardly compared."""
    draw = random.Random(4)
    names = [("g", "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(5, 14)))) for _ in range(800)]
    df = spark.createDataFrame(names, "g string, key string").withColumn("id", F.col("key"))
    assert compared(df, None, ["g"], 0.8).count() < 400
    assert compared(df, None, ["g"], 0.6).count() < 20_000


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_neighbourhoods_are_never_sent_round(spark):
    """Neighbourhoods of a small file are many times its size, which the estimate of a plan doesn't know."""
    draw = random.Random(5)
    make = lambda n: [(draw.choice([0, 1]), k, "".join(draw.choices("abc", k=draw.randint(0, 5)))) for k in range(n)]
    left, right = make(60), make(80)
    a, b = (spark.createDataFrame(rows, "g int, id int, key string") for rows in (left, right))
    out = within_one(a, b, ["g"])
    assert "Broadcast" not in plan_of(out)
    near = lambda x, y: x == y or any(x[:i] + x[i + 1 :] in (y, y[:j] + y[j + 1 :]) or y[:j] + y[j + 1 :] == x for i in range(len(x) + 1) for j in range(len(y) + 1) if i == j or len(x) != len(y))
    want = sorted((g, i, j, x, y) for g, i, x in left for h, j, y in right if g == h and abs(len(x) - len(y)) <= 1 and near(x, y))
    assert sorted((r.g, r.l_id, r.r_id, r.l_key, r.r_key) for r in out.collect()) == want


def test_rosters_are_never_sent_round(spark):
    names = spark.createDataFrame([(1, "Anna"), (1, "Annax"), (1, "Otto"), (1, "Zoe")], "alliance_id bigint, raw_name string")
    roster = spark.createDataFrame([(1, 1, "Anna"), (1, 2, "Ottos"), (1, 3, "Otta")], "alliance_id bigint, player_id bigint, player_name string")
    aliases = spark.createDataFrame([], "alliance_id bigint, raw_name string, player_id bigint")
    out = resolve(names, roster, aliases)
    assert "Broadcast" not in plan_of(out)
    assert sorted((r.raw_name, r.resolution, r.player_id) for r in out.collect()) == [("Anna", "exact", 1), ("Annax", "fuzzy", 1), ("Otto", "ambiguous", None), ("Zoe", "new", None)]


def test_names_that_only_known_players_are_near_take_no_rounds(spark, monkeypatch):
    """Variants of known players are near one another too, but none of them makes a player that another could be."""
    from muster.operators import resolution

    rounds, settled = [], resolution._settled
    monkeypatch.setattr(resolution, "_settled", lambda v: rounds.append(1) or settled(v))
    roster = spark.createDataFrame([(1, k, f"player{k}") for k in range(11, 17)], "alliance_id bigint, player_id bigint, player_name string")
    seen = spark.createDataFrame([(1, f"player{k}x", k, True) for k in range(11, 17)], "alliance_id bigint, raw_name string, capture bigint, creates boolean")
    aliases = spark.createDataFrame([], "alliance_id bigint, raw_name string, player_id bigint")
    out = resolution.resolve_in_order(seen, roster, aliases, 5)
    assert sorted((r.raw_name, r.resolution, r.player_id) for r in out.rows.collect()) == [(f"player{k}x", "fuzzy", k) for k in range(11, 17)]
    assert not rounds and out.created.isEmpty()


def test_nearest_players_are_found_among_few(spark, monkeypatch):
    """Names one edit from a player are settled by the pairs of the closest names alone."""
    from muster.operators import duplicates

    asked, whole = [], duplicates.resembling
    monkeypatch.setattr(duplicates, "resembling", lambda n, r, least=0.6: asked.append(least) or whole(n, r, least))
    roster = spark.createDataFrame([(1, k, f"Customer#{k:09d}") for k in range(300)], "alliance_id bigint, player_id bigint, player_name string")
    names = roster.where("player_id % 4 = 0").selectExpr("alliance_id", "replace(player_name, '#0', '#Z') as raw_name")
    got = duplicates.nearest_in_roster(names, roster).collect()
    assert sorted((r.raw_name, r.player_id) for r in got) == [(f"Customer#Z{k:08d}", k) for k in range(0, 300, 4)]
    assert asked == [0.9]
