"""What a task holds and does stays small, however large the input."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from muster.operators import stats_chat, upsert
from muster.operators.kept import dealt


def test_tables_are_not_spread_into_fields_for_corrections(spark):
    """A table's row stays one row of numbers where it meets its corrections."""
    tables = {
        "at_participations": spark.createDataFrame([(1, 5, None), (2, 6, 7)], "row_id bigint, points bigint, power bigint"),
        "at_donations": spark.createDataFrame([(1, 9)], "row_id bigint, honor bigint"),
    }
    rows = [(1, "at_participations", 1, "power", 3), (2, "at_participations", 1, "power", None), (3, "at_participations", 1, "honor", 4), (4, "at_donations", 1, "honor", 8), (5, "at_donations", 2, "honor", 8), (6, "elsewhere", 1, "honor", 8), (7, None, 1, "honor", 8), (8, "at_donations", 1, None, 8)]
    out, audit = upsert.apply_corrections(tables, spark.createDataFrame(rows, "ordinal int, target_table string, target_id bigint, field string, new_value bigint"))
    got = sorted((r.ordinal, r.old_value, r.new_value, r.error) for r in audit.collect())
    assert got == [(1, None, 3, None), (2, 3, None, None), (3, None, 4, "22023"), (4, 9, 8, None), (5, None, 8, "P0002"), (6, None, 8, "22023"), (7, None, 8, "22023"), (8, None, 8, "22023")]
    assert sorted(map(tuple, out["at_participations"].collect())) == [(1, 5, None), (2, 6, 7)]
    assert "Generate" not in audit._jdf.queryExecution().executedPlan().toString()


def test_lines_of_chats_are_dealt_by_their_number(spark, monkeypatch):
    lines = spark.range(4000).select((F.col("id") % 500).alias("capture_id"), F.col("id").alias("line_no"), F.concat(F.lit("Player"), F.col("id").cast("string")).alias("line"))
    parts = dealt(lines, ["capture_id"], 100)
    assert parts.rdd.getNumPartitions() == 40 and parts.select("capture_id", F.spark_partition_id()).distinct().count() == 500
    asked = []
    monkeypatch.setattr(stats_chat, "dealt", lambda rows, keys: asked.append(keys) or dealt(rows, keys, 100))
    plan = stats_chat.parse(lines)._jdf.queryExecution().executedPlan().toString()
    assert asked == [["capture_id"]] and "REPARTITION_BY_NUM" in plan


def test_ids_are_counted_when_the_table_is_made_anew(monkeypatch):
    """Counting over the whole vocabulary costs more than a step does: once a refresh, not once a step."""
    from muster.llm import idcoder

    counted, whole = [], np.bincount
    monkeypatch.setattr(idcoder.np, "bincount", lambda x, minlength=0: counted.append(minlength) or whole(x, minlength=minlength))
    ids = np.random.default_rng(1).integers(0, 900, 64 * 300)
    words, used = idcoder.encode_ids(ids, 1000)
    assert 0 < counted.count(1000) <= 9
    assert (idcoder.decode_ids(words, used, len(ids), 1000) == ids).all()
