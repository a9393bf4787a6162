"""Captures as JSON: a union of events, donations and stat posts, read with declared schemas."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

MEMBER = "struct<name:string,rank:string,power:bigint,points:bigint,alliance_tag:string,alliance_honor:bigint,attack_pct:double,attack_kind:string,hp_pct:double,defense_pct:double,ocr_confidence:double>"
CAPTURE = f"kind string, event_type string, event_datetime string, period_type string, alliance_rank int, total_battlers int, total_points bigint, possible_truncation boolean, expected_rows int, source_file string, members array<{MEMBER}>"

ANSWERS = ArrayType(StructType().add("name", StringType()).add("score", LongType()).add("rank", StringType()))


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """One row a capture; a missing kind is an event. Unreadable files give a row of nulls with their text in `bad`."""
    rows = spark.read.schema(f"{CAPTURE}, bad string").option("multiLine", "true").option("columnNameOfCorruptRecord", "bad").json(path)
    return rows.withColumn("kind", F.coalesce("kind", F.lit("event")))


def members(captures: DataFrame, kind: str) -> DataFrame:
    """Rows of one kind of capture with their place, which the repairs need. Null points: did not take part."""
    own = captures.where(F.col("kind") == kind)
    return own.select("source_file", "event_type", "event_datetime", "period_type", F.posexplode("members").alias("row_index", "m")).select("source_file", "event_type", "event_datetime", "period_type", "row_index", "m.*")


def balanced(text: str) -> str | None:
    """The first {...} of a text whose braces balance, those within strings not counted."""
    for m in re.finditer(r"\{", text):
        depth = 0
        for t in re.finditer(r'"(?:[^"\\]|\\.)*"|[{}]', text[m.start() :]):
            depth += {"{": 1, "}": -1}.get(t[0], 0)
            if not depth:
                return text[m.start() : m.start() + t.end()]
    return None


@pandas_udf(ANSWERS)
def answer_members(answers: pd.Series) -> pd.Series:
    """Members that a language model lists, as {"members": [...]} or a bare array; entries without a name are dropped."""

    def whole(x) -> int | None:
        if isinstance(x, bool) or x is None:
            return None
        return int(x) if isinstance(x, (int, float)) or isinstance(x, str) and x.strip().isdigit() else None

    def parse(text: str) -> list:
        try:
            got = json.loads(text)
        except ValueError:
            try:
                got = json.loads(balanced(text) or "null")
            except ValueError:
                got = None
        rows = got.get("members") if isinstance(got, dict) else got
        named = [r for r in rows or [] if isinstance(r, dict) and str(r.get("name") or "").strip()] if isinstance(rows, list) else []
        return [{"name": str(r["name"]).strip(), "score": whole(r.get("score")), "rank": r.get("rank") if isinstance(r.get("rank"), str) else None} for r in named]

    return answers.map(parse, na_action="ignore")
