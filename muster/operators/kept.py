"""Intermediate tables that are worked out once and read often."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local one only where none is named."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="muster-checkpoint-"))
    return shared_folder(spark)


def kept(df: DataFrame) -> DataFrame:
    """`df` worked out now and read back from the shared folder, whatever executors are lost later."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def unsent(df: DataFrame) -> DataFrame:
    """`df` as a side of a join that both sides are dealt out for: tables that grow with the input look small by the size of
    their compressed files, and whole ones, sent round, pass through the driver."""
    return df.hint("merge")


def dealt(rows: DataFrame, keys: list[str], a_task: int = 250_000) -> DataFrame:
    """`rows` dealt by `keys` to as many tasks as hold about `a_task` rows each, so that what a task sorts doesn't grow with
    the input; few rows stay as they are."""
    n = -(-rows.count() // a_task)
    return rows.repartition(max(n, rows.sparkSession.sparkContext.defaultParallelism), *keys) if n > 1 else rows


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
