"""Reading tables and keeping intermediate results, shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` below `sf_dir`, read by Spark from whatever store holds it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; one of our own only where the cluster names none."""
    named = spark.conf.get(CHECKPOINT_CONF, None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="muster-checkpoint-")
    spark.sparkContext.setCheckpointDir(named)
    return named


def keep(df: DataFrame) -> DataFrame:
    """`df` computed once and read back from the shared folder; survives the loss of any executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to a new folder below the shared one, and read back."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
