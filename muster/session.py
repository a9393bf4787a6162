"""The session that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "muster", **conf: str) -> SparkSession:
    """UTC, ANSI and adaptive execution; anything in `conf` (keys with `__` for dots) comes on top."""
    builder = SparkSession.builder.appName(name)
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # checkpoints go with the tables that need them
    }
    for k, v in (fixed | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
