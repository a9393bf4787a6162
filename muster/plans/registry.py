"""Where queries and the SQL that checks them are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from muster.sources.domain import Domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f: Callable[[Domain], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Domain(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle
        return f

    return add
