"""Every registered query beside the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.league_sql import with_league
from checks.silver import Silver, load, plain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a transform of the league under ``name``."""

    def register(build: Callable[[Silver], DataFrame]) -> Callable[[Silver], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: plain(build(load(spark, folder)))
        if sql is not None:
            ORACLES[name] = with_league(sql)
        return build

    return register
