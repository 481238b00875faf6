"""Named queries and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import Views, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str) -> Callable:
    """Register ``plan(views)`` under ``name``; ``sql`` may use the named views as tables."""

    def register(plan: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: plan(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(sql, *views)
        return plan

    return register
