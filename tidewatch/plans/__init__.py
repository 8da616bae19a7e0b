"""Registered queries: each runs an operator over the given tables and states the same result in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function name, with the SQL that must give the same rows (if SQL can say it)."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            # event times are UTC; no result may depend on the machine's time zone
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, folder)

        key = name or fn.__name__
        QUERIES[key] = run
        if sql:
            ORACLES[key] = sql
        return fn

    return register


def load_all() -> None:
    from tidewatch.plans import (  # noqa: F401
        accounts,
        canonical,
        decisions,
        features,
        history,
        learning,
        quality,
        streams,
        sharing,
        timelines,
    )
