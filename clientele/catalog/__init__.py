"""Named queries over the test tables, each with the SQL that checks it where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, if given, the SQL an independent engine runs to check it."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql:
            CHECKS[name] = sql
        return fn

    return register


def load() -> None:
    """Import every family so that its queries register."""
    from clientele.catalog import (  # noqa: F401
        anomaly,
        commerce,
        grounding,
        labels,
        models,
        quality,
        signals,
        storage,
        streams,
    )
