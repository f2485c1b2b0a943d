"""The registered queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from doseframe.plans import features, records, sources, splits

PLANS = (records, splits, features, sources)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for plan in PLANS for f in plan.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: text for plan in PLANS for name, text in plan.SQL.items()}
