"""All registered queries of the price analytics, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mandi.plans import alerts, forecast, landed, measure, shocks, temporal

_MODULES = (measure, temporal, forecast, alerts, landed, shocks)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in _MODULES for name, text in m.SQL.items()}
