"""All registered queries of the engine's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES: tuple[str, ...] = ("queries_relational", "queries_functions", "queries_steps")


def _all() -> tuple[dict[str, Query], dict[str, str]]:
    from importlib import import_module

    found: dict[str, Query] = {}
    sql: dict[str, str] = {}
    for name in MODULES:
        m = import_module(f"stopgrid.{name}")
        found |= m.QUERIES
        sql |= m.ORACLES
    return found, sql


def queries() -> dict[str, Query]:
    return _all()[0]


def oracle_sql() -> dict[str, str]:
    return _all()[1]
