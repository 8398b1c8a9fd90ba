"""How queries are registered: as one SQL text for both engines, as two, or as a DataFrame function with or without SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")
Query = Callable[[SparkSession, str], DataFrame]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, sql: str, **frames: DataFrame) -> DataFrame:
    """sql names tables in braces; only those are read."""
    names = set(re.findall(r"\{(\w+)\}", sql)) - set(frames)
    return spark.sql(sql, **{n: load(spark, sf_dir, n) for n in names}, **frames)


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def pair(self, name: str, spark_sql: str, duck_sql: str) -> None:
        self.queries[name] = lambda spark, sf_dir: run_sql(spark, sf_dir, spark_sql)
        self.oracles[name] = re.sub(r"\{(\w+)\}", r"\1", duck_sql)

    def same(self, name: str, sql: str) -> None:
        self.pair(name, sql, sql)

    def frame(self, name: str, duck_sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[name] = f
            if duck_sql:
                self.oracles[name] = duck_sql
            return f

        return add
