"""Relational helpers: the first row of each key, nearest rows of each key, updates as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each key. Catalyst turns the filter into a limit for each group before the shuffle (WindowGroupLimit)."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where(F.col("_n") <= k).drop("_n")


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per(df, keys, order)


def update_from(df: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """df with the columns' new values where changes has its keys (at most once), as UPDATE ... FROM."""
    new = changes.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in columns), F.lit(True).alias("_hit"))
    out = df.join(new, keys, "left")
    return out.select(*(F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns))


def upsert_add(df: DataFrame, more: DataFrame, keys: list[str], value: str) -> DataFrame:
    """INSERT ... ON CONFLICT DO UPDATE that adds up."""
    return df.select(*keys, value).unionByName(more.select(*keys, value)).groupBy(*keys).agg(F.sum(value).alias(value))


def nulls_first_desc(c: str) -> Column:
    return F.col(c).desc_nulls_first()
