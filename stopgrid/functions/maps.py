"""Map functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "cast(map() as map<string,string>)"


def map_overlay(left: Column, right: Column) -> Column:
    """Both maps' entries; right's win, and a null map is an empty one. Needs no session setting for repeated keys."""
    a, b = F.coalesce(left, F.expr(EMPTY)), F.coalesce(right, F.expr(EMPTY))
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def tags_of(json: Column) -> Column:
    return F.from_json(json, "map<string,string>")
