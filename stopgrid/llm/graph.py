"""Connected components by the library's operator, with shuffle files freed after each round."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import graph
from .common import written


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long). Returns node, label: the least node reachable."""
    return graph.components(edges, written)
