"""Connected components of a graph whose edges are rows; nothing but a count of changes reaches the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written


def components(edges: DataFrame, written: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """edges: u, v. Returns node, label: the least node reachable, for every node with an edge to another.

    Each round gives the least label around to a node and to the node that its label names, and then takes that label's own label. So whole
    trees are hung at once, and long chains in any order of ids take few rounds. Each round is a table in the shared folder, from which
    lost executors' work is redone.
    """
    both = edges.select("u", "v").where("u <> v")
    both = written(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("label")), "labels")
    while True:
        around = both.join(labels, both["v"] == labels["node"]).groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(around, "node").withColumn("least", F.least("label", "near"))
        hung = least.select("node", "least", "label").unionByName(least.select(F.col("label").alias("node"), "least", F.lit(None).cast(labels.schema["label"].dataType).alias("label")))
        now = hung.groupBy("node").agg(F.min("least").alias("now"), F.min("label").alias("label"))
        above = labels.select(F.col("node").alias("now"), F.col("label").alias("up"))
        moved = now.join(above, "now").select("node", F.least("now", "up").alias("label"), (F.col("label") != F.least("now", "up")).alias("changed"))
        moved = written(moved, "labels")
        labels = moved.select("node", "label")
        if not moved.where("changed").limit(1).count():
            return labels
