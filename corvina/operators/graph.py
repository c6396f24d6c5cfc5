"""Reachability over edge tables by levels of joins.

Each level joins only the nodes that the one before found and leaves out what is known; edges and levels are written to the cluster's shared folder, and the search ends at the first empty level.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut as stored


def reachable(edges: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, depth): nodes within `depth` steps of start(node) along edges(a, b), at any distance where it is None, with the fewest steps."""
    found = last = stored(start.select("node").distinct().withColumn("depth", F.lit(0)))
    edges = stored(edges.select("a", "b"))
    for k in itertools.count(1) if depth is None else range(1, depth + 1):
        step = last.join(edges, last["node"] == edges["a"]).select(edges["b"].alias("node")).distinct()
        last = stored(step.join(found, "node", "left_anti").withColumn("depth", F.lit(k)))
        if last.isEmpty():
            break
        found = found.unionByName(last)
    return found
