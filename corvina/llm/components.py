"""Connected components of an edge table, in alternating star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import through_storage

#: Edges, once contracted within partitions, that one task contracts to the end: every step of the others takes six shuffles.
FEW = 1 << 14


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the nodes of the edges a-b other than those smallest ones."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _local(batches):
    for batch in batches:
        node, root = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["a", "b"])


def _whole(batches):
    every = [b for b in batches if b.num_rows]
    if every:
        node, root = forest(*(np.concatenate([b.column(k).to_numpy() for b in every]) for k in range(2)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])


def components(edges: DataFrame, most: int = 60, few: int = FEW) -> DataFrame:
    """(node, root) for edges(a long, b long): root is the smallest node that links reach; nodes that are roots themselves have no row.

    Edges are first contracted within partitions. If up to `few` are left, one task contracts them all. Else each step keeps at most as many edges as before and is written to the shared folder. Null ends are dropped; loops and repeated edges do not matter.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = through_storage(edges.mapInArrow(_local, "a long, b long").distinct(), "components")
    if now.count() <= few:
        return through_storage(now.coalesce(1).mapInArrow(_whole, "node long, root long"), "components")
    before = None
    for _ in range(most):
        # large star: every larger neighbour, and the node, to the smallest of the neighbourhood
        both = now.unionByName(now.selectExpr("b AS a", "a AS b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").selectExpr("b AS a", "m AS b").where("a <> b").distinct()
        # small star: every smaller neighbour, and the node, to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").selectExpr("b AS a", "m AS b").where("a <> b").unionByName(least.selectExpr("a", "m AS b")).distinct()
        now = through_storage(small, "components")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.selectExpr("a AS node", "b AS root")
        before = mark
    raise RuntimeError(f"components did not settle in {most} steps")
