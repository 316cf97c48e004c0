"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (a, b: long) -> (node, root: long), a row for each node that has an edge; root: one node of its component.

    Every round each node takes the smallest of its neighbours and itself as parent, parents take their own parents,
    and edges are rewritten to parents, so the edge table shrinks until none is left. Tables live in the shared
    checkpoint folder. Joins on a hot node split: the other side has one row a node. No edges: no rows."""
    keep = lambda df: scratch.save(df, narrow=True)
    left = keep(edges.where("a <> b").select("a", "b").distinct())
    roots = None
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        parent = keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("up")))
        for _ in range(2):
            above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            higher = keep(parent.join(above, "up").select("node", F.col("top").alias("up")))
            scratch.drop(parent)
            parent = higher
        if roots is None:
            merged = keep(parent.select("node", F.col("up").alias("root")))
        else:
            merged = keep(roots.join(parent, roots.root == parent.node, "left").select(roots.node, F.coalesce(parent.up, roots.root).alias("root")))
            scratch.drop(roots)
        roots = merged
        pa, pb = parent.select(F.col("node").alias("a"), F.col("up").alias("ua")), parent.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        fewer = keep(left.join(pa, "a").join(pb, "b").where("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct())
        scratch.drop(left, parent)
        left = fewer
    if roots is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
