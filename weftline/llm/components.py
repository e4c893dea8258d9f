"""Connected components by contraction: every round is a few joins, and nothing reaches the driver but a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(node, root), written, of every node with an edge in `edges` (a, b); the root is the smallest node of its component.

    Each round points every node at its smallest smaller neighbour, follows the pointers to their ends by doubling, and
    joins the edges again between those ends; it ends when no edge is left. Minima are pre-aggregated and the
    joins carry two numbers a row, so a hub's edges are never gathered in one place.
    Edges of a node with itself and null ends are ignored; repeated edges count once.
    """
    def ordered(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    left = ws.save(ordered(edges))
    roots = None
    while not left.isEmpty():
        up = ws.save(left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")))
        while True:
            # Two steps of the same pointers a round: less tables than with one.
            over = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            once = up.join(over, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            step = ws.save(once.join(over, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
            moved = not step.where("moved").isEmpty()
            up = step.select("node", "root")
            if not moved:
                break
        if roots is None:
            roots = up
        else:
            old = roots.join(up.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            # A node gets its first pointer in the round in which it stops being the end of others.
            roots = ws.save(old.union(up.join(roots.select("node"), "node", "left_anti").select("node", "root")))
        a = up.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = ws.save(ordered(left.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))))
    if roots is None:
        return ws.save(left.select(F.col("a").alias("node"), F.col("b").alias("root")))
    ends = roots.select(F.col("root").alias("node")).distinct()
    return ws.save(roots.union(ends.join(roots.select("node"), "node", "left_anti").select("node", F.col("node").alias("root"))))
