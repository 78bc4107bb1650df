"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def components(ws: Workspace, links: DataFrame) -> DataFrame:
    """(node, root): every linked node and the least node it can reach.

    Each step links a node and all its neighbours to the least of them, which keeps what
    is connected connected and doubles how far a least node reaches.  A node's minimum is
    a partial aggregate and its neighbours are joined to that one row, so no task holds a
    neighbourhood.  It ends when every node has larger neighbours only, or one smaller one.
    """
    edges = ws.save(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "links")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = ws.save(
            both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.max("b").alias("high"), F.count_if(F.col("b") < F.col("a")).alias("below")),
            "least",
        )
        if near.where("below > 1 or (below = 1 and high > a)").isEmpty():
            return near.select(F.col("a").alias("node"), F.col("m").alias("root"))
        least = near.select("a", "m")
        moved = both.join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = ws.save(moved.union(least.select("a", F.col("m").alias("b"))).where("a != b").distinct(), "links")


def tops(ws: Workspace, parents: DataFrame) -> DataFrame:
    """The rows of (node, root, ...), a forest with at most one root a node, with the top of its tree as root."""
    while True:
        up = parents.select(F.col("node").alias("_n"), F.col("root").alias("_r")).where("_n != _r")
        moved = parents.join(up.hint("merge"), F.col("root") == F.col("_n"), "left")
        rest = [c for c in parents.columns if c not in ("root", "_moved")]
        parents = ws.save(moved.select(*rest, F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("_moved")), "parents")
        if parents.where("_moved").isEmpty():
            return parents.drop("_moved")


def placed(rows: DataFrame, node: str, maps: list[DataFrame]) -> DataFrame:
    """``rows`` with ``root``: the class of ``node`` by the maps (node, root), one after the other."""
    rows = rows.withColumn("root", F.col(node))
    for step in maps:
        to = step.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        rows = rows.join(to.hint("merge"), F.col("root") == F.col("_n"), "left").withColumn("root", F.coalesce("_r", "root")).drop("_n", "_r")
    return rows
