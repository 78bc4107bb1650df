"""Merkle manifest of a dataset: checkpointed levels, proofs whose inner nodes are recomputed.

Every row is a leaf, every language a tree, and the trees' roots are the leaves of the
tree above them.  ``FAN`` consecutive nodes become their hash until one is left.

Only the leaves and every ``every``-th level above are written (checkpoints).  Proofs come
from the top down: an aligned subtree between two checkpoints is read back from its stored
nodes (``FAN ** every`` at most), its missing inner nodes are computed again, the siblings
beside each stored node's way up are appended to what the subtree's own root has from above,
and the inner nodes are dropped.  So a task holds one small subtree however large the data
are, and a lost executor costs the subtrees that it was working on.

Leaves are numbered without gathering a tree: range partitions are sorted, and the counts of
those before (a row for each partition and language) tell where each one starts, so a
language with most of the rows is spread like any other.

Cases: a null field counts as ``-``, told apart from the text "-" by its length prefix; an
empty text is ``0:``; rows without doc_id come first and are never tampered with; rows
that share a doc_id are ordered by their leaf, and rows that repeat each other are leaves of
their own; a tree of one leaf is that leaf; an empty table gives no rows; further columns play
no part.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

FAN = 8
#: Bits of a position that tell the nodes of a run apart.
BITS = FAN.bit_length() - 1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels from one checkpoint to the next.
EVERY = 3
#: A table of starts of at most so many rows is broadcast; a larger one is joined.
SMALL = 50_000


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: dict[str, Column] | None = None) -> Column:
    """The hash of a row; ``fields`` replace columns of their name."""
    fields = fields or {}
    return F.sha2(F.concat(*[_field(fields.get(c, F.col(c))) for c in FIELDS]), 256)


def tampered_leaf() -> Column:
    """The hash of a row whose text lost its capitals A to Z."""
    return leaf({"text": F.translate("text", string.ascii_uppercase, string.ascii_lowercase)})


def chosen() -> Column:
    """Whether the check tampers with a row."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))


def _numbered(rows: DataFrame, ws: Workspace) -> DataFrame:
    """Adds ``pos``, the place from 0 of each row of a tree by (key, node, _n), and ``size``, the tree's number of rows."""
    order = ["tree", "key", "node", "_n"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ws.save(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("_at", 33)
    found = ranged.groupBy("tree", part.alias("_part")).agg(F.count("*").alias("_many"), F.min("_at").alias("_first"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_many").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ws.save(found.select(F.col("tree").alias("_tree"), "_part", (before - F.col("_first")).alias("_shift"), F.sum("_many").over(tree).alias("size")), "starts")
    side = F.broadcast(starts) if starts.count() <= SMALL else starts
    placed = ranged.join(side, F.col("tree").eqNullSafe(F.col("_tree")) & (part == F.col("_part")))
    return ws.save(placed.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_tree", "_part", "_shift", "_at", "_n", "key"), "placed")


def height(size: Column, most: int) -> Column:
    """Levels above the leaves of a tree of ``size`` leaves, ``most`` at the utmost."""
    out = F.lit(0)
    for level in range(most):
        out = out + F.when(size > FAN**level, 1).otherwise(0)
    return out


def _levels(size: int) -> int:
    out = 0
    while FAN**out < size:
        out += 1
    return out


def _hashed(nodes: Column) -> Column:
    """The nodes one level up."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * FAN + 1, F.lit(FAN)), ""), 256))


def _subtrees(nodes: DataFrame, level: int, every: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """(tree, up, height, members, l0, l1, ...): aligned subtrees with their inner levels, computed again.

    ``members`` are the stored nodes in order with their ``extra`` columns; levels above the
    root of the whole tree repeat it.
    """
    members = F.array_sort(F.collect_list(F.struct("pos", "node", *extra)))
    out = nodes.groupBy("tree", F.shiftright("pos", BITS * every).alias("up")).agg(members.alias("members"), F.first("height").alias("height"))
    out = out.withColumn("l0", F.transform("members", lambda m: m["node"]))
    for step in range(1, every + 1):
        below = F.col(f"l{step - 1}")
        out = out.withColumn(f"l{step}", F.when(F.col("height") >= level + step, _hashed(below)).otherwise(below))
    return out


def _way_up(place: Column, level: int, every: int) -> Column:
    """The siblings left and right of a stored node's way to the root of its subtree, level by level."""
    steps = []
    for step in range(every):
        nodes = F.col(f"l{step}")
        at = F.shiftright(place, BITS * step)
        first = at - at % FAN
        left = F.array_join(F.slice(nodes, first + 1, at - first), "")
        right = F.array_join(F.slice(nodes, at + 2, first + (FAN - 1) - at), "")
        both = F.array(F.struct(left.alias("left"), right.alias("right")))
        steps.append(F.when(F.col("height") > level + step, both).otherwise(F.slice(both, 1, 0)))
    return F.concat(*steps)


def fold(path: Column, node: Column) -> Column:
    """The root that a node and the siblings of its way up give."""
    return F.aggregate(path, node, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def joined(path: Column) -> Column:
    """The siblings of a way up, in one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


class Forest:
    """The checkpoints of the trees of some leaves: (tree, key, node, _n) and the columns ``extra``.

    ``roots`` are (tree, node, height).
    """

    def __init__(self, leaves: DataFrame, ws: Workspace, extra: tuple[str, ...] = (), every: int = EVERY):
        self.every, self.extra, self.ws = every, extra, ws
        placed = _numbered(leaves, ws)
        top = _levels(placed.agg(F.max("size")).first()[0] or 0)
        nodes = placed.withColumn("height", height(F.col("size"), top)).drop("size")
        roots = nodes.where("height = 0").select("tree", "node", "height")
        self.checkpoints = [nodes]
        for level in range(0, top, every):
            subtrees = _subtrees(nodes.where(F.col("height") > level), level, every)
            made = subtrees.select("tree", F.col("up").alias("pos"), F.get(f"l{every}", F.lit(0)).alias("node"), "height")
            nodes = ws.save(made, f"level-{level + every}")
            roots = roots.unionByName(nodes.where(F.col("height") <= level + every).select("tree", "node", "height"))
            self.checkpoints.append(nodes)
        self.roots = ws.save(roots, "roots")

    def proofs(self, above: DataFrame, results: Callable[[Column, Column, Column], list[Column]]) -> DataFrame:
        """``results`` (of a leaf's columns, the siblings of its way to the topmost root, and what
        ``above`` has of its tree) for every leaf.

        ``above`` is (tree, height, up) with ``up`` a struct of a tree's own ``path`` further up and more.
        """
        lower = None
        for n in reversed(range(max(len(self.checkpoints) - 1, 1))):
            level = n * self.every
            top = above.where(F.col("height") <= level + self.every)
            top = (top if n == 0 else top.where(F.col("height") > level)).select(F.col("tree").alias("_tree"), F.lit(0).cast("long").alias("_up"), F.col("up").alias("_above"))
            top = top if lower is None else top.unionByName(lower)
            grouped = _subtrees(self.checkpoints[n].where(F.col("height") >= (level and level + 1)), level, self.every, self.extra if n == 0 else ())
            met = grouped.join(top, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("up") == F.col("_up")))
            ways = met.withColumn("_ways", F.transform("members", lambda m, i: F.struct(m.alias("m"), F.concat(_way_up(i, level, self.every), F.col("_above.path")).alias("path"))))
            if n == 0:
                out = F.transform("_ways", lambda w: F.struct(*results(w["m"], w["path"], F.col("_above"))))
                return ways.select("tree", F.inline(out))
            out = F.transform("_ways", lambda w: F.struct(w["m"]["pos"].alias("_up"), F.col("_above").withField("path", w["path"]).alias("_above")))
            lower = self.ws.save(ways.select(F.col("tree").alias("_tree"), F.inline(out)), f"paths-{level}")
        raise AssertionError("a forest has its leaves at least")


def _trees(docs: DataFrame, every: int) -> tuple[Forest, DataFrame]:
    """A tree for each language with what stands above: (tree, height, up), ``up`` being path, subroot and root."""
    ws = Workspace(docs.sparkSession, "merkle")
    leaves = docs.select(
        F.col("lang").cast("string").alias("tree"), F.col("doc_id").cast("long").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("node"),
        F.when(chosen(), tampered_leaf()).alias("forged"), F.monotonically_increasing_id().alias("_n"),
    )
    forest = Forest(ws.save(leaves, "leaves"), ws, ("doc_id", "forged"), every)
    tops = forest.roots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("tree").alias("lang"), F.col("height").alias("below"), "node", F.lit(0).alias("_n"))
    crown = Forest(tops, ws, ("lang", "below"), every)
    start = F.slice(F.array(F.struct(F.lit("").alias("left"), F.lit("").alias("right"))), 1, 0)
    over = crown.roots.select("tree", "height", F.struct(start.alias("path"), F.col("node").alias("root")).alias("up"))

    def own(m: Column, path: Column, up: Column) -> list[Column]:
        return [m["lang"].alias("lang"), m["below"].alias("height"), F.struct(path.alias("path"), m["node"].alias("subroot"), up["root"].alias("root")).alias("up")]

    above = crown.proofs(over, own).select(F.col("lang").alias("tree"), "height", "up")
    return forest, ws.save(above, "above")


def proofs(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """lang, doc_id, leaf, path, subroot and root of every row: ``path`` has the siblings left and right of the way up."""
    forest, above = _trees(docs, every)

    def own(m: Column, path: Column, up: Column) -> list[Column]:
        return [m["doc_id"].alias("doc_id"), m["node"].alias("leaf"), path.alias("path"), up["subroot"].alias("subroot"), up["root"].alias("root")]

    return forest.proofs(above, own).withColumnRenamed("tree", "lang")


def verify(docs: DataFrame, stored: DataFrame) -> DataFrame:
    """``stored`` proofs (of rows with ids of their own) with ``verified``: whether the row that
    ``docs`` now has of that id gives the root; false where it is gone."""
    now = docs.select(F.col("doc_id").cast("long").alias("_id"), leaf().alias("_leaf"))
    met = stored.join(now, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return met.withColumn("verified", F.coalesce(fold(F.col("path"), F.col("_leaf")) == F.col("root"), F.lit(False))).drop("_id", "_leaf")


def report(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row: every third one is tampered with and then checked against the proof made before."""
    forest, above = _trees(docs, every)

    def own(m: Column, path: Column, up: Column) -> list[Column]:
        now = F.coalesce(m["forged"], m["node"])
        return [
            m["doc_id"].alias("doc_id"), m["node"].alias("leaf"), up["subroot"].alias("subroot"), up["root"].alias("root"),
            F.sha2(joined(path), 256).alias("proof_sha256"), fold(path, now).alias("folded_root"),
        ]

    return forest.proofs(above, own).drop("tree").withColumn("verified", F.col("folded_root") == F.col("root"))
