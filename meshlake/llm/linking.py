"""Classes of nodes that share buckets and pass a check, without expanding buckets into pairs.

1. Every node is compared with one centre: of its buckets' most crowded nodes the one
   that it shares most buckets with.
2. Buckets whose nodes are in one class then need nothing more.  In the others, the
   open ones, sketches are compared inside the bucket, and pairs from different classes
   that the sketches can't rule out are checked: first only as many as could join the
   bucket's classes (a forest), then all that are left.

Sketches never rule out a link, so no link that joins two classes is lost.  A large
bucket is compared in blocks of ``BLOCK`` nodes against ``BLOCK`` nodes.

``linked`` compares nodes of open buckets with their texts beside them, a pair only while its
nodes are in different classes there; no pair leaves its task but those that join two classes.

Joins that carry texts, buckets or nodes of the corpus ask for a sort-merge join: they are
planned alike at every size, and nothing that grows with the corpus is broadcast.  Their
sides are read from tables, so that Spark splits the partition of a hot key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components, placed, tops
from .workspace import Workspace

BLOCK = 1000


def crowded_members(ws: Workspace, rows: DataFrame) -> DataFrame:
    """(bucket, k, about, crowd, head) of the buckets with two nodes or more.  ``rows`` has every
    (bucket, k) once; ``crowd`` is the size of all buckets of k, ``head`` marks one row of each k."""
    crowded = ws.save(rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    own = Window.partitionBy("k")
    members = rows.join(crowded.hint("merge"), "bucket").select(
        "bucket", "k", "about", F.sum("size").over(own).alias("crowd"), (F.row_number().over(own.orderBy("bucket")) == 1).alias("head")
    )
    members = ws.save(members, "members")
    ws.drop(crowded)
    ws.release()
    return members


def _confirmed(ws: Workspace, pairs: DataFrame, texts: DataFrame, check: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The pairs (a, b, ra, rb) with ``ok``, as ``check`` says, given a_text and b_text too.
    Their table goes afterwards."""
    with_b = pairs.join(texts.withColumnsRenamed({"k": "b", "text": "b_text"}).hint("merge"), "b")
    full = with_b.join(texts.withColumnsRenamed({"k": "a", "text": "a_text"}).hint("merge"), "a")
    out = ws.save(check(full.select("a", "b", "ra", "rb", "a_text", "b_text")).select("a", "b", "ra", "rb", "ok"), "checked")
    ws.drop(pairs)
    ws.release()
    return out


def _centres(ws: Workspace, members: DataFrame, near: Callable[[Column, Column], Column]) -> DataFrame:
    """(a, b): for every node the centre it is compared with, crowded as b or more than a."""
    top = ws.save(members.groupBy("bucket").agg(F.max(F.struct("crowd", "k", "about")).alias("c")), "tops")
    asked = members.join(top.hint("merge"), "bucket").where((F.col("k") != F.col("c.k")) & near(F.col("about"), F.col("c.about")))
    shared = asked.groupBy(F.col("k").alias("a"), F.col("c.k").alias("b")).agg(F.count("*").alias("n"))
    return shared.groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b"))


def _pairs_in_blocks(matches: Callable, forest: bool):
    """Pairs of the rows of a block that ``matches`` gives, whose classes differ and that weren't asked before."""

    def block(rows: list[tuple]) -> list[tuple[int, int, int, int]]:
        _, _, j, *_ = rows[0]
        # Rows of the bucket's main class go last: they needn't be compared with each other.
        rows = sorted(rows, key=lambda r: r[5] < 0)
        roots, own = [r[4] for r in rows], [r[5] for r in rows]
        if len(set(roots)) < 2:
            return []
        others = sum(part >= 0 for part in own)
        joined: dict[int, int] = {}

        def find(r: int) -> int:
            while (up := joined.get(r, r)) != r:
                r = up
            return r

        out = []
        root_of, own_of = np.array(roots), np.array(own)
        for x, ys in matches([r[7] for r in rows], others):
            # Pairs outside the main class belong to the block of its first part, or,
            # from two parts, to a block of their own.
            keep = root_of[ys] != root_of[x]
            if j > 0:
                keep &= np.maximum(ys, x) >= others
            elif j < 0:
                keep &= own_of[ys] != own_of[x]
            for y in ys[keep].tolist():
                if rows[x][6] == rows[y][3] or rows[y][6] == rows[x][3]:
                    continue
                if forest:
                    p, q = find(roots[x]), find(roots[y])
                    if p == q:
                        continue
                    joined[max(p, q)] = min(p, q)
                if rows[x][3] < rows[y][3]:
                    out.append((rows[y][3], rows[x][3], roots[y], roots[x]))
                else:
                    out.append((rows[x][3], rows[y][3], roots[x], roots[y]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        found: list[tuple] = []
        names = ["bucket", "i", "j", "k", "root", "own", "asked", "sketch"]
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                if held and held[0][:3] != row[:3]:
                    found += block(held)
                    held = []
                held.append(row)
            if found:
                yield _as_batch(found)
                found = []
        if held:
            yield _as_batch(block(held))

    return run


def _as_batch(pairs: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in range(4)], ["a", "b", "ra", "rb"])


def _open(ws: Workspace, rows: DataFrame) -> DataFrame:
    """(bucket, k, root, asked, main, m, r): the rows of buckets with more than one class, the
    class that most rows are in, and the number of rows inside and outside it."""
    rows = ws.save(rows.drop("_was"), "placed")
    sizes = rows.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    still = sizes.groupBy("bucket").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("m"), (F.sum("n") - F.max("n")).alias("r")
    )
    still = ws.save(still.where("r > 0"), "open")
    left = ws.save(rows.join(still.hint("merge"), "bucket"), "left")
    ws.drop(rows)
    ws.drop(still)
    ws.release()
    return left


def _candidates(left: DataFrame, sketches: DataFrame, matches: Callable, forest: bool) -> DataFrame:
    """Pairs inside open buckets."""
    rows = _in_blocks(left, ["bucket", "k", "root", "asked"]).join(sketches.hint("merge"), "k")
    rows = rows.select("bucket", F.col("at.i"), F.col("at.j"), "k", "root", "own", "asked", "sketch")
    ordered = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "k")
    return ordered.mapInArrow(_pairs_in_blocks(matches, forest), "a long, b long, ra long, rb long").distinct()


def _in_blocks(left: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of rows of open buckets with ``own`` and, for each block that a row is in, ``at``.  The rows
    outside a bucket's main class, in parts of ``BLOCK``, meet each part of the main class and each other; a
    row of the main class is copied only if the others are more than ``BLOCK``."""
    zero = F.lit(0).cast("long")
    left = left.withColumns({"_mp": F.floor((F.col("m") - 1) / BLOCK), "_rp": F.floor((F.col("r") - 1) / BLOCK)})
    left = left.withColumns({"_mo": F.pmod(F.xxhash64("k"), F.col("_mp") + 1), "_ro": F.pmod(F.xxhash64("k"), F.col("_rp") + 1)})
    is_main = F.col("root") == F.col("main")
    place = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    with_main = F.transform(F.sequence(zero, "_mp"), lambda m: place(F.col("_ro"), m))
    apart = F.filter(F.sequence(zero, "_rp"), lambda q: q != F.col("_ro"))
    with_others = F.transform(apart, lambda q: place(F.least(F.col("_ro"), q), F.lit(-1) - F.greatest(F.col("_ro"), q)))
    of_main = F.transform(F.sequence(zero, "_rp"), lambda q: place(q, F.col("_mo")))
    blocks = F.when(is_main, of_main).otherwise(F.concat(with_main, with_others))
    own = F.when(is_main, F.lit(-1).cast("long")).otherwise(F.col("_ro"))
    return left.select(*columns, own.alias("own"), F.explode(blocks).alias("at"))


def classes(
    ws: Workspace,
    members: DataFrame,
    texts: DataFrame,
    near: Callable[[Column, Column], Column],
    sketch: Callable,
    matches: Callable,
    check: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """(node, root): the class of every node of ``members``.

    ``near`` is a necessary condition on two nodes' ``about``.  ``sketch`` maps batches of
    (k, text) to (k, sketch); ``matches`` gives for a list of sketches (x, places that may be
    linked with x), pairs with a place below ``stop`` once each; ``check`` adds ``ok`` to
    pairs with their texts.
    """
    maps, left = _by_centres(ws, members, texts, near, check)
    maps += _inside(ws, left, texts, sketch, matches, check)
    return _classes_of(ws, members.where("head").select("k"), maps)


def linked(
    ws: Workspace,
    nodes: DataFrame,
    members: DataFrame,
    texts: DataFrame,
    near: Callable[[Column, Column], Column],
    check: Callable[[DataFrame], DataFrame],
    meet: Callable[[np.ndarray, np.ndarray], np.ndarray],
    sketch: Callable[[list[str]], np.ndarray],
    may: Callable[[np.ndarray, np.ndarray], np.ndarray],
    similar: Callable[[list[tuple[str, str]]], np.ndarray],
) -> DataFrame:
    """``classes`` of ``nodes`` (k), but those of open buckets are compared with their texts beside them.  ``about`` is a
    struct of numbers; ``meet`` says what ``near`` says, of arrays with the numbers last.  ``sketch`` gives
    a row for each text, ``may`` is a necessary condition on such rows, ``similar`` decides on pairs of texts."""
    maps, left = _by_centres(ws, members, texts, near, check, ["about"])
    if not left.isEmpty():
        links = ws.save(_links(left, texts, _joined(meet, sketch, may, similar)), "joined")
        ws.drop(left)
        ws.release()
        if not links.isEmpty():
            maps.append(components(ws, links))
    return _classes_of(ws, nodes, maps)


def _by_centres(
    ws: Workspace, members: DataFrame, texts: DataFrame, near: Callable, check: Callable, more: list[str] = []
) -> tuple[list[DataFrame], DataFrame]:
    """The map of nodes to classes that links with centres make, and the rows of the buckets left open."""
    pairs = ws.save(_centres(ws, members, near).select("a", "b", F.col("a").alias("ra"), F.col("b").alias("rb")), "pairs")
    asked = _confirmed(ws, pairs, texts, check)
    # A centre is more crowded than its node, so the confirmed pairs are a forest.
    forest = asked.select(F.col("a").alias("node"), F.when(F.col("ok"), F.col("b")).otherwise(F.col("a")).alias("root"), F.col("b").alias("asked"))
    maps = [tops(ws, forest)]
    start = members.join(maps[0].hint("merge"), F.col("k") == F.col("node"), "left")
    return maps, _open(ws, start.select("bucket", "k", F.coalesce("root", "k").alias("root"), "asked", *more))


def _classes_of(ws: Workspace, nodes: DataFrame, maps: list[DataFrame]) -> DataFrame:
    return ws.save(placed(nodes.select(F.col("k").alias("node")), "node", maps), "classes")


def _inside(ws: Workspace, left: DataFrame, texts: DataFrame, sketch: Callable, matches: Callable, check: Callable) -> list[DataFrame]:
    """Maps that join the classes linked inside open buckets."""
    maps: list[DataFrame] = []
    if left.isEmpty():
        return maps
    wanted = left.select("k").distinct()
    sketches = ws.save(texts.join(wanted.hint("merge"), "k", "left_semi").mapInArrow(sketch, "k long, sketch binary"), "sketches")
    tested = None
    for forest_only in (True, False):
        pairs = _candidates(left, sketches, matches, forest_only)
        if tested is not None:
            pairs = pairs.join(tested.hint("merge"), ["a", "b"], "left_anti")
        found = _confirmed(ws, ws.save(pairs, "pairs"), texts, check)
        good = found.where("ok")
        if not good.isEmpty():
            step = components(ws, good.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
            maps.append(step)
            if forest_only:
                before = left
                left = _open(ws, placed(left.select("bucket", "k", "asked", F.col("root").alias("_was")), "_was", [step]))
                ws.drop(before)
                if left.isEmpty():
                    break
        tested = found.select("a", "b")
    return maps


#: Characters of texts and pairs held before they are compared, rounds of a pair for each class, and pairs of a later round.
_HELD_CHARS, _HELD_PAIRS, _ROUNDS, _MORE = 6_000_000, 1_000_000, 2, 20_000


def _links(left: DataFrame, texts: DataFrame, joined: Callable) -> DataFrame:
    """(a, b): classes of which a node of one is similar to one of the other in an open bucket, as many as join them."""
    rows = _in_blocks(left, ["bucket", "k", "root", "asked", "about"]).join(texts.hint("merge"), "k")
    rows = rows.select("bucket", F.col("at.i"), F.col("at.j"), "k", "root", "own", "asked", "text", "about.*")
    ordered = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "k")
    return ordered.mapInArrow(joined, "a long, b long").distinct()


def _joined(meet: Callable, sketch: Callable, may: Callable, similar: Callable):
    def pairs_of(block: list[tuple]) -> tuple[list[tuple], list[tuple[int, int]]]:
        """The rows of a block, those of the main class last, and the pairs to compare in it."""
        rows = sorted(block, key=lambda r: r[5] < 0)
        j = rows[0][2]
        root, own, k = (np.array([r[i] for r in rows]) for i in (4, 5, 3))
        asked = np.array([-1 if r[6] is None else r[6] for r in rows])
        about = np.array([r[8:] for r in rows])
        others = int((own >= 0).sum())
        found = []
        for x in range(min(others, len(rows) - 1)):
            # As in _pairs_in_blocks.
            keep = (root[x + 1 :] != root[x]) & (asked[x + 1 :] != k[x]) & (k[x + 1 :] != asked[x]) & meet(about[x + 1 :], about[x])
            if j > 0:
                keep[: others - x - 1] = False
            elif j < 0:
                keep &= own[x + 1 :] != own[x]
            ys = np.flatnonzero(keep) + x + 1
            found.append(np.stack([np.full(len(ys), x), ys]))
        if not sum(f.shape[1] for f in found):
            return rows, []
        x, y = np.concatenate(found, axis=1)
        used, at = np.unique(np.concatenate([x, y]), return_inverse=True)
        sketches, at = sketch([rows[i][7] for i in used.tolist()]), at.reshape(2, -1)
        good = np.concatenate([may(sketches[at[0, i : i + _MORE]], sketches[at[1, i : i + _MORE]]) for i in range(0, len(x), _MORE)])
        return rows, list(zip(x[good].tolist(), y[good].tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        held: list[tuple[int, str]] = []  # class and text of the rows of blocks
        pairs: list[tuple[int, int]] = []
        chars = 0

        def close() -> None:
            nonlocal chars
            rows, found = pairs_of(block)
            if found:
                pairs.extend((x + len(held), y + len(held)) for x, y in found)
                held.extend((r[4], r[7]) for r in rows)
                chars += sum(len(r[7]) for r in rows)
            block.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if block and block[0][:3] != row[:3]:
                    close()
                    if chars > _HELD_CHARS or len(pairs) > _HELD_PAIRS:
                        yield _as_links(_joins(held, pairs, similar))
                        held, pairs, chars = [], [], 0
                block.append(row)
        if block:
            close()
        yield _as_links(_joins(held, pairs, similar))

    return run


def _as_links(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in range(2)], ["a", "b"])


def _joins(held: list[tuple[int, str]], pairs: list[tuple[int, int]], similar: Callable) -> list[tuple[int, int]]:
    """Classes joined by similar pairs.  A pair is compared only if its classes aren't joined so far: in the
    first rounds one for each class, then many at once."""
    roots, code = np.unique(np.array([r for r, _ in held], np.int64), return_inverse=True)
    left = np.array(pairs, np.int64).reshape(-1, 2)
    joined = list(range(len(roots)))

    def find(c: int) -> int:
        while joined[c] != c:
            joined[c] = c = joined[joined[c]]
        return c

    links, turn = [], 0
    while len(left):
        now = np.array([find(c) for c in range(len(roots))])[code]
        of = np.sort(now[left], axis=1)
        apart = of[:, 0] != of[:, 1]
        left, of = left[apart], of[apart]
        picked = np.unique(of[:, 1], return_index=True)[1] if turn < _ROUNDS else np.arange(min(len(left), _MORE))
        good = similar([(held[x][1], held[y][1]) for x, y in left[picked].tolist()]) if len(picked) else np.zeros(0, bool)
        for x, y in left[picked[good]].tolist():
            a, b = find(code[x]), find(code[y])
            if a != b:
                joined[max(a, b)] = min(a, b)
                links.append((int(roots[code[x]]), int(roots[code[y]])))
        left = np.delete(left, picked, axis=0)
        turn += 1
    return links


def bit_matches(matrix: np.ndarray, stop: int, most: Callable[[int, slice], np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(x, later rows that differ from row x in at most ``most(x, rows)`` bits) of a matrix of bytes, x < stop."""
    for x in range(min(stop, len(matrix) - 1)):
        later = slice(x + 1, len(matrix))
        differ = np.bitwise_count(matrix[later] ^ matrix[x]).sum(axis=1, dtype=np.int64)
        hit = np.flatnonzero(differ <= most(x, later))
        if len(hit):
            yield x, hit + x + 1
