"""Point location among boxes of any size, stacks of layers, and cells in three dimensions.

The index lists every box under the few cells that it touches of a lattice whose step is the box' own
size, and splits cells that hold too many in halves along each axis, as counts tell; so neither
the sizes of a mesh's faces nor where they crowd have to be known.  A point looks up its cell once for each step in use.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import scratch
from .grid import AXES, RegularGrid

#: Entries of a bucket that are not split; the finest lattice has 2 ** DEEPEST cells along an axis.
CROWDED, DEEPEST = 64, 24
#: Samples of stacks that are held together.
HELD = 2_000_000


@dataclass
class BoxIndex:
    """``entries``: (id, level, _c0, _c1, ...), the cells that each box is listed under."""

    entries: DataFrame
    low: list[float]
    span: float
    levels: list[int]

    @property
    def cells(self) -> list[str]:
        return [f"_c{a}" for a in range(len(self.low))]

    def cell(self, axis: int, level: Column, x: Column) -> Column:
        return F.floor((x - F.lit(self.low[axis])) * F.pow(F.lit(2.0), level) / F.lit(self.span)).cast("long")

    def meet(self, points: DataFrame, coords: Sequence[str]) -> DataFrame:
        """The points with the ``id`` of each box listed where they are."""
        levels = F.explode(F.array(*[F.lit(n) for n in self.levels]))
        asked = points.withColumn("level", levels)
        asked = asked.withColumns({c: self.cell(a, F.col("level"), F.col(x)) for a, (c, x) in enumerate(zip(self.cells, coords))})
        return asked.join(self.entries, ["level", *self.cells]).drop("level", *self.cells)

    def statistics(self) -> DataFrame:
        """(level, buckets, entries, largest): how full the index is."""
        each = self.entries.groupBy("level", *self.cells).agg(F.count("*").alias("n"))
        return each.groupBy("level").agg(F.count("*").alias("buckets"), F.sum("n").alias("entries"), F.max("n").alias("largest"))


def box_index(boxes: DataFrame, d: int, crowded: int = CROWDED) -> BoxIndex:
    """An index of (id, lo0, hi0, lo1, hi1, ...); boxes without a place are left out."""
    lo, hi = [F.col(f"lo{a}") for a in range(d)], [F.col(f"hi{a}") for a in range(d)]
    ends = boxes.agg(*[F.min(x) for x in lo], *[F.max(x) for x in hi]).first()
    if ends[0] is None:
        return BoxIndex(boxes.select("id", *[F.lit(0).cast("long").alias(c) for c in ["level", *[f"_c{a}" for a in range(d)]]]).limit(0), [0.0] * d, 1.0, [0])
    low = [float(x) for x in ends[:d]]
    span = max(float(b) - a for a, b in zip(low, ends[d:])) or 1.0
    index = BoxIndex(boxes, low, span, [])
    size = F.greatest(*[h - x for x, h in zip(lo, hi)]) if d > 1 else hi[0] - lo[0]
    level = F.when(size > 0, F.least(F.floor(F.log2(F.lit(span) / size)), F.lit(DEEPEST))).otherwise(F.lit(DEEPEST))

    def listed(rows: DataFrame, parent: bool = False) -> DataFrame:
        """Rows with their cells at their level; inside the cell of the level above if they have one."""
        for a, c in enumerate(index.cells):
            first, last = index.cell(a, F.col("level"), lo[a]), index.cell(a, F.col("level"), hi[a])
            if parent:
                first, last = F.greatest(first, 2 * F.col(c)), F.least(last, 2 * F.col(c) + 1)
            rows = rows.where(first <= last).withColumn(c, F.explode(F.sequence(first, last)))
        return rows

    keep = ["id", *[f"{e}{a}" for a in range(d) for e in ("lo", "hi")], "level", *index.cells]
    table = scratch.written(listed(boxes.where(size.isNotNull()).withColumn("level", level.cast("int"))).select(keep), "boxes")
    bucket = ["level", *index.cells]
    largest = _largest(table, bucket)
    while largest > crowded:
        many = table.groupBy(*bucket).agg(F.count("*").alias("_n")).where((F.col("_n") > crowded) & (F.col("level") < DEEPEST)).drop("_n")
        split = table.join(many, bucket, "left_semi").withColumn("level", F.col("level") + 1)
        finer = scratch.written(table.join(many, bucket, "left_anti").unionByName(listed(split, True).select(keep)), "boxes")
        now = _largest(finer, bucket)
        if now > 0.9 * largest:  # boxes that lie on each other can't be told apart
            scratch.drop(finer)
            break
        scratch.drop(table)
        table, largest = finer, now
    index.entries = table.select("id", *bucket)
    index.levels = sorted(r[0] for r in table.select("level").distinct().collect())  # at most DEEPEST + 1
    return index


def _largest(table: DataFrame, bucket: Sequence[str]) -> int:
    return table.groupBy(*bucket).count().agg(F.max("count")).first()[0] or 0


# Stacks of layers


def sample_stacks(z: np.ndarray, v: np.ndarray, at: np.ndarray, quadratic: bool = False) -> np.ndarray:
    """Values at heights ``at`` (P) in stacks of heights and values (P x L) in the order of the layers; NaN where there are none.

    Layers without a height are passed over.  Between the first two neighbours around the height
    the value is linear; ``quadratic``, it is the parabola through these and the next one (the one before at the end).
    """
    n, layers = z.shape
    order = np.argsort(np.isnan(z), axis=1, kind="stable")
    z, v = np.take_along_axis(z, order, 1), np.take_along_axis(v, order, 1)
    count = layers - np.isnan(z).sum(axis=1)
    out = np.full(n, np.nan)
    if layers < 2:
        return out
    with np.errstate(invalid="ignore"):
        held = (np.minimum(z[:, :-1], z[:, 1:]) <= at[:, None]) & (at[:, None] <= np.maximum(z[:, :-1], z[:, 1:]))
    rows = np.flatnonzero(held.any(axis=1))
    k = held[rows].argmax(axis=1)
    z0, z1, v0, v1, p = z[rows, k], z[rows, k + 1], v[rows, k], v[rows, k + 1], at[rows]
    with np.errstate(invalid="ignore", divide="ignore"):
        got = np.where(z0 == z1, v0, v0 + (v1 - v0) * (p - z0) / (z1 - z0))
        if quadratic:
            third = np.where(k + 2 < count[rows], k + 2, k - 1)
            has = third >= 0
            z2, v2 = z[rows, np.maximum(third, 0)], v[rows, np.maximum(third, 0)]
            parabola = v0 * (p - z1) * (p - z2) / ((z0 - z1) * (z0 - z2)) + v1 * (p - z0) * (p - z2) / ((z1 - z0) * (z1 - z2)) + v2 * (p - z0) * (p - z1) / ((z2 - z0) * (z2 - z1))
            got = np.where(has, parabola, got)
    out[rows] = got
    return out


def stacks_of(layers: DataFrame, key: Sequence[str], layer: str) -> DataFrame:
    """(key, layers, zs, vs): the heights and values of a column of samples as arrays; a column is one row."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(layer).cast("int").alias("l"), F.col("z").cast("double").alias("z"), F.col("value").cast("double").alias("v"))))
    grouped = layers.groupBy(*key).agg(rows.alias("_s"))
    return grouped.select(*key, F.col("_s.l").alias("ls"), F.col("_s.z").alias("zs"), F.col("_s.v").alias("vs"))


def dense_stacks(ls, zs, vs) -> tuple[np.ndarray, np.ndarray]:
    """Arrow lists of layer numbers, heights and values, a list for each column, as arrays (columns x layers)."""
    size = ls.value_lengths().to_numpy(zero_copy_only=False)
    number = ls.flatten().to_numpy(zero_copy_only=False)
    column = np.repeat(np.arange(len(size)), size)
    shape = (len(size), int(number.max(initial=-1)) + 1)
    out = []
    for values in (zs, vs):
        dense = np.full(shape, np.nan)
        dense[column, number] = values.flatten().to_numpy(zero_copy_only=False)
        out.append(dense)
    return out[0], out[1]


def weighted(weights: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums over corners (P x n and P x n x L); NaN if one of non-zero weight is."""
    return np.where(weights[..., None] == 0, 0.0, weights[..., None] * values).sum(axis=1)


def sample_layered_grid(points: DataFrame, heights: DataFrame, values: DataFrame, grid: RegularGrid, key: Sequence[str], quadratic: bool = False) -> DataFrame:
    """(key, value): samples in a grid that is regular along i and j (``grid``) and has a height for each (i, j, k).

    A cell's sides along i and j are planes, its lower and upper sides two triangles each, cut from (0, 0) to (1, 1): the heights
    at a point are those of its triangle.  The value is bilinear in each layer.
    """
    layers = heights.select("i", "j", "k", F.col("value").alias("z")).join(values.select("i", "j", "k", "value"), ["i", "j", "k"], "left")
    stacks = stacks_of(layers, ["i", "j"], "k")
    x, y = (grid.offset(a, F.col(c)) for a, c in enumerate("xy"))
    cell = [grid.cell(a, F.col(c)) for a, c in enumerate("xy")]
    asked = points.where(F.col("x").between(grid.low[0], grid.high[0]) & F.col("y").between(grid.low[1], grid.high[1]))
    asked = asked.select(F.struct(*key).alias("_k"), F.col("z").cast("double").alias("_z"), (x - cell[0]).alias("_p"), (y - cell[1]).alias("_q"), cell[0].alias("_i"), cell[1].alias("_j"))
    corners = F.array(*[F.struct(F.lit(n).alias("n"), (F.col("_i") + (n & 1)).alias("i"), (F.col("_j") + (n >> 1)).alias("j")) for n in range(4)])
    each = asked.withColumn("_c", F.explode(corners)).select("_k", "_z", "_p", "_q", F.col("_c.n").alias("n"), F.col("_c.i").alias("i"), F.col("_c.j").alias("j"))
    met = each.join(stacks, ["i", "j"])
    grouped = met.groupBy("_k").agg(*[F.first(c).alias(c) for c in ("_z", "_p", "_q")], F.array_sort(F.collect_list(F.struct("n", "ls", "zs", "vs"))).alias("corners"))
    kind = grouped.schema["_k"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for whole in batches:
            batch = whole.filter(pc.equal(pc.list_value_length(whole.column("corners")), 4))
            flat = batch.column("corners").flatten()
            z, v = dense_stacks(*(flat.field(c) for c in ("ls", "zs", "vs")))
            at, p, q = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_z", "_p", "_q"))
            lower = p >= q  # the triangle (0, 0), (1, 0), (1, 1)
            tri = np.stack([np.where(lower, 1 - p, 1 - q), np.where(lower, p - q, 0), np.where(lower, 0, q - p), np.where(lower, q, p)], axis=1)
            four = np.stack([(1 - p) * (1 - q), p * (1 - q), (1 - p) * q, p * q], axis=1)
            got = np.full(len(at), np.nan)
            deep = max(1, HELD // max(1, 4 * z.shape[1]))
            for first in range(0, len(at), deep):
                rows = slice(first, min(first + deep, len(at)))
                own = slice(4 * first, 4 * rows.stop)
                heights_at, values_at = (weighted(w[rows], x[own].reshape(-1, 4, x.shape[1])) for w, x in ((tri, z), (four, v)))
                got[rows] = sample_stacks(heights_at, values_at, at[rows], quadratic)
            yield pa.RecordBatch.from_arrays([batch.column("_k"), pa.array(got, from_pandas=True)], ["_k", "value"])

    found = grouped.mapInArrow(run, f"_k {kind}, value double")
    return points.select(*key).join(found.select(*[F.col(f"_k.{c}").alias(c) for c in key], "value"), list(key), "left")


# Hexahedra


def tetrahedra(odd: bool = False) -> list[tuple[int, int, int, int]]:
    """Five tetrahedra that fill a hexahedron; corner number = i + 2 j + 4 k offsets.

    The middle one joins four corners no two of which share an edge; each other corner
    closes one more with its three neighbours.  ``odd`` is the mirrored division, which fits beside the other.
    """
    flip = int(odd)
    middle = tuple(c ^ flip for c in range(8) if bin(c).count("1") % 2 == 0)
    around = [(c ^ flip, c ^ 1 ^ flip, c ^ 2 ^ flip, c ^ 4 ^ flip) for c in range(8) if bin(c).count("1") % 2]
    return [middle, *around]


def tetrahedron_weights(corners: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Barycentric weights (... x 4) of points (... x 3) in tetrahedra (... x 4 x 3); NaN in flat ones."""
    a, b, c = (corners[..., n, :] - corners[..., 0, :] for n in (1, 2, 3))
    p = points - corners[..., 0, :]
    bc, ca, ab = np.cross(b, c), np.cross(c, a), np.cross(a, b)
    volume = (a * bc).sum(axis=-1)
    with np.errstate(invalid="ignore", divide="ignore"):
        inner = np.stack([(p * x).sum(axis=-1) / volume for x in (bc, ca, ab)], axis=-1)
    inner[~np.isfinite(inner)] = np.nan
    return np.concatenate([1 - inner.sum(axis=-1, keepdims=True), inner], axis=-1)


#: Cells of a block of hexahedra, and of a group of it along each axis; pairs of points and groups in one task, and at a time.
BLOCK, SUB, TOGETHER, PAIRS = 4096, 4, 50_000, 5_000


def _boxes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest x, y, z of the cells of a block (x, y, z, value, presence; k, j, i); NaN where a corner has no row."""
    lo = hi = None
    for c in range(8):
        own = data[:, *[slice(c >> s & 1, data.shape[a] - 1 + (c >> s & 1)) for a, s in ((1, 2), (2, 1), (3, 0))]]
        lo, hi = (own, own) if lo is None else (np.fmin(lo, own), np.fmax(hi, own))
        gone = np.isnan(own[4]) if c == 0 else gone | np.isnan(own[4])  # noqa: F821
    return np.where(gone, np.nan, lo[:3]), np.where(gone, np.nan, hi[:3])


def sample_hexahedra(points: DataFrame, coordinates: DataFrame, values: DataFrame, n: Sequence[int], key: Sequence[str], epsilon: float = 1e-9) -> DataFrame:
    """(key, ci, cj, ck, value): samples in a curvilinear grid whose samples (i, j, k) have places (x, y, z).

    Cells are divided in five tetrahedra each, neighbours mirrored so that their sides fit; a value is
    linear in a tetrahedron, and null if a corner of non-zero weight is missing.  A point on a side belongs to the cell of least index.

    Cells stay in blocks that share their border samples; the index holds boxes of small groups of cells, and a point's pairs with groups go to the block.
    """
    from . import flow

    shape = RegularGrid(tuple(n), (0.0,) * 3, tuple(float(m - 1) for m in n))
    parts = [*[coordinates.select(*AXES, F.col(c).alias("value")) for c in "xyz"], values.select(*AXES, "value"), coordinates.select(*AXES, F.lit(1.0).alias("value"))]
    size = flow.even_block(shape, BLOCK)
    blocks, plain = flow.StoredField(shape, parts, block=size).blocks(), flow.StoredField(shape, [], block=size)
    grouped = [-(-b // SUB) for b in plain.block]
    groups, plane, line = int(np.prod(grouped)), (n[0] - 1) * (n[1] - 1), n[0] - 1

    def boxes_of(batches):
        import pyarrow as pa

        for batch in batches:
            for number, samples in zip(batch.column("key").to_pylist(), batch.column("samples")):
                lo, hi = _boxes(np.frombuffer(samples.as_py()).reshape(5, *reversed(plain.shape_of(number))))
                for axis in (1, 2, 3):
                    cuts = np.arange(0, lo.shape[axis], SUB)
                    lo, hi = (f.reduceat(x, cuts, axis=axis) if len(cuts) else x for f, x in ((np.fmin, lo), (np.fmax, hi)))
                k, j, i = np.nonzero(~np.isnan(lo).any(axis=0))
                ids = number * groups + (k * grouped[1] + j) * grouped[0] + i
                ends = [pa.array(x) for c in range(3) for x in (lo[c, k, j, i] - epsilon, hi[c, k, j, i] + epsilon)]
                yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), *ends], ["id", *names])

    names = [f"{e}{c}" for c in range(3) for e in ("lo", "hi")]
    boxes = scratch.written(blocks.mapInArrow(boxes_of, f"id long, {', '.join(f'{c} double' for c in names)}"), "groups")
    index = box_index(boxes, 3)
    asked = points.select(F.struct(*key).alias("_k"), *[F.col(c).cast("double").alias(f"p{c}") for c in "xyz"])
    met = index.meet(asked, ["px", "py", "pz"]).join(boxes, "id").where(" and ".join(f"p{c} between lo{a} and hi{a}" for a, c in enumerate("xyz")))
    pairs = scratch.written(met.select("_k", "px", "py", "pz", F.floor(F.col("id") / groups).alias("key"), (F.col("id") % groups).alias("group")), "pairs")
    many = pairs.groupBy("key").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("_n"))
    sent = pairs.join(many, "key").withColumn("_part", F.pmod(F.xxhash64("_k"), F.col("_n")).cast("int")).drop("_n")
    kind = pairs.schema["_k"].dataType.simpleString()

    def run(key, asked, block):
        import pyarrow as pa

        made = []
        if asked.num_rows and block.num_rows:
            number = key[0].as_py()
            data, origin = np.frombuffer(block.column("samples")[0].as_py()).reshape(5, *reversed(plain.shape_of(number))), plain.place_of(number)[1]
            for first in range(0, asked.num_rows, PAIRS):
                some = asked.slice(first, PAIRS)
                at = np.stack([some.column(f"p{c}").to_numpy() for c in "xyz"], axis=1)
                who, ids, value = _in_hexahedra(data, origin, some.column("group").to_numpy(), at)
                made.append(pa.table({"_k": some.column("_k").take(pa.array(who)), "id": pa.array(ids), "value": pa.array(value, from_pandas=True)}))
        if made:
            return pa.concat_tables(made)
        return pa.table({"_k": asked.column("_k").slice(0, 0), "id": pa.array([], pa.int64()), "value": pa.array([], pa.float64())})

    def _in_hexahedra(data, origin, group, at):
        """Which points are in which cells of their groups, and the values there."""
        lo, hi = _boxes(data)
        start = np.stack([group % grouped[0], group // grouped[0] % grouped[1], group // (grouped[0] * grouped[1])], axis=1) * SUB
        offset = np.stack([x.ravel() for x in np.indices((SUB, SUB, SUB))], axis=1)
        cell = start[:, None] + offset[None]
        there = (cell < np.array(lo.shape[:0:-1])).all(axis=2)
        i, j, k = np.where(there[..., None], cell, 0).transpose(2, 0, 1)
        for c in range(3):
            there &= (at[:, None, c] >= lo[c, k, j, i] - epsilon) & (at[:, None, c] <= hi[c, k, j, i] + epsilon)
        who, which = np.nonzero(there)
        i, j, k = (x[who, which] for x in (i, j, k))
        corner = np.stack([data[:4, k + (c >> 2), j + (c >> 1 & 1), i + (c & 1)] for c in range(8)])  # corner, part, pair
        place, value, at = corner[:, :3].transpose(2, 0, 1), corner[:, 3].T, at[who]
        i, j, k = (x + o for x, o in zip((i, j, k), origin))
        odd = (i + j + k) % 2 == 1
        got, hit = np.full(len(at), np.nan), np.zeros(len(at), bool)
        for parity in (False, True):
            for corners in tetrahedra(parity):
                rows = np.flatnonzero((odd == parity) & ~hit)
                w = tetrahedron_weights(place[rows][:, corners], at[rows])
                inside = (w >= -epsilon).all(axis=1)
                rows, w = rows[inside], np.where(np.abs(w[inside]) <= epsilon, 0.0, w[inside])
                hit[rows] = True
                got[rows] = np.where(w == 0, 0.0, w * value[rows][:, corners]).sum(axis=1)
        return who[hit], ((k * (n[1] - 1) + j) * (n[0] - 1) + i)[hit].astype(np.int64), got[hit]

    tasks = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), points.sparkSession.sparkContext.defaultParallelism)
    slices = flow._slices(many, blocks).repartition(tasks, "_key", "_slice")
    tested = sent.repartition(tasks, "key", "_part").groupBy("key", "_part").cogroup(slices.groupBy("_key", "_slice")).applyInArrow(run, f"_k {kind}, id long, value double")
    best = tested.groupBy("_k").agg(F.min(F.struct("id", "value")).alias("_b"))
    cell = F.col("_b.id")
    out = asked.select("_k").join(best, "_k", "left")
    return out.select(
        *[F.col(f"_k.{c}").alias(c) for c in key], (cell % line).cast("int").alias("ci"), F.floor(cell % plane / line).cast("int").alias("cj"), F.floor(cell / plane).cast("int").alias("ck"), F.col("_b.value").alias("value")
    )
