"""Unstructured and curvilinear grids: connectivity, point location, polygon weights.

A mesh is ``nodes(node, x, y, value)`` and ``face_nodes(face, slot, node)``; padding
slots have negative nodes.  Points meet faces through square buckets that face boxes
are listed under; weights are computed in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import written
from .cells import HELD, box_index, dense_stacks, sample_stacks, stacks_of, tetrahedra, weighted
from .grid import AXES


def valid_slots(face_nodes: DataFrame) -> DataFrame:
    return face_nodes.where("node >= 0")


def one_based(face_nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """1-based connectivity to 0-based; slots beyond a face's count become -1, a 0 marks the whole face -2."""
    faces = Window.partitionBy("face")
    broken = F.max(F.when((F.col("node") == 0) & (F.col("slot") < F.col("n_nodes")), 1).otherwise(0)).over(faces)
    node = F.when(broken == 1, -2).when(F.col("slot") >= F.col("n_nodes"), -1).otherwise(F.col("node") - 1)
    return face_nodes.join(counts.select("face", "n_nodes"), "face").withColumn("node", node).drop("n_nodes")


def cut_at_date_line(face_nodes: DataFrame, nodes: DataFrame, degrees: float = 180.0) -> DataFrame:
    """Members more than so many degrees of longitude from the face's first valid one become -2."""
    lon = face_nodes.join(nodes.select("node", F.col("x").alias("_lon")), "node", "left")
    first = F.min(F.when(F.col("_lon").isNotNull(), F.struct("slot", "_lon"))).over(Window.partitionBy("face"))["_lon"]
    return lon.withColumn("node", F.when(F.abs(F.col("_lon") - first) > degrees, -2).otherwise(F.col("node"))).drop("_lon")


def face_values(face_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(face, value): mean of the faces' nodes; null if any is missing."""
    joined = valid_slots(face_nodes).join(nodes.select("node", "value"), "node")
    return joined.groupBy("face").agg(
        F.when(F.count("value") == F.count("*"), F.avg("value")).alias("value"), F.count("*").alias("n_nodes")
    )


def node_faces(face_nodes: DataFrame) -> DataFrame:
    """(node, faces): the faces around every node."""
    return valid_slots(face_nodes).groupBy("node").agg(F.sort_array(F.collect_set("face")).alias("faces"))


def face_neighbours(face_nodes: DataFrame) -> DataFrame:
    """(face, neighbour): faces that share an edge."""
    sides = edges(face_nodes)
    other = sides.select("a", "b", F.col("face").alias("neighbour"))
    return sides.join(other, ["a", "b"]).where("face != neighbour").select("face", "neighbour").distinct()


def edges(face_nodes: DataFrame) -> DataFrame:
    """(face, a, b): the edges of every face, a < b."""
    order = Window.partitionBy("face").orderBy("slot")
    whole = Window.partitionBy("face").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.coalesce(F.lead("node").over(order), F.first("node").over(whole))
    return valid_slots(face_nodes).withColumn("_next", after).select(
        "face", F.least("node", "_next").alias("a"), F.greatest("node", "_next").alias("b")
    )


def wireframe(face_nodes: DataFrame) -> DataFrame:
    """Distinct edges."""
    return edges(face_nodes).select("a", "b").distinct()


def vertex_from_cells(vertex_cells: DataFrame, cells: DataFrame) -> DataFrame:
    """(vertex, value): mean of the cells around a vertex; null if any is missing."""
    joined = vertex_cells.join(cells.select("cell", "value"), "cell", "left")
    return joined.groupBy("vertex").agg(F.when(F.count("value") == F.count("*"), F.avg("value")).alias("value"))


def vertex_winds(vertex_edges: DataFrame, edge_values: DataFrame) -> DataFrame:
    """(vertex, zonal, meridional): edge winds ``normal`` and ``tangential`` turned by the edge
    ``angle`` and averaged over a vertex's edges."""
    cos, sin = F.cos("angle"), F.sin("angle")
    turned = edge_values.select(
        "edge",
        (cos * F.col("normal") - sin * F.col("tangential")).alias("_z"),
        (sin * F.col("normal") + cos * F.col("tangential")).alias("_m"),
    )
    return vertex_edges.join(turned, "edge").groupBy("vertex").agg(F.avg("_z").alias("zonal"), F.avg("_m").alias("meridional"))


def triangle_weights(px: Column, py: Column, corners: Sequence[tuple[Column, Column]]) -> list[Column]:
    """Barycentric weights of a point in a triangle."""
    (ax, ay), (bx, by), (cx, cy) = corners
    area = (bx - ax) * (cy - ay) - (cx - ax) * (by - ay)
    b = ((px - ax) * (cy - ay) - (cx - ax) * (py - ay)) / area
    c = ((bx - ax) * (py - ay) - (px - ax) * (by - ay)) / area
    return [F.lit(1.0) - b - c, b, c]


def polygon_weights(polygon: np.ndarray, point: np.ndarray, epsilon: float = 1e-9) -> np.ndarray | None:
    """Wachspress weights of a point in a convex polygon (n x 2, either turn); None outside.

    On an edge the weights are linear between its ends.
    """
    n = len(polygon)
    rel = polygon - point
    nxt = np.roll(rel, -1, axis=0)
    area = rel[:, 0] * nxt[:, 1] - rel[:, 1] * nxt[:, 0]  # twice the triangle (point, i, i + 1)
    turn = np.sign(area.sum()) or 1.0
    area = area * turn
    scale = np.abs(area).max() or 1.0
    for i in np.flatnonzero(np.abs(area) <= epsilon * scale):
        side = polygon[(i + 1) % n] - polygon[i]
        length = side @ side
        t = (point - polygon[i]) @ side / length if length else 0.0
        if -epsilon <= t <= 1 + epsilon:
            out = np.zeros(n)
            out[i], out[(i + 1) % n] = 1 - t, t
            return np.clip(out, 0.0, 1.0)
        return None
    if (area < 0).any():
        return None
    before, after = np.roll(polygon, 1, axis=0), np.roll(polygon, -1, axis=0)
    corner = turn * ((polygon - before)[:, 0] * (after - polygon)[:, 1] - (polygon - before)[:, 1] * (after - polygon)[:, 0])
    weight = corner / (np.roll(area, 1) * area)
    return weight / weight.sum()


def polygon_weights_of(polygons: np.ndarray, points: np.ndarray, epsilon: float = 1e-9) -> np.ndarray:
    """``polygon_weights`` of many points in as many polygons of n corners each (P x n x 2); NaN outside."""
    rel = polygons - points[:, None, :]
    nxt = np.roll(rel, -1, axis=1)
    area = rel[..., 0] * nxt[..., 1] - rel[..., 1] * nxt[..., 0]
    turn = np.sign(area.sum(axis=1))
    turn[turn == 0] = 1.0
    area = area * turn[:, None]
    scale = np.abs(area).max(axis=1, initial=0.0)
    scale[scale == 0] = 1.0
    edge = (np.abs(area) <= epsilon * scale[:, None]).any(axis=1)
    out = np.full(area.shape, np.nan)
    for i in np.flatnonzero(edge).tolist():
        one = polygon_weights(polygons[i], points[i], epsilon)
        if one is not None:
            out[i] = one
    free = ~edge & (area >= 0).all(axis=1)
    if free.any():
        p, area = polygons[free], area[free]
        before, after = p - np.roll(p, 1, axis=1), np.roll(p, -1, axis=1) - p
        corner = turn[free, None] * (before[..., 0] * after[..., 1] - before[..., 1] * after[..., 0])
        weight = corner / (np.roll(area, 1, axis=1) * area)
        out[free] = weight / weight.sum(axis=1, keepdims=True)
    return out


def _faces_with_corners(nodes: DataFrame, face_nodes: DataFrame) -> DataFrame:
    joined = valid_slots(face_nodes).join(nodes.select("node", "x", "y", "value"), "node")
    corner = F.struct("slot", "node", "x", "y", "value")
    return joined.groupBy("face").agg(
        F.array_sort(F.collect_list(corner)).alias("corners"),  # a face has a handful of nodes
        F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"),
    )


def _sampler(policy: str):
    """Samples of points in the faces beside them, all faces of one number of corners at once."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lists = batch.column("corners")
            size = lists.value_lengths().to_numpy()
            first = np.cumsum(size) - size
            flat = lists.flatten()
            x, y, v = (flat.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("x", "y", "value"))
            points = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("px", "py")], axis=1)
            linear, nearest, hit = np.full(len(size), np.nan), np.full(len(size), np.nan), np.zeros(len(size), bool)
            for n in np.unique(size).tolist():
                rows = np.flatnonzero(size == n)
                at = first[rows, None] + np.arange(n)
                weight, value = polygon_weights_of(np.stack([x[at], y[at]], axis=2), points[rows]), v[at]
                inside = ~np.isnan(weight).any(axis=1)
                rows, weight, value = rows[inside], weight[inside], value[inside]
                hit[rows] = True
                nearest[rows] = value[np.arange(len(rows)), weight.argmax(axis=1)]
                known = ~np.isnan(value)
                share = np.where(known, weight, 0.0)
                total = share.sum(axis=1)
                bad = ~known.any(axis=1) | (total == 0)
                if policy == "strict":
                    bad |= (~known & (weight > 0)).any(axis=1)
                else:
                    share = share / np.where(total == 0, 1.0, total)[:, None]
                linear[rows] = np.where(bad, np.nan, (share * np.where(known, value, 0.0)).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_k"), batch.column("face"), pa.array(hit), pa.array(linear, from_pandas=True), pa.array(nearest, from_pandas=True)],
                ["_k", "face", "hit", "linear", "nearest"],
            )

    return run


def _candidates(points: DataFrame, faces: DataFrame, key: Sequence[str], width: float | None) -> DataFrame:
    """(_k, the points' further columns, face, corners): the faces whose boxes hold each point, found through square
    buckets of a ``width`` or, without one, an index that follows the faces' sizes and crowds."""
    more = [c for c in points.columns if c not in (*key, "x", "y")]
    asked = points.select(F.struct(*key).alias("_k"), F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"), *more)
    if width is None:
        faces = written(faces, "faces")
        boxes = faces.select(F.col("face").alias("id"), F.col("_x0").alias("lo0"), F.col("_x1").alias("hi0"), F.col("_y0").alias("lo1"), F.col("_y1").alias("hi1"))
        near = box_index(boxes, 2).meet(asked, ["px", "py"]).withColumnRenamed("id", "face").join(faces, "face")
    else:
        bucket = lambda c: F.floor(c / width).cast("long")
        listed = faces.withColumn("_bx", F.explode(F.sequence(bucket(F.col("_x0")), bucket(F.col("_x1"))))).withColumn(
            "_by", F.explode(F.sequence(bucket(F.col("_y0")), bucket(F.col("_y1"))))
        )
        near = asked.withColumns({"_bx": bucket(F.col("px")), "_by": bucket(F.col("py"))}).join(listed, ["_bx", "_by"])
    return near.where("px between _x0 and _x1 and py between _y0 and _y1").select("_k", "face", "px", "py", "corners", *more)


def sample_faces(points: DataFrame, nodes: DataFrame, face_nodes: DataFrame, key: Sequence[str], width: float | None = None, policy: str = "strict") -> DataFrame:
    """(key, face, linear, nearest): samples of points in the faces that hold them.

    ``policy`` strict: null if a corner of non-zero weight is missing; renormalise: missing
    corners are left out and the other weights scaled up.  A point on a shared edge belongs
    to the face of least number; points outside have nulls.  ``width`` is that of the buckets that points and faces
    meet in; without it an index finds widths of its own.
    """
    boxed = _candidates(points.select(*key, "x", "y"), _faces_with_corners(nodes, face_nodes), key, width)
    kind = boxed.schema["_k"].dataType.simpleString()
    face_kind = boxed.schema["face"].dataType.simpleString()
    tested = boxed.mapInArrow(_sampler(policy), f"_k {kind}, face {face_kind}, hit boolean, linear double, nearest double")
    best = tested.where("hit").groupBy("_k").agg(F.min(F.struct("face", "linear", "nearest")).alias("_b"))
    joined = points.select(F.struct(*key).alias("_k")).join(best, "_k", "left")
    return joined.select(*[F.col(f"_k.{c}").alias(c) for c in key], F.col("_b.face").alias("face"), F.col("_b.linear").alias("linear"), F.col("_b.nearest").alias("nearest"))


def curvilinear_mesh(coordinates: DataFrame, values: DataFrame, n: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """Nodes and quadrilateral faces of a curvilinear grid, ``coordinates`` being (i, j, x, y)."""
    ni, nj = n[:2]
    number = lambda i, j: (j * ni + i).cast("long")
    nodes = coordinates.join(values.select("i", "j", "value"), ["i", "j"], "left").select(
        number(F.col("i"), F.col("j")).alias("node"), "x", "y", "value"
    )
    cells = coordinates.where((F.col("i") < ni - 1) & (F.col("j") < nj - 1))
    i, j = F.col("i"), F.col("j")
    ring = F.array(number(i, j), number(i + 1, j), number(i + 1, j + 1), number(i, j + 1))
    faces = cells.select((j * (ni - 1) + i).cast("long").alias("face"), F.posexplode(ring).alias("slot", "node"))
    return nodes, faces


def sample_layers(
    points: DataFrame, layers: DataFrame, face_nodes: DataFrame, key: Sequence[str], width: float | None = None, quadratic: bool = False
) -> DataFrame:
    """(key, value): samples in layered meshes; ``layers`` is (node, layer, x, y, z, value).

    A node's layers are a stack, one row; a face carries its corners' stacks, so a point meets its face once, whatever
    the number of layers.  Heights and values are weighed in the plane, then the two layers around
    the point's z are combined (three for ``quadratic``, Lagrange).
    """
    places = layers.groupBy("node").agg(F.first("x").alias("x"), F.first("y").alias("y"))
    nodes = stacks_of(layers, ["node"], "layer").join(places, "node")
    joined = valid_slots(face_nodes).join(nodes, "node")
    faces = joined.groupBy("face").agg(
        F.array_sort(F.collect_list(F.struct("slot", "x", "y", "ls", "zs", "vs"))).alias("corners"),
        F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"),
    )
    boxed = _candidates(points.select(*key, "x", "y", F.col("z").cast("double").alias("_z")), faces, key, width)
    kind, face_kind = (boxed.schema[c].dataType.simpleString() for c in ("_k", "face"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lists = batch.column("corners")
            size = lists.value_lengths().to_numpy()
            first = np.cumsum(size) - size
            flat = lists.flatten()
            x, y = (flat.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in "xy")
            z, v = dense_stacks(*(flat.field(c) for c in ("ls", "zs", "vs")))
            points, height = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("px", "py")], axis=1), batch.column("_z").to_numpy(zero_copy_only=False)
            got, hit = np.full(len(size), np.nan), np.zeros(len(size), bool)
            for n in np.unique(size).tolist():
                every = np.flatnonzero(size == n)
                deep = max(1, HELD // max(1, n * z.shape[1]))
                for begin in range(0, len(every), deep):
                    rows = every[begin : begin + deep]
                    at = first[rows, None] + np.arange(n)
                    weight = polygon_weights_of(np.stack([x[at], y[at]], axis=2), points[rows])
                    inside = ~np.isnan(weight).any(axis=1)
                    rows, at, weight = rows[inside], at[inside], weight[inside]
                    hit[rows] = True
                    got[rows] = sample_stacks(weighted(weight, z[at]), weighted(weight, v[at]), height[rows], quadratic)
            yield pa.RecordBatch.from_arrays([batch.column("_k"), batch.column("face"), pa.array(hit), pa.array(got, from_pandas=True)], ["_k", "face", "hit", "value"])

    tested = boxed.mapInArrow(run, f"_k {kind}, face {face_kind}, hit boolean, value double")
    best = tested.where("hit").groupBy("_k").agg(F.min(F.struct("face", "value")).alias("_b"))
    joined = points.select(F.struct(*key).alias("_k")).join(best, "_k", "left")
    return joined.select(*[F.col(f"_k.{c}").alias(c) for c in key], F.col("_b.value").alias("value"))


def hexahedron_tetrahedra() -> list[tuple[int, int, int, int]]:
    """Five tetrahedra that fill a hexahedron; corner number = i + 2 j + 4 k offsets."""
    return tetrahedra()


def handedness(values: DataFrame) -> DataFrame:
    """(right_handed): sign of the determinant of the axes at the first sample, from (i, j, k, x, y, z)."""
    corner = values.where(" + ".join(AXES) + " <= 1")
    pick = lambda c, a: F.max(F.when(F.col(a) == 1, F.col(c))) - F.max(F.when(F.col("i") + F.col("j") + F.col("k") == 0, F.col(c)))
    m = corner.agg(*[pick(c, a).alias(f"{a}{c}") for a in AXES for c in ("x", "y", "z")])
    c = {n: F.col(n) for n in m.columns}
    det = (
        c["ix"] * (c["jy"] * c["kz"] - c["jz"] * c["ky"])
        - c["iy"] * (c["jx"] * c["kz"] - c["jz"] * c["kx"])
        + c["iz"] * (c["jx"] * c["ky"] - c["jy"] * c["kx"])
    )
    return m.select((det > 0).alias("right_handed"))
