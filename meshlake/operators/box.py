"""Boxes as pairs of corners, and derived coordinates that follow from extents alone."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import numbered

Box = tuple[tuple[float, ...], tuple[float, ...]]


def crop(box: Box, bounds: Box) -> Box:
    """A box moved inside bounds corner by corner."""
    clip = lambda p: tuple(min(max(v, lo), hi) for v, lo, hi in zip(p, *bounds))
    return clip(box[0]), clip(box[1])


def intersect(a: Box, b: Box) -> Box | None:
    low, high = tuple(map(max, a[0], b[0])), tuple(map(min, a[1], b[1]))
    return (low, high) if all(lo <= hi for lo, hi in zip(low, high)) else None


def rotation(degrees: Sequence[float]) -> list[list[float]]:
    """Matrix of turns about x, then y, then z."""
    (ca, sa), (cb, sb), (cc, sc) = ((math.cos(math.radians(d)), math.sin(math.radians(d))) for d in degrees)
    return [
        [cc * cb, cc * sb * sa - sc * ca, cc * sb * ca + sc * sa],
        [sc * cb, sc * sb * sa + cc * ca, sc * sb * ca - cc * sa],
        [-sb, cb * sa, cb * ca],
    ]


def turn(matrix: Sequence[Sequence[float]], p: Sequence[float]) -> tuple[float, ...]:
    return tuple(sum(m * v for m, v in zip(row, p)) for row in matrix)


def normal(degrees: Sequence[float]) -> tuple[float, ...]:
    """Normal of the x-y plane after turns."""
    return turn(rotation(degrees), (0.0, 0.0, 1.0))


def rotated_extents(box: Box, degrees: Sequence[float]) -> Box:
    """The axis-aligned box around a box turned about its middle."""
    middle = [(a + b) / 2 for a, b in zip(*box)]
    matrix = rotation(degrees)
    corners = []
    for choice in product((0, 1), repeat=3):
        corner = [box[c][a] - middle[a] for a, c in enumerate(choice)]
        corners.append([v + m for v, m in zip(turn(matrix, corner), middle)])
    return tuple(map(min, *corners)), tuple(map(max, *corners))


def plane_patch(box: Box, origin: Sequence[float], n: Sequence[float]) -> tuple | None:
    """(origin, u, v): the least rectangle of a plane that covers its cut through a box; None if they don't meet.

    The rectangle has a side along one of the cut polygon's edges.
    """
    length = math.sqrt(sum(c * c for c in n))
    n = [c / length for c in n]
    corners = [tuple(box[c][a] for a, c in enumerate(choice)) for choice in product((0, 1), repeat=3)]
    side = [sum(a * (b - o) for a, b, o in zip(n, p, origin)) for p in corners]
    points = [p for p, s in zip(corners, side) if abs(s) < 1e-12]
    for i, j in product(range(8), repeat=2):
        if i < j and bin(i ^ j).count("1") == 1 and side[i] * side[j] < 0:
            t = side[i] / (side[i] - side[j])
            points.append(tuple(a + t * (b - a) for a, b in zip(corners[i], corners[j])))
    if len(points) < 3:
        return None
    helper = (1.0, 0.0, 0.0) if abs(n[0]) < 0.9 else (0.0, 1.0, 0.0)
    e1 = _unit(_cross(n, helper))
    e2 = _cross(n, e1)
    flat = sorted({(round(_dot(p, e1), 12), round(_dot(p, e2), 12)) for p in points})
    hull = _hull(flat)
    best = None
    for (ax, ay), (bx, by) in zip(hull, hull[1:] + hull[:1]):
        edge = math.hypot(bx - ax, by - ay)
        if edge == 0:
            continue
        dx, dy = (bx - ax) / edge, (by - ay) / edge
        us, vs = [x * dx + y * dy for x, y in hull], [-x * dy + y * dx for x, y in hull]
        area = (max(us) - min(us)) * (max(vs) - min(vs))
        if best is None or area < best[0] - 1e-12:
            best = (area, dx, dy, min(us), max(us), min(vs), max(vs))
    if best is None:
        return None
    _, dx, dy, u0, u1, v0, v1 = best
    du = tuple(dx * a + dy * b for a, b in zip(e1, e2))
    dv = tuple(-dy * a + dx * b for a, b in zip(e1, e2))
    lift = _dot(origin, n)
    base = tuple(u0 * a + v0 * b + lift * c for a, b, c in zip(du, dv, n))
    return base, tuple((u1 - u0) * c for c in du), tuple((v1 - v0) * c for c in dv)


def _dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def _cross(a, b):
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def _unit(a):
    size = math.sqrt(_dot(a, a))
    return tuple(c / size for c in a)


def _hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull of sorted points, counter-clockwise."""

    def half(ordered):
        out: list[tuple[float, float]] = []
        for p in ordered:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(points[::-1]) if len(points) > 2 else points


def index_coordinate(spark, n: int, axis: str = "i") -> DataFrame:
    """(axis, value): 0 .. n - 1, for a dimension without a coordinate."""
    return spark.range(n).select(F.col("id").cast("int").alias(axis), F.col("id").cast("double").alias("value"))


def span_coordinate(values: DataFrame, n: int, axis: str = "i") -> DataFrame:
    """(axis, value): n even steps from the least to the largest value of another coordinate."""
    ends = values.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    share = F.col("id") / F.lit(max(n - 1, 1))
    steps = values.sparkSession.range(n).crossJoin(F.broadcast(ends))
    return steps.select(F.col("id").cast("int").alias(axis), (F.col("lo") + share * (F.col("hi") - F.col("lo"))).alias("value"))


def sorted_times(times: DataFrame, text: str, parse) -> DataFrame:
    """(file_step, ts, seconds): times of a file in order, with the step each has in the file."""
    parsed = times.select("file_step", parse(F.col(text)).alias("seconds"))
    return numbered(parsed, [F.col("seconds"), F.col("file_step")], "ts").withColumn("ts", F.col("ts").cast("int"))


def projected_coordinates(coordinates: DataFrame, project) -> DataFrame:
    """x and y in metres from longitude and latitude columns ``lon`` and ``lat``."""
    x, y = project(F.col("lon"), F.col("lat"))
    return coordinates.withColumns({"x": x, "y": y})


def projected_axes(samples: DataFrame, lon: DataFrame, lat: DataFrame, project) -> DataFrame:
    """Samples (i, j, ...) with x and y in metres, from the axes (i, lon) and (j, lat)."""
    placed = samples.join(lon.select("i", "lon"), "i").join(lat.select("j", "lat"), "j")
    return projected_coordinates(placed, project).drop("lon", "lat")


def linear_index(indices: Sequence[Column], n: Sequence[int]) -> Column:
    """One number for an index tuple, first axis fastest."""
    out, step = F.lit(0).cast("long"), 1
    for i, m in zip(indices, n):
        out, step = out + i * F.lit(step).cast("long"), step * m
    return out


def index_of(linear: Column, n: Sequence[int]) -> list[Column]:
    """The index tuple of a number."""
    out = []
    for m in n:
        out.append((linear % m).cast("int"))
        linear = F.floor(linear / m)
    return out


def fixed_coordinate(spark, rows: Sequence[Sequence[float]]) -> DataFrame:
    """(i, j, value): a 2-D coordinate given as rows of numbers, j by j."""
    cells = [(i, j, float(v)) for j, row in enumerate(rows) for i, v in enumerate(row)]
    return spark.createDataFrame(cells, "i int, j int, value double")


def fixed_rows(table: DataFrame, row: str, numbers: str) -> DataFrame:
    """(i, j, value): a 2-D coordinate given as a table of rows of numbers, numbered by j."""
    each = table.select(F.col(row).cast("int").alias("j"), F.posexplode(numbers).alias("i", "_v"))
    return each.select("i", "j", F.col("_v").cast("double").alias("value"))
