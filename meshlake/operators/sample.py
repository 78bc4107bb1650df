"""Sampling grids at points: nearest, linear, on stretched axes, along transects and slices.

Points are a table with x, y, z (those the grid has) and any other columns.  A point
computes the keys of the samples it needs, so sampling is an equi-join on indices.
Null rule of linear sampling: the result is null if a sample of non-zero weight is.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import written
from .grid import AXES, COORDS, RegularGrid


def nearest_index(grid: RegularGrid, axis: int, coord: Column) -> Column:
    """Index of the nearest sample; half-way points go to the lower one."""
    at = grid.offset(axis, coord)
    low = F.floor(at)
    return F.least(low + F.when(at - low > 0.5, 1).otherwise(0), F.lit(grid.n[axis] - 1)).cast("int")


def sample_nearest(points: DataFrame, values: DataFrame, grid: RegularGrid, name: str = "sampled") -> DataFrame:
    """The points with the nearest sample; null outside the grid."""
    keys = {a: nearest_index(grid, n, F.col(COORDS[n])) for n, a in enumerate(grid.axes)}
    wanted = points.withColumns({f"_{a}": F.when(grid.inside(), k) for a, k in keys.items()})
    side = values.select(*[F.col(a).alias(f"_{a}") for a in grid.axes], F.col("value").alias(name))
    return wanted.join(side, [f"_{a}" for a in grid.axes], "left").drop(*[f"_{a}" for a in grid.axes])


def _weights(grid: RegularGrid) -> Column:
    """The corners around a point with their indices and weights; corners of weight 0 are left out."""
    dims = [a for a in range(len(grid.n)) if grid.n[a] > 1]
    corners = []
    for number in range(1 << len(dims)):
        weight, fields = F.lit(1.0), []
        for a, axis in enumerate(grid.axes):
            cell = grid.cell(a, F.col(COORDS[a]))
            upper = number >> dims.index(a) & 1 if a in dims else 0
            if a in dims:
                part = grid.offset(a, F.col(COORDS[a])) - cell
                weight = weight * (part if upper else F.lit(1.0) - part)
            fields.append((cell + upper).cast("int").alias(f"_{axis}"))
        corners.append(F.struct(weight.alias("_w"), *fields))
    return F.filter(F.array(*corners), lambda c: c["_w"] != 0)


def sample_linear(points: DataFrame, values: DataFrame, grid: RegularGrid, key: Sequence[str], name: str = "sampled", also: Sequence[str] = ()) -> DataFrame:
    """(key, name): multilinear samples of the points with these key columns; null outside.

    ``also`` names key columns that the values have too, such as a step, and that must be equal.
    """
    keys = [f"_{a}" for a in grid.axes]
    wanted = points.where(grid.inside()).select(*key, F.explode(_weights(grid)).alias("_c")).select(*key, "_c.*")
    side = values.select(*[F.col(a).alias(f"_{a}") for a in grid.axes], *also, "value")
    found = (
        wanted.join(side, [*keys, *also], "left")
        .groupBy(*key)
        .agg(F.sum(F.col("_w") * F.col("value")).alias("_s"), F.bool_or(F.col("value").isNull()).alias("_gap"))
        .select(*key, F.when(~F.col("_gap"), F.col("_s")).alias(name))
    )
    return points.select(*key).join(found, list(key), "left")


def axis_intervals(axis: DataFrame, index: str, coord: str, buckets: int) -> DataFrame:
    """Cells of a 1-D axis, each listed under the equal-width buckets that it touches."""
    ends = axis.agg(F.min(coord).alias("_lo"), F.max(coord).alias("_hi"))
    order = Window.orderBy(coord)  # an axis has as many rows as the grid is long in one direction
    cells = axis.select(
        F.col(index).alias("_i"), F.col(coord).alias("_a"), F.lead(coord).over(order).alias("_b"), F.lead(coord, 2).over(order).isNull().alias("_last")
    ).where("_b is not null")
    width = (F.col("_hi") - F.col("_lo")) / buckets
    bucket = lambda c: F.floor((c - F.col("_lo")) / width).cast("int")
    return cells.crossJoin(F.broadcast(ends)).withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_a")), bucket(F.col("_b")))))


def locate(points: DataFrame, axis: DataFrame, index: str, coord: str, at: str, buckets: int = 64) -> DataFrame:
    """Points with ``cell`` and ``weight``: their interval on a stretched axis and the place
    inside, by an equi-join on buckets; null outside.  The last node is in the last cell."""
    intervals = axis_intervals(axis, index, coord, buckets)
    ends = axis.agg(F.min(coord).alias("_plo"), F.max(coord).alias("_phi"))
    width = (F.col("_phi") - F.col("_plo")) / buckets
    bucketed = points.crossJoin(F.broadcast(ends)).withColumn("_pb", F.floor((F.col(at) - F.col("_plo")) / width).cast("int"))
    match = (F.col("_pb") == F.col("_bucket")) & (F.col(at) >= F.col("_a")) & ((F.col(at) < F.col("_b")) | (F.col("_last") & (F.col(at) == F.col("_b"))))
    found = bucketed.join(intervals, match, "left")
    return found.withColumns(
        {"cell": F.col("_i"), "weight": (F.col(at) - F.col("_a")) / (F.col("_b") - F.col("_a"))}
    ).drop("_plo", "_phi", "_pb", "_bucket", "_lo", "_hi", "_i", "_a", "_b", "_last")


def sample_stretched(points: DataFrame, values: DataFrame, axes: Sequence[DataFrame], key: Sequence[str], name: str = "sampled") -> DataFrame:
    """(key, name): multilinear samples on a grid whose axes are tables of index and coordinate, (i, x), (j, y), (k, z);
    null outside, and if a sample of non-zero weight is missing."""
    placed = points.select(*key, *[F.col(c).cast("double").alias(c) for c in COORDS[: len(axes)]])
    for n, axis in enumerate(axes):
        placed = locate(placed, axis.withColumnRenamed(COORDS[n], "_at"), AXES[n], "_at", COORDS[n])
        placed = placed.withColumnsRenamed({"cell": f"_c{n}", "weight": f"_w{n}"})
    corners = []
    for number in range(1 << len(axes)):
        weight, index = F.lit(1.0), []
        for n in range(len(axes)):
            up = number >> n & 1
            weight = weight * (F.col(f"_w{n}") if up else F.lit(1.0) - F.col(f"_w{n}"))
            index.append((F.col(f"_c{n}") + up).cast("int").alias(f"_{AXES[n]}"))
        corners.append(F.struct(weight.alias("_w"), *index))
    inside = placed.where(" and ".join(f"_c{n} is not null" for n in range(len(axes))))
    wanted = inside.select(*key, F.explode(F.filter(F.array(*corners), lambda c: c["_w"] != 0)).alias("_c")).select(*key, "_c.*")
    side = values.select(*[F.col(AXES[n]).alias(f"_{AXES[n]}") for n in range(len(axes))], "value")
    met = wanted.join(side, [f"_{AXES[n]}" for n in range(len(axes))], "left").groupBy(*key)
    found = met.agg(F.when(F.count("value") == F.count("*"), F.sum(F.col("_w") * F.col("value"))).alias(name))
    return points.select(*key).join(found, list(key), "left")


def nearest_on_axis(located: DataFrame) -> Column:
    """Index of the nearest node of a located point; half-way points go to the lower one."""
    return F.col("cell") + F.when(F.col("weight") > 0.5, 1).otherwise(0)


def transect(spark, start: Sequence[float], end: Sequence[float], n: int) -> DataFrame:
    """n points on a segment, both ends exact, with ``step`` and ``distance`` from the start."""
    length = sum((b - a) ** 2 for a, b in zip(start, end)) ** 0.5
    step = F.col("step") / F.lit(max(n - 1, 1))
    coords = {
        COORDS[a]: F.when(F.col("step") == n - 1, F.lit(float(hi))).otherwise(F.lit(float(lo)) + step * F.lit(float(hi) - float(lo)))
        for a, (lo, hi) in enumerate(zip(start, end))
    }
    return spark.range(n).select(F.col("id").cast("int").alias("step")).withColumns({**coords, "distance": step * F.lit(length)})


def slice_points(spark, origin: Sequence[float], u: Sequence[float], v: Sequence[float], side: int) -> DataFrame:
    """side x side points of a plane patch ``origin + a u + b v``, a and b from 0 to 1."""
    a, b = (F.col(c) / F.lit(max(side - 1, 1)) for c in ("row", "col"))
    cells = spark.range(side * side).select((F.col("id") % side).cast("int").alias("row"), F.floor(F.col("id") / side).cast("int").alias("col"))
    return cells.withColumns({COORDS[d]: F.lit(float(origin[d])) + a * F.lit(float(u[d])) + b * F.lit(float(v[d])) for d in range(len(origin))})


def nearest_neighbour(
    points: DataFrame, targets: DataFrame, key: Sequence[str], target: str, width: float, within: float | None = None
) -> DataFrame:
    """(key, nearest, distance): nearest target in the plane, the least ``target`` of equally
    near ones; null only for points or targets without coordinates, without any targets, or
    with none ``within`` that distance, if it is given.

    Targets are in square buckets of ``width``; a point looks at its bucket and the ring
    around it, where a target up to ``width`` away is the true nearest.  Where these nine hold more than ``CROWD`` targets,
    buckets of half the width serve, and so on: a point meets no more targets in a denser table.  Of targets at one place the least stands
    for all.  Points that find none go down a pyramid of the targets' cells, from the coarsest, and leave out those that are farther away
    than the farthest place of another; so far points don't meet all targets of a dense bucket.
    """
    usable = lambda d: d.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    side = usable(targets).select(F.col(target).alias("_t"), F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y"))
    side = written(side.groupBy("_x", "_y").agg(F.min("_t").alias("_t")), "places")
    left = usable(points).select(*key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    crowded = _crowded(side, width)
    asked = left.withColumn("_h", F.lit(0))
    if crowded:  # the first lattice that isn't crowded around a point: it is crowded around it at each coarser one
        every = left.withColumn("_h", F.explode(F.sequence(F.lit(0), F.lit(len(crowded) - 1))))
        every = every.select(*key, "_h", _bucket("x", width).alias("_bx"), _bucket("y", width).alias("_by"))
        full = reduce(DataFrame.unionByName, [cells.withColumn("_h", F.lit(h)) for h, cells in enumerate(crowded)])
        depth = every.join(full, ["_h", "_bx", "_by"]).groupBy(*key).agg(F.count("*").cast("int").alias("_more"))
        asked = left.join(depth, list(key), "left").select(*key, "x", "y", F.coalesce("_more", F.lit(0)).alias("_h"))
    deepest = min(len(crowded), HALVINGS - 1)  # what is still crowded goes down the pyramid
    around = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    nine = asked.where(F.col("_h") <= deepest).select(*key, "x", "y", "_h", F.explode(around).alias("_o"))
    nine = nine.select(*key, "x", "y", "_h", (_bucket("x", width) + F.col("_o.dx")).alias("_bx"), (_bucket("y", width) + F.col("_o.dy")).alias("_by"))
    listed = side.withColumn("_h", F.explode(F.sequence(F.lit(0), F.lit(deepest)))).withColumns({"_bx": _bucket("_x", width), "_by": _bucket("_y", width)})
    reach = F.lit(width) / F.pow(F.lit(2.0), "_h")
    reach = reach if within is None else F.least(reach, F.lit(float(within)))
    near = nine.join(listed, ["_h", "_bx", "_by"]).withColumn("_d", _apart()).where(F.col("_d") <= reach).groupBy(*key).agg(F.min(F.struct("_d", "_t")).alias("_n"))
    found = near
    if within is None or within > width or crowded:
        found = written(near, "nearest")
        rest = written(left.join(found, list(key), "left_anti"), "left")
        if not rest.isEmpty():
            found = found.unionByName(_descend(rest, side, key, within))
    return points.select(*key).join(found, list(key), "left").select(*key, F.col("_n._t").alias("nearest"), F.col("_n._d").alias("distance"))


#: Targets in nine buckets that a point meets, and halvings of the buckets' width at most.
CROWD, HALVINGS = 64, 24


def _bucket(c: str, width: float) -> Column:
    """The bucket of a coordinate on the lattice whose width is halved ``_h`` times."""
    return F.floor(F.col(c) / F.lit(width) * F.pow(F.lit(2.0), F.col("_h"))).cast("long")


def _crowded(targets: DataFrame, width: float) -> list[DataFrame]:
    """For each halving, the buckets (_bx, _by) that have too many targets in and around them; up to the last with any."""
    out = []
    around = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    for h in range(HALVINGS):
        full = targets.withColumn("_h", F.lit(h)).groupBy(_bucket("_x", width).alias("_cx"), _bucket("_y", width).alias("_cy")).agg(F.count("*").alias("_m"))
        each = full.withColumn("_o", F.explode(around)).select((F.col("_cx") + F.col("_o.dx")).alias("_bx"), (F.col("_cy") + F.col("_o.dy")).alias("_by"), "_m")
        many = written(each.groupBy("_bx", "_by").agg(F.sum("_m").alias("_m")).where(F.col("_m") > CROWD).select("_bx", "_by"), "crowded")
        if many.isEmpty():
            break
        out.append(many)
    return out


def _apart() -> Column:
    return F.sqrt((F.col("x") - F.col("_x")) ** 2 + (F.col("y") - F.col("_y")) ** 2)


#: Halvings of the targets' extent along each axis, and targets of a cell that isn't divided any more.
DEEPEST, FEW = 16, 32


def _descend(points: DataFrame, targets: DataFrame, key: Sequence[str], within: float | None) -> DataFrame:
    """(key, _n): distance and name of the nearest target of every point, by bounds of cells of targets."""
    ends = targets.agg(F.min("_x"), F.min("_y"), F.max("_x"), F.max("_y")).first()
    kind = F.struct(F.lit(None).cast("double").alias("_d"), F.lit(None).cast(targets.schema["_t"].dataType).alias("_t")).alias("_n")
    if ends[0] is None:
        return points.select(*key, kind).limit(0)
    span = max(ends[2] - ends[0], ends[3] - ends[1]) or 1.0
    at = lambda c, low: F.least(F.floor((F.col(c) - F.lit(low)) / F.lit(span) * (1 << DEEPEST)), F.lit((1 << DEEPEST) - 1)).cast("int")
    placed = written(targets.withColumns({"_cx": at("_x", ends[0]), "_cy": at("_y", ends[1])}), "targets")
    box = [F.min("_x").alias("_x0"), F.max("_x").alias("_x1"), F.min("_y").alias("_y0"), F.max("_y").alias("_y1")]
    cells = placed.groupBy("_cx", "_cy").agg(F.count("*").alias("_m"), *box).withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(DEEPEST))))
    cells = cells.withColumns({"_cx": F.expr(f"shiftright(_cx, {DEEPEST} - _l)"), "_cy": F.expr(f"shiftright(_cy, {DEEPEST} - _l)")})
    ends_of = [F.min("_x0").alias("_x0"), F.max("_x1").alias("_x1"), F.min("_y0").alias("_y0"), F.max("_y1").alias("_y1")]
    pyramid = written(cells.groupBy("_l", "_cx", "_cy").agg(F.sum("_m").alias("_m"), *ends_of), "pyramid")
    out = lambda c, low, high: F.greatest(F.col(low) - F.col(c), F.col(c) - F.col(high), F.lit(0.0))
    far = lambda c, low, high: F.greatest(F.abs(F.col(c) - F.col(low)), F.abs(F.col(c) - F.col(high)))
    least = F.sqrt(out("x", "_x0", "_x1") ** 2 + out("y", "_y0", "_y1") ** 2)
    most = F.sqrt(far("x", "_x0", "_x1") ** 2 + far("y", "_y0", "_y1") ** 2)
    keep = [*key, "x", "y", "_l", "_cx", "_cy", "_m", "_least", "_most"]
    top = pyramid.where("_l = 0").drop("_l", "_cx", "_cy")
    every = points.withColumns({"_l": F.lit(0), "_cx": F.lit(0), "_cy": F.lit(0)}).join(F.broadcast(top.withColumn("_one", F.lit(0))), F.col("_l") == F.col("_one"))
    now = every.withColumns({"_least": least, "_most": most}).select(keep)
    for level in range(1, DEEPEST + 1):
        many = now.where(F.col("_m") > FEW)
        if many.isEmpty():
            break
        below = pyramid.where(F.col("_l") == level).withColumns({"_px": F.shiftright("_cx", 1), "_py": F.shiftright("_cy", 1)})
        parents = many.select(*key, "x", "y", F.col("_cx").alias("_px"), F.col("_cy").alias("_py"))
        split = parents.join(below, ["_px", "_py"]).withColumns({"_least": least, "_most": most}).select(keep)
        each = now.where(F.col("_m") <= FEW).unionByName(split).withColumn("_best", F.min("_most").over(Window.partitionBy(*key)))
        limit = F.col("_best") * (1 + 1e-12) if within is None else F.least(F.col("_best") * (1 + 1e-12), F.lit(float(within)))
        now = written(each.where(F.col("_least") <= limit).select(keep), "candidates")
    found = None
    for level in sorted(r[0] for r in now.select("_l").distinct().collect()):  # at most DEEPEST + 1
        own = placed.withColumns({"_cx": F.shiftright("_cx", DEEPEST - level), "_cy": F.shiftright("_cy", DEEPEST - level)})
        met = now.where(F.col("_l") == level).select(*key, "x", "y", "_cx", "_cy").join(own, ["_cx", "_cy"]).withColumn("_d", _apart())
        met = met if within is None else met.where(F.col("_d") <= within)
        one = met.groupBy(*key).agg(F.min(F.struct("_d", "_t")).alias("_n"))
        found = one if found is None else found.unionByName(one)
    if found is None:
        return points.select(*key, kind).limit(0)
    return found.groupBy(*key).agg(F.min("_n").alias("_n"))
