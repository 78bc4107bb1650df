"""Neighbourhood operators along grid axes, as window expressions.

A window is partitioned by the other axes (and time), so lines of the grid are spread
over tasks; a line is as long as the grid in one direction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grid import AXES


def _line(values: DataFrame, axis: str):
    others = [c for c in ("ts", *AXES) if c in values.columns and c != axis]
    return Window.partitionBy(*others).orderBy(axis)


def _combination(column: str, weights: dict[int, float], line) -> Column:
    terms = [F.lit(float(w)) * (F.col(column) if s == 0 else F.lag(column, -s).over(line)) for s, w in weights.items()]
    return sum(terms[1:], terms[0])


#: Stencils by order: cells at an end that are one-sided, then start, middle and end weights by offset.
STENCILS = {
    2: (1, {0: -1, 1: 1}, {-1: -1 / 2, 1: 1 / 2}, {-1: -1, 0: 1}),
    4: (
        2,
        {0: -3 / 2, 1: 2, 2: -1 / 2},
        {-2: 1 / 12, -1: -2 / 3, 1: 2 / 3, 2: -1 / 12},
        {-2: 1 / 2, -1: -2, 0: 3 / 2},
    ),
    6: (
        3,
        {0: -11 / 6, 1: 3, 2: -3 / 2, 3: 1 / 3},
        {-3: -1 / 60, -2: 3 / 20, -1: -3 / 4, 1: 3 / 4, 2: -3 / 20, 3: 1 / 60},
        {-3: -1 / 3, -2: 3 / 2, -1: -3, 0: 11 / 6},
    ),
}


def _order(n: int, order: int) -> int:
    """Short axes fall back to lower orders; 0 means no derivative."""
    return 0 if n < 2 else 2 if n < 4 else min(order, 4) if n < 6 else order


def difference(values: DataFrame, axis: str, n: int, column: str = "value", order: int = 6) -> Column:
    """Difference quotient of a column per index along an axis of n samples."""
    order = _order(n, order)
    if not order:
        return F.lit(0.0)
    edge, start, middle, end = STENCILS[order]
    line, at = _line(values, axis), F.col(axis)
    return (
        F.when(at < edge, _combination(column, start, line))
        .when(at >= n - edge, _combination(column, end, line))
        .otherwise(_combination(column, middle, line))
    )


def derivative(values: DataFrame, axis: str, n: int, dx: float, order: int = 6, name: str = "derivative") -> DataFrame:
    return values.withColumn(name, difference(values, axis, n, "value", order) / F.lit(dx))


def derivative_by(values: DataFrame, axis: str, n: int, other: str, order: int = 6, name: str = "derivative") -> DataFrame:
    """Derivative of value by another variable along an axis."""
    top, bottom = (difference(values, axis, n, c, order) for c in ("value", other))
    return values.withColumn(name, F.when(bottom != 0, top / bottom))


def gradient(values: DataFrame, n: Sequence[int], dx: Sequence[float], order: int = 6) -> DataFrame:
    return values.withColumns({f"d_{a}": difference(values, a, m, "value", order) / F.lit(d) for a, m, d in zip(AXES, n, dx)})


def divergence(vectors: DataFrame, parts: Sequence[str], n: Sequence[int], dx: Sequence[float], order: int = 6) -> DataFrame:
    terms = [difference(vectors, a, m, p, order) / F.lit(d) for a, p, m, d in zip(AXES, parts, n, dx)]
    return vectors.withColumn("divergence", sum(terms[1:], terms[0]))


def curl(vectors: DataFrame, parts: Sequence[str], n: Sequence[int], dx: Sequence[float], order: int = 6) -> DataFrame:
    """Curl of a vector field; with two components its part along k."""
    d = lambda part, a: difference(vectors, AXES[a], n[a], parts[part], order) / F.lit(dx[a])
    if len(parts) == 2:
        return vectors.withColumn("curl_k", d(1, 0) - d(0, 1))
    return vectors.withColumns(
        {"curl_i": d(2, 1) - d(1, 2), "curl_j": d(0, 2) - d(2, 0), "curl_k": d(1, 0) - d(0, 1)}
    )


def stagger(values: DataFrame, axis: str, n: int) -> DataFrame:
    """n + 1 samples half a cell to each side: mid-points, linear extrapolation at both ends."""
    line, at, v = _line(values, axis), F.col(axis), F.col("value")
    rows = values.withColumns({"_before": F.lag("value").over(line), "_after": F.lead("value").over(line)})
    low = F.when(at == 0, v - (F.col("_after") - v) / 2).otherwise((F.col("_before") + v) / 2)
    shifted = F.array(F.struct(at.alias("a"), low.alias("v")), F.struct((at + 1).alias("a"), (v + (v - F.col("_before")) / 2).alias("v")))
    # A sample gives the place before it; the last one also the place behind it.
    both = F.slice(shifted, 1, F.when(at == n - 1, 2).otherwise(1))
    kept = rows.withColumn("_s", F.explode(both))
    return kept.withColumns({axis: F.col("_s.a"), "value": F.col("_s.v")}).drop("_s", "_before", "_after")


def unstagger(values: DataFrame, axis: str) -> DataFrame:
    """n - 1 means of neighbouring samples."""
    after = F.lead("value").over(_line(values, axis))
    last = F.lead(axis).over(_line(values, axis)).isNull()
    return values.withColumns({"value": (F.col("value") + after) / 2, "_last": last}).where("not _last").drop("_last")


def spline_midpoints(lines):
    """Cubic splines through lines (NumPy, L x n) without knots at the second and last but one sample, half-way between
    samples; lines of less than four samples give means."""
    import numpy as np

    y = np.asarray(lines, float)
    n = y.shape[1]
    middle = (y[:, :-1] + y[:, 1:]) / 2
    if n < 4:
        return middle
    right = 6 * (y[:, :-2] - 2 * y[:, 1:-1] + y[:, 2:])  # of the samples 1 to n - 2
    bend = np.empty_like(y)
    bend[:, 1], bend[:, n - 2] = right[:, 0] / 6, right[:, -1] / 6
    if n > 4:  # a tridiagonal system for those between
        c, d = np.empty(n), np.empty_like(y)
        c[1], d[:, 1] = 0.0, bend[:, 1]
        for k in range(2, n - 2):
            c[k] = 1 / (4 - c[k - 1])
            d[:, k] = (right[:, k - 1] - d[:, k - 1]) * c[k]
        for k in range(n - 3, 1, -1):
            bend[:, k] = d[:, k] - c[k] * bend[:, k + 1]
    bend[:, 0], bend[:, n - 1] = 2 * bend[:, 1] - bend[:, 2], 2 * bend[:, n - 2] - bend[:, n - 3]
    return middle - (bend[:, :-1] + bend[:, 1:]) / 16


def unstagger_spline(values: DataFrame, axis: str) -> DataFrame:
    """n - 1 samples half-way between those of each line, by cubic splines."""
    from .codec import map_lines

    return map_lines(values, axis, spline_midpoints)


def downsample(values: DataFrame, axis: str, n_in: int, n_out: int) -> DataFrame:
    """Linear samples at n_out evenly spread places of an axis of n_in."""
    delta = n_in / n_out
    shift = ((n_in - 1) - delta * (n_out - 1)) / 2
    after = F.lead("value").over(_line(values, axis))
    targets = [(o, int(o * delta + shift), o * delta + shift - int(o * delta + shift)) for o in range(n_out)]
    by_source: dict[int, list[tuple[int, float]]] = {}
    for o, i, w in targets:
        by_source.setdefault(i, []).append((o, w))
    # Samples of one place come from one or more targets: a small map from source index to targets.
    wanted = values.sparkSession.createDataFrame([(i, o, w) for i, group in by_source.items() for o, w in group], "_i int, _o int, _w double")
    paired = values.withColumn("_next", after).join(F.broadcast(wanted), F.col(axis) == F.col("_i"))
    value = F.when(F.col("_w") == 0, F.col("value")).otherwise(F.col("value") * (1 - F.col("_w")) + F.col("_next") * F.col("_w"))
    return paired.withColumns({axis: F.col("_o"), "value": value}).drop("_i", "_o", "_w", "_next")


def decimate(values: DataFrame, factor: int = 2) -> DataFrame:
    """Means of blocks of ``factor`` samples along every axis."""
    axes = [a for a in AXES if a in values.columns]
    others = [c for c in ("ts",) if c in values.columns]
    return values.groupBy(*others, *[F.floor(F.col(a) / factor).cast("int").alias(a) for a in axes]).agg(F.avg("value").alias("value"))


def interpolate_to_level(columns: DataFrame, by: Sequence[str], level: str, pressure: str, value: str, target: float) -> DataFrame:
    """(by, value): the value where ``pressure`` first falls below the target going up;
    the lowest level's own value if that is the first, the top value if none is.

    The share of the way from the crossing level down to the one below it weighs the
    crossing level, as users of this operation expect it, though the other way round
    would be linear interpolation."""
    order = Window.partitionBy(*by).orderBy(level)
    here = columns.withColumns({"_pb": F.lag(pressure).over(order), "_vb": F.lag(value).over(order)})
    ratio = (F.lit(target) - F.col(pressure)) / (F.col("_pb") - F.col(pressure))
    at = F.when(F.col("_pb").isNull(), F.col(value)).otherwise(ratio * F.col(value) + (1 - ratio) * F.col("_vb"))
    crossing = F.min(F.when(F.col(pressure) < target, F.struct(F.col(level), at.alias("v"))))
    return here.groupBy(*by).agg(crossing.alias("_c"), F.max_by(value, level).alias("_top")).select(
        *by, F.when(F.col("_c").isNotNull(), F.col("_c.v")).otherwise(F.col("_top")).alias("value")
    )


def unwrap_longitude(values: DataFrame, by: Sequence[str], order: str, lon: str) -> DataFrame:
    """Longitudes below the first of their line get 360 more."""
    first = F.first(lon).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return values.withColumn(lon, F.when(F.col(lon) < first, F.col(lon) + 360).otherwise(F.col(lon)))


def shift_longitude(lon: Column, bound: float = 180.0) -> Column:
    """A longitude moved by whole turns into (bound - 360, bound]."""
    return lon - F.ceil((lon - F.lit(bound)) / 360) * 360


def boundary(values: DataFrame, n: Sequence[int]) -> DataFrame:
    """The outer ring of a 2-D grid with ``ring``, its order: along row 0, up the last column, back and down."""
    i, j, (ni, nj) = F.col("i"), F.col("j"), n[:2]
    ring = (
        F.when(j == 0, i)
        .when(i == ni - 1, (ni - 1) + j)
        .when(j == nj - 1, (ni - 1) + (nj - 1) + (ni - 1 - i))
        .when(i == 0, 2 * (ni - 1) + (nj - 1) + (nj - 1 - j))
    )
    return values.withColumn("ring", ring.cast("long")).where("ring is not null")


def step_factor(streams: DataFrame, low_degrees: float = 3.0, high_degrees: float = 15.0) -> DataFrame:
    """Step-size factor at each particle from its last three positions: 1.25 if nearly
    straight, 0.5 if the bend is sharp, else 1."""
    import math

    order = Window.partitionBy("stream").orderBy("step")
    coords = [c for c in ("x", "y", "z") if c in streams.columns]
    new = {c: F.col(c) - F.lag(c).over(order) for c in coords}
    old = {c: F.lag(c).over(order) - F.lag(c, 2).over(order) for c in coords}
    dot = sum((new[c] * old[c] for c in coords[1:]), new[coords[0]] * old[coords[0]])
    size = lambda v: F.sqrt(sum((v[c] * v[c] for c in coords[1:]), v[coords[0]] * v[coords[0]]))
    product = size(new) * size(old)
    cosine = dot / product
    factor = (
        F.when(product.isNull() | (product < 1e-7), 1.0)
        .when(cosine > math.cos(math.radians(low_degrees)), 1.25)
        .when(cosine < math.cos(math.radians(high_degrees)), 0.5)
        .otherwise(1.0)
    )
    return streams.withColumn("factor", factor)
