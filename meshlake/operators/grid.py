"""Grid tables and the geometry of their indices.

A variable on a grid is a table with a row for each sample: index columns
``i``, ``j``, ``k`` (those the grid has), optionally ``ts``, and ``value`` (null where
missing).  Geometry is an expression over the index columns, so filters on
coordinates become filters on indices and reach the scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("i", "j", "k")
COORDS = ("x", "y", "z")


@dataclass(frozen=True)
class RegularGrid:
    """Uniform axes: ``n`` samples from ``low`` to ``high`` each; one sample sits at ``low``."""

    n: tuple[int, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]

    @property
    def axes(self) -> tuple[str, ...]:
        return AXES[: len(self.n)]

    @property
    def coords(self) -> tuple[str, ...]:
        return COORDS[: len(self.n)]

    def delta(self, axis: int) -> float:
        return (self.high[axis] - self.low[axis]) / (self.n[axis] - 1) if self.n[axis] > 1 else 0.0

    def coordinate(self, axis: int) -> Column:
        return F.lit(self.low[axis]) + F.col(AXES[axis]) * F.lit(self.delta(axis))

    def with_coordinates(self, values: DataFrame) -> DataFrame:
        """Adds x, y, z of every index."""
        return values.withColumns({COORDS[a]: self.coordinate(a) for a in range(len(self.n))})

    def offset(self, axis: int, coord: Column) -> Column:
        """Place along the axis in cells."""
        d = self.delta(axis)
        return (coord - F.lit(self.low[axis])) / F.lit(d) if d else F.lit(0.0)

    def cell(self, axis: int, coord: Column) -> Column:
        """Index of the cell that holds a coordinate; the last node belongs to the last cell."""
        return F.least(F.floor(self.offset(axis, coord)), F.lit(max(self.n[axis] - 2, 0))).cast("int")

    def inside(self) -> Column:
        tests = [F.col(c).between(lo, hi) for c, lo, hi in zip(self.coords, self.low, self.high)]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out

    def wrap(self, axis: int, coord: Column) -> Column:
        """A coordinate of a periodic axis moved inside by whole spans; the upper end stays."""
        lo, hi = self.low[axis], self.high[axis]
        if self.n[axis] == 1 or hi <= lo:
            return F.lit(lo)
        span = hi - lo
        return (
            F.when(coord < lo, coord + F.ceil((F.lit(lo) - coord) / span) * span)
            .when(coord > hi, coord - F.ceil((coord - F.lit(hi)) / span) * span)
            .otherwise(coord)
        )

    def index_box(self, box: Sequence[tuple[float, float]], halo: int = 0) -> list[tuple[int, int]]:
        """Indices that a coordinate box covers, widened by ``halo`` cells for interpolation."""
        import math

        out = []
        for a, (lo, hi) in enumerate(box):
            d = self.delta(a) or 1.0
            first = math.ceil((lo - self.low[a]) / d - 1e-12) - halo
            last = math.floor((hi - self.low[a]) / d + 1e-12) + halo
            out.append((max(first, 0), min(last, self.n[a] - 1)))
        return out


def from_arrays(rows: DataFrame, row: str, array: str) -> DataFrame:
    """A 2-D grid from rows that hold a line of samples: i along the array, j the row's number."""
    return rows.select(F.col(row).cast("long").alias("j"), F.posexplode(array).alias("i", "_v")).select(
        "i", "j", F.col("_v").cast("double").alias("value")
    )


def missing_to_null(values: DataFrame, sentinel: float) -> DataFrame:
    """A sentinel for missing samples, and NaN, become null."""
    v = F.col("value")
    return values.withColumn("value", F.when((v != F.lit(sentinel)) & ~F.isnan(v), v))


def subset(values: DataFrame, box: Sequence[tuple[int, int]]) -> DataFrame:
    """Samples of an index box, ends included and clamped by the data."""
    for axis, (lo, hi) in zip(AXES, box):
        values = values.where(F.col(axis).between(lo, hi))
    return values


def block_superset(values: DataFrame, box: Sequence[tuple[int, int]], block: int) -> DataFrame:
    """The blocks that touch an index box, whole."""
    return subset(values, [(lo // block * block, hi // block * block + block - 1) for lo, hi in box])


def block_extents(values: DataFrame, block: int) -> DataFrame:
    """Range of values and number of present samples of every block."""
    axes = [a for a in AXES if a in values.columns]
    keys = [F.floor(F.col(a) / block).cast("int").alias(f"b{a}") for a in axes]
    return values.groupBy(*keys).agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.count("value").alias("n_present")
    )


def stride(values: DataFrame, step: int) -> DataFrame:
    """Every step-th sample along each axis."""
    for axis in (a for a in AXES if a in values.columns):
        values = values.where(F.col(axis) % step == 0)
    return values


def cell_corners(values: DataFrame, grid: RegularGrid) -> DataFrame:
    """One row for each cell and corner: cell indices ``ci``, ``cj``, ``ck``, corner number and value.

    A sample is emitted to the cells around it, so no join is needed.
    """
    dims = [a for a in range(len(grid.n)) if grid.n[a] > 1]
    corners = []
    for number in range(1 << len(dims)):
        shift = {a: number >> bit & 1 for bit, a in enumerate(dims)}
        corners.append(
            F.struct(
                F.lit(number).alias("corner"),
                *[(F.col(AXES[a]) - shift.get(a, 0)).cast("int").alias(f"c{AXES[a]}") for a in range(len(grid.n))],
            )
        )
    out = values.withColumn("_c", F.explode(F.array(*corners)))
    for a in range(len(grid.n)):
        out = out.where(F.col(f"_c.c{AXES[a]}").between(0, max(grid.n[a] - 2, 0)))
    return out.select("_c.*", "value")


def cells_in_box(values: DataFrame, grid: RegularGrid, box: Sequence[tuple[int, int]]) -> DataFrame:
    """Cells with all corners in an index box."""
    inside = F.lit(True)
    for axis, (lo, hi) in zip(grid.axes, box):
        inside = inside & F.col(axis).between(lo, hi)
    flagged = cell_corners(values.withColumn("value", inside), grid)
    keys = [f"c{a}" for a in grid.axes]
    return flagged.groupBy(*keys).agg(F.bool_and("value").alias("all_in")).where("all_in").select(*keys)


def neighbours(cells: DataFrame, grid: RegularGrid) -> DataFrame:
    """Cells that share a side: (ci, cj, ..., ni, nj, ...)."""
    steps = [(a, d) for a in range(len(grid.n)) for d in (-1, 1)]
    moved = [
        F.struct(*[(F.col(f"c{x}") + (d if AXES[a] == x else 0)).cast("int").alias(f"n{x}") for x in grid.axes])
        for a, d in steps
    ]
    out = cells.withColumn("_n", F.explode(F.array(*moved))).select(*[f"c{x}" for x in grid.axes], "_n.*")
    for a, x in enumerate(grid.axes):
        out = out.where(F.col(f"n{x}").between(0, max(grid.n[a] - 2, 0)))
    return out
