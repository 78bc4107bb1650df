"""Datasets: metadata of dimensions, meshes and variables, and requests for variables.

Metadata is small and lives on the driver; it is offered as DataFrames too.  A request
is a lazy DataFrame: time step and box become filters on the variable's table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import AXES, RegularGrid, block_superset, subset

GRID_TYPES = ("regular", "stretched", "layered", "curvilinear", "unstructured 2d", "unstructured layered", "unstructured 3d")


@dataclass
class Variable:
    name: str
    mesh: str
    kind: str = "data"  # data, coordinate or auxiliary
    units: str = ""
    time_varying: bool = False
    axis: int | None = None
    uniform: bool = True
    levels: int = 1
    block: int = 64  # samples of a block of the native store along each axis
    ratios: tuple[int, ...] = (1,)
    attributes: dict = field(default_factory=dict)
    inputs: tuple[str, ...] = ()
    derived: bool = False


@dataclass
class Mesh:
    name: str
    dimensions: tuple[str, ...]
    coordinates: tuple[str, ...] = ()
    kind: str = "structured"
    faces: str | None = None


def grid_type(coordinates: Sequence[tuple[int, bool]], mesh: str = "structured") -> str:
    """Grid type from each coordinate's number of dimensions and uniformity."""
    if mesh == "unstructured":
        return "unstructured layered" if any(n == 2 for n, _ in coordinates) and len(coordinates) == 3 else "unstructured 2d"
    if all(n == 1 for n, _ in coordinates):
        return "regular" if all(u for _, u in coordinates) else "stretched"
    x, y, *z = [n for n, _ in coordinates]
    if x == y == 1 and z and z[0] == 3:
        return "layered"
    if x == y == 2:
        return "curvilinear"
    return "unstructured 3d"


def is_uniform(axis: Sequence[float], tolerance: float = 1e-4) -> bool:
    """Whether neighbouring steps of an axis agree."""
    steps = [b - a for a, b in zip(axis, axis[1:])]
    return all(abs(a - b) <= tolerance * max(abs(a), abs(b)) for a, b in zip(steps, steps[1:]))


def normal_level(level: int, n: int) -> int:
    """A level or detail number as a negative one, -1 the best; clamped."""
    if level >= 0:
        level = min(level, n - 1) - n
    return max(min(level, -1), -n)


def length_at_level(n: int, block: int, down: int) -> int:
    """Samples of an axis ``down`` levels below the best, whole blocks and the rest halved apart (``codec.dims_at_level``)."""
    return max(1, n // block * max(1, -(-block // (1 << down))) + (n % block >> down))


class Dataset:
    def __init__(self, spark: SparkSession, name: str = "data"):
        self.spark, self.name = spark, name
        self.dimensions: dict[str, int] = {}
        self.meshes: dict[str, Mesh] = {}
        self.variables: dict[str, Variable] = {}
        self.times: list[float] = [0.0]
        self.time_coordinate: str | None = None
        self.faces: dict[str, DataFrame] = {}  # (face, slot, node) of unstructured meshes
        self._tables: dict[str, DataFrame | Callable[[], DataFrame]] = {}
        self._derived: dict[str, Callable[[Dataset], DataFrame]] = {}
        self._regional: dict[str, Callable[..., DataFrame]] = {}
        self.attributes: dict = {}
        self._progressive: dict[str, Callable[..., DataFrame]] = {}
        self._ranges: dict = {}
        self._stored: dict[str, set] = {}

    # Definition

    def add_mesh(self, mesh: Mesh, sizes: dict[str, int]) -> None:
        self.dimensions |= sizes
        self.meshes[mesh.name] = mesh

    def add_variable(self, variable: Variable, table: DataFrame | Callable[[], DataFrame], available: Sequence[tuple[int, int, int]] | None = None) -> None:
        """``table`` has index columns, value and, if time-varying, ts, or makes such a table when it is asked for
        first; ``available`` lists the (ts, level, detail) that are stored (None: all)."""
        if variable.mesh not in self.meshes:
            raise ValueError(f"unknown mesh {variable.mesh}")
        self.variables[variable.name] = variable
        self._tables[variable.name] = table
        if available is not None:
            self._stored[variable.name] = set(available)

    def add_progressive(self, variable: Variable, path: str, available: Sequence[tuple[int, int, int]] | None = None) -> None:
        """A variable of the store by level and detail (``sources.progressive``), whose levels and ratios it takes."""
        from ..sources import progressive

        layout = progressive.layout_of(path)
        variable.levels, variable.ratios, variable.block = layout.steps + 1, layout.ratios, layout.block
        self._progressive[variable.name] = lambda ts, level, lod, box: progressive.read(self.spark, path, ts, level, lod, box)
        self.add_variable(variable, lambda: progressive.read(self.spark, path), available)

    def table(self, name: str) -> DataFrame:
        """All samples of a variable, at the best level and detail."""
        if name in self._derived:
            return self._derived[name](self)
        if not isinstance(self._tables[name], DataFrame):
            self._tables[name] = self._tables[name]()
        return self._tables[name]

    def add_derived(self, variable: Variable, make: Callable[[Dataset], DataFrame]) -> None:
        """A variable that is made from others when it is read."""
        variable.derived = True
        self.variables[variable.name] = variable
        self._derived[variable.name] = make

    def add_regional(self, name: str, make: Callable[[int, Sequence[tuple[int, int]] | None], DataFrame]) -> None:
        """How a part of a derived variable, a step and a box, is made from parts of its inputs."""
        self._regional[name] = make

    def remove_derived(self, name: str) -> None:
        if name in self._derived:
            del self._derived[name], self.variables[name]
            self._regional.pop(name, None)

    # Attributes

    def attribute(self, name: str, key: str):
        """An attribute of a variable, or of the dataset for an empty name; None if there is none."""
        return (self.variables[name].attributes if name else self.attributes).get(key)

    def put_attribute(self, name: str, key: str, value) -> None:
        (self.variables[name].attributes if name else self.attributes)[key] = value

    def copy_attributes(self, source: Dataset, name: str) -> None:
        """Takes a variable's attributes from another dataset, all of the same name included, or the dataset's own for an empty name."""
        own = self.variables[name].attributes if name else self.attributes
        own |= source.variables[name].attributes if name else source.attributes

    def attribute_table(self) -> DataFrame:
        """(variable, key, value) of all attributes, the dataset's own with an empty name."""
        rows = [("", k, str(v)) for k, v in self.attributes.items()]
        rows += [(n, k, str(x)) for n, v in self.variables.items() for k, x in v.attributes.items()]
        return self.spark.createDataFrame(rows, "variable string, key string, value string")

    # Metadata

    def names(self, kind: str = "data", ndim: int | None = None) -> list[str]:
        return sorted(v.name for v in self.variables.values() if v.kind == kind and ndim in (None, self.topology(v.name)))

    def topology(self, name: str) -> int:
        return len(self.meshes[self.variables[name].mesh].dimensions)

    def geometry(self, name: str) -> int:
        return len(self.meshes[self.variables[name].mesh].coordinates)

    def shape(self, name: str, level: int = -1) -> tuple[int, ...]:
        v = self.variables[name]
        down = -1 - normal_level(level, v.levels)
        return tuple(length_at_level(self.dimensions[d], v.block, down) for d in self.meshes[v.mesh].dimensions)

    def inputs(self, name: str) -> list[str]:
        """All variables that one depends on, itself last."""
        seen: list[str] = []

        def visit(n: str) -> None:
            if n in seen:
                return
            v = self.variables[n]
            for m in (*v.inputs, *self.meshes[v.mesh].coordinates):
                if m in self.variables and m != n:
                    visit(m)
            seen.append(n)

        visit(name)
        return seen

    def exists(self, name: str, ts: int = 0, level: int = -1, lod: int = -1) -> bool:
        """Whether a variable and all it needs are stored at a step, level and detail."""
        if name not in self.variables:
            return False
        for n in self.inputs(name):
            v = self.variables[n]
            step = ts if v.time_varying else 0
            if v.time_varying and not 0 <= ts < len(self.times):
                return False
            stored = self._stored.get(n)
            if stored is not None and (step, normal_level(level, v.levels), normal_level(lod, len(v.ratios))) not in stored:
                return False
        return True

    def first(self, ndim: int) -> tuple[int, str] | None:
        """First step and name of an existing variable of so many dimensions."""
        for ts in range(len(self.times)):
            for n in self.names(ndim=ndim):
                if self.exists(n, ts):
                    return ts, n
        return None

    def common_accuracy(self, names: Sequence[str], ts: int, level: int = -1, lod: int = -1) -> tuple[int, int]:
        """The best level and detail, no better than asked, at which all variables exist."""
        for lv in range(normal_level(level, 99), -100, -1):
            for ld in range(normal_level(lod, 99), -100, -1):
                if all(self.exists(n, ts, lv, ld) and -lv <= self.variables[n].levels and -ld <= len(self.variables[n].ratios) for n in names):
                    return lv, ld
        raise ValueError("the variables have no accuracy in common")

    def describe(self) -> DataFrame:
        """One row for each variable."""
        rows = [
            (v.name, v.kind, v.mesh, v.units, v.time_varying, v.derived, self.topology(v.name), self.geometry(v.name), v.levels, list(v.ratios), list(self.shape(v.name)), {k: str(x) for k, x in v.attributes.items()})
            for v in self.variables.values()
        ]
        schema = "name string, kind string, mesh string, units string, time_varying boolean, derived boolean, topology int, geometry int, levels int, ratios array<int>, shape array<int>, attributes map<string,string>"
        return self.spark.createDataFrame(rows, schema)

    def dimension_table(self) -> DataFrame:
        return self.spark.createDataFrame(list(self.dimensions.items()), "name string, length int")

    def mesh_table(self) -> DataFrame:
        rows = [(m.name, m.kind, list(m.dimensions), list(m.coordinates)) for m in self.meshes.values()]
        return self.spark.createDataFrame(rows, "name string, kind string, dimensions array<string>, coordinates array<string>")

    # Requests

    def variable(
        self, name: str, ts: int = 0, box: Sequence[tuple[int, int]] | None = None, exact: bool = True, block: int = 64, level: int = -1, lod: int = -1
    ) -> DataFrame:
        """A variable at a step, level and detail, cut to an index box of that level (or the blocks that touch it).

        Variables of the store by level and detail read only what these need; others have one of each.
        """
        v = self.variables[name]
        if name in self._progressive:
            step = ts if v.time_varying else 0
            if not self.exists(name, ts, level, lod):
                raise ValueError(f"{name} isn't stored at step {ts}, level {level}, detail {lod}")
            wide = box if exact or box is None else [(lo // block * block, hi // block * block + block - 1) for lo, hi in box]
            return self._progressive[name](step, level, lod, wide)
        if box is not None and name in self._regional:
            wide = box if exact else [(lo // block * block, hi // block * block + block - 1) for lo, hi in box]
            table = self._regional[name](ts, wide)
        else:
            table = self.table(name)
        if v.time_varying and "ts" in table.columns:
            table = table.where(F.col("ts") == ts)
        if box is not None:
            table = subset(table, box) if exact else block_superset(table, box, block)
        return table

    def steps(self, name: str, first: int, last: int) -> range:
        """The steps that a statistic over first to last has to read: one for a variable that doesn't vary."""
        return range(first, last + 1) if self.variables[name].time_varying else range(first, first + 1)

    def hyper_slices(self, name: str, ts: int = 0) -> Iterator[tuple[int, DataFrame]]:
        """A variable slice by slice along its last axis, each a request of its own."""
        shape, axes = self.shape(name), AXES[: self.topology(name)]
        for n in range(shape[-1]):
            yield n, self.variable(name, ts).where(F.col(axes[-1]) == n)

    def sliced(self, name: str, ts: int = 0) -> DataFrame:
        """A variable spread by slices along its last axis, each slice in one task and in order: one job serves all slices."""
        axes = AXES[: self.topology(name)]
        return self.variable(name, ts).repartition(axes[-1]).sortWithinPartitions(*reversed(axes))

    def together(self, names: Sequence[str], ts: int = 0, box=None) -> DataFrame:
        """Variables on one mesh side by side, a column each."""
        if len({self.variables[n].mesh for n in names}) > 1:
            raise ValueError("the variables are on different meshes")
        axes = list(AXES[: self.topology(names[0])])
        out = None
        for n in names:
            one = self.variable(n, ts, box).select(*axes, F.col("value").alias(n))
            out = one if out is None else out.join(one, axes)
        return out

    def data_range(self, name: str, ts: int = 0, box=None) -> tuple[float | None, float | None]:
        """Least and largest present value; remembered."""
        key = (name, ts, tuple(map(tuple, box)) if box else None)
        if key not in self._ranges:
            self._ranges[key] = tuple(self.variable(name, ts, box).agg(F.min("value"), F.max("value")).first())
        return self._ranges[key]


def open_dataset(spark: SparkSession, path: str, name: str, grid: RegularGrid, ratios: Sequence[int] = (1,)) -> Dataset:
    """A dataset of one variable of the native store on a regular grid."""
    from ..sources.tables import read_variable

    out = Dataset(spark, path)
    dims = {f"n{a}": n for a, n in zip(grid.axes, grid.n)}
    out.add_mesh(Mesh("grid", tuple(dims), grid.coords), dims)
    table = read_variable(spark, path)
    steps = [r[0] for r in table.select("ts").distinct().orderBy("ts").collect()]
    out.times = [float(s) for s in steps]
    out.add_variable(Variable(name, "grid", time_varying=len(steps) > 1, ratios=tuple(ratios)), table)
    return out
