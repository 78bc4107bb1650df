"""The native store by level and detail: wavelet coefficients of blocks, in Parquet.

A variable is cut in blocks; each is decomposed (``lifting``) in a task, and its coefficients are ranked by
size.  ``ratios`` say how many are kept up to each detail number: a block's size by the ratio.
A row has the coefficients of one block that share a level and a detail number, as arrays of places (ascending, as gaps)
and values.  Rows are partitioned by step, detail and level and sorted by block, so a request for a level,
a detail and a box reads a prefix of the partitions and skips row groups of other blocks.  A
request shuffles just the coefficients it reads, to put each block's together.

Blocks at the end of an axis are continued by reflection before they are decomposed, and cut afterwards.
Missing samples are replaced by the block's mean; a bit map beside the approximation says where they were.
A sample of a coarser level is missing where all samples that it stands for are.

Writing a step again replaces it.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lifting
from ..operators.grid import AXES
from ..plans.catalog import Dataset, Mesh, Variable, length_at_level, normal_level
from . import netcdf
from .ranges import list_files, open_range, write_bytes

META = "_meta.json"


@dataclass
class Layout:
    """Lengths of the axes (i first), of a block along each, the wavelet, its steps, and the ratios by detail; and
    the names of the dimensions, the times and the attributes that the variable came with."""

    n: list[int]
    block: int = 64
    family: str = "bior2.2"
    steps: int = 2
    ratios: tuple[int, ...] = (500, 100, 10, 1)
    dims: tuple[str, ...] = ()
    times: tuple[float, ...] = ()
    attributes: dict = field(default_factory=dict)

    def __post_init__(self):
        self.n, self.ratios = [int(x) for x in self.n], tuple(self.ratios)
        self.dims, self.times = tuple(self.dims or [f"n{a}" for a in AXES[: len(self.n)]]), tuple(self.times)
        if self.steps > lifting.max_steps(self.block, self.family):
            raise ValueError(f"{self.steps} steps are too many for blocks of {self.block} samples")
        if list(self.ratios) != sorted(self.ratios, reverse=True) or min(self.ratios) < 1:
            raise ValueError("ratios go from coarse to fine")

    @property
    def shape(self) -> tuple[int, ...]:
        """Of a block, outermost axis first; axes of a single sample have blocks of one."""
        return tuple(self.block if n > 1 else 1 for n in reversed(self.n))

    @property
    def axes(self) -> list[str]:
        return list(AXES[: len(self.n)])

    def size_at(self, axis: int, block: int, down: int) -> int:
        """Samples of a block along an axis (i is 0), ``down`` steps below the best."""
        n = self.n[axis]
        if n == 1:
            return 1
        if block < n // self.block:
            return max(1, -(-self.block // (1 << down)))
        return max(n % self.block >> down, 1 if n < self.block else 0)

    def at_level(self, down: int) -> tuple[int, ...]:
        """Lengths of all axes."""
        return tuple(length_at_level(n, self.block, down) for n in self.n)


def _bands(layout: Layout, approximations: int, details: int) -> list[int]:
    """How many of a block's details, by rank, are in each detail number and those before."""
    total = approximations + details
    return [min(details, max(0, -(-total // r) - approximations)) for r in layout.ratios]


def encode(block: np.ndarray, layout: Layout) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(level, lod, places, values) of a whole block without missing samples."""
    levels = lifting.decompose(block, layout.family, layout.steps)
    level = np.repeat(np.arange(len(levels)), [len(x) for x in levels])[len(levels[0]) :]
    place = np.concatenate([np.arange(len(x)) for x in levels[1:]] or [np.zeros(0, int)])
    value = np.concatenate([*levels[1:], np.zeros(0)])
    order = np.argsort(-np.abs(value), kind="stable")  # ties by level and place
    bounds = _bands(layout, len(levels[0]), len(value))
    lod = np.full(len(value), -1)
    start = 0
    for number, end in enumerate(bounds):
        lod[order[start:end]] = number
        start = max(start, end)
    out = [(0, 0, np.arange(len(levels[0])), levels[0].astype(float))]
    for number in range(len(bounds)):
        for lv in range(1, len(levels)):
            own = (lod == number) & (level == lv)
            if own.any():
                out.append((lv, number, place[own], value[own].astype(float)))
    return out


def decode(parts: Sequence[tuple[int, np.ndarray, np.ndarray]], layout: Layout, upto: int) -> np.ndarray:
    """A block's samples at a level from some of its (level, places, values)."""
    sizes = lifting.shapes(layout.shape, layout.steps)
    counts = [math.prod(sizes[-1])] + [math.prod(sizes[layout.steps - lv]) - math.prod(sizes[layout.steps - lv + 1]) for lv in range(1, upto + 1)]
    levels = [np.zeros(c) for c in counts]
    for level, places, values in parts:
        levels[level][places] = values
    return lifting.reconstruct(levels, layout.shape, layout.family, layout.steps, upto)


def _coarse_holes(holes: np.ndarray, down: int) -> np.ndarray:
    """Where all samples that one stands for are missing."""
    for axis in range(holes.ndim):
        for _ in range(down):
            if holes.shape[axis] % 2:
                last = np.take(holes, [-1], axis)
                holes = np.concatenate([holes, last], axis)
            pairs = np.moveaxis(holes, axis, -1)
            holes = np.moveaxis(pairs[..., ::2] & pairs[..., 1::2], -1, axis)
    return holes


def _blocks_of(layout: Layout, block: Sequence[int]) -> list[np.ndarray]:
    """The sample at each place of a block along each axis, outermost first, reflected beyond the end."""
    out = []
    for axis in reversed(range(len(layout.n))):
        n, first = layout.n[axis], block[axis] * layout.block
        size = layout.block if n > 1 else 1
        own = min(n - first, size)
        at = np.arange(size) % (2 * own)
        out.append(np.where(at < own, at, 2 * own - 1 - at))
    return out


def write(values: DataFrame, path: str, layout: Layout) -> None:
    """(ts, i, j, k, value) as a store; a table without ts is step 0.  Samples that the table lacks count as missing."""
    axes, shape = layout.axes, layout.shape
    write_bytes(f"{path}/{META}", json.dumps(asdict(layout)).encode())
    keys = [f"b{a}" for a in axes]
    table = values if "ts" in values.columns else values.withColumn("ts", F.lit(0))
    cut = table.select(F.col("ts").cast("int").alias("ts"), *[F.floor(F.col(a) / layout.block).cast("int").alias(k) for a, k in zip(axes, keys)], *[(F.col(a) % layout.block).cast("int").alias(a) for a in axes], F.col("value").cast("double").alias("value"))

    def run(key, group):
        import pyarrow as pa

        ts, *block = (k.as_py() for k in key)
        raw = np.full(shape, np.nan)
        raw[tuple(group.column(a).to_numpy() for a in reversed(axes))] = group.column("value").to_numpy()
        raw = raw[np.ix_(*_blocks_of(layout, block))]
        holes = np.isnan(raw)
        if holes.all():
            raw = np.zeros(shape)
        elif holes.any():
            raw = np.where(holes, np.nanmean(raw), raw)
        rows = {"ts": [], "lod": [], "level": [], **{k: [] for k in keys}, "places": [], "coefficients": [], "holes": []}
        for level, lod, places, coefficients in encode(raw, layout):
            for name, x in (("ts", ts), ("lod", lod), ("level", level), *zip(keys, block)):
                rows[name].append(x)
            rows["places"].append(np.diff(places, prepend=-1).astype(np.int32))
            rows["coefficients"].append(coefficients)
            rows["holes"].append(np.packbits(holes).tobytes() if level == 0 and holes.any() else None)
        kinds = [pa.int32()] * (3 + len(keys)) + [pa.list_(pa.int32()), pa.list_(pa.float64()), pa.binary()]
        return pa.table([pa.array(v, k) for v, k in zip(rows.values(), kinds)], names=list(rows))

    schema = ", ".join([f"{c} int" for c in ("ts", "lod", "level", *keys)]) + ", places array<int>, coefficients array<double>, holes binary"
    rows = cut.groupBy("ts", *keys).applyInArrow(run, schema)
    order = ["ts", "lod", "level", *keys]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ts", "lod", "level").parquet(f"{path}/data")


def layout_of(path: str) -> Layout:
    with open_range(f"{path}/{META}") as file:
        return Layout(**json.loads(file.read()))


def coefficients(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows: ts, lod, level, blocks, places as gaps, coefficients, holes."""
    return spark.read.parquet(f"{path}/data")


def read(
    spark: SparkSession, path: str, ts: int | None = None, level: int = -1, lod: int = -1, box: Sequence[tuple[int, int]] | None = None
) -> DataFrame:
    """(ts, i, j, k, value) at a level and detail (-1 the best, or from 0, the coarsest), cut to a box of that level's indices."""
    layout = layout_of(path)
    upto = layout.steps + 1 + normal_level(level, layout.steps + 1)
    detail = len(layout.ratios) + normal_level(lod, len(layout.ratios))
    down, axes, keys = layout.steps - upto, layout.axes, [f"b{a}" for a in layout.axes]
    rows = coefficients(spark, path).where((F.col("level") <= upto) & (F.col("lod") <= detail))
    if ts is not None:
        rows = rows.where(F.col("ts") == ts)
    step = max(1, -(-layout.block // (1 << down)))  # samples of a whole block at this level
    for (lo, hi), key, n in zip(box or (), keys, layout.n):
        last = max(0, (n - 1) // layout.block)
        rows = rows.where(F.col(key).between(min(lo // step, last), min(max(hi, 0) // step, last)))
    part = F.struct("level", "places", "coefficients")
    grouped = rows.groupBy("ts", *keys).agg(F.collect_list(part).alias("parts"), F.max("holes").alias("holes"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                block = [batch.column(k)[row].as_py() for k in keys]
                parts = batch.column("parts")[row].values
                places, values = parts.field("places"), parts.field("coefficients")
                own = [
                    (lv, np.cumsum(places[n].values.to_numpy(zero_copy_only=False)) - 1, values[n].values.to_numpy(zero_copy_only=False))
                    for n, lv in enumerate(parts.field("level").to_pylist())
                ]
                samples = decode(own, layout, upto)
                packed = batch.column("holes")[row].as_py()
                if packed is not None:
                    holes = np.unpackbits(np.frombuffer(packed, np.uint8))[: math.prod(layout.shape)].reshape(layout.shape).astype(bool)
                    samples = np.where(_coarse_holes(holes, down), np.nan, samples)
                sizes = [layout.size_at(a, block[a], down) for a in reversed(range(len(axes)))]
                samples = samples[tuple(slice(0, s) for s in sizes)]
                index = [x.ravel() for x in np.indices(samples.shape)][::-1]
                index = [x + b * (step if n > 1 else 1) for x, b, n in zip(index, block, layout.n)]
                value = samples.ravel().astype(float)
                if box is not None:
                    keep = np.logical_and.reduce([(x >= lo) & (x <= hi) for x, (lo, hi) in zip(index, box)])
                    index, value = [x[keep] for x in index], value[keep]
                columns = [pa.array(np.full(len(value), batch.column("ts")[row].as_py(), np.int32))] + [pa.array(x.astype(np.int32)) for x in index]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(value, from_pandas=True)], ["ts", *axes, "value"])

    return grouped.mapInArrow(run, f"ts int, {', '.join(f'{a} int' for a in axes)}, value double")


def open_store(spark: SparkSession, path: str) -> Dataset:
    """A dataset of all variables that were written below a folder, each at its levels and details."""
    out = Dataset(spark, path)
    metas = list_files(spark, f"{path}/*/{META}")
    found = {m.rsplit("/", 2)[1]: layout_of(m.rsplit("/", 1)[0]) for m in metas}
    out.times = sorted({t for layout in found.values() for t in layout.times}) or [0.0]
    for name, layout in found.items():
        mesh = "_".join(layout.dims)
        out.add_mesh(Mesh(mesh, layout.dims, layout.dims), dict(zip(layout.dims, layout.n)))
        told = dict(layout.attributes)
        out.add_progressive(Variable(name, mesh, units=str(told.get("units", "")), time_varying=len(layout.times) > 1, attributes=told), f"{path}/{name}")
    return out


def from_files(spark: SparkSession, path: str | Sequence[str], target: str, opened=netcdf.open_cf, **options) -> list[str]:
    """Writes every data variable with axes of NetCDF files to stores below a folder; their names.  ``options`` go to the layout."""
    data = opened(spark, path)
    names = [n for n in data.names() if data.topology(n)]
    for name in names:
        v = data.variables[name]
        dims = data.meshes[v.mesh].dimensions
        times = data.times if v.time_varying else data.times[:1]
        layout = Layout([data.dimensions[d] for d in dims], dims=dims, times=times, attributes={k: x for k, x in v.attributes.items() if k not in ("_FillValue", "missing_value", "scale_factor", "add_offset")}, **options)
        write(data.table(name), f"{target}/{name}", layout)
    return names


def to_files(spark: SparkSession, path: str, folder: str, name: str, level: int = -1, lod: int = -1, units: str = "seconds since 1970-01-01 00:00:00") -> DataFrame:
    """Writes a stored variable at a level and detail as NetCDF files, one for each step; (ts, path)."""
    layout = layout_of(path)
    down = -1 - normal_level(level, layout.steps + 1)
    sizes = dict(zip(layout.dims, layout.at_level(down)))
    told = {k: x for k, x in layout.attributes.items() if isinstance(x, (str, int, float))}
    return netcdf.write_files(read(spark, path, None, level, lod), folder, name, sizes, layout.times or [0.0], units, attributes=told)


def to_raw(spark: SparkSession, path: str, folder: str, name: str, level: int = -1, lod: int = -1, box: Sequence[tuple[int, int]] | None = None, kind: str = "<f4") -> DataFrame:
    """Writes a region of a stored variable at a level and detail as raw binary, one file for each step; (ts, path)."""
    from .ranges import write_raw

    layout = layout_of(path)
    n = layout.at_level(-1 - normal_level(level, layout.steps + 1))
    box = [(max(lo, 0), min(hi, m - 1)) for (lo, hi), m in zip(box or [(0, m - 1) for m in n], n)]
    rows = read(spark, path, None, level, lod, box)
    rows = rows.withColumns({a: F.col(a) - lo for a, (lo, _) in zip(layout.axes, box)})
    return write_raw(rows, folder, name, [hi - lo + 1 for lo, hi in box], kind)
