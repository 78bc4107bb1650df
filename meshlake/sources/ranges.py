"""Arrays in files as tables: a Spark data source that reads byte ranges.

An index says where the samples of a variable lie: for each time step a file and an offset,
and for each kind of file the array's shape and element type.  The source plans
partitions of a bounded number of bytes from it (a slab of a large step, or several small
steps) and reads only those bytes.  Filters on ``ts`` and the index columns are taken over
when the plan is made: steps that they exclude are in no partition, and inside a step only rows
of the array that the box meets are read, together with gaps too small for a request of their own.

Files are opened through Arrow's file systems (local, HDFS, S3 and others, by the path's
scheme); no file is read as a whole, so its size doesn't matter.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from ..operators.grid import AXES
from ..plans.scratch import fresh_path, written

#: Bytes of a partition, about; samples that become rows together; bytes that are read rather than skipped.
PARTITION, SLAB, GAP = 64 << 20, 1 << 20, 64 << 10


def open_range(path: str):
    """A file that is open for reads at any place."""
    from pyarrow.fs import FileSystem

    system, inside = FileSystem.from_uri(path)
    return system.open_input_file(inside)


def write_bytes(path: str, data: bytes) -> None:
    from pyarrow.fs import FileSystem

    system, inside = FileSystem.from_uri(path)
    system.create_dir(inside.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(inside) as out:
        out.write(data)


def list_files(spark: SparkSession, path: str | Sequence[str]) -> list[str]:
    """The files that paths, folders and patterns name, in order of their paths."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = set()
    for pattern in [path] if isinstance(path, str) else path:
        target = jvm.org.apache.hadoop.fs.Path(pattern)
        system = target.getFileSystem(conf)
        found = system.globStatus(target) or []
        for status in found:
            inside = system.listStatus(status.getPath()) if status.isDirectory() else [status]
            shown = status.isFile()  # what a pattern names itself counts, hidden or not
            out |= {s.getPath().toString() for s in inside if s.isFile() and (shown or s.getPath().getName()[0] not in "._")}
    if not out:
        raise ValueError(f"no file at {path}")
    return sorted(out)


@dataclass
class Layout:
    """How the samples of one step lie in a file; ``shape`` has the outermost axis first."""

    shape: list[int]
    kind: str
    begin: int
    stride: int = 0  # bytes from one step to the next
    missing: list = field(default_factory=list)
    scale: float = 1.0
    add: float = 0.0

    @property
    def item(self) -> int:
        return np.dtype(self.kind).itemsize

    def clean(self, raw: np.ndarray) -> np.ndarray:
        """Doubles, NaN where missing."""
        out = raw.astype(float)
        for value in self.missing:
            out[raw == np.array(value).astype(raw.dtype)] = np.nan
        return out if (self.scale, self.add) == (1.0, 0.0) else out * self.scale + self.add

    def limits(self, box: dict[str, tuple[int, int]]) -> list[tuple[int, int]] | None:
        """First and last index of each axis, outermost first, inside a box; None if it is empty."""
        out = []
        for n, axis in zip(self.shape, reversed(AXES[: len(self.shape)])):
            lo, hi = box.get(axis, (0, n - 1))
            out.append((max(lo, 0), min(hi, n - 1)))
        return out if all(lo <= hi for lo, hi in out) else None

    def depth(self, limits: Sequence[tuple[int, int]]) -> int:
        """The number of outer axes whose places are rows: up to the last that the box cuts, and until a row is small."""
        cut = [a + 1 for a, (n, (lo, hi)) in enumerate(zip(self.shape, limits)) if lo > 0 or hi < n - 1]
        out = max(cut, default=min(1, len(self.shape)))
        while out < len(self.shape) and math.prod(self.shape[out:]) > SLAB:
            out += 1
        return out


@dataclass
class Piece:
    """Rows ``first`` to ``last``, exclusive, of the array of one step."""

    path: str
    layout: Layout
    ts: int
    local: int
    first: int
    last: int


@dataclass
class Index:
    """Where a variable lies: steps (ts, number of a path, number of a layout, step in that file)."""

    paths: list[str]
    layouts: list[Layout]
    steps: list[tuple[int, int, int, int]]
    timed: bool = True

    @property
    def ndim(self) -> int:
        return len(self.layouts[0].shape)

    def save(self, spark: SparkSession) -> str:
        path = f"{fresh_path(spark, 'index')}/index.json"
        used = sorted({p for _, p, _, _ in self.steps})
        new = {p: n for n, p in enumerate(used)}
        told = {"paths": [self.paths[p] for p in used], "layouts": [asdict(x) for x in self.layouts], "steps": [(t, new[p], w, s) for t, p, w, s in self.steps], "timed": self.timed}
        write_bytes(path, json.dumps(told).encode())
        return path

    @staticmethod
    def load(path: str) -> Index:
        with open_range(path) as file:
            told = json.loads(file.read())
        return Index(told["paths"], [Layout(**x) for x in told["layouts"]], told["steps"], told["timed"])

    def schema(self) -> str:
        return ", ".join([*(["ts int"] if self.timed else []), *[f"{a} int" for a in AXES[: self.ndim]], "value double"])

    def table(self, spark: SparkSession, partition: int = PARTITION) -> DataFrame:
        """The variable's rows (ts, i, j, k, value)."""
        register(spark)
        return spark.read.format(GridRanges.name()).schema(self.schema()).option("index", self.save(spark)).option("bytes", partition).load()


def plan(index: Index, bounds: dict[str, tuple[int, int]], steps: set[int] | None = None, partition: int = PARTITION) -> list[list[Piece]]:
    """Pieces to be read, grouped to partitions; ``bounds`` has the range of ts and of each axis that is asked for."""
    out: list[list[Piece]] = []
    group: list[Piece] = []
    size = 0
    low, high = bounds.get("ts", (None, None))
    for ts, path, which, local in index.steps:
        if index.timed and ((low is not None and not low <= ts <= high) or (steps is not None and ts not in steps)):
            continue
        layout = index.layouts[which]
        limits = layout.limits(bounds)
        if limits is None:
            continue
        outer = layout.depth(limits)
        shape = layout.shape[:outer]
        first = int(np.ravel_multi_index([lo for lo, _ in limits[:outer]], shape)) if shape else 0
        last = int(np.ravel_multi_index([hi for _, hi in limits[:outer]], shape)) + 1 if shape else 1
        row = math.prod(layout.shape[outer:]) * layout.item
        deep = max(1, partition // row)
        for at in range(first, last, deep):
            piece = Piece(index.paths[path], layout, ts, local, at, min(at + deep, last))
            group.append(piece)
            size += (piece.last - piece.first) * row
            if size >= partition:
                out.append(group)
                group, size = [], 0
    return [*out, group] if group else out


def spans(rows: np.ndarray, row: int, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``most`` rows that hold ascending rows of so many bytes, with the gaps that are too small to skip."""
    cuts = np.flatnonzero(np.diff(rows) > 1 + GAP // row) + 1
    for part in np.split(rows, cuts):
        first, last = int(part[0]), int(part[-1]) + 1
        for at in range(first, last, most):
            yield at, min(at + most, last)


def read_piece(file, piece: Piece, box: dict[str, tuple[int, int]]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """(index arrays, i first, and values) of a piece's samples inside a box."""
    layout = piece.layout
    limits = layout.limits(box)
    if limits is None:
        return
    outer = layout.depth(limits)
    inner = math.prod(layout.shape[outer:])
    row = inner * layout.item
    begin = layout.begin + piece.local * layout.stride
    rows = np.arange(piece.first, piece.last)
    if outer:
        places = np.unravel_index(rows, layout.shape[:outer])
        rows = rows[np.logical_and.reduce([(p >= lo) & (p <= hi) for p, (lo, hi) in zip(places, limits)])]
    if not len(rows):
        return
    for first, last in spans(rows, row, max(1, SLAB // inner)):
        data = file.read_at((last - first) * row, begin + first * row)
        if len(data) < (last - first) * row:
            raise ValueError(f"{piece.path} ends before its samples")
        raw = np.frombuffer(data, layout.kind)
        if not layout.shape:
            yield [], layout.clean(raw)
            continue
        at = np.unravel_index(np.arange(first * inner, last * inner), layout.shape)
        keep = np.logical_and.reduce([(p >= lo) & (p <= hi) for p, (lo, hi) in zip(at, limits)])
        if keep.all():
            yield list(at[::-1]), layout.clean(raw)
        elif keep.any():
            yield [p[keep] for p in at[::-1]], layout.clean(raw[keep])


class Slabs(InputPartition):
    """Pieces of one task."""


class RangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.index, self.partition = options["index"], int(options.get("bytes", PARTITION))
        self.bounds: dict[str, tuple[int, int]] = {}
        self.steps: set[int] | None = None

    def _narrow(self, name: str, low: float, high: float) -> None:
        a, b = self.bounds.get(name, (-(1 << 62), 1 << 62))
        self.bounds[name] = (max(a, math.ceil(low)), min(b, math.floor(high)))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of ts and the index columns with numbers; ``In`` lists of indices narrow the box and stay."""
        far = 1 << 62
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            value = getattr(f, "value", None)
            if name != "ts" and name not in AXES:
                yield f
            elif isinstance(f, IsNotNull):
                continue
            elif isinstance(f, In) and f.value and all(isinstance(v, int) for v in f.value):
                self._narrow(name, min(f.value), max(f.value))
                if name == "ts":
                    self.steps = set(f.value) if self.steps is None else self.steps & set(f.value)
                else:
                    yield f
            elif not isinstance(value, int):
                yield f
            elif isinstance(f, EqualTo):
                self._narrow(name, value, value)
            elif isinstance(f, GreaterThanOrEqual):
                self._narrow(name, value, far)
            elif isinstance(f, GreaterThan):
                self._narrow(name, value + 1, far)
            elif isinstance(f, LessThanOrEqual):
                self._narrow(name, -far, value)
            elif isinstance(f, LessThan):
                self._narrow(name, -far, value - 1)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        found = plan(Index.load(self.index), self.bounds, self.steps, self.partition)
        return [Slabs(group) for group in found] or [Slabs([])]

    def read(self, partition: InputPartition):
        import pyarrow as pa

        timed = None
        for piece in partition.value:
            if timed is None:
                timed = piece.ts is not None
            with open_range(piece.path) as file:
                for index, values in read_piece(file, piece, self.bounds):
                    columns = [pa.array(np.full(len(values), piece.ts, np.int32))] if timed else []
                    columns += [pa.array(x.astype(np.int32)) for x in index] + [pa.array(values, from_pandas=True)]
                    names = [*(["ts"] if timed else []), *AXES[: len(index)], "value"]
                    yield pa.RecordBatch.from_arrays(columns, names)


class GridRanges(DataSource):
    """``spark.read.format("grid_ranges")`` with the option ``index``, a file that ``Index.save`` wrote, and ``bytes`` a partition."""

    @classmethod
    def name(cls) -> str:
        return "grid_ranges"

    def schema(self) -> str:
        return Index.load(self.options["index"]).schema()

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the source known to a session and lets Spark hand filters to it."""
    spark.dataSource.register(GridRanges)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_raw(
    spark: SparkSession, files: Sequence[str], n: Sequence[int], kind: str = "<f4", offset: int = 0, missing: Sequence[float] = (), partition: int = PARTITION
) -> DataFrame:
    """(ts, i, j, k, value) of headerless binary volumes, a file for each step in the given order, the first axis fastest."""
    layout = Layout(list(reversed([int(x) for x in n])), kind, offset, 0, list(missing))
    return Index(list(files), [layout], [(t, t, 0, 0) for t in range(len(files))]).table(spark, partition)


#: Samples that are put in a file together.
PART = 1 << 18


class _Stream:
    """A file that is written sample by sample in order, gaps filled; it appears whole under its name or not at all."""

    def __init__(self, system, folder: str, name: str, start: bytes, kind: str, fill: float, count: int):
        import uuid

        self.system, self.path, self.draft = system, f"{folder}/{name}", f"{folder}/_{uuid.uuid4().hex}"
        self.kind, self.fill, self.count, self.done = kind, fill, count, 0
        self.out = system.open_output_stream(self.draft)
        self.out.write(start)

    def skip(self, to: int) -> None:
        while self.done < to:
            n = min(to - self.done, PART)
            self.out.write(np.full(n, self.fill, self.kind).tobytes())
            self.done += n

    def put(self, at: np.ndarray, values: np.ndarray) -> None:
        """Values at ascending places."""
        for first in range(0, len(at), PART):
            a, x = at[first : first + PART], values[first : first + PART]
            for b, y in zip(np.split(a, cuts := np.flatnonzero(np.diff(a) > PART) + 1), np.split(x, cuts)):
                self.skip(int(b[0]))
                part = np.full(int(b[-1]) + 1 - self.done, self.fill, self.kind)
                part[b - self.done] = np.where(np.isnan(y), self.fill, y)
                self.out.write(part.tobytes())
                self.done = int(b[-1]) + 1

    def close(self) -> str:
        self.skip(self.count)
        self.out.close()
        self.system.move(self.draft, self.path)
        return self.path


def write_steps(
    values: DataFrame, folder: str, name: str, n: Sequence[int], kind: str, start: Callable[[int], bytes] = lambda ts: b"", fill: float = math.nan, suffix: str = ".raw"
) -> DataFrame:
    """Writes (ts, i, j, k, value) as binary files of a step each, the first axis fastest, and returns (ts, path).

    ``start`` gives the bytes before a step's samples; missing samples and gaps become ``fill``.
    A task writes the steps that it has, one after the other, as a stream.
    """
    from pyarrow.fs import FileSystem

    system, inside = FileSystem.from_uri(folder)
    system.create_dir(inside, recursive=True)
    count = math.prod(n)

    def run(batches):
        import pyarrow as pa

        store, base = FileSystem.from_uri(folder)
        now, out = None, None
        for batch in batches:
            steps, place = batch.column("_ts").to_numpy(), batch.column("_at").to_numpy()
            value = batch.column("_v").to_numpy(zero_copy_only=False)
            for ts in np.unique(steps).tolist():
                if ts != now:
                    if out is not None:
                        yield pa.RecordBatch.from_pydict({"ts": pa.array([now], pa.int32()), "path": [out.close()]})
                    now, out = ts, _Stream(store, base, f"{name}-{ts:08d}{suffix}", start(ts), kind, fill, count)
                own = steps == ts
                out.put(place[own], value[own])
        if out is not None:
            yield pa.RecordBatch.from_pydict({"ts": pa.array([now], pa.int32()), "path": [out.close()]})

    flat = F.lit(0).cast("long")
    for axis, size in reversed(list(zip(AXES, n))):
        flat = flat * size + F.col(axis)
    step = F.col("ts") if "ts" in values.columns else F.lit(0)
    rows = values.select(step.cast("int").alias("_ts"), flat.alias("_at"), F.col("value").cast("double").alias("_v"))
    return written(rows.repartition("_ts").sortWithinPartitions("_ts", "_at").mapInArrow(run, "ts int, path string"), "files")


def write_raw(values: DataFrame, folder: str, name: str, n: Sequence[int], kind: str = "<f4") -> DataFrame:
    """A region as raw binary files, one for each step; ``n`` are the lengths of its axes, whose first indices are 0."""
    return write_steps(values, folder, name, n, kind)
