"""Classic NetCDF files (versions 1, 2 and 5 of the format) as tables.

Headers and time coordinates are read in a Spark job, a few kilobytes of each file; samples
come from the byte-range source (``ranges``), so that a request reads the variable, steps and
rows that it asks for, whatever the files' size.

Conventions: the last dimension is axis i, the one before it j, then k; ``_FillValue`` and
``missing_value`` are null; ``scale_factor`` and ``add_offset`` are applied.

Several files make one series.  A time dimension is the record dimension or one whose
variable has units of time since a date; the series' steps are the distinct times of all files
in order, and a step is served by the first file, in order of paths, that has the variable at
that time.  Without a time coordinate the files' steps follow each other in that order; without
a time dimension a variable of several files has a step for each of them.  Variables without time
come from the first file that has them, and exist at all steps.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from datetime import datetime, timedelta, timezone

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.atmosphere import terrain_elevation
from ..operators import mesh as faces
from ..plans.catalog import Dataset, Mesh, Variable
from ..plans.scratch import written
from .ranges import PARTITION, Index, Layout, list_files, open_range, write_steps
from .tables import write_variable

# Fixed values of the file format: type numbers and list tags.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
#: Bytes that are read for a header at first.
HEADER = 16 << 10


@dataclass
class Stored:
    """A variable of a file: dimensions, element type, first byte, whether it has a sample a record."""

    dims: list[str]
    shape: list[int]
    kind: str
    begin: int
    record: bool
    attributes: dict = field(default_factory=dict)

    def record_bytes(self) -> int:
        size = int(np.prod(self.shape[1:] if self.record else self.shape, dtype=np.int64)) * np.dtype(self.kind).itemsize
        return size + -size % 4


class Header:
    """What a file holds; ``data`` must reach to the end of its header."""

    def __init__(self, data: bytes):
        if data[:3] != b"CDF" or data[3] not in (1, 2, 5):
            raise ValueError("not a classic NetCDF file")
        self._data, self._at, version = data, 4, data[3]
        self._count = ">q" if version == 5 else ">i"
        self.records = self._number(self._count)
        self.dims = dict(self._list(DIMENSIONS, lambda: (self._name(), self._number(self._count))))
        names = list(self.dims)
        self.attributes = dict(self._list(ATTRIBUTES, self._attribute))

        def variable() -> tuple[str, Stored]:
            name = self._name()
            dims = [names[self._number(self._count)] for _ in range(self._number(self._count))]
            attributes = dict(self._list(ATTRIBUTES, self._attribute))
            kind = TYPES[self._number(">i")]
            self._number(self._count)  # the size, which overflows for large variables
            begin = self._number(">i" if version == 1 else ">q")
            record = bool(dims) and self.dims[dims[0]] == 0
            shape = [self.records if self.dims[d] == 0 else self.dims[d] for d in dims]
            return name, Stored(dims, shape, kind, begin, record, attributes)

        self.variables: dict[str, Stored] = dict(self._list(VARIABLES, variable))
        own = [v for v in self.variables.values() if v.record]
        self.stride = sum(v.record_bytes() for v in own)
        if len(own) == 1:  # a single record variable isn't padded
            v = own[0]
            self.stride = int(np.prod(v.shape[1:], dtype=np.int64)) * np.dtype(v.kind).itemsize

    def _number(self, kind: str) -> int:
        (value,) = struct.unpack_from(kind, self._data, self._at)
        self._at += struct.calcsize(kind)
        return value

    def _bytes(self, n: int) -> bytes:
        out = self._data[self._at : self._at + n]
        self._at += n + -n % 4
        return out

    def _name(self) -> str:
        return self._bytes(self._number(self._count)).decode()

    def _list(self, tag: int, item) -> list:
        found, n = self._number(">i"), self._number(self._count)
        if found not in (0, tag):
            raise ValueError("the header is damaged")
        return [item() for _ in range(n)]

    def _attribute(self) -> tuple[str, object]:
        name, kind = self._name(), TYPES[self._number(">i")]
        n = self._number(self._count)
        raw = self._bytes(n * np.dtype(kind).itemsize)
        if kind == "S1":
            return name, raw.rstrip(b"\0").decode()
        values = np.frombuffer(raw, kind).tolist()
        return name, values[0] if n == 1 else values

    def layout(self, name: str, timed: bool) -> Layout:
        """Where the samples lie; of one step at a time if the first dimension is ``timed``."""
        v = self.variables[name]
        said = [v.attributes[x] for x in ("_FillValue", "missing_value") if x in v.attributes and not isinstance(v.attributes[x], str)]
        missing = [y for x in said for y in (x if isinstance(x, list) else [x])]
        shape = [int(n) for n in (v.shape[1:] if timed else v.shape)]
        stride = 0
        if timed:
            stride = self.stride if v.record else int(np.prod(shape, dtype=np.int64)) * np.dtype(v.kind).itemsize
        return Layout(shape, v.kind, v.begin, stride, missing, float(v.attributes.get("scale_factor", 1.0)), float(v.attributes.get("add_offset", 0.0)))


def read_header(file) -> Header:
    """The header of an open file, from as few bytes as hold it."""
    size, n = file.size(), HEADER
    while True:
        try:
            header = Header(file.read_at(min(n, size), 0))
            break
        except (struct.error, UnicodeDecodeError, IndexError):
            if n >= size:
                raise ValueError("the header is damaged") from None
            n *= 4
    own = [v for v in header.variables.values() if v.record]
    if header.records < 0 and own and header.stride:  # written as a stream: the size tells
        header.records = (size - min(v.begin for v in own)) // header.stride
        for v in own:
            v.shape[0] = header.records
    return header


def time_variables(header: Header) -> dict[str, str]:
    """The time dimensions of a file with the variable that has their times ("" if none)."""
    out = {v.dims[0]: "" for v in header.variables.values() if v.record}
    for name, v in header.variables.items():
        units = str(v.attributes.get("units", ""))
        if len(v.dims) == 1 and " since " in units and (name == v.dims[0] or not out.get(v.dims[0])):
            out[v.dims[0]] = name
        elif len(v.dims) == 2 and v.kind == "S1" and name in TIME_TEXTS and not out.get(v.dims[0]):
            out[v.dims[0]] = name
    for d in out:
        if not out[d] and d in header.variables and header.variables[d].kind != "S1" and header.variables[d].dims == [d]:
            out[d] = d
    return out


#: Variables whose text is the time of each record.
TIME_TEXTS = ("Times", "xtime")
_DATE = re.compile(r"\s*([+-]?\d+)-(\d+)-(\d+)(?:[T_ ]+(\d+):(\d+)(?::(\d+(?:\.\d*)?))?)?")
_DAY = re.compile(r"\s*(\d+)-(\d{3})_(\d+):(\d+):(\d+)")


def _epoch(year: int, month: int, day: int, hour: int, minute: int, second: float) -> float:
    shift = 400 * (1 + (1 - year) // 400) if year < 1 else 0  # the calendar repeats after 400 years
    at = datetime(year + shift, month, 1, tzinfo=timezone.utc) + timedelta(days=day - 1, hours=hour, minutes=minute, seconds=second)
    return (at - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() - shift // 400 * 146097 * 86400.0


def epoch_of(text: str) -> float | None:
    """Epoch seconds of ``2001-02-03 04:05:06`` and its shorter forms, or of ``2001-034_04:05:06``."""
    by_day = _DAY.match(text)
    if by_day:
        y, d, h, m, s = map(int, by_day.groups())
        return _epoch(y, 1, d, h, m, s)
    found = _DATE.match(text)
    if not found:
        return None
    y, mo, d, h, m, s = found.groups()
    return _epoch(int(y), int(mo), int(d), int(h or 0), int(m or 0), float(s or 0))


def seconds_of(values: Sequence[float], units: str) -> list[float]:
    """Epoch seconds of numbers in ``<unit> since <date>``; other numbers stay."""
    unit, _, start = units.partition(" since ")
    origin = epoch_of(start) if start else None
    if origin is None:
        return [float(v) for v in values]
    unit = unit if unit in scalar.UNITS else f"{unit}s"
    if unit not in scalar.UNITS or scalar.UNITS[unit][0] != "time":
        raise ValueError(f"not a time unit: {units}")
    return [float(v) * scalar.UNITS[unit][1] + origin for v in values]


def _whole(file, header: Header, name: str) -> np.ndarray:
    """A small variable, its records together."""
    v = header.variables[name]
    layout = header.layout(name, v.record)
    n = int(np.prod(layout.shape, dtype=np.int64))
    parts = [np.frombuffer(file.read_at(n * layout.item, layout.begin + r * layout.stride), v.kind) for r in range(header.records if v.record else 1)]
    return (np.concatenate(parts) if parts else np.zeros(0, v.kind)).reshape([header.records if v.record else 1, *layout.shape] if v.record else layout.shape)


def facts(path: str) -> dict:
    """What a file says of itself, and its times by time dimension (None: unknown)."""
    with open_range(path) as file:
        header = read_header(file)
        times: dict[str, list[float] | None] = {}
        for d, name in time_variables(header).items():
            if not name:
                times[d] = None
                continue
            raw = _whole(file, header, name)
            if raw.dtype.kind == "S":
                texts = [b"".join(row.tolist()).decode(errors="replace").strip("\0 ") for row in raw]
                found = [epoch_of(t) for t in texts]
                times[d] = None if None in found else found
            else:
                v = header.variables[name]
                times[d] = seconds_of(header.layout(name, v.record).clean(raw).ravel().tolist(), str(v.attributes.get("units", "")))
    lengths = {d: header.records if n == 0 else n for d, n in header.dims.items()}
    kinds = {n: asdict(v) for n, v in header.variables.items()}
    for v in kinds.values():  # the number of records is the file's, not the kind's
        v["shape"] = v["shape"][1:] if v["record"] else v["shape"]
    return {"kind": json.dumps([kinds, header.stride, header.attributes, header.dims]), "lengths": json.dumps(lengths), "times": json.dumps(times)}


def scan(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(path, kind, lengths, times), texts in JSON, of the files that ``path`` names: a few bytes of each are read."""
    paths = list_files(spark, path)
    parts = max(1, min(len(paths), 4 * spark.sparkContext.defaultParallelism))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for one in batch.column("path").to_pylist():
                yield pa.RecordBatch.from_pylist([{"path": one} | facts(one)])

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(parts).mapInArrow(run, "path string, kind string, lengths string, times string")


@dataclass
class File:
    path: str
    kind: int  # which of the collection's headers
    lengths: dict[str, int]
    times: dict[str, list[float] | None]


class Collection:
    """The metadata of some files: a header for each kind of file, and for each file its path, lengths and times."""

    def __init__(self, spark: SparkSession, path: str | Sequence[str]):
        self.spark, self.path = spark, path
        rows = written(scan(spark, path), "headers")
        # One row for each kind of file, and a short one for each file.
        kinds = {r["id"]: r["kind"] for r in rows.select(F.sha2("kind", 256).alias("id"), "kind").distinct().collect()}
        number = {k: n for n, k in enumerate(sorted(kinds))}
        self.kinds = [json.loads(kinds[k]) for k in sorted(kinds)]
        found = rows.select("path", F.sha2("kind", 256).alias("id"), "lengths", "times").collect()
        self.files = sorted((File(r["path"], number[r["id"]], json.loads(r["lengths"]), json.loads(r["times"])) for r in found), key=lambda f: f.path)
        self.variables: dict[str, Stored] = {}
        for f in self.files:
            for name, v in self.kinds[f.kind][0].items():
                self.variables.setdefault(name, Stored(**v))
        offsets: dict[str, int] = {}
        self._times: list[dict[str, list[float]]] = []
        timed = any(f.times for f in self.files)
        for f in self.files:
            own = {}
            for d, known in f.times.items():
                n = f.lengths[d]
                own[d] = known if known is not None else [float(offsets.get(d, 0) + t) for t in range(n)]
                offsets[d] = offsets.get(d, 0) + n
            self._times.append(own)
        self.by_file = not timed and len(self.files) > 1
        if self.by_file:
            many = max(sum(name in self.kinds[f.kind][0] for f in self.files) for name in self.variables)
            self.times = [float(n) for n in range(many)]
        else:
            self.times = sorted({t for own in self._times for times in own.values() for t in times}) or [0.0]

    def time_dimension(self, name: str) -> str | None:
        """The time dimension of a variable, which must be its first."""
        dims = self.variables[name].dims
        return dims[0] if dims and any(dims[0] in f.times for f in self.files) else None

    def time_coordinate(self) -> str | None:
        """The name of the variable that has the times."""
        for f in self.files:
            for d in f.times:
                for name, v in self.variables.items():
                    if v.dims and v.dims[0] == d and (name == d or " since " in str(v.attributes.get("units", "")) or name in TIME_TEXTS):
                        return name
        return None

    def varies(self, name: str) -> bool:
        if self.by_file:
            return sum(name in self.kinds[f.kind][0] for f in self.files) > 1
        return self.time_dimension(name) is not None

    def steps(self, name: str) -> list[tuple[int, int, int]]:
        """(step, number of a file, step in that file) of a variable, a row for each step at which it exists."""
        own = [n for n, f in enumerate(self.files) if name in self.kinds[f.kind][0]]
        if not self.varies(name):
            return [(0, own[0], 0)]
        if self.by_file:
            return [(ts, n, 0) for ts, n in enumerate(own)]
        number = {t: ts for ts, t in enumerate(self.times)}
        out: dict[int, tuple[int, int]] = {}
        for n in own:
            dims = self.kinds[self.files[n].kind][0][name]["dims"]
            for local, t in enumerate(self._times[n].get(dims[0], [])):
                out.setdefault(number[t], (n, local))
        return [(ts, n, local) for ts, (n, local) in sorted(out.items())]

    def local_step(self, name: str, ts: int) -> tuple[int, int]:
        """The file and step there that serve a step of the series, the nearest end of the variable's own beyond them."""
        steps = self.steps(name)
        at = min(max(ts, steps[0][0]), steps[-1][0])
        last = max(s for s in steps if s[0] <= at)
        return last[1], last[2]

    def step_range(self, path_number: int) -> tuple[int, int] | None:
        """First and last step of the series that lie in a file's times; None without times."""
        number = {t: ts for ts, t in enumerate(self.times)}
        own = [number[t] for times in self._times[path_number].values() for t in times]
        return (min(own), max(own)) if own else None

    def index(self, name: str) -> Index:
        timed = self.varies(name)
        layouts: list[Layout] = []
        of_kind: dict[tuple, int] = {}
        steps = []
        for ts, n, local in self.steps(name):
            f = self.files[n]
            own = Stored(**self.kinds[f.kind][0][name])
            own.shape = [f.lengths[d] for d in own.dims]
            key = (f.kind, tuple(own.shape[1:] if timed and not self.by_file else own.shape))
            if key not in of_kind:
                of_kind[key] = len(layouts)
                header = object.__new__(Header)
                header.variables, header.stride = {name: own}, self.kinds[f.kind][1]
                layout = header.layout(name, timed and not self.by_file)
                if own.record and not timed:
                    raise ValueError(f"{name} has records without time")
                layouts.append(layout)
            steps.append((ts if timed else None, n, of_kind[key], local))
        return Index([f.path for f in self.files], layouts, steps, timed)

    def table(self, name: str, partition: int = PARTITION) -> DataFrame:
        """(ts, i, j, k, value) of a variable; without ts if it has no time."""
        return self.index(name).table(self.spark, partition)

    def sizes(self, name: str) -> dict[str, int]:
        """The lengths of a variable's dimensions in the first file that has it, outermost first, time left out."""
        first = next(f for f in self.files if name in self.kinds[f.kind][0])
        time = self.time_dimension(name)
        return {d: first.lengths[d] for d in self.variables[name].dims if d != time}

    def numeric(self, name: str) -> bool:
        return self.variables[name].kind != "S1"


def describe(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(path, name, dims, shape, record, attributes) of the variables of some files, from their headers."""
    stored = "struct<dims:array<string>,shape:array<long>,kind:string,begin:long,record:boolean,attributes:map<string,string>>"
    rows = scan(spark, path).select("path", F.from_json(F.get_json_object("kind", "$[0]"), f"map<string,{stored}>").alias("v"), F.from_json("lengths", "map<string,long>").alias("n"))
    rows = rows.select("path", "n", F.explode("v").alias("name", "v"))
    return rows.select("path", "name", "v.dims", F.transform("v.dims", lambda d: F.col("n")[d]).alias("shape"), "v.record", "v.attributes")


def axis_of(attributes: dict) -> int | None:
    """0, 1 or 2 for a longitude or x, latitude or y, and vertical coordinate by its attributes."""
    units, axis, name = (str(attributes.get(x, "")) for x in ("units", "axis", "standard_name"))
    if axis.upper() in ("X", "Y", "Z"):
        return "XYZ".index(axis.upper())
    if units in scalar.LONGITUDE_UNITS or name in ("longitude", "projection_x_coordinate", "grid_longitude"):
        return 0
    if units in scalar.LATITUDE_UNITS or name in ("latitude", "projection_y_coordinate", "grid_latitude"):
        return 1
    if str(attributes.get("positive", "")).lower() in ("up", "down") or name in ("height", "altitude", "depth", "air_pressure"):
        return 2
    return None


def coordinates_of(files: Collection, name: str) -> tuple[str, ...]:
    """The coordinates of a variable, by axis: those of its dimensions' names, and before them those that its
    ``coordinates`` attribute lists and whose dimensions it has."""
    v, time = files.variables[name], files.time_dimension(name)
    dims = [d for d in v.dims if d != time][::-1]
    chosen: dict[int, str] = {}
    for n, d in enumerate(dims):
        if d in files.variables and files.variables[d].dims == [d]:
            own = axis_of(files.variables[d].attributes)
            chosen[n if own is None or own in chosen else own] = d
    for c in str(v.attributes.get("coordinates", "")).split():
        if c in files.variables and files.numeric(c):
            own = axis_of(files.variables[c].attributes)
            if own is not None and set(files.variables[c].dims) - {files.time_dimension(c)} <= set(dims) and own < len(dims):
                chosen[own] = c
    return tuple(chosen[n] for n in sorted(chosen))


def _add(out: Dataset, files: Collection, name: str, mesh: str, kind: str, **more) -> None:
    v = files.variables[name]
    told = {k: x for k, x in v.attributes.items()}
    out.add_variable(Variable(name, mesh, units=str(told.get("units", "")), time_varying=files.varies(name), kind=kind, attributes=told, **more), lambda: files.table(name))


def _open(spark: SparkSession, path: str | Sequence[str]) -> tuple[Dataset, Collection]:
    files = Collection(spark, path)
    out = Dataset(spark, str(path))
    out.times, out.time_coordinate = files.times, files.time_coordinate()
    for f in reversed(files.files):
        out.dimensions |= {d: n for d, n in f.lengths.items() if d not in f.times}
    return out, files


def _structured(out: Dataset, files: Collection, names: Sequence[str], coordinates: dict[str, tuple[str, ...]]) -> None:
    """Adds variables with a mesh for each set of dimensions and coordinates."""
    used = {c for own in coordinates.values() for c in own}
    for name in names:
        dims = tuple(reversed(files.sizes(name)))
        own = tuple(c for c in coordinates[name] if c != name)
        mesh = "_".join(dims) or "point"
        if mesh in out.meshes and out.meshes[mesh].coordinates != own and not set(own) <= set(out.meshes[mesh].coordinates):
            mesh += "__" + "_".join(own)
        if mesh not in out.meshes:
            out.add_mesh(Mesh(mesh, dims, own), files.sizes(name))
        kind = "coordinate" if name in used or name in files.variables[name].dims or name == out.time_coordinate else "data"
        _add(out, files, name, mesh, kind)


def open_cf(spark: SparkSession, path: str | Sequence[str]) -> Dataset:
    """A dataset of files that follow the climate conventions.

    Dimensions, meshes and variables are those of all files together.  Coordinates are
    found by name, and by the ``coordinates`` attribute; text variables are left out.
    """
    out, files = _open(spark, path)
    names = sorted((n for n in files.variables if files.numeric(n)), key=lambda n: -len(files.variables[n].dims))
    _structured(out, files, names, {n: coordinates_of(files, n) for n in names})
    return out


def open_ugrid(spark: SparkSession, path: str | Sequence[str]) -> Dataset:
    """A dataset of files with meshes by the conventions for unstructured grids.

    ``Dataset.faces`` has (face, slot, node) of each mesh: numbers from 0, missing nodes and those
    more than 180 degrees of longitude from the face's first valid one are -2.
    """
    out, files = _open(spark, path)
    topologies = {n: v.attributes for n, v in files.variables.items() if v.attributes.get("cf_role") == "mesh_topology"}
    taken: dict[str, str] = {}
    for name, told in topologies.items():
        nodes = str(told.get("node_coordinates", "")).split()
        connect = str(told.get("face_node_connectivity", ""))
        if connect not in files.variables or not all(n in files.variables for n in nodes):
            raise ValueError(f"the mesh {name} lacks its nodes or faces")
        by_axis = sorted(nodes, key=lambda n: (axis_of(files.variables[n].attributes) is None, axis_of(files.variables[n].attributes) or 0))
        out.add_mesh(Mesh(name, tuple(files.sizes(by_axis[0])), tuple(by_axis), "unstructured", connect), files.sizes(by_axis[0]))
        start = int(files.variables[connect].attributes.get("start_index", 0))
        lon = files.table(by_axis[0]).select(F.col("i").cast("long").alias("node"), F.col("value").alias("x"))
        slots = files.table(connect).select(F.col("j").cast("long").alias("face"), F.col("i").alias("slot"), (F.col("value") - start).cast("long").alias("node"))
        out.faces[name] = faces.cut_at_date_line(slots.withColumn("node", F.coalesce("node", F.lit(-2))), lon, 180.0)
        for n in [*nodes, connect]:
            taken[n] = name
        for n in nodes:
            _add(out, files, n, name, "coordinate")
        for n, v in files.variables.items():
            if n not in taken and files.numeric(n) and (v.attributes.get("mesh") == name or v.dims[-1:] == list(files.sizes(by_axis[0]))) and v.attributes.get("location", "node") == "node":
                taken[n] = name
                _add(out, files, n, name, "data")
    rest = [n for n in files.variables if n not in taken and n not in topologies and files.numeric(n)]
    _structured(out, files, rest, {n: coordinates_of(files, n) for n in rest})
    return out


def open_mpas(spark: SparkSession, path: str | Sequence[str]) -> Dataset:
    """A dataset of files of a model on Voronoi cells: the mesh ``primal`` has cells as faces and their corners as
    nodes, ``dual`` has triangles of cell centres.  Longitudes and latitudes become degrees, from -180 to 180.

    ``Dataset.faces`` has numbers from 0; slots beyond a cell's edges are -1, members more than 90
    degrees of longitude from the first -2, as are all of a face with a 0.
    """
    out, files = _open(spark, path)
    turn = 180.0 / np.pi
    west = lambda c: F.when(c > 180.0, c - 360.0).otherwise(c)
    members = {"primal": ("nVertices", "Vertex", "verticesOnCell"), "dual": ("nCells", "Cell", "cellsOnVertex")}
    taken: set[str] = set()
    for mesh, (dim, who, connect) in members.items():
        if connect not in files.variables or f"lon{who}" not in files.variables:
            continue
        taken |= {f"lon{who}", f"lat{who}", connect}
        out.add_mesh(Mesh(mesh, (dim,), (f"lon{who}", f"lat{who}"), "unstructured", connect), {dim: out.dimensions[dim]})
        for n in (f"lon{who}", f"lat{who}"):
            degrees = F.col("value") * turn
            table = files.table(n).withColumn("value", west(degrees) if n[:3] == "lon" else degrees)
            out.add_variable(Variable(n, mesh, "coordinate", "degrees_east" if n[:3] == "lon" else "degrees_north"), table)
        slots = files.table(connect).select((F.col("j")).cast("long").alias("face"), F.col("i").alias("slot"), F.col("value").cast("long").alias("node"))
        if mesh == "primal" and "nEdgesOnCell" in files.variables:
            counts = files.table("nEdgesOnCell").select(F.col("i").cast("long").alias("face"), F.col("value").cast("int").alias("n_nodes"))
        else:
            counts = slots.groupBy("face").agg((F.max("slot") + 1).alias("n_nodes"))
        lon = files.table(f"lon{who}").select(F.col("i").cast("long").alias("node"), west(F.col("value") * turn).alias("x"))
        out.faces[mesh] = faces.cut_at_date_line(faces.one_based(slots, counts), lon, 90.0)
    for n, v in files.variables.items():
        own = [d for d in v.dims if d != files.time_dimension(n)]
        mesh = next((m for m, (dim, _, _) in members.items() if m in out.meshes and dim in own), None)
        if n in taken or not files.numeric(n):
            continue
        if mesh and own == [members[mesh][0]]:
            taken.add(n)
            _add(out, files, n, mesh, "data")
        elif mesh and len(own) == 2 and own[0] == members[mesh][0] and own[1].startswith("nVertLevels"):
            taken.add(n)
            if f"{mesh}_{own[1]}" not in out.meshes:
                out.add_mesh(Mesh(f"{mesh}_{own[1]}", (own[1], own[0]), out.meshes[mesh].coordinates, "unstructured", out.meshes[mesh].faces), {d: out.dimensions[d] for d in own})
                out.faces[f"{mesh}_{own[1]}"] = out.faces[mesh]
            _add(out, files, n, f"{mesh}_{own[1]}", "data")
    rest = [n for n in files.variables if n not in taken and files.numeric(n)]
    _structured(out, files, rest, {n: () for n in rest})
    return out


def open_wrf(spark: SparkSession, path: str | Sequence[str]) -> Dataset:
    """A dataset of files of the regional weather model with staggered axes.

    Horizontal coordinates are ``XLONG`` and ``XLAT`` at the first step; for staggered axes
    (``_U``, ``_V``) they are the files' own or mid-points of these, extended at the ends.  Heights are made
    from the geopotential, ``PH`` and ``PHB``: ``ElevationW`` on its own levels, ``Elevation`` half-way between them, and from
    that ``ElevationU`` and ``ElevationV`` on the staggered axes.
    """
    from ..operators import stencil

    out, files = _open(spark, path)

    def flat(name: str) -> DataFrame:
        table = files.table(name)
        return table.where("ts = 0").drop("ts") if "ts" in table.columns else table

    places: dict[tuple[str, ...], tuple[str, ...]] = {}
    have = {"XLONG", "XLAT"} <= set(files.variables)
    if have:
        sizes = files.sizes("XLONG")
        for tail, axis, dims in (("", None, ("west_east", "south_north")), ("_U", "i", ("west_east_stag", "south_north")), ("_V", "j", ("west_east", "south_north_stag"))):
            if not set(dims) <= set(out.dimensions):
                continue
            mesh = "_".join(dims)
            out.add_mesh(Mesh(mesh, dims, (f"XLONG{tail}", f"XLAT{tail}")), {d: out.dimensions[d] for d in dims})
            places[dims] = out.meshes[mesh].coordinates
            for base, unit in (("XLONG", "degrees_east"), ("XLAT", "degrees_north")):
                own = f"{base}{tail}"
                if own in files.variables:
                    make = lambda own=own: flat(own)
                else:
                    n = sizes["west_east" if axis == "i" else "south_north"]
                    make = lambda base=base, axis=axis, n=n: stencil.stagger(flat(base), axis, n)
                out.add_variable(Variable(own, mesh, "coordinate", unit, derived=own not in files.variables), make)
    for n in files.variables:
        if not files.numeric(n) or n in out.variables:
            continue
        dims = tuple(reversed(files.sizes(n)))
        mesh = "_".join(dims) or "point"
        if mesh not in out.meshes:
            out.add_mesh(Mesh(mesh, dims, places.get(dims[:2], ())), files.sizes(n))
        _add(out, files, n, mesh, "data")
    if {"PH", "PHB"} <= set(files.variables):
        _elevations(out, files)
    return out


def _elevations(out: Dataset, files: Collection) -> None:
    from ..operators import stencil

    i, j, k = reversed(files.sizes("PH"))
    half = k.removesuffix("_stag")

    def upper() -> DataFrame:
        keys = [c for c in ("ts", *"ijk") if c in files.table("PH").columns]
        both = files.table("PH").join(files.table("PHB").withColumnRenamed("value", "_base"), keys)
        return both.select(*keys, terrain_elevation(F.col("value"), F.col("_base")).alias("value"))

    middle = lambda: stencil.unstagger(upper(), "k")
    made = {
        "ElevationW": ((i, j, k), upper), "Elevation": ((i, j, half), middle),
        "ElevationU": ((f"{i}_stag", j, half), lambda: stencil.stagger(middle(), "i", out.dimensions[i])),
        "ElevationV": ((i, f"{j}_stag", half), lambda: stencil.stagger(middle(), "j", out.dimensions[j])),
    }
    for name, (dims, make) in made.items():
        if set(dims) <= set(out.dimensions):
            mesh = "_".join(dims)
            if mesh not in out.meshes:
                out.add_mesh(Mesh(mesh, dims), {d: out.dimensions[d] for d in dims})
            out.add_variable(Variable(name, mesh, "coordinate", "m", files.varies("PH"), derived=True, inputs=("PH", "PHB")), make)


def convert(spark: SparkSession, path: str | Sequence[str], target: str, blocks: int = 64, opened=open_cf) -> list[str]:
    """Writes every data variable of the files to the native store; their names.  A second run gives the same store."""
    data = opened(spark, path)
    names = data.names()
    for name in names:
        write_variable(data.table(name), f"{target}/{name}", blocks)
    return names


# Writing


def encode_header(version: int, dims: dict[str, int], records: int, variables: Sequence[tuple[str, Sequence[str], str, dict, int]], attributes: dict) -> bytes:
    """The header of a file; variables are (name, dimensions, element type, attributes, first byte)."""
    count = ">q" if version == 5 else ">i"
    numbers = {v: k for k, v in TYPES.items()}

    def number(n: int) -> bytes:
        return struct.pack(count, n)

    def padded(b: bytes) -> bytes:
        return b + b"\0" * (-len(b) % 4)

    def name(text: str) -> bytes:
        return number(len(text.encode())) + padded(text.encode())

    def listed(tag: int, items: Sequence[bytes]) -> bytes:
        return struct.pack(">i", tag if items else 0) + number(len(items)) + b"".join(items)

    def attribute(key: str, value) -> bytes:
        if isinstance(value, str):
            return name(key) + struct.pack(">i", 2) + number(len(value.encode())) + padded(value.encode())
        data = np.atleast_1d(np.array(value, ">f8"))
        return name(key) + struct.pack(">i", 6) + number(len(data)) + data.tobytes()

    order = list(dims)
    made = []
    for own, own_dims, kind, told, begin in variables:
        shape = [dims[d] or 1 for d in own_dims]
        size = min(int(np.prod(shape, dtype=np.int64)) * np.dtype(kind).itemsize, (1 << 31) - 4)
        size += -size % 4
        body = name(own) + number(len(own_dims)) + b"".join(number(order.index(d)) for d in own_dims) + listed(ATTRIBUTES, [attribute(k, v) for k, v in told.items()])
        made.append(body + struct.pack(">i", numbers[kind]) + number(size) + struct.pack(">i" if version == 1 else ">q", begin))
    parts = [listed(DIMENSIONS, [name(d) + number(n) for d, n in dims.items()]), listed(ATTRIBUTES, [attribute(k, v) for k, v in attributes.items()]), listed(VARIABLES, made)]
    return b"CDF" + bytes([version]) + number(records) + b"".join(parts)


#: Fixed value: what stands for a missing sample in files that don't say otherwise.
FILL = 9.969209968386869e36


def write_files(
    values: DataFrame, folder: str, name: str, sizes: dict[str, int], times: Sequence[float], units: str = "seconds since 1970-01-01 00:00:00",
    coordinates: dict[str, tuple[Sequence[float], dict]] | None = None, attributes: dict | None = None, kind: str = ">f8",
) -> DataFrame:
    """Writes (ts, i, j, k, value) as files of one step each, and returns (ts, path) of them.

    ``sizes`` are the dimensions, axis i first, ``coordinates`` values and attributes of some of
    them.  A task writes the steps that it has, in order and as a stream; gaps become missing.
    """
    dims = {"time": 0, **dict(reversed(list(sizes.items())))}
    shape = list(dims.values())[1:]
    count = int(np.prod(shape, dtype=np.int64))
    told = {"_FillValue": FILL} | (attributes or {})
    fixed = [(c, np.asarray(v, ">f8"), more) for c, (v, more) in (coordinates or {}).items()]
    version = 5 if count * np.dtype(kind).itemsize >= 1 << 31 else 2

    def head(time_begin: int, begins: Sequence[int], begin: int) -> bytes:
        variables = [(c, [c], ">f8", more, at) for (c, _, more), at in zip(fixed, begins)]
        variables += [("time", ["time"], ">f8", {"units": units}, time_begin), (name, list(dims), kind, told, begin)]
        return encode_header(version, dims, 1, variables, {})

    size = len(head(0, [0] * len(fixed), 0))
    begins, at = [], size
    for _, v, _ in fixed:
        begins.append(at)
        at += v.nbytes
    start = head(at, begins, at + 8) + b"".join(v.tobytes() for _, v, _ in fixed)
    every = np.asarray(times, ">f8")
    return write_steps(values, folder, name, list(sizes.values()), kind, lambda ts: start + every[ts : ts + 1].tobytes(), FILL, ".nc")
