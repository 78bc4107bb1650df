"""Classic NetCDF files against the arrays that were put in."""

import struct

import numpy as np
import pytest

from meshlake.plans.scratch import fresh_path
from meshlake.sources import netcdf, ranges, tables

NUMBERS = {np.dtype(v).str: k for k, v in netcdf.TYPES.items()}


def encoded(version, dims, records, variables, attributes):
    """A file: dims {name: length}, variables [(name, dims, array, attributes)]; the first dimension may be records (0)."""
    count = ">q" if version == 5 else ">i"
    n = lambda x: struct.pack(count, x)
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    name = lambda s: n(len(s.encode())) + pad(s.encode())

    def attrs(found):
        out = struct.pack(">i", 12 if found else 0) + n(len(found))
        for k, v in found.items():
            if isinstance(v, str):
                out += name(k) + struct.pack(">i", 2) + n(len(v)) + pad(v.encode())
            else:
                a = np.atleast_1d(np.array(v, ">f8"))
                out += name(k) + struct.pack(">i", 6) + n(len(a)) + a.tobytes()
        return out

    def head(begins):
        out = b"CDF" + bytes([version]) + n(records) + struct.pack(">i", 10) + n(len(dims))
        out += b"".join(name(k) + n(v) for k, v in dims.items()) + attrs(attributes) + struct.pack(">i", 11) + n(len(variables))
        for (k, d, a, more), begin in zip(variables, begins):
            out += name(k) + n(len(d)) + b"".join(n(list(dims).index(x)) for x in d) + attrs(more)
            out += struct.pack(">i", NUMBERS[a.dtype.newbyteorder(">").str]) + n(0) + struct.pack(">i" if version == 1 else ">q", begin)
        return out

    big = lambda a: np.array(a).astype(a.dtype.newbyteorder(">")).tobytes()
    in_records = [bool(d) and dims[d[0]] == 0 for _, d, _, _ in variables]
    begins, body, at = [0] * len(variables), b"", len(head([0] * len(variables)))
    for i, (_, _, a, _) in enumerate(variables):
        if not in_records[i]:
            begins[i] = at + len(body)
            body += pad(big(a))
    single = sum(in_records) == 1
    offset = at + len(body)
    for i, (_, _, a, _) in enumerate(variables):
        if in_records[i]:
            begins[i] = offset
            offset += len(big(a[0])) if single else len(pad(big(a[0])))
    for r in range(records):
        for i, (_, _, a, _) in enumerate(variables):
            if in_records[i]:
                body += big(a[r]) if single else pad(big(a[r]))
    return head(begins) + body


@pytest.fixture(scope="module")
def series(tmp_path_factory):
    """Two files of two and one steps, later times first."""
    folder, rng = tmp_path_factory.mktemp("nc"), np.random.default_rng(1)
    lat, lon = np.linspace(10, 20, 3).astype("f4"), np.linspace(0, 30, 4)
    parts = {}
    for file, (version, times) in {"a.nc": (1, [48.0]), "b.nc": (5, [0.0, 24.0])}.items():
        t2 = rng.integers(-300, 300, (len(times), 3, 4)).astype("i2")
        t2[0, 1, 2] = -999
        mask = rng.integers(0, 9, (len(times), 3)).astype("i1")  # three bytes a record: padded
        dims = {"time": 0, "lat": 3, "lon": 4}
        variables = [
            ("lat", ["lat"], lat, {"units": "degrees_north"}),
            ("time", ["time"], np.array(times), {"units": "hours since 2001-02-03 00:00:00"}),
            ("t2", ["time", "lat", "lon"], t2, {"units": "K", "scale_factor": 0.5, "add_offset": 273.0, "_FillValue": -999.0}),
            ("lon", ["lon"], lon, {"units": "degrees_east"}),
            ("mask", ["time", "lat"], mask, {}),
        ]
        (folder / file).write_bytes(encoded(version, dims, len(times), variables, {"title": "x"}))
        parts |= {t: (t2[r], mask[r]) for r, t in enumerate(times)}
    return folder, lat, lon, [parts[t] for t in sorted(parts)]


def test_header(series):
    header = netcdf.Header((series[0] / "a.nc").read_bytes())
    assert header.dims == {"time": 0, "lat": 3, "lon": 4} and header.attributes == {"title": "x"} and header.records == 1
    assert header.variables["t2"].shape == [1, 3, 4] and header.variables["t2"].attributes["scale_factor"] == 0.5
    with pytest.raises(ValueError):
        netcdf.Header(b"HDF1....")


def test_series(spark, series):
    folder, lat, lon, parts = series
    data = netcdf.open_cf(spark, f"{folder}/*.nc")
    assert len(data.times) == 3 and data.times[1] - data.times[0] == 86400.0
    assert data.names() == ["mask", "t2"] and data.names("coordinate") == ["lat", "lon", "time"]
    assert data.shape("t2") == (4, 3) and data.meshes[data.variables["t2"].mesh].coordinates == ("lon", "lat")
    for ts, (t2, mask) in enumerate(parts):
        want = {(i, j): None if t2[j, i] == -999 else t2[j, i] * 0.5 + 273.0 for j in range(3) for i in range(4)}
        assert {(r.i, r.j): r.value for r in data.variable("t2", ts).collect()} == want
        assert {r.i: r.value for r in data.variable("mask", ts).collect()} == {i: float(mask[i]) for i in range(3)}
    assert {(r.i, r.j) for r in data.variable("t2", 1, [(1, 2), (0, 0)]).collect()} == {(1, 0), (2, 0)}
    assert [r.value for r in data.variable("lon").orderBy("i").collect()] == lon.tolist()


def test_one_record_variable_is_not_padded(spark, tmp_path):
    values = np.arange(9).reshape(3, 3).astype("i1")
    (tmp_path / "x.nc").write_bytes(encoded(2, {"t": 0, "x": 3}, 3, [("v", ["t", "x"], values, {})], {}))
    found = netcdf.open_cf(spark, str(tmp_path / "x.nc")).table("v").collect()
    assert {(r.ts, r.i): r.value for r in found} == {(t, i): float(values[t, i]) for t in range(3) for i in range(3)}


def test_convert(spark, series, tmp_path):
    assert netcdf.convert(spark, f"{series[0]}/*.nc", str(tmp_path / "store"), 2) == ["mask", "t2"]
    back = tables.read_variable(spark, str(tmp_path / "store/t2"), 2, [(0, 1), (0, 2)], 2)
    t2 = series[3][2][0]
    assert {(r.i, r.j): r.value for r in back.collect()} == {(i, j): None if t2[j, i] == -999 else t2[j, i] * 0.5 + 273.0 for i in range(2) for j in range(3)}


def values_of(table, *keys):
    return {tuple(r[k] for k in keys): r.value for r in table.collect()}


def test_a_second_run_gives_the_same_store(spark, series, tmp_path):
    for _ in range(2):
        netcdf.convert(spark, f"{series[0]}/*.nc", str(tmp_path / "store"), 2)
    assert spark.read.parquet(str(tmp_path / "store/t2")).count() == 36


def test_overlapping_times_are_served_by_the_first_file(spark, tmp_path):
    for file, times, base in (("a.nc", [0.0, 1.0], 0), ("b.nc", [1.0, 2.0], 100), ("c.nc", [-1.0], 200)):
        v = (base + np.arange(2 * len(times))).reshape(len(times), 2).astype("f4")
        spec = [("time", ["time"], np.array(times), {"units": "days since 2000-01-01"}), ("v", ["time", "x"], v, {})]
        (tmp_path / file).write_bytes(encoded(2, {"time": 0, "x": 2}, len(times), spec, {}))
    data = netcdf.open_cf(spark, str(tmp_path))
    assert [(t - data.times[0]) / 86400 for t in data.times] == [0, 1, 2, 3] and data.time_coordinate == "time"
    assert values_of(data.table("v"), "ts", "i") == {(0, 0): 200, (0, 1): 201, (1, 0): 0, (1, 1): 1, (2, 0): 2, (2, 1): 3, (3, 0): 102, (3, 1): 103}
    files = netcdf.Collection(spark, str(tmp_path))
    assert files.local_step("v", 3) == (1, 1) and files.local_step("v", 99) == (1, 1) and files.local_step("v", -5) == (2, 0)
    assert files.step_range(1) == (2, 3)


def test_files_without_times_follow_each_other(spark, tmp_path):
    for n, file in enumerate(("a.nc", "b.nc")):
        (tmp_path / file).write_bytes(encoded(2, {"t": 0, "x": 2}, 2, [("v", ["t", "x"], (10 * n + np.arange(4)).reshape(2, 2).astype("i2"), {})], {}))
    found = values_of(netcdf.open_cf(spark, str(tmp_path)).table("v"), "ts", "i")
    assert found == {(0, 0): 0, (0, 1): 1, (1, 0): 2, (1, 1): 3, (2, 0): 10, (2, 1): 11, (3, 0): 12, (3, 1): 13}


def test_files_without_a_time_dimension(spark, tmp_path):
    for n, file in enumerate(("a.nc", "b.nc")):
        more = [("fixed", ["x"], np.array([7, 8], "i2"), {})] if n else []
        (tmp_path / file).write_bytes(encoded(2, {"x": 2}, 0, [("v", ["x"], np.array([n, n + 5], "i2"), {}), *more], {}))
    data = netcdf.open_cf(spark, str(tmp_path))
    assert values_of(data.table("v"), "ts", "i") == {(0, 0): 0, (0, 1): 5, (1, 0): 1, (1, 1): 6} and data.times == [0.0, 1.0]
    assert values_of(data.table("fixed"), "i") == {(0,): 7, (1,): 8} and not data.variables["fixed"].time_varying


def test_time_on_a_fixed_dimension_and_coordinates_by_attribute(spark, tmp_path):
    lon, lat = np.arange(6.0).reshape(2, 3), np.arange(6.0, 12).reshape(2, 3)
    v = np.arange(12).reshape(2, 2, 3).astype("f4")
    spec = [
        ("clock", ["step"], np.array([3.0, 6.0]), {"units": "hours since 1999-12-31T00:00:00Z"}),
        ("lon2", ["y", "x"], lon, {"units": "degrees_east"}), ("lat2", ["y", "x"], lat, {"standard_name": "latitude"}),
        ("v", ["step", "y", "x"], v, {"coordinates": "lat2 lon2", "missing_value": 5.0}),
    ]
    (tmp_path / "a.nc").write_bytes(encoded(5, {"step": 2, "y": 2, "x": 3}, 0, spec, {}))
    data = netcdf.open_cf(spark, str(tmp_path / "a.nc"))
    mesh = data.meshes[data.variables["v"].mesh]
    assert mesh.dimensions == ("x", "y") and mesh.coordinates == ("lon2", "lat2") and data.time_coordinate == "clock"
    assert data.times == [946598400 + 3 * 3600.0, 946598400 + 6 * 3600.0] and data.names() == ["v"]
    want = {(i, j): None if v[1, j, i] == 5 else float(v[1, j, i]) for i in range(3) for j in range(2)}
    assert values_of(data.variable("v", 1), "i", "j") == want


class Counted:
    """A file that counts the bytes that are read."""

    read = 0

    def __init__(self, file):
        self.file = file

    def read_at(self, n, at):
        data = self.file.read_at(n, at)
        Counted.read += len(data)
        return data

    def size(self):
        return self.file.size()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


def test_only_the_bytes_asked_for_are_read(spark, tmp_path, monkeypatch):
    """One variable of several in a sparse file of more than 2 GB; a box of one step of it."""
    n, path = 11000, str(tmp_path / "big.nc")
    sizes = {"a": 4, "v": 4, "b": 4}
    begins, at = {}, 4096
    for name in sizes:
        begins[name] = at
        at += 4 * n * 20000
    header = netcdf.encode_header(5, {"y": n, "x": 20000}, 0, [(k, ["y", "x"], ">f4", {}, begins[k]) for k in sizes], {})
    with open(path, "wb") as out:
        out.write(header)
        for row in (1000, 1001, 10999):
            out.seek(begins["v"] + 4 * (row * 20000 + 19998))
            out.write(np.array([row, row + 0.5], ">f4").tobytes())
        out.truncate(at)
    assert at > 2 << 30
    real = ranges.open_range
    monkeypatch.setattr(ranges, "open_range", lambda p: Counted(real(p)))
    monkeypatch.setattr(netcdf, "open_range", lambda p: Counted(real(p)))
    netcdf.facts(path)
    assert Counted.read < 20_000
    Counted.read = 0
    data = netcdf.open_cf(spark, path)
    files = netcdf.Collection(spark, path)
    box = {"j": (1000, 1001), "i": (19990, 19999)}
    planned = ranges.plan(files.index("v"), box)
    got = {}
    for group in planned:
        for piece in group:
            with ranges.open_range(piece.path) as file:
                for index, values in ranges.read_piece(file, piece, box):
                    got |= {k: v for k, v in zip(zip(*[x.tolist() for x in index]), values.tolist()) if v}
    assert got == {(19998, 1000): 1000, (19999, 1000): 1000.5, (19998, 1001): 1001, (19999, 1001): 1001.5}
    assert len(planned) == 1 and Counted.read < 200_000
    rows = data.variable("v", 0, [(19990, 19999), (10990, 10999)])
    assert values_of(rows.where("value > 0"), "i", "j") == {(19998, 10999): 10999, (19999, 10999): 10999.5}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "\nFilter" not in plan and " Filter (" not in plan  # the source took the box over
    assert rows.rdd.getNumPartitions() == 1


def test_large_steps_are_cut_and_small_ones_are_joined():
    layout = ranges.Layout([100, 10], ">f4", 0, 4000)
    index = ranges.Index(["x"], [layout], [(t, 0, 0, t) for t in range(20)])
    assert sum(len(g) for g in ranges.plan(index, {}, None, 400)) == 20 * 10
    assert len(ranges.plan(index, {}, None, 8000)) == 10
    assert [p.ts for g in ranges.plan(index, {"ts": (3, 9)}, {1, 4, 7}) for p in g] == [4, 7]
    assert ranges.plan(index, {"j": (200, 300)}) == []


@pytest.mark.parametrize("shape", [(7,), (5, 6), (3, 4, 5)])
def test_boxes_of_every_shape(shape, tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "GAP", 8)
    monkeypatch.setattr(ranges, "SLAB", 4)
    data = np.arange(np.prod(shape)).reshape(shape).astype("<i4")
    (tmp_path / "raw").write_bytes(b"12" + data.tobytes())
    rng = np.random.default_rng(0)
    index = ranges.Index([str(tmp_path / "raw")], [ranges.Layout(list(shape), "<i4", 2)], [(None, 0, 0, 0)], False)
    for _ in range(40):
        box = {a: tuple(sorted(rng.integers(0, n + 1, 2).tolist())) for a, n in zip("ijk", reversed(shape)) if rng.random() < 0.7}
        got = {}
        for group in ranges.plan(index, box, None, 40):
            for piece in group:
                with ranges.open_range(piece.path) as file:
                    for places, values in ranges.read_piece(file, piece, box):
                        for key, v in zip(zip(*[x.tolist() for x in places]), values.tolist()):
                            assert key not in got
                            got[key] = v
        want = {tuple(reversed(k)): float(v) for k, v in np.ndenumerate(data) if all(box.get(a, (0, 99))[0] <= x <= box.get(a, (0, 99))[1] for a, x in zip("ijk", reversed(k)))}
        assert got == want


def test_raw_volumes(spark, tmp_path):
    for t in range(2):
        (tmp_path / f"{t}.raw").write_bytes(b"head" + (np.arange(24) + 100 * t).astype(">i2").tobytes())
    table = ranges.read_raw(spark, [str(tmp_path / f"{t}.raw") for t in range(2)], (4, 3, 2), ">i2", 4, [105], 16)
    got = values_of(table, "ts", "i", "j", "k")
    assert got == {(t, i, j, k): None if (v := 100 * t + (k * 3 + j) * 4 + i) == 105 else v for t in range(2) for i in range(4) for j in range(3) for k in range(2)}
    assert values_of(table.where("ts = 1 and k = 1 and i in (0, 2)"), "i", "j") == {(i, j): 112 + 4 * j + i for i in (0, 2) for j in range(3)}
    (tmp_path / "short.raw").write_bytes(b"1")
    with pytest.raises(Exception, match="ends before its samples"):
        ranges.read_raw(spark, [str(tmp_path / "short.raw")], (4,)).collect()


def test_unstructured_meshes(spark, tmp_path):
    lon, lat = np.array([0.0, 10.0, 10.0, 0.0, 200.0]), np.array([0.0, 0.0, 10.0, 10.0, 5.0])
    faces = np.array([[1, 2, 3, 4], [2, 3, 5, -9]], "i4")
    spec = [
        ("mesh", [], np.array(0, "i4"), {"cf_role": "mesh_topology", "topology_dimension": 2.0, "node_coordinates": "ny nx", "face_node_connectivity": "conn"}),
        ("nx", ["node"], lon, {"units": "degrees_east"}), ("ny", ["node"], lat, {"units": "degrees_north"}),
        ("conn", ["face", "four"], faces, {"start_index": 1.0, "_FillValue": -9.0}),
        ("temp", ["node"], np.arange(5.0), {"mesh": "mesh", "location": "node"}), ("area", ["face"], np.arange(2.0), {"mesh": "mesh", "location": "face"}),
    ]
    (tmp_path / "u.nc").write_bytes(encoded(5, {"node": 5, "face": 2, "four": 4}, 0, spec, {}))
    data = netcdf.open_ugrid(spark, str(tmp_path))
    assert {(r.face, r.slot): r.node for r in data.faces["mesh"].collect()} == {(0, 0): 0, (0, 1): 1, (0, 2): 2, (0, 3): 3, (1, 0): 1, (1, 1): 2, (1, 2): -2, (1, 3): -2}
    assert data.meshes["mesh"].coordinates == ("nx", "ny") and data.variables["temp"].mesh == "mesh" and data.variables["area"].mesh != "mesh"


def test_voronoi_meshes(spark, tmp_path):
    lon = np.radians([0.0, 10.0, 10.0, 0.0, 200.0])
    times = np.array([list("2001-02-03_04:05:06".ljust(64)), list("2001-02-03_05:05:06".ljust(64))], "S1")
    spec = [
        ("lonVertex", ["nVertices"], lon, {}), ("latVertex", ["nVertices"], lon, {}), ("lonCell", ["nCells"], lon[:3], {}), ("latCell", ["nCells"], lon[:3], {}),
        ("nEdgesOnCell", ["nCells"], np.array([4, 3, 3], "i4"), {}),
        ("verticesOnCell", ["nCells", "maxEdges"], np.array([[1, 2, 3, 4], [2, 3, 5, 7], [1, 0, 2, 3]], "i4"), {}),
        ("cellsOnVertex", ["nVertices", "three"], np.array([[1, 2, 3]] * 5, "i4"), {}),
        ("xtime", ["Time", "StrLen"], times, {}), ("theta", ["Time", "nCells", "nVertLevels"], np.arange(12.0).reshape(2, 3, 2), {}),
    ]
    (tmp_path / "m.nc").write_bytes(encoded(5, {"Time": 0, "nVertices": 5, "nCells": 3, "maxEdges": 4, "three": 3, "StrLen": 64, "nVertLevels": 2}, 2, spec, {}))
    data = netcdf.open_mpas(spark, str(tmp_path))
    got = {}
    for r in data.faces["primal"].orderBy("face", "slot").collect():
        got.setdefault(r.face, []).append(r.node)
    assert got == {0: [0, 1, 2, 3], 1: [1, 2, -2, -1], 2: [-2, -2, -2, -2]}
    assert data.times[1] - data.times[0] == 3600.0 and data.meshes[data.variables["theta"].mesh].coordinates == ("lonCell", "latCell")
    assert values_of(data.variable("theta", 1).where("j = 2"), "i") == {(0,): 10.0, (1,): 11.0}


def test_regional_model(spark, tmp_path):
    times = np.array([list("2005-08-28_00:00:00"), list("2005-08-28_06:00:00")], "S1")
    lon = np.array([[[0.0, 2.0, 4.0], [0.0, 2.0, 4.0]]] * 2)
    ph = np.arange(36.0).reshape(2, 3, 2, 3) * 9.81
    spec = [
        ("PH", ["Time", "bottom_top_stag", "south_north", "west_east"], ph, {}), ("PHB", ["Time", "bottom_top_stag", "south_north", "west_east"], ph * 0 + 9.81, {}),
        ("Times", ["Time", "DateStrLen"], times, {}), ("XLONG", ["Time", "south_north", "west_east"], lon, {}), ("XLAT", ["Time", "south_north", "west_east"], lon + 5, {}),
        ("U", ["Time", "south_north", "west_east_stag"], np.arange(16.0).reshape(2, 2, 4), {"units": "m s-1"}), ("T2", ["Time", "south_north", "west_east"], lon, {"units": "K"}),
    ]
    (tmp_path / "wrfout").write_bytes(encoded(2, {"Time": 0, "DateStrLen": 19, "west_east": 3, "south_north": 2, "west_east_stag": 4, "bottom_top": 2, "bottom_top_stag": 3}, 2, spec, {}))
    data = netcdf.open_wrf(spark, str(tmp_path))
    assert data.times[1] - data.times[0] == 6 * 3600.0 and data.names() == ["PH", "PHB", "T2", "U"]
    assert data.meshes[data.variables["U"].mesh].coordinates == ("XLONG_U", "XLAT_U") and data.shape("U") == (4, 2)
    assert values_of(data.variable("XLONG_U").where("j = 0"), "i") == {(0,): -1.0, (1,): 1.0, (2,): 3.0, (3,): 5.0}
    assert values_of(data.variable("U", 1, [(3, 3), (0, 0)]), "i", "j") == {(3, 0): 11.0}
    heights = {n: values_of(data.variable(n).where("j = 1"), "i", "k") for n in ("ElevationW", "Elevation", "ElevationU")}
    assert heights["ElevationW"] == pytest.approx({(i, k): 6 * k + 3 + i + 1 for i in range(3) for k in range(3)})
    assert heights["Elevation"] == pytest.approx({(i, k): 6 * k + 3 + 3 + i + 1 for i in range(3) for k in range(2)})
    assert heights["ElevationU"] == pytest.approx({(i, k): 6 * k + 3 + 3 + i + 0.5 for i in range(4) for k in range(2)})
    assert data.shape("ElevationU") == (4, 2, 2) and "ElevationV" not in data.variables


def test_written_files_come_back(spark, tmp_path):
    v = np.random.default_rng(3).normal(size=(3, 4, 5))
    rows = [(t, i, j, None if (t, i, j) == (1, 2, 3) else float(v[t, j, i])) for t in range(3) for j in range(4) for i in range(5) if (t, i, j) != (2, 4, 3)]
    folder = fresh_path(spark, "nc")
    made = netcdf.write_files(spark.createDataFrame(rows, "ts int, i int, j int, value double"), folder, "v", {"x": 5, "y": 4}, [0.0, 60.0, 120.0], coordinates={"x": (range(5), {"units": "degrees_east"})}, attributes={"units": "K"})
    assert [r.ts for r in made.orderBy("ts").collect()] == [0, 1, 2]
    data = netcdf.open_cf(spark, folder)
    want = {(t, i, j): x for t, i, j, x in rows} | {(2, 4, 3): None}
    assert values_of(data.table("v"), "ts", "i", "j") == want
    assert data.times == [0.0, 60.0, 120.0] and data.variables["v"].units == "K" and values_of(data.table("x"), "i")[(3,)] == 3.0
    described = {r.name: r for r in netcdf.describe(spark, folder).where("path like '%00000001.nc'").collect()}
    assert described["v"].dims == ["time", "y", "x"] and described["v"].shape == [1, 4, 5] and described["v"].attributes["units"] == "K"


@pytest.mark.parametrize("text, want", [("1970-01-01", 0.0), ("1969-12-31 23:00", -3600.0), ("2001-032_00:00:01", 980985601.0), ("0001-01-01 00:00:00", -62135596800.0), ("0000-12-31", -62135683200.0), ("x", None)])
def test_dates(text, want):
    assert netcdf.epoch_of(text) == want
