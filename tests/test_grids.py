"""Synthetic grids: sampling at a node gives the node's value, on every kind of grid."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlake.operators import codec, contour, flow, grid, mesh, sample, stats, stencil
from meshlake.operators.grid import RegularGrid
from meshlake.sources.tables import from_numpy

SIZES = [(2, 2, 2), (4, 2, 2), (8, 2, 2), (7, 7, 7), (8, 8, 8)]


def fields(n, rng):
    k, j, i = np.indices((n[2], n[1], n[0]), float)
    gaps = np.where(rng.random((n[2], n[1], n[0])) < 0.1, np.nan, i)
    return {
        "constant": np.full(i.shape, 3.5),
        "ramp": i + 10 * j + 100 * k,
        "ramp on an axis": k / max(n[2] - 1, 1),
        "triangle": ((i + j + k) % 2) * 2 - 1,
        "all missing": np.full(i.shape, np.nan),
        "some missing": gaps,
    }


@pytest.mark.parametrize("n", SIZES)
def test_value_at_node_is_value_at_its_coordinates(spark, n):
    g = RegularGrid(n, (0.0, 0.0, 0.0), (1.0, 1.0, 1.0))
    for name, array in fields(n, np.random.default_rng(0)).items():
        values = from_numpy(spark, array)
        at = g.with_coordinates(values).withColumnRenamed("value", "own")
        for got in (
            sample.sample_nearest(at, values, g).select("own", "sampled"),
            at.join(sample.sample_linear(at, values, g, ["i", "j", "k"]), ["i", "j", "k"]).select("own", "sampled"),
        ):
            rows = got.collect()
            assert len(rows) == array.size
            for r in rows:
                assert (r.own is None) == (r.sampled is None), name
                assert r.own is None or r.sampled == pytest.approx(r.own, abs=1e-9), name


def test_linear_between_nodes_and_outside(spark):
    g = RegularGrid((4, 3, 5), (-1.0, 0.0, 2.0), (2.0, 4.0, 4.0))
    k, j, i = np.indices((5, 3, 4), float)
    plane = 2 * (i - 1) - 3 * (2 * j) + (2 + 0.5 * k)
    rng = random.Random(1)
    rows = [(m, rng.uniform(-1, 2), rng.uniform(0, 4), rng.uniform(2, 4)) for m in range(100)] + [(200, -1.5, 0.0, 2.0), (201, 2.0, 4.0, 4.0)]
    points = spark.createDataFrame(rows, "m long, x double, y double, z double")
    got = {r.m: r.sampled for r in sample.sample_linear(points, from_numpy(spark, plane), g, ["m"]).collect()}
    for m, x, y, z in rows:
        assert (got[m] is None) if m == 200 else got[m] == pytest.approx(2 * x - 3 * y + z)


def test_missing_rule_of_edges(spark):
    g = RegularGrid((2, 2), (0.0, 0.0), (1.0, 1.0))
    values = from_numpy(spark, np.array([[1.0, 3.0], [np.nan, 5.0]]))
    points = spark.createDataFrame([(0, 0.5, 0.0), (1, 1.0, 0.5), (2, 0.5, 0.5), (3, 0.0, 1.0), (4, 1.0, 1.0)], "m int, x double, y double")
    got = {r.m: r.sampled for r in sample.sample_linear(points, values, g, ["m"]).collect()}
    assert got == {0: 2.0, 1: 4.0, 2: None, 3: None, 4: 5.0}


def test_stretched_nearest(spark):
    axis = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 4.0), (3, 10.0)], "i int, a double")
    points = spark.createDataFrame([(0.0,), (0.5,), (0.51,), (4.0,), (7.1,), (10.0,), (10.1,), (-0.1,)], "x double")
    found = sample.locate(points, axis, "i", "a", "x", buckets=8)
    got = {r.x: (r.cell, r.n) for r in found.withColumn("n", sample.nearest_on_axis(found)).collect()}
    assert got == {0.0: (0, 0), 0.5: (0, 0), 0.51: (0, 1), 4.0: (2, 2), 7.1: (2, 3), 10.0: (2, 3), 10.1: (None, None), -0.1: (None, None)}


def test_curvilinear_and_unstructured(spark):
    ni, nj = 6, 5
    rows = []
    for j in range(nj):
        for i in range(ni):
            rows.append((i, j, i + 0.3 * math.sin(j), j + 0.2 * math.sin(i), float(2 * i - j)))
    table = spark.createDataFrame(rows, "i int, j int, x double, y double, value double")
    nodes, faces = mesh.curvilinear_mesh(table.drop("value"), table.drop("x", "y"), (ni, nj))
    at = table.select("i", "j", "x", "y")
    got = {(r.i, r.j): (r.linear, r.nearest) for r in mesh.sample_faces(at, nodes, faces, ["i", "j"], 1.0).collect()}
    for i, j, _, _, v in rows:
        assert got[i, j][0] == pytest.approx(v, abs=1e-6) and got[i, j][1] == v
    off = spark.createDataFrame([(1, 100.0, 0.0), (2, 2.5, 2.5)], "m int, x double, y double")
    out = {r.m: r.linear for r in mesh.sample_faces(off, nodes, faces, ["m"], 1.0).collect()}
    assert out[1] is None and out[2] is not None


def test_polygon_weights_reproduce_linear_fields():
    rng = np.random.default_rng(2)
    angles = np.sort(rng.uniform(0, 2 * np.pi, 6))
    polygon = np.stack([np.cos(angles), np.sin(angles)], axis=1)
    for turned in (polygon, polygon[::-1]):
        for _ in range(50):
            p = rng.dirichlet(np.ones(6)) @ turned
            w = mesh.polygon_weights(turned, p)
            assert w.sum() == pytest.approx(1) and w @ turned == pytest.approx(p)
        assert mesh.polygon_weights(turned, np.array([3.0, 0.0])) is None
        edge = (turned[2] + turned[3]) / 2
        assert mesh.polygon_weights(turned, edge)[[2, 3]] == pytest.approx([0.5, 0.5])


def test_gaps_policies(spark):
    nodes = spark.createDataFrame([(0, 0.0, 0.0, 1.0), (1, 2.0, 0.0, 3.0), (2, 2.0, 2.0, None), (3, 0.0, 2.0, 1.0)], "node long, x double, y double, value double")
    faces = spark.createDataFrame([(7, s, n) for s, n in enumerate([0, 1, 2, 3, -1])], "face long, slot int, node long")
    points = spark.createDataFrame([(0, 1.0, 1.0), (1, 1.0, 0.0)], "m int, x double, y double")
    strict = {r.m: r.linear for r in mesh.sample_faces(points, nodes, faces, ["m"], 5.0).collect()}
    scaled = {r.m: r.linear for r in mesh.sample_faces(points, nodes, faces, ["m"], 5.0, "renormalise").collect()}
    assert strict[0] is None and strict[1] == pytest.approx(2.0)
    assert scaled[0] == pytest.approx(5 / 3)
    assert {(r.face, r.neighbour) for r in mesh.face_neighbours(faces).collect()} == set()
    assert mesh.wireframe(faces).count() == 4


def test_layers(spark):
    rows = [(n, k, x, y, k * 2.0 + x, 10.0 * (k * 2.0 + x) ** (1 if n >= 0 else 2)) for n, (x, y) in enumerate([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]) for k in range(4)]
    layers = spark.createDataFrame(rows, "node long, layer int, x double, y double, z double, value double")
    faces = spark.createDataFrame([(0, s, s) for s in range(4)], "face long, slot int, node long")
    points = spark.createDataFrame([(0, 0.5, 0.5, 3.0), (1, 0.25, 0.0, 0.25), (2, 0.5, 0.5, 50.0)], "m int, x double, y double, z double")
    for quadratic in (False, True):
        got = {r.m: r.value for r in mesh.sample_layers(points, layers, faces, ["m"], 1.0, quadratic).collect()}
        assert got[0] == pytest.approx(30.0) and got[1] == pytest.approx(2.5) and got[2] is None


def test_connectivity_rules(spark):
    faces = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 2, 9), (1, 0, 0), (1, 1, 3), (1, 2, 4)], "face long, slot int, node long")
    counts = spark.createDataFrame([(0, 2), (1, 3)], "face long, n_nodes int")
    got = {(r.face, r.slot): r.node for r in mesh.one_based(faces, counts).collect()}
    assert got == {(0, 0): 0, (0, 1): 1, (0, 2): -1, (1, 0): -2, (1, 1): -2, (1, 2): -2}
    nodes = spark.createDataFrame([(0, 179.0, 0.0), (1, -179.0, 0.0), (2, 178.0, 1.0)], "node long, x double, y double")
    tri = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (0, 2, 2)], "face long, slot int, node long")
    assert [r.node for r in mesh.cut_at_date_line(tri, nodes).orderBy("slot").collect()] == [0, -2, 2]


def test_hexahedron_parts_fill_it():
    corners = np.array([[c & 1, c >> 1 & 1, c >> 2 & 1] for c in range(8)], float)
    volumes = [abs(np.linalg.det(corners[list(t)][1:] - corners[t[0]])) / 6 for t in mesh.hexahedron_tetrahedra()]
    assert sum(volumes) == pytest.approx(1.0)


def test_handedness(spark):
    g = RegularGrid((2, 2, 2), (0.0,) * 3, (1.0,) * 3)
    table = g.with_coordinates(from_numpy(spark, np.zeros((2, 2, 2))))
    assert mesh.handedness(table).first().right_handed
    assert not mesh.handedness(table.withColumn("x", -F.col("x"))).first().right_handed


def test_derivatives_of_polynomials(spark):
    x = np.arange(12.0) * 0.5
    for order, degree in ((2, 1), (4, 2), (6, 3)):
        line = from_numpy(spark, (x**degree)[None, :])
        got = stencil.derivative(line, "i", 12, 0.5, order).orderBy("i").collect()
        assert [r.derivative for r in got] == pytest.approx((degree * x ** (degree - 1)).tolist())
    short = from_numpy(spark, np.array([[1.0, 4.0, 9.0]]))
    assert [r.derivative for r in stencil.derivative(short, "i", 3, 1.0).orderBy("i").collect()] == [3.0, 4.0, 5.0]


def test_curl_of_rotation(spark):
    k, j, i = np.indices((7, 7, 7), float)
    table = from_numpy(spark, i).select("i", "j", "k", (-F.col("j")).cast("double").alias("u"), F.col("i").cast("double").alias("v"), F.lit(0.0).alias("w"))
    out = stencil.curl(table, ["u", "v", "w"], (7, 7, 7), (1.0, 1.0, 1.0)).agg(F.min("curl_k"), F.max("curl_k"), F.max(F.abs("curl_i")), F.max(F.abs("curl_j"))).first()
    assert tuple(out) == pytest.approx((2.0, 2.0, 0.0, 0.0), abs=1e-9)


def test_median_is_the_upper_one(spark):
    for values in ([1.0], [4.0, 1.0], [1.0, 2.0, 3.0], [5.0, 5.0, 1.0, 9.0], [2.0] * 10 + [3.0] * 10):
        table = spark.createDataFrame([(v,) for v in values] + [(None,)], "value double")
        assert stats.upper_median(table).first().median == sorted(values)[len(values) // 2]


@pytest.mark.parametrize("name", ["haar", "db2"])
def test_filters_are_orthogonal(spark, name):
    array = np.random.default_rng(3).random((3, 16))
    there = codec.transform_lines(from_numpy(spark, array), "i", name)
    back = codec.transform_lines(there, "i", name, inverse=True)
    for r in back.collect():
        assert r.value == pytest.approx(array[r.j, r.i])
    energy = there.agg(F.sum(F.col("value") ** 2)).first()[0]
    assert energy == pytest.approx((array**2).sum())


def test_levels_and_bands(spark):
    array = np.random.default_rng(4).random((2, 32))
    table = from_numpy(spark, array)
    coefficients = codec.decompose(table, "i", 3)
    full = {(r.i, r.j): r.value for r in codec.reconstruct(coefficients, "i", 3).collect()}
    assert all(full[i, j] == pytest.approx(array[j, i]) for i in range(32) for j in range(2))
    coarse = codec.reconstruct(coefficients, "i", 3, upto=0).collect()
    assert {(r.i, r.j): r.value for r in coarse} == pytest.approx({(i, j): array[j, 8 * i : 8 * i + 8].sum() / 8**0.5 for i in range(4) for j in range(2)})
    bands = codec.detail_bands(coefficients, ["j"], [4, 8, 16])
    errors = []
    for lod in range(3):
        got = {(r.i, r.j): r.value for r in codec.reconstruct(codec.upto_band(bands, lod), "i", 3).collect()}
        errors.append(sum((got[i, j] - array[j, i]) ** 2 for i in range(32) for j in range(2)))
    assert errors == sorted(errors, reverse=True)
    maps = codec.significance(coefficients.where("j = 0"), ["j"], 32)
    assert len(maps.first().places) == 32
    assert codec.invert_significance(maps, 128).first().places[:1]


def rotation(n=65):
    g = RegularGrid((n, n), (-1.0, -1.0), (1.0, 1.0))
    y, x = np.meshgrid(np.linspace(-1, 1, n), np.linspace(-1, 1, n), indexing="ij")
    return g, flow.Field(g, [0.0], [-y[None], x[None]])


def test_traces_in_a_rotation_stay_on_circles(spark):
    _, field = rotation()
    seeds = spark.createDataFrame([(1, 0.5, 0.0), (2, 0.0, 0.25)], "seed long, x double, y double")
    rows = flow.advect(seeds, field, 0.05, steps=100, fixed=True).collect()
    assert len(rows) == 202
    for r in rows:
        assert math.hypot(r.x, r.y) == pytest.approx(0.5 if r.stream == 1 else 0.25, abs=1e-5)
        assert r.stream != 1 or (r.x, r.y) == pytest.approx((0.5 * math.cos(0.05 * r.step), 0.5 * math.sin(0.05 * r.step)), abs=1e-4)
    back = flow.bidirectional(seeds, field, 0.05, steps=10, fixed=True)
    ends = {r.step: (r.x, r.y) for r in back.where("stream = 1").collect()}
    assert ends[-10] == pytest.approx((0.5 * math.cos(0.5), -0.5 * math.sin(0.5)), abs=1e-4)


def test_traces_end_and_wrap(spark):
    g = RegularGrid((5, 5), (0.0, 0.0), (4.0, 4.0))
    east = flow.Field(g, [0.0], [np.ones((1, 5, 5)), np.zeros((1, 5, 5))])
    seed = spark.createDataFrame([(0, 3.2, 1.0)], "seed long, x double, y double")
    out = flow.advect(seed, east, 0.5, steps=10, fixed=True).orderBy("step").collect()
    assert out[-1].special and len([r for r in out if not r.special]) >= 2
    wrapped = flow.advect(seed, east, 0.5, steps=10, fixed=True, periodic=(True, False)).orderBy("step").collect()
    assert sum(r.special for r in wrapped) == 1 and wrapped[-1].x == pytest.approx(4.2) and min(r.x for r in wrapped) == pytest.approx(0.2)
    still = flow.Field(g, [0.0], [np.zeros((1, 5, 5)), np.zeros((1, 5, 5))])
    assert [r.special for r in flow.advect(seed, still, 0.5, steps=5).orderBy("step").collect()] == [False, True]
    exported = flow.export_rows(flow.advect(seed, east, 0.5, steps=10, fixed=True), steps=1).collect()
    assert len(exported) == 2


def test_unsteady_field_and_integral(spark):
    g = RegularGrid((3, 3), (0.0, 0.0), (10.0, 10.0))
    speed = np.stack([np.full((3, 3), v) for v in (0.0, 2.0)])
    field = flow.Field(g, [0.0, 1.0], [speed, np.zeros((2, 3, 3))])
    seed = spark.createDataFrame([(0, 1.0, 5.0)], "seed long, x double, y double")
    out = flow.advect(seed, field, 0.1, until=1.0, fixed=True).orderBy("step").collect()
    assert out[-1].time == pytest.approx(1.0) and out[-1].x == pytest.approx(2.0)
    assert field.first_step() > 0
    values = from_numpy(spark, np.full((3, 3), 3.0))
    streams = flow.attach_property(flow.advect(seed, field, 0.1, until=1.0, fixed=True), values, g, "p")
    total = stats.running_integral(streams, "p").orderBy(F.desc("step")).first().integral
    assert total == pytest.approx(3.0)


def smooth(grid, times, seed):
    """Arrays (time, k, j, i) of smooth random vectors, with some samples missing."""
    rng = np.random.default_rng(seed)
    index = np.indices(tuple(reversed(grid.n)))
    parts = []
    for _ in grid.n:
        waves = [sum(rng.normal() * np.sin(index[a] * rng.uniform(0.1, 0.4) + rng.uniform(0, 6)) for a in range(len(grid.n))) for _ in times]
        parts.append(np.stack(waves))
    parts[0][(0, *[3] * len(grid.n))] = np.nan
    return parts


def component(spark, array):
    """(ts, i, j, k, value) of an array, missing samples left out."""
    axes = "ijk"[: array.ndim - 1]
    rows = [(p[0], *reversed(p[1:]), float(v)) for p, v in np.ndenumerate(array) if not np.isnan(v)]
    return spark.createDataFrame(rows, "ts int, " + ", ".join(f"{a} int" for a in axes) + ", value double")


def outcome(rows):
    return {(r.stream, r.step): tuple(r)[2:] for r in rows.collect()}


@pytest.mark.parametrize("case", ["steady", "adaptive", "backward", "unsteady", "periodic", "euler"])
def test_traces_in_a_stored_field_are_those_in_memory(spark, case, monkeypatch):
    monkeypatch.setattr(flow, "TOGETHER", 3)
    grid = RegularGrid((12, 9), (0.0, 0.0), (11.0, 16.0)) if case != "unsteady" else RegularGrid((8, 7, 6), (0.0, -1.0, 0.0), (7.0, 5.0, 5.0))
    times = [0.0, 1.5, 2.0, 4.0] if case == "unsteady" else [0.0]
    parts = smooth(grid, times, 1)
    rng = np.random.default_rng(2)
    places = rng.uniform(grid.low, grid.high, (25, len(grid.n)))
    places[0] = grid.high
    places[1] = np.array(grid.low) - 5
    seeds = spark.createDataFrame([(n, *map(float, p)) for n, p in enumerate(places)], "seed long, " + ", ".join(f"{c} double" for c in grid.coords))
    options = {
        "steady": {"dt": 0.7, "steps": 15, "fixed": True}, "adaptive": {"dt": 0.4, "steps": 20}, "backward": {"dt": -0.5, "steps": 12, "fixed": True},
        "unsteady": {"dt": 0.2, "until": 3.7, "start": 0.1}, "periodic": {"dt": 1.5, "steps": 25, "periodic": (True, True)}, "euler": {"dt": 2.5, "steps": 9, "method": "euler", "fixed": True},
    }[case]
    tables = [component(spark, p) for p in parts]
    if case != "unsteady":
        tables = [t.drop("ts") for t in tables]
    stored = flow.StoredField(grid, tables, times, 1.25, block=3)
    want = outcome(flow.advect(seeds, flow.Field(grid, times, parts, 1.25), **options))
    got = outcome(flow.advect(seeds, stored, **options))
    assert len({stored.empty().cells(places)[0][0][n] // 3 for n in range(25)}) > 1 and len(want) > 100
    assert got == want


def test_runs_that_are_given_up_are_marked(spark, monkeypatch):
    monkeypatch.setattr(flow, "RUNAWAY", 50)
    _, field = rotation(9)
    rows, left = zip(*flow.trace(field, flow.Particles.at(np.array([[0.5, 0.0], [0.0, 0.0]]), 0.0, 1e-9), 1e-9, None, 5.0, True, False, (False, False)))
    who, step, _, _, special, capped = (np.concatenate([r[c] for r in rows]) for c in range(6))
    assert step[(who == 0) & capped].tolist() == [51] and capped.sum() == 1 and special[capped].all()
    assert step[(who == 1) & special].tolist() == [1]


def test_traces_are_passed_on_in_parts():
    _, field = rotation(9)
    made = list(flow.trace(field, flow.Particles.at(np.full((10, 2), 0.3), 0.0, 0.01), 0.01, 100, None, True, False, (False, False), rows=200))
    assert len(made[-1][1]) == 10 and sum(len(p[0]) for p, _ in made) == 200


def test_large_fields_stay_in_tables(spark, monkeypatch):
    monkeypatch.setattr(flow, "IN_MEMORY", 10)
    g = RegularGrid((4, 4), (0.0, 0.0), (3.0, 3.0))
    field = flow.field_from_tables(g, [from_numpy(spark, np.full((4, 4), a)) for a in (3.0, 4.0)])
    assert isinstance(field, flow.StoredField)
    assert field.first_step() == pytest.approx(flow.Field(g, [0.0], [np.full((1, 4, 4), a) for a in (3.0, 4.0)]).first_step())


def test_seeds_that_prefer_large_values(spark):
    g = RegularGrid((5, 5), (0.0, 0.0), (4.0, 4.0))
    values = from_numpy(spark, np.arange(25.0).reshape(5, 5))
    value = lambda r: r.x + 5 * r.y
    every = sorted(value(r) for r in flow.random_rake(spark, (0.0, 0.0), (4.0, 4.0), 40).collect())
    for bias, want in ((3, every[-10:]), (-3, every[:10])):
        got = sorted(value(r) for r in flow.biased_rake(values, g, (0.0, 0.0), (4.0, 4.0), 10, bias).collect())
        assert got == pytest.approx(want)
    assert flow.biased_rake(values, g, (0.0, 0.0), (4.0, 4.0), 10, 0).count() == 10


def test_property_between_steps(spark):
    g = RegularGrid((3, 3), (0.0, 0.0), (2.0, 2.0))
    values = component(spark, np.stack([np.full((3, 3), v) for v in (1.0, 5.0, 6.0)]))
    streams = spark.createDataFrame([(1, n, 0.5, 1.0, t, False) for n, t in enumerate((0.0, 5.0, 10.0, 30.0, 50.0, 51.0))], "stream long, step int, x double, y double, time double, special boolean")
    got = flow.attach_property(streams, values, g, "p", [0.0, 10.0, 50.0]).orderBy("step").collect()
    assert [r.p for r in got] == [1.0, 3.0, 5.0, 5.5, 6.0, None]


def test_field_from_tables_and_barbs(spark):
    g = RegularGrid((4, 4), (0.0, 0.0), (3.0, 3.0))
    u, v = (from_numpy(spark, np.full((4, 4), a)) for a in (1.0, -2.0))
    field = flow.field_from_tables(g, [u, v])
    assert field.velocity(np.zeros(1), np.array([[1.5, 1.5]]))[0].tolist() == [1.0, -2.0]
    seeds = contour.rake(spark, (0.0, 0.0), (3.0, 3.0), (2, 2))
    ends = contour.barbs(seeds, [u, v], g, 0.5).collect()
    assert len(ends) == 4 and all(r.x_end == r.x + 0.5 and r.y_end == r.y - 1 for r in ends)
    assert contour.largest_component(u.withColumnRenamed("value", "u"), ["u"]).first().largest == 1.0
    assert contour.displaced(u, v).first().z == -2.0


def test_nearest_neighbour_at_any_distance(spark):
    rng = np.random.default_rng(3)
    a = np.r_[rng.normal(0, 1, (60, 2)), rng.normal(5000, 900, (20, 2)), [[-40000.0, 7.0]]]
    b = np.r_[rng.normal(0, 1, (9, 2)), [[300.0, -200.0]]]
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(a)] + [(99, None, 1.0)], "k long, x double, y double")
    targets = spark.createDataFrame([(t, float(x), float(y)) for t, (x, y) in enumerate(b)], "t long, x double, y double")
    got = {r.k: (r.nearest, r.distance) for r in sample.nearest_neighbour(points, targets, ["k"], "t", 1.0).collect()}
    apart = np.hypot(*(a[:, None] - b[None]).transpose(2, 0, 1))
    assert got.pop(99) == (None, None) and len(got) == len(a)
    assert all(got[k][0] == apart[k].argmin() and np.isclose(got[k][1], apart[k].min()) for k in got)
    none = sample.nearest_neighbour(points, targets.limit(0), ["k"], "t", 1.0).collect()
    assert len(none) == len(a) + 1 and all(r.nearest is None for r in none)


def test_samples_of_blocks_are_never_broadcast(spark):
    """Constant samples are files of few bytes, and large in memory."""
    grid = RegularGrid((40, 40), (0.0, 0.0), (39.0, 39.0))
    table = spark.range(1600).select((F.col("id") % 40).cast("int").alias("i"), F.floor(F.col("id") / 40).cast("int").alias("j"), F.lit(1.0).alias("value"))
    stored = flow.StoredField(grid, [table, table], block=8)
    many = spark.createDataFrame([(0, 2), (7, 1)], "key long, _n int")
    met = flow._slices(many, stored.blocks())
    plan = met._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "BroadcastExchange" in plan and not re.search(r"BroadcastExchange\s+Input \[\d+\]: \[.*samples", plan)
    assert sorted((r._key, r._slice, len(r.samples)) for r in met.collect()) == [(0, 0, 9 * 9 * 16), (0, 1, 9 * 9 * 16), (7, 0, 9 * 9 * 16)]


@pytest.mark.parametrize("n, high", [((64, 720000), (120.0, 120.0)), ((500, 500, 500), (1.0, 1.0, 1.0)), ((10**5, 10**5), (1.0, 1000.0)), ((4, 5), (1.0, 1.0)), ((1, 10**6), (0.0, 1.0))])
def test_sides_of_blocks_are_equally_long(n, high):
    """Traces across samples that are close along one axis would change their block many times a step."""
    grid = RegularGrid(n, (0.0,) * len(n), high)
    block = flow.StoredField(grid, []).block
    assert math.prod(block) <= flow.BLOCK and all(1 <= b <= max(m - 1, 1) for b, m in zip(block, n))
    free = [a for a in range(len(n)) if 1 < block[a] < n[a] - 1]
    sides = [block[a] * grid.delta(a) for a in free]
    assert not sides or max(sides) < 1.2 * min(sides)


def test_a_trace_across_close_samples_takes_few_rounds(spark, monkeypatch):
    grid = RegularGrid((5, 1000), (0.0, 0.0), (100.0, 100.0))
    table = spark.range(5000).select((F.col("id") % 5).cast("int").alias("i"), F.floor(F.col("id") / 5).cast("int").alias("j"), F.lit(1.0).alias("value"))
    rounds, slices = [], flow._slices
    monkeypatch.setattr(flow, "_slices", lambda many, blocks: rounds.append(1) or slices(many, blocks))
    seeds = spark.createDataFrame([(1, 5.0, 5.0)], "seed long, x double, y double")
    out = flow.advect(seeds, flow.StoredField(grid, [table, table]), 8.0, steps=10, fixed=True)
    assert out.agg(F.max("x"), F.max("y")).first() == (pytest.approx(85.0), pytest.approx(85.0)) and len(rounds) < 4
