"""Point location in meshes of uneven faces, layered and curvilinear grids in three dimensions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlake.operators import cells, mesh, sample
from meshlake.operators.grid import RegularGrid


def uneven(spark):
    """Squares whose sides halve from 512 to 0.5 along x, 4 to 4096 of them in a column; and a linear field."""
    nodes, faces, number, x0 = {}, [], 0, 0.0
    for size in (512.0, 64.0, 8.0, 0.5):
        for j in range(int(min(512 / size, 96))):
            ring = [(x0, j * size), (x0 + size, j * size), (x0 + size, (j + 1) * size), (x0, (j + 1) * size)]
            for slot, p in enumerate(ring):
                faces.append((number, slot, nodes.setdefault(p, len(nodes))))
            number += 1
        x0 += size
    rows = [(n, x, y, 2 * x - 3 * y + 1) for (x, y), n in nodes.items()]
    return spark.createDataFrame(rows, "node long, x double, y double, value double"), spark.createDataFrame(faces, "face long, slot int, node long"), number


def test_faces_of_very_different_sizes(spark):
    nodes, faces, many = uneven(spark)
    rng = np.random.default_rng(1)
    places = np.r_[rng.uniform((0, 0), (512, 512), (40, 2)), rng.uniform((512, 0), (584.5, 48), (60, 2)), rng.uniform((584, 0), (584.5, 48), (60, 2)), [[600.0, 1.0], [-1.0, 5.0]]]
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(places)], "k int, x double, y double")
    got = {r.k: r for r in mesh.sample_faces(points, nodes, faces, ["k"]).collect()}
    fixed = {r.k: r for r in mesh.sample_faces(points, nodes, faces, ["k"], 16.0).collect()}
    assert len(got) == len(places) and got == fixed
    for k, (x, y) in enumerate(places):
        if got[k].face is not None:
            assert got[k].linear == pytest.approx(2 * x - 3 * y + 1)
    assert sum(r.face is not None for r in got.values()) > 140 and got[160].face is None and got[161].face is None
    boxes = mesh._faces_with_corners(nodes, faces).select(F.col("face").alias("id"), F.col("_x0").alias("lo0"), F.col("_x1").alias("hi0"), F.col("_y0").alias("lo1"), F.col("_y1").alias("hi1"))
    index = cells.box_index(boxes, 2)
    told = index.statistics().collect()
    assert max(r.largest for r in told) <= cells.CROWDED and sum(r.entries for r in told) <= 9 * many and len(told) >= 4


def test_crowded_cells_are_split_and_equal_boxes_are_not(spark):
    rng = np.random.default_rng(2)
    thin = [(n, 0.0, 100.0, float(y), float(y) + 0.01) for n, y in enumerate(rng.uniform(0, 100, 400))]
    boxes = spark.createDataFrame(thin, "id int, lo0 double, hi0 double, lo1 double, hi1 double")
    index = cells.box_index(boxes, 2, 40)
    assert max(r.largest for r in index.statistics().collect()) <= 40
    points = spark.createDataFrame([(n, 50.0, y + 0.005) for n, _, _, y, _ in thin], "k int, x double, y double")
    met = {(r.k, r.id) for r in index.meet(points, ["x", "y"]).collect()}
    assert all((n, n) in met for n in range(400)) and len(met) < 400 * 40
    same = spark.createDataFrame([(n, 0.0, 1.0, 0.0, 1.0) for n in range(100)], "id int, lo0 double, hi0 double, lo1 double, hi1 double")
    index = cells.box_index(same, 2, 10)
    assert index.meet(spark.createDataFrame([(1, 0.5, 0.5)], "k int, x double, y double"), ["x", "y"]).count() == 100
    assert cells.box_index(same.limit(0), 2).meet(points, ["x", "y"]).count() == 0


def rippled(n, seed=3):
    """Places and values of a bent grid with axes (k, j, i); the value is linear in space."""
    k, j, i = np.indices((n[2], n[1], n[0])).astype(float)
    x = i + 0.2 * np.sin(j + k)
    y = j + 0.2 * np.cos(i)
    z = k + 0.1 * np.sin(i * j)
    return x, y, z, 2 * x - y + 3 * z


def tables(spark, n, x, y, z, v):
    rows = [(int(i), int(j), int(k), float(x[k, j, i]), float(y[k, j, i]), float(z[k, j, i]), None if np.isnan(v[k, j, i]) else float(v[k, j, i])) for k, j, i in np.ndindex(*reversed(n))]
    return spark.createDataFrame(rows, "i int, j int, k int, x double, y double, z double, value double")


def test_hexahedra(spark):
    n = (5, 4, 6)
    x, y, z, v = rippled(n)
    v[0, 0, 0] = np.nan
    samples = tables(spark, n, x, y, z, v)
    at_nodes = samples.withColumn("key", (F.col("k") * 20 + F.col("j") * 5 + F.col("i")).cast("int"))
    got = {r.key: r for r in cells.sample_hexahedra(at_nodes.select("key", "x", "y", "z"), samples.select("i", "j", "k", "x", "y", "z"), samples, n, ["key"]).collect()}
    for r in at_nodes.collect():  # what is sampled at a sample's place is the sample
        assert got[r.key].ci is not None and (got[r.key].value is None if r.value is None else got[r.key].value == pytest.approx(r.value))
    rng = np.random.default_rng(4)
    inner = rng.uniform((1, 1, 1), (3, 2.5, 4), (60, 3))
    points = spark.createDataFrame([(m, *map(float, p)) for m, p in enumerate(inner)] + [(99, 50.0, 0.0, 0.0)], "key int, x double, y double, z double")
    got = {r.key: r for r in cells.sample_hexahedra(points, samples.select("i", "j", "k", "x", "y", "z"), samples, n, ["key"]).collect()}
    assert all(got[m].value == pytest.approx(2 * p[0] - p[1] + 3 * p[2]) for m, p in enumerate(inner)) and got[99].ci is None


def test_mirrored_tetrahedra_fill_their_cell():
    corners = np.array([[c & 1, c >> 1 & 1, c >> 2 & 1] for c in range(8)], float)
    points = np.random.default_rng(5).uniform(size=(200, 3))
    for odd in (False, True):
        inside = sum((cells.tetrahedron_weights(np.broadcast_to(corners[list(t)], (200, 4, 3)), points) >= 0).all(axis=1).astype(int) for t in cells.tetrahedra(odd))
        assert (inside == 1).all()
    sides = [{frozenset(x) for t in cells.tetrahedra(odd) for x in [[c for c in t if c & 1 == side]] if len(x) == 3} for odd, side in ((False, 1), (True, 0))]
    assert {frozenset(c ^ 1 for c in x) for x in sides[0]} == sides[1]


def test_layered_grid(spark):
    grid = RegularGrid((5, 4), (0.0, 0.0), (8.0, 6.0))
    k, j, i = np.indices((6, 4, 5)).astype(float)
    z = k * 2 + 0.3 * i + 0.1 * j
    v = 4 * z + i - 2 * j
    table = tables(spark, (5, 4, 6), i, j, z, v)
    heights, values = table.select("i", "j", "k", F.col("z").alias("value")), table.select("i", "j", "k", "value")
    at_nodes = table.select((F.col("k") * 20 + F.col("j") * 5 + F.col("i")).cast("int").alias("key"), (F.col("i") * 2.0).alias("x"), (F.col("j") * 2.0).alias("y"), "z", F.col("value").alias("want"))
    for quadratic in (False, True):
        got = {r.key: r.value for r in cells.sample_layered_grid(at_nodes, heights, values, grid, ["key"], quadratic).collect()}
        assert all(got[r.key] == pytest.approx(r.want) for r in at_nodes.collect())
    points = spark.createDataFrame([(0, 3.0, 2.5, 5.0), (1, 3.0, 2.5, -1.0), (2, 9.0, 0.0, 1.0), (3, 1.0, 5.9, 9.0)], "key int, x double, y double, z double")
    got = {r.key: r.value for r in cells.sample_layered_grid(points, heights, values, grid, ["key"]).collect()}
    assert got[0] == pytest.approx(4 * 5.0 + 1.5 - 2 * 1.25) and got[1] is None and got[2] is None and got[3] == pytest.approx(36 + 0.5 - 5.9)


def test_heights_of_a_triangle_and_a_missing_layer(spark):
    """Heights that are no plane over a cell are those of the triangle; a column that lacks a layer is passed over there."""
    z, v = np.array([[0.0, 1.0, np.nan, 3.0]]), np.array([[0.0, 10.0, 5.0, 30.0]])
    assert cells.sample_stacks(z, v, np.array([2.0]))[0] == pytest.approx(20.0)
    assert np.isnan(cells.sample_stacks(z, v, np.array([3.5]))[0])
    assert cells.sample_stacks(np.array([[0.0, 1.0, 2.0]]), np.array([[0.0, 1.0, 4.0]]), np.array([1.5]), True)[0] == pytest.approx(2.25)
    assert cells.sample_stacks(np.array([[0.0, 1.0, 2.0]]), np.array([[0.0, 1.0, 4.0]]), np.array([0.5]), True)[0] == pytest.approx(0.25)
    grid = RegularGrid((2, 2), (0.0, 0.0), (1.0, 1.0))
    rows = [(i, j, k, 4.0 * k + (1.0 if (i, j) == (1, 0) else 0.0), 10.0 * k) for i in range(2) for j in range(2) for k in range(2)]
    table = spark.createDataFrame(rows, "i int, j int, k int, z double, value double")
    points = spark.createDataFrame([(0, 0.25, 0.75, 1.0), (1, 0.75, 0.25, 1.5)], "key int, x double, y double, z double")
    got = {r.key: r.value for r in cells.sample_layered_grid(points, table.select("i", "j", "k", F.col("z").alias("value")), table, grid, ["key"]).collect()}
    assert got[0] == pytest.approx(2.5) and got[1] == pytest.approx(10 * (1.5 - 0.5) / 4)


def test_far_points_go_down_the_pyramid(spark):
    rng = np.random.default_rng(9)
    b = np.r_[rng.normal(0, 1, (400, 2)), rng.normal(50, 0.01, (300, 2)), [[7.0, 7.0]] * 60]
    a = np.r_[rng.uniform(-300, 300, (60, 2)), rng.normal(25, 8, (40, 2)), [[1e6, -1e6]]]
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(a)], "k long, x double, y double")
    targets = spark.createDataFrame([(t, float(x), float(y)) for t, (x, y) in enumerate(b)], "t long, x double, y double")
    apart = np.hypot(*(a[:, None] - b[None]).transpose(2, 0, 1))
    for within in (None, 40.0):
        got = {r.k: (r.nearest, r.distance) for r in sample.nearest_neighbour(points, targets, ["k"], "t", 0.5, within).collect()}
        for k in range(len(a)):
            if within is None or apart[k].min() <= within:
                assert got[k] == (int(np.flatnonzero(apart[k] == apart[k].min())[0]), pytest.approx(apart[k].min()))
            else:
                assert got[k] == (None, None)


def test_points_meet_few_targets_of_a_dense_table(spark, monkeypatch):
    """Buckets get smaller where targets crowd, so pairs grow with the points alone; copies of a place are one."""
    monkeypatch.setattr(sample, "CROWD", 12)
    rng = np.random.default_rng(4)
    b = np.r_[rng.uniform(0, 10, (300, 2)), rng.normal(5, 0.02, (300, 2)), [[3.0, 3.0]] * 100]
    a = np.r_[rng.uniform(-1, 11, (100, 2)), rng.normal(5, 0.03, (60, 2)), [[3.0, 3.0], [3.1, 3.0]]]
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(a)], "k long, x double, y double")
    targets = spark.createDataFrame([(t, float(x), float(y)) for t, (x, y) in enumerate(b)], "t long, x double, y double")
    assert len(sample._crowded(targets.select(F.col("x").alias("_x"), F.col("y").alias("_y")).distinct(), 4.0)) > 4
    got = {r.k: (r.nearest, r.distance) for r in sample.nearest_neighbour(points, targets, ["k"], "t", 4.0).collect()}
    apart = np.hypot(*(a[:, None] - b[None]).transpose(2, 0, 1))
    for k in range(len(a)):
        assert got[k] == (int(np.flatnonzero(apart[k] == apart[k].min())[0]), pytest.approx(apart[k].min()))


def test_the_index_of_hexahedra_has_a_box_for_many_cells(spark, monkeypatch):
    """Indexing and shuffling each cell with its eight corners moves the grid many times over."""
    n, counts, made = (9, 9, 9), [], cells.box_index
    monkeypatch.setattr(cells, "box_index", lambda boxes, d: counts.append(boxes.count()) or made(boxes, d))
    samples = spark.range(729).select(*[(F.floor(F.col("id") / 9**a) % 9).cast("int").alias(c) for a, c in enumerate("ijk")])
    samples = samples.withColumns({"x": F.col("i") + 0.1 * F.col("j"), "y": F.col("j") + 0.0, "z": F.col("k") + 0.0, "value": F.col("i") + F.col("k") * 10.0})
    points = spark.createDataFrame([(1, 2.55, 1.5, 7.25), (2, 20.0, 0.0, 0.0)], "key long, x double, y double, z double")
    hole = (F.col("i") == 8) & (F.col("j") == 8) & (F.col("k") == 8)
    got = {r.key: r for r in cells.sample_hexahedra(points, samples.where(~hole), samples, n, ["key"]).collect()}
    assert counts == [8] and (got[1].ci, got[1].cj, got[1].ck, got[1].value) == (2, 1, 7, pytest.approx(2.4 + 72.5)) and got[2].value is None
