"""Further queries: meshes, layers, 3-D grids, traces, the store, metadata, units."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import atmosphere, scalar
from .operators import box, codec, contour, flow, mesh, sample
from .operators.grid import RegularGrid
from .plans.catalog import Dataset, Mesh, Variable
from .plans.scratch import fresh_path
from .queries import NI, G, field, points, query, r6, table, unit_grid
from .sources import tables

# A 3-D grid: the vector cut in rows of 8.

CUBE = G + """, c AS (SELECT CAST(i % 8 AS INT) AS i, CAST(j AS INT) AS j, CAST(i // 8 AS INT) AS k, v FROM g),
  p3 AS (SELECT c_custkey AS key, CAST(c_custkey * 37 % 700 AS DOUBLE) / 100 AS x, CAST(c_custkey * 91 % 4990 AS DOUBLE) / 100 AS y, CAST(c_custkey * 53 % 700 AS DOUBLE) / 100 AS z FROM customer) """


def _cube(spark, sf):
    return field(spark, sf).select((F.col("i") % 8).cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.floor(F.col("i") / 8).cast("int").alias("k"), "value")


def _points3(spark, sf):
    key = F.col("c_custkey")
    part = lambda m, n: (key * m % n).cast("double") / 100
    return table(spark, sf, "customer").select(key.alias("key"), part(37, 700).alias("x"), part(91, 4990).alias("y"), part(53, 700).alias("z"))


@query(
    "g6_trilinear",
    CUBE + """, q AS (SELECT *, least(floor(x), 6) AS ci, least(floor(y), nj - 2) AS cj, least(floor(z), 6) AS ck FROM p3, n),
      w AS (SELECT key, ci + di AS qi, cj + dj AS qj, ck + dk AS qk,
        (CASE di WHEN 1 THEN x - ci ELSE 1 - (x - ci) END) * (CASE dj WHEN 1 THEN y - cj ELSE 1 - (y - cj) END) * (CASE dk WHEN 1 THEN z - ck ELSE 1 - (z - ck) END) AS w
        FROM q, (VALUES (0), (1)) AS a(di), (VALUES (0), (1)) AS b(dj), (VALUES (0), (1)) AS d(dk))
      SELECT key, round(sum(w * v), 6) AS sampled FROM w JOIN c ON c.i = qi AND c.j = qj AND c.k = qk GROUP BY key""",
)
def _(spark, sf):
    nj = table(spark, sf, "embeddings").count()
    g = RegularGrid((8, nj, 8), (0.0, 0.0, 0.0), (7.0, nj - 1.0, 7.0))
    return sample.sample_linear(_points3(spark, sf), _cube(spark, sf), g, ["key"]).select("key", r6("sampled").alias("sampled"))


# Unstructured and layered meshes: the plane's cells as quadrilateral faces.

SHIFTED = """, p AS (SELECT c_custkey AS k, CAST(c_custkey * 37 % 6200 AS DOUBLE) / 100 + 0.003 AS x, CAST(c_custkey * 91 % 4900 AS DOUBLE) / 100 + 0.004 AS y FROM customer),
  w AS (SELECT k, x, y, floor(x) + di AS qi, floor(y) + dj AS qj, di, dj, (CASE di WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE dj WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) AS w
        FROM p, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) AS o(di, dj)) """


def _shifted(spark, sf):
    key = F.col("c_custkey")
    part = lambda m, n, by: (key * m % n).cast("double") / 100 + by
    return table(spark, sf, "customer").select(key.alias("k"), part(37, 6200, 0.003).alias("x"), part(91, 4900, 0.004).alias("y"))


def _plane_mesh(spark, sf):
    g = unit_grid(spark, sf)
    return mesh.curvilinear_mesh(g.with_coordinates(field(spark, sf)).select("i", "j", "x", "y"), field(spark, sf), g.n)


@query(
    "g11_nearest_in_face",
    G + SHIFTED + """SELECT k, CAST(floor(any_value(y)) * 63 + floor(any_value(x)) AS BIGINT) AS face, arg_max(v, w) AS nearest FROM w JOIN g ON g.i = qi AND g.j = qj GROUP BY k""",
)
def _(spark, sf):
    nodes, faces = _plane_mesh(spark, sf)
    return mesh.sample_faces(_shifted(spark, sf), nodes, faces, ["k"], 4.0).select("k", "face", "nearest")


@query(
    "g13_layers",
    G + SHIFTED + """, s AS (SELECT k, sum(w * v) AS s FROM w JOIN g ON g.i = qi AND g.j = qj GROUP BY k)
      SELECT k, round(s * 2 + 10 * (k % 40) / 10.0, 4) AS value FROM s""",
)
def _(spark, sf):
    """Two layers, at heights 0 and 4: at height h the value is 2 v + 10 h."""
    nodes, faces = _plane_mesh(spark, sf)
    layers = nodes.withColumn("layer", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns(
        {"z": F.col("layer") * 4.0, "value": F.col("value") * 2 + F.col("layer") * 40.0}
    )
    asked = _shifted(spark, sf).withColumn("z", (F.col("k") % 40) / 10.0)
    return mesh.sample_layers(asked, layers, faces, ["k"], 4.0).select("k", F.round("value", 4).alias("value"))


@query(
    "g22_triangle_weights",
    """WITH p AS (SELECT c_custkey AS k, CAST(c_custkey % 89 AS DOUBLE) / 10 AS x, CAST(c_custkey % 71 AS DOUBLE) / 10 AS y FROM customer),
       w AS (SELECT k, ((x - 1) * 7 - 2 * (y - 1)) / 54 AS b, (8 * (y - 1) - (x - 1) * 1) / 54 AS c FROM p)
       SELECT k, round(1 - b - c, 6) AS a, round(b, 6) AS b, round(c, 6) AS c FROM w""",
)
def _(spark, sf):
    """Corners (1, 1), (9, 2), (3, 8)."""
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), ((F.col("c_custkey") % 89) / 10).alias("x"), ((F.col("c_custkey") % 71) / 10).alias("y"))
    corners = [(F.lit(a), F.lit(b)) for a, b in ((1.0, 1.0), (9.0, 2.0), (3.0, 8.0))]
    a, b, c = mesh.triangle_weights(F.col("x"), F.col("y"), corners)
    return rows.select("k", r6(a).alias("a"), r6(b).alias("b"), r6(c).alias("c"))


# Traces

TRACE_SEEDS = "WITH seeds AS (SELECT c_custkey AS seed, CAST(c_custkey % 40 AS DOUBLE) + 10 AS x, CAST(c_custkey % 30 AS DOUBLE) + 20 AS y FROM customer)"


def _plane(spark, sf, low: float, high: float) -> RegularGrid:
    """The table's grid, laid over a square."""
    return RegularGrid((NI, table(spark, sf, "embeddings").count()), (low, low), (high, high))


def _stream(spark, sf, rotation: bool = False) -> flow.Field | flow.StoredField:
    """A uniform wind (1, 0.5), or one that turns about (50, 50) at one radian a second, at the samples of the table."""
    g = _plane(spark, sf, -10.0, 110.0)
    places = g.with_coordinates(field(spark, sf))
    wind = [-(F.col("y") - 50), F.col("x") - 50] if rotation else [F.lit(1.0), F.lit(0.5)]
    return flow.field_from_tables(g, [places.select("i", "j", w.alias("value")) for w in wind])


def _seeds(spark, sf):
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(key.alias("seed"), ((key % 40) + 10.0).alias("x"), ((key % 30) + 20.0).alias("y"))


@query(
    "l4_euler_steps",
    TRACE_SEEDS + " SELECT seed AS stream, CAST(s.range AS INT) AS step, x + 2.0::DOUBLE * s.range AS x, y + 1.0::DOUBLE * s.range AS y, 2.0::DOUBLE * s.range AS time FROM seeds, range(7) s",
)
def _(spark, sf):
    return flow.advect(_seeds(spark, sf), _stream(spark, sf), 2.0, steps=6, method="euler", fixed=True).select("stream", "step", "x", "y", "time")


@query(
    "l5_turn",
    TRACE_SEEDS + """ SELECT seed AS stream, CAST(s.range AS INT) AS step, round(50 + (x - 50) * cos(s.range * 0.01::DOUBLE) - (y - 50) * sin(s.range * 0.01::DOUBLE), 3) AS x,
      round(50 + (x - 50) * sin(s.range * 0.01::DOUBLE) + (y - 50) * cos(s.range * 0.01::DOUBLE), 3) AS y FROM seeds, range(41) s""",
)
def _(spark, sf):
    """Fourth order steps around a circle against the exact turn."""
    out = flow.advect(_seeds(spark, sf), _stream(spark, sf, True), 0.01, steps=40, fixed=True)
    return out.select("stream", "step", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query(
    "l7_until_a_time",
    TRACE_SEEDS + """ SELECT seed AS stream, CAST(s.range AS INT) AS step, round(x + least(3.0::DOUBLE * s.range, 10), 6) AS x, round(least(3.0::DOUBLE * s.range, 10), 6) AS time FROM seeds, range(5) s""",
)
def _(spark, sf):
    """The last step is cut to end at the time asked for."""
    out = flow.advect(_seeds(spark, sf), _stream(spark, sf), 3.0, until=10.0, fixed=True)
    return out.select("stream", "step", r6("x").alias("x"), r6("time").alias("time"))


@query(
    "l8_both_ways",
    TRACE_SEEDS + " SELECT seed AS stream, CAST(s.range - 3 AS INT) AS step, x + 2.0::DOUBLE * (s.range - 3) AS x FROM seeds, range(7) s",
)
def _(spark, sf):
    return flow.bidirectional(_seeds(spark, sf), _stream(spark, sf), 2.0, steps=3, fixed=True).select("stream", "step", "x")


@query(
    "l10_property_along_traces",
    TRACE_SEEDS + """ SELECT seed AS stream, CAST(s.range AS INT) AS step, round(3 * (x + 2.0::DOUBLE * s.range) - 2 * (y + 1.0::DOUBLE * s.range), 6) AS scalar FROM seeds, range(4) s""",
)
def _(spark, sf):
    """A scalar that is linear in space is met exactly."""
    streams = flow.advect(_seeds(spark, sf), _stream(spark, sf), 2.0, steps=3, fixed=True)
    g = _plane(spark, sf, 0.0, 100.0)
    values = g.with_coordinates(field(spark, sf)).select("i", "j", (3 * F.col("x") - 2 * F.col("y")).alias("value"))
    out = flow.attach_property(streams, values, g, "scalar")
    return out.select("stream", "step", r6("scalar").alias("scalar"))


@query(
    "a15_first_step",
    "SELECT round(sqrt(28800) / (max(sqrt((120 * (a.range + 1) / 11.0::DOUBLE - 60) ** 2 + (120 * (b.range + 1) / 11.0::DOUBLE - 60) ** 2)) * sqrt(64 * 64 + max(nj) ** 2)), 6) AS dt FROM range(10) a, range(10) b, (SELECT count(*) AS nj FROM embeddings)",
)
def _(spark, sf):
    """From a lattice of samples of a field in tables."""
    g = _plane(spark, sf, -10.0, 110.0)
    places = g.with_coordinates(field(spark, sf))
    stored = flow.StoredField(g, [places.select("i", "j", w.alias("value")) for w in (-(F.col("y") - 50), F.col("x") - 50)])
    return spark.createDataFrame([(round(float(stored.first_step()), 6),)], "dt double")


WINDS = G + """, f AS (SELECT a.i, a.j, 8 * a.v AS u, 8 * b.v AS v FROM g a JOIN g b ON b.i = 63 - a.i AND b.j = a.j),
  seeds AS (SELECT s_suppkey AS stream, CAST(s_suppkey * 37 % 630 AS DOUBLE) / 10 AS x, CAST(s_suppkey * 91 % 4990 AS DOUBLE) / 10 AS y FROM supplier) """


def _winds(spark, sf) -> flow.StoredField:
    """The table's values as winds, kept in blocks."""
    values = field(spark, sf)
    across = [values.select("i", "j", (8 * F.col("value")).alias("value")), values.select((63 - F.col("i")).alias("i"), "j", (8 * F.col("value")).alias("value"))]
    return flow.StoredField(unit_grid(spark, sf), across, block=16)


def _wind_seeds(spark, sf):
    key = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(key.alias("seed"), ((key * 37 % 630).cast("double") / 10).alias("x"), ((key * 91 % 4990).cast("double") / 10).alias("y"))


@query(
    "l6_trace_in_stored_field",
    WINDS.replace("WITH g", "WITH RECURSIVE g") + """, t AS (SELECT stream, 0 AS step, x, y FROM seeds UNION ALL
      SELECT stream, step + 1, x + 0.9::DOUBLE * ((1 - p) * (1 - q) * a.u + p * (1 - q) * b.u + (1 - p) * q * c.u + p * q * d.u), y + 0.9::DOUBLE * ((1 - p) * (1 - q) * a.v + p * (1 - q) * b.v + (1 - p) * q * c.v + p * q * d.v)
      FROM (SELECT *, x - ci AS p, y - cj AS q FROM (SELECT *, CAST(least(floor(x), 62) AS INT) AS ci, CAST(least(floor(y), nj - 2) AS BIGINT) AS cj FROM t, n WHERE step < 12 AND x BETWEEN 0 AND 63 AND y BETWEEN 0 AND nj - 1))
      JOIN f a ON a.i = ci AND a.j = cj JOIN f b ON b.i = ci + 1 AND b.j = cj JOIN f c ON c.i = ci AND c.j = cj + 1 JOIN f d ON d.i = ci + 1 AND d.j = cj + 1)
      SELECT stream, CAST(step AS INT) AS step, round(x, 5) AS x, round(y, 5) AS y FROM t""",
)
def _(spark, sf):
    """Steps of Euler's method in a field that stays in blocks; a trace may leave the grid with its last step."""
    out = flow.advect(_wind_seeds(spark, sf), _winds(spark, sf), 0.9, steps=12, method="euler", fixed=True)
    return out.where("not special").select("stream", "step", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


# An unsteady field whose winds grow with time, one step for each third of the table: w(t) linear between the steps.


@query(
    "l7_unsteady_stored_field",
    WINDS + """SELECT stream, CAST(s.range AS INT) AS step, round(x + 0.25::DOUBLE * s.range + 0.015625::DOUBLE * s.range * s.range, 6) AS x, round(0.25::DOUBLE * s.range, 6) AS time
      FROM seeds, range(17) s WHERE x < 40""",
)
def _(spark, sf):
    """Winds 1, 3 and 5 along x at times 0, 4 and 8: fourth order steps are exact, x = x0 + t + t * t / 4."""
    base = field(spark, sf)
    steps = F.explode(F.array(*[F.lit(n) for n in range(3)]))
    along = base.withColumn("ts", steps).select("ts", "i", "j", (1.0 + 2.0 * F.col("ts")).alias("value"))
    stored = flow.StoredField(unit_grid(spark, sf), [along, along.withColumn("value", F.lit(0.0))], [0.0, 4.0, 8.0], block=16)
    out = flow.advect(_wind_seeds(spark, sf).where("x < 40"), stored, 0.25, until=4.0, fixed=True)
    return out.where("not special").select("stream", "step", r6("x").alias("x"), r6("time").alias("time"))


@query(
    "l10_property_between_steps",
    WINDS + """, w AS (SELECT CAST(j % 3 AS INT) AS ts, i, CAST(j // 3 AS INT) AS j, v FROM g), p AS (SELECT stream, 0.25::DOUBLE * s.range AS t, CAST(s.range AS INT) AS step, floor(x) AS i, floor(y / 4) AS j FROM seeds, range(9) s)
      SELECT stream, step, round(CASE WHEN t <= 1 THEN a.v * (1 - t) + b.v * t ELSE b.v * (1 - (t - 1) / 3) + c.v * ((t - 1) / 3) END, 6) AS scalar
      FROM p JOIN w a ON a.ts = 0 AND a.i = p.i AND a.j = p.j JOIN w b ON b.ts = 1 AND b.i = p.i AND b.j = p.j JOIN w c ON c.ts = 2 AND c.i = p.i AND c.j = p.j""",
)
def _(spark, sf):
    """Scalars of three steps at uneven times, on traces that stand at samples."""
    spots = _wind_seeds(spark, sf).select(F.col("seed").alias("stream"), F.floor("x").cast("double").alias("x"), F.floor(F.col("y") / 4).cast("double").alias("y"))
    each = spots.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(8)))).withColumns({"time": 0.25 * F.col("step"), "special": F.lit(False)})
    nj = table(spark, sf, "embeddings").count() // 3
    g = RegularGrid((NI, nj), (0.0, 0.0), (NI - 1.0, nj - 1.0))
    out = flow.attach_property(each, _steps(spark, sf).where(F.col("j") < nj), g, "scalar", [0.0, 1.0, 4.0])
    return out.where("y <= %d" % (nj - 1)).select("stream", "step", r6("scalar").alias("scalar"))


# Drawing data


@query(
    "r4_barbs",
    G + """, q AS (SELECT k, x, y, CASE WHEN x <= 63 AND y <= nj - 1 THEN CAST(floor(x) + CASE WHEN x - floor(x) > 0.5 THEN 1 ELSE 0 END AS INT) END AS qi,
      CASE WHEN x <= 63 AND y <= nj - 1 THEN CAST(floor(y) + CASE WHEN y - floor(y) > 0.5 THEN 1 ELSE 0 END AS INT) END AS qj FROM pts, n)
      SELECT k, round(x + 3 * v, 6) AS x_end, round(y - 6 * v, 6) AS y_end FROM q JOIN g ON g.i = qi AND g.j = qj""",
)
def _(spark, sf):
    values = field(spark, sf)
    parts = [values, values.withColumn("value", F.col("value") * -2)]
    return contour.barbs(points(spark, sf), parts, unit_grid(spark, sf), 3.0).select("k", r6("x_end").alias("x_end"), r6("y_end").alias("y_end"))


@query("r7_displaced", G + "SELECT i, CAST(j AS BIGINT) AS j, v AS value, round(v * v + 1, 6) AS z FROM g")
def _(spark, sf):
    values = field(spark, sf)
    return contour.displaced(values, values.withColumn("value", F.col("value") * F.col("value") + 1)).select("i", F.col("j").cast("long").alias("j"), "value", r6("z").alias("z"))


# Datasets, requests and the store

STEPS = G + ", t AS (SELECT CAST(j % 3 AS INT) AS ts, i, CAST(j // 3 AS INT) AS j, v FROM g) "


def _steps(spark, sf):
    j = F.col("j")
    return field(spark, sf).select((j % 3).cast("int").alias("ts"), "i", F.floor(j / 3).cast("int").alias("j"), "value")


def _timed(spark, sf) -> Dataset:
    data = Dataset(spark)
    data.times = [0.0, 10.0, 20.0]
    data.add_mesh(Mesh("plane", ("i", "j"), ("x", "y")), {"i": NI, "j": table(spark, sf, "embeddings").count() // 3})
    stored = [(ts, level, -1) for ts in range(3) for level in (-1, -2) if (ts, level) != (2, -1)]
    data.add_variable(Variable("wind", "plane", time_varying=True, levels=2), _steps(spark, sf), stored)
    data.add_derived(Variable("double", "plane", time_varying=True, levels=2, inputs=("wind",)), lambda d: d._tables["wind"].withColumn("value", F.col("value") * 2))
    return data


@query("p1_request", STEPS + "SELECT ts, i, j, v AS value FROM t WHERE ts = 1 AND i BETWEEN 3 AND 20 AND j BETWEEN 0 AND 30")
def _(spark, sf):
    return _timed(spark, sf).variable("wind", 1, [(3, 20), (0, 30)])


@query("d16_derived_variable", STEPS + "SELECT i, j, round(2 * v, 6) AS value FROM t WHERE ts = 2")
def _(spark, sf):
    return _timed(spark, sf).variable("double", 2).select("i", "j", r6("value").alias("value"))


@query("a2_data_range", STEPS + "SELECT CAST(ts AS INT) AS ts, min(v) AS low, max(v) AS high FROM t GROUP BY ts")
def _(spark, sf):
    data = _timed(spark, sf)
    return spark.createDataFrame([(ts, *data.data_range("wind", ts)) for ts in range(3)], "ts int, low double, high double")


@query(
    "m11_exists",
    STEPS + """, a AS (SELECT CAST(s.range AS INT) AS ts, CAST(-1 - l.range AS INT) AS level FROM range(4) s, range(2) l), e AS (SELECT DISTINCT ts FROM t)
       SELECT v.name, a.ts, level, e.ts IS NOT NULL AND NOT (a.ts = 2 AND level = -1) AS there FROM a LEFT JOIN e ON e.ts = a.ts, (VALUES ('wind'), ('double')) AS v(name)""",
)
def _(spark, sf):
    """The steps that the table has are those that exist, but for one level of the last."""
    data = _timed(spark, sf)
    steps = [r[0] for r in _steps(spark, sf).select("ts").distinct().collect()]
    data._stored["wind"] = {(ts, level, -1) for ts in steps for level in (-1, -2) if (ts, level) != (2, -1)}
    rows = [(n, ts, level, data.exists(n, ts, level)) for n in ("wind", "double") for ts in range(4) for level in (-1, -2)]
    return spark.createDataFrame(rows, "name string, ts int, level int, there boolean")


@query("m4_dimensions", "SELECT 'i' AS name, CAST(64 AS INT) AS length UNION ALL SELECT 'j', CAST(count(*) // 3 AS INT) FROM embeddings")
def _(spark, sf):
    return _timed(spark, sf).dimension_table()


@query("m3_meshes", "SELECT 'plane' AS name, 'i,j' AS dimensions, 'x,y' AS coordinates, CAST(64 * (count(*) // 3) AS BIGINT) AS samples, CAST(2 AS BIGINT) AS variables FROM embeddings")
def _(spark, sf):
    data = _timed(spark, sf)
    many = data.describe().groupBy("mesh").agg(F.count("*").alias("variables"))
    listed = data.mesh_table().select("name", F.array_join("dimensions", ",").alias("dimensions"), F.array_join("coordinates", ",").alias("coordinates"), F.lit(NI * data.dimensions["j"]).cast("long").alias("samples"))
    return listed.join(many, F.col("name") == F.col("mesh")).drop("mesh")


@query("m10_inputs", STEPS + "SELECT name, inputs, (SELECT count(*) FROM t WHERE ts = 1) AS samples FROM (VALUES ('double', 'wind,double'), ('wind', 'wind')) AS v(name, inputs)")
def _(spark, sf):
    """What variables depend on, and how many samples each has at a step."""
    data, out = _timed(spark, sf), None
    for n in ("double", "wind"):
        one = data.variable(n, 1).agg(F.count("*").alias("samples")).select(F.lit(n).alias("name"), F.lit(",".join(data.inputs(n))).alias("inputs"), "samples")
        out = one if out is None else out.unionByName(one)
    return out


@query("k1_store_round_trip", STEPS + "SELECT ts, i, j, v AS value FROM t")
def _(spark, sf):
    path = fresh_path(spark, "store")
    tables.write_variable(_steps(spark, sf), path, 16)
    return tables.read_variable(spark, path).select(F.col("ts").cast("int").alias("ts"), "i", "j", "value")


@query("k2_store_copy_box", STEPS + "SELECT ts, i, j, v AS value FROM t WHERE ts = 2 AND i BETWEEN 10 AND 40 AND j BETWEEN 5 AND 25")
def _(spark, sf):
    path, copy = fresh_path(spark, "store"), fresh_path(spark, "store")
    tables.write_variable(_steps(spark, sf), path, 16)
    tables.copy_variable(spark, path, copy, 8)
    return tables.read_variable(spark, copy, 2, [(10, 40), (5, 25)], 8).select(F.col("ts").cast("int").alias("ts"), "i", "j", "value")


@query("s10_files_as_series", G + "SELECT CAST(j % 3 AS INT) AS ts, count(*) AS n, round(sum(v), 4) AS total FROM g GROUP BY 1")
def _(spark, sf):
    """Three files with a time each, listed out of order."""
    files = [(field(spark, sf).where(F.col("j") % 3 == r).withColumn("step", F.lit(0)), [10.0 * r]) for r in (2, 0, 1)]
    out = tables.aggregate_files(files)
    return out.groupBy(F.col("ts").cast("int").alias("ts")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("s8_particles", "SELECT l_orderkey, l_linenumber, l_quantity AS x, l_extendedprice AS y, l_discount AS z FROM lineitem")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    return tables.particles(rows, ("l_quantity", "l_extendedprice", "l_discount"))


@query("l15_seed_list", "SELECT DISTINCT CAST(c_custkey % 50 AS DOUBLE) AS x, CAST(c_custkey % 7 AS DOUBLE) + 0.5 AS y, 0.25::DOUBLE AS z FROM customer")
def _(spark, sf):
    path, key = fresh_path(spark, "seeds"), F.col("c_custkey")
    line = F.concat((key % 50).cast("string"), F.lit(" , "), ((key % 7) + 0.5).cast("string"), F.lit(",0.25, 9"))
    table(spark, sf, "customer").select(F.when(key % 11 == 0, F.concat(F.lit("# "), line)).otherwise(line).alias("value")).unionByName(
        table(spark, sf, "customer").where(key % 11 == 0).select(line.alias("value"))
    ).write.text(path)
    return tables.read_seeds(spark, path)


# Names, units and formulas

UNIT = "CASE n_nationkey % 4 WHEN 0 THEN 'degrees_north' WHEN 1 THEN 'degreeE' WHEN 2 THEN 'm' ELSE 'degree_N' END"


@query("f9_axis_units", f"SELECT n_nationkey, {UNIT} LIKE '%\\_n%' ESCAPE '\\' OR {UNIT} = 'degree_N' AS latitude, {UNIT} = 'degreeE' AS longitude FROM nation")
def _(spark, sf):
    part = F.col("n_nationkey") % 4
    unit = F.when(part == 0, "degrees_north").when(part == 1, "degreeE").when(part == 2, "m").otherwise("degree_N")
    return table(spark, sf, "nation").select("n_nationkey", scalar.is_latitude(unit).alias("latitude"), scalar.is_longitude(unit).alias("longitude"))


@query("f23_formula_terms", "SELECT n_nationkey, n_nationkey % 3 = 0 AS valid, CASE WHEN n_nationkey % 3 <> 2 THEN 'eta_' || n_nationkey END AS eta FROM nation")
def _(spark, sf):
    key = F.col("n_nationkey")
    text = F.concat(
        F.lit(" s: s_rho "), F.when(key % 3 != 2, F.concat(F.lit("eta : eta_"), key.cast("string"))).otherwise(F.lit("zeta: z")), F.when(key % 3 == 1, F.lit(" more: m")).otherwise(F.lit("")), F.lit(" depth: h")
    )
    return table(spark, sf, "nation").select("n_nationkey", scalar.valid_formula(text, ["s", "eta", "depth"]).alias("valid"), scalar.formula_terms(text)["eta"].alias("eta"))


@query(
    "w17_sea_level_pressure",
    G + """, a AS (SELECT j, i AS k, 100000.0::DOUBLE - i * 1300 AS p, (300 + v - i * 0.1::DOUBLE) * ((100000.0::DOUBLE - i * 1300) * 1e-5) ** (2.0::DOUBLE / 7) * (1 + 0.608::DOUBLE * 0.01) AS t, 50 + i * 120.0::DOUBLE AS z FROM g),
      b AS (SELECT *, lead(p) OVER w AS pu, lead(t) OVER w AS tu, lead(z) OVER w AS zu FROM a WINDOW w AS (PARTITION BY j ORDER BY k)),
      c AS (SELECT * FROM b WHERE k = 8),
      d AS (SELECT j, 90000.0::DOUBLE AS at, ln(90000.0::DOUBLE / pu) * ln(p / pu) AS f, * EXCLUDE (j) FROM c),
      e AS (SELECT j, tu - (tu - t) * f AS ta, zu - (zu - z) * f AS za FROM d),
      s AS (SELECT j, ta * (100000 / 90000.0::DOUBLE) ** (0.0065::DOUBLE * 287.04 / 9.81) AS surface, ta + 0.0065::DOUBLE * za AS sea FROM e),
      x AS (SELECT j, surface, CASE WHEN surface <= 290.21::DOUBLE AND sea >= 290.21::DOUBLE THEN 290.21::DOUBLE ELSE 290.21::DOUBLE - 0.005::DOUBLE * (surface - 290.21::DOUBLE) ** 2 END AS fixed FROM s)
      SELECT j, round(0.01 * 100000 * exp(2.0::DOUBLE * 9.81 * 50 / (287.04::DOUBLE * (fixed + surface))), 4) AS slp FROM x""",
)
def _(spark, sf):
    """Columns of air along the vector: 100 hPa above the lowest level comes with level 8."""
    i = F.col("i")
    air = field(spark, sf).select("j", i.alias("k"), F.lit(0.0).alias("p"), (100000.0 - i * 1300).alias("pb"), (F.col("value") - i * 0.1).alias("t"), F.lit(0.01).alias("q"), (50 + i * 120.0).alias("height"))
    return atmosphere.sea_level_pressure(air, ["j"]).select("j", F.round("slp", 4).alias("slp"))


# Padding and blocks, statistics as text


def _padded(mode: str, place: str):
    @query(f"c9_pad_{mode}", G + f"SELECT i, j, v AS value FROM g UNION ALL SELECT CAST(p.range AS INT), j, {'0.0::DOUBLE' if mode == 'zero' else 'v'} FROM g, range(64, 72) p WHERE i = {place}")
    def _(spark, sf):
        return codec.pad_axis(field(spark, sf), "i", NI, 24, mode)


for _mode, _place in {"symmetric": "127 - p.range", "reflect": "126 - p.range", "periodic": "p.range - 64", "smooth": "63", "zero": "63"}.items():
    _padded(_mode, _place)


@query("c9_blocks", G + "SELECT CAST(i // 24 AS INT) AS bi, CAST(j // 10 AS INT) AS bj, CAST(i % 24 AS INT) AS oi, CAST(j % 10 AS INT) AS oj, v AS value FROM g")
def _(spark, sf):
    sizes = {"i": 24, "j": 10}
    there = codec.unblock(codec.blocks(field(spark, sf), sizes), sizes)
    return codec.blocks(there, sizes).drop("i", "j")


@query("k6_statistics_text", "SELECT event_type, count(value) AS n, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def _(spark, sf):
    path = fresh_path(spark, "statistics")
    rows = table(spark, sf, "events").groupBy("event_type").agg(F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    tables.write_statistics(rows, path)
    return spark.read.option("header", True).schema("event_type string, n long, low double, high double").csv(path)


@query("d3_fixed_coordinate", G + "SELECT i, CAST(j AS INT) AS j, v AS value FROM g")
def _(spark, sf):
    """A coordinate with two dimensions that is given as rows of numbers."""
    return box.fixed_rows(table(spark, sf, "embeddings"), "vec_id", "embedding")


@query("p13_hyper_slices", STEPS + "SELECT j AS slice, count(*) AS n, min(v) AS low FROM t WHERE ts = 1 GROUP BY j")
def _(spark, sf):
    """Every slice of a step, all from one table that is spread by slices."""
    slices = _timed(spark, sf).sliced("wind", 1)
    return slices.groupBy(F.col("j").alias("slice")).agg(F.count("*").alias("n"), F.min("value").alias("low"))


# Wavelets along several axes


@query(
    "c1_haar_2d",
    G + """, q AS (SELECT CAST(i // 2 AS INT) AS i, CAST(j // 2 AS INT) AS j, sum(v) FILTER (i % 2 = 0 AND j % 2 = 0) AS a, sum(v) FILTER (i % 2 = 1 AND j % 2 = 0) AS b,
        sum(v) FILTER (i % 2 = 0 AND j % 2 = 1) AS c, sum(v) FILTER (i % 2 = 1 AND j % 2 = 1) AS d FROM g GROUP BY 1, 2)
      SELECT i, j, CAST(CASE band WHEN 0 THEN 0 ELSE 1 END AS INT) AS level, CAST(band AS INT) AS band,
        round(CASE band WHEN 0 THEN a + b + c + d WHEN 1 THEN a - b + c - d WHEN 2 THEN a + b - c - d ELSE a - b - c + d END / 2, 6) AS value FROM q, (VALUES (0), (1), (2), (3)) AS x(band)""",
)
def _(spark, sf):
    """The number of vectors is even in all tables."""
    out = codec.decompose_nd(field(spark, sf), ["i", "j"], 1)
    return out.select("i", F.col("j").cast("int").alias("j"), "level", "band", r6("value").alias("value"))


@query("c2_round_trip_3d", CUBE + "SELECT i, j, k, round(v, 6) AS value FROM c")
def _(spark, sf):
    """Two levels along three axes and back; the last vectors are padded to a group of four and cut."""
    nj = table(spark, sf, "embeddings").count()
    cube = codec.pad_axis(_cube(spark, sf), "j", nj, 4)
    back = codec.cut_axis(codec.reconstruct_nd(codec.decompose_nd(cube, ["i", "j", "k"], 2), ["i", "j", "k"], 2), "j", nj)
    return back.select(*[F.col(a).cast("int").alias(a) for a in ("i", "j", "k")], r6("value").alias("value"))


@query(
    "m9_length_at_level",
    """SELECT CAST(l.range AS INT) AS down, CAST(greatest(1, n // 64 * (64 >> l.range) + ((n % 64) >> l.range)) AS INT) AS length FROM (SELECT count(*) // 3 AS n FROM embeddings), range(3) l""",
)
def _(spark, sf):
    data = _timed(spark, sf)
    data.variables["wind"].levels = 3
    return spark.createDataFrame([(down, data.shape("wind", -1 - down)[1]) for down in range(3)], "down int, length int")
