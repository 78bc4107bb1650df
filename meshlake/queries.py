"""Queries over the driver's tables and the SQL that gives the same rows.

The ``embeddings`` table is read as a 2-D regular grid (i along the vector, j the vector's
number), ``events`` as time series, ``lineitem`` as a particle cloud.  Results are
rounded where sums depend on their order.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import atmosphere, colour, scalar
from .operators import box, codec, contour, flow, grid, mesh, sample, stats, stencil, timeline
from .operators.grid import RegularGrid
from .plans.catalog import Dataset, Mesh, Variable
from .plans.registry import Registry
from .streaming import series

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

NI = 64
#: The grid as a table, and the same with some samples missing.
G = """WITH g AS (SELECT CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS i, vec_id AS j,
  CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
  h AS (SELECT i, j, CASE WHEN (i * 7 + j * 3) % 11 = 0 THEN NULL ELSE v END AS v FROM g),
  n AS (SELECT max(j) + 1 AS nj FROM g),
  pts AS (SELECT c_custkey AS k, CAST(c_custkey * 37 % 6300 AS DOUBLE) / 100 AS x, CAST(c_custkey * 91 % 49900 AS DOUBLE) / 100 AS y FROM customer) """


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.from_arrays(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    hole = (F.col("i") * 7 + F.col("j") * 3) % 11 == 0
    return field(spark, sf_dir).withColumn("value", F.when(~hole, F.col("value")))


def unit_grid(spark: SparkSession, sf_dir: str) -> RegularGrid:
    """The grid with one unit between samples."""
    nj = table(spark, sf_dir, "embeddings").count()
    return RegularGrid((NI, nj), (0.0, 0.0), (NI - 1.0, nj - 1.0))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("k"), ((key * 37 % 6300).cast("double") / 100).alias("x"), ((key * 91 % 49900).cast("double") / 100).alias("y")
    )


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# Requests and predicates


@query("p3_index_box", G + "SELECT i, j, v AS value FROM g WHERE i BETWEEN 8 AND 23 AND j BETWEEN 10 AND 109")
def _(spark, sf):
    return grid.subset(field(spark, sf), [(8, 23), (10, 109)])


@query("p2_block_superset", G + "SELECT i, j, v AS value FROM g WHERE i BETWEEN 0 AND 31 AND j BETWEEN 0 AND 111")
def _(spark, sf):
    return grid.block_superset(field(spark, sf), [(8, 23), (10, 109)], 16)


@query(
    "p4_coordinate_box",
    G + "SELECT i, j, CAST(i * 0.5 - 2 AS DOUBLE) AS x, CAST(j * 0.25 AS DOUBLE) AS y, v AS value FROM g WHERE i * 0.5 - 2 BETWEEN 1 AND 7.3 AND j * 0.25 BETWEEN 3.1 AND 20",
)
def _(spark, sf):
    nj = table(spark, sf, "embeddings").count()
    g = RegularGrid((NI, nj), (-2.0, 0.0), (-2.0 + 0.5 * (NI - 1), 0.25 * (nj - 1)))
    box = g.index_box([(1.0, 7.3), (3.1, 20.0)])
    return g.with_coordinates(grid.subset(field(spark, sf), box)).select("i", "j", r6("x").alias("x"), r6("y").alias("y"), "value")


@query("p6_cells_in_box", G + "SELECT DISTINCT i AS ci, CAST(j AS INT) AS cj FROM g WHERE i BETWEEN 8 AND 22 AND j BETWEEN 10 AND 108")
def _(spark, sf):
    return grid.cells_in_box(field(spark, sf), unit_grid(spark, sf), [(8, 23), (10, 109)])


@query("p7_missing", G + "SELECT j, count(*) - count(v) AS n_missing FROM h GROUP BY j")
def _(spark, sf):
    return gappy(spark, sf).groupBy("j").agg(F.count(F.when(F.col("value").isNull(), 1)).alias("n_missing"))


@query(
    "p9_periodic_coordinate",
    """SELECT event_id, round(CASE WHEN value < 100 THEN value + ceil((100 - value) / 60) * 60
       WHEN value > 160 THEN value - ceil((value - 160) / 60) * 60 ELSE value END, 6) AS wrapped FROM events""",
)
def _(spark, sf):
    g = RegularGrid((7,), (100.0,), (160.0,))
    return table(spark, sf, "events").select("event_id", r6(g.wrap(0, F.col("value"))).alias("wrapped"))


@query("p11_stride", G + "SELECT i, j, v AS value FROM g WHERE i % 5 = 0 AND j % 5 = 0")
def _(spark, sf):
    return grid.stride(field(spark, sf), 5)


@query(
    "m13_variables",
    """SELECT 'embedding' AS name, 'data' AS kind, CAST(2 AS INT) AS topology, CAST(64 AS INT) AS length_i, CAST((SELECT max(vec_id) + 1 FROM embeddings) AS INT) AS length_j""",
)
def _(spark, sf):
    data = _dataset(spark, sf)
    return data.describe().where("name = 'embedding'").select(
        "name", "kind", "topology", F.col("shape")[0].alias("length_i"), F.col("shape")[1].alias("length_j")
    )


def _dataset(spark: SparkSession, sf: str) -> Dataset:
    g = unit_grid(spark, sf)
    data = Dataset(spark)
    data.add_mesh(Mesh("plane", ("i", "j"), ("x", "y")), {"i": g.n[0], "j": g.n[1]})
    data.add_variable(Variable("embedding", "plane"), field(spark, sf))
    data.add_variable(Variable("rounded", "plane"), field(spark, sf).withColumn("value", F.round("value", 2)))
    return data


# Sampling


@query(
    "g3_nearest",
    G + """, q AS (SELECT k, CASE WHEN x <= 63 AND y <= nj - 1 THEN CAST(floor(x) + CASE WHEN x - floor(x) > 0.5 THEN 1 ELSE 0 END AS INT) END AS qi,
      CASE WHEN x <= 63 AND y <= nj - 1 THEN CAST(floor(y) + CASE WHEN y - floor(y) > 0.5 THEN 1 ELSE 0 END AS INT) END AS qj FROM pts, n)
      SELECT q.k, g.v AS sampled FROM q LEFT JOIN g ON g.i = q.qi AND g.j = q.qj""",
)
def _(spark, sf):
    return sample.sample_nearest(points(spark, sf), field(spark, sf), unit_grid(spark, sf)).select("k", "sampled")


LINEAR = """, q AS (SELECT k, x, y, least(floor(x), 62) AS ci, least(floor(y), nj - 2) AS cj, x <= 63 AND y <= nj - 1 AS ok FROM pts, n),
  w AS (SELECT k, ci + di AS qi, cj + dj AS qj, (CASE di WHEN 1 THEN x - ci ELSE 1 - (x - ci) END) * (CASE dj WHEN 1 THEN y - cj ELSE 1 - (y - cj) END) AS w
        FROM q, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) AS o(di, dj) WHERE ok),
  s AS (SELECT w.k, CASE WHEN count(*) = count(t.v) THEN sum(w.w * t.v) END AS s FROM w LEFT JOIN {t} t ON t.i = w.qi AND t.j = w.qj WHERE w.w <> 0 GROUP BY w.k)
  SELECT pts.k, round(s.s, 6) AS sampled FROM pts LEFT JOIN s USING (k)"""


@query("g4_linear", G + LINEAR.format(t="g"))
def _(spark, sf):
    return sample.sample_linear(points(spark, sf), field(spark, sf), unit_grid(spark, sf), ["k"]).select("k", r6("sampled").alias("sampled"))


@query("g5_linear_with_missing", G + LINEAR.format(t="h"))
def _(spark, sf):
    return sample.sample_linear(points(spark, sf), gappy(spark, sf), unit_grid(spark, sf), ["k"]).select("k", r6("sampled").alias("sampled"))


@query(
    "g7_stretched_axis",
    G + """, a AS (SELECT CAST(i AS INT) AS i, i * i / 63.0 AS a, (i + 1) * (i + 1) / 63.0 AS b FROM range(63) r(i))
      SELECT pts.k, a.i AS cell, round((x - a.a) / (a.b - a.a), 6) AS weight FROM pts LEFT JOIN a ON x >= a.a AND (x < a.b OR (a.i = 62 AND x = a.b))""",
)
def _(spark, sf):
    axis = spark.range(NI).select(F.col("id").cast("int").alias("i"), (F.col("id") * F.col("id") / 63.0).alias("a"))
    return sample.locate(points(spark, sf), axis, "i", "a", "x").select("k", "cell", r6("weight").alias("weight"))


@query(
    "g7_stretched_values",
    G + """, a AS (SELECT CAST(i AS INT) AS i, i * i / 63.0 AS a, (i + 1) * (i + 1) / 63.0 AS b FROM range(63) r(i)),
      l AS (SELECT k, a.i AS ci, (x - a.a) / (a.b - a.a) AS p, least(floor(y), nj - 2) AS cj, y - least(floor(y), nj - 2) AS q FROM pts JOIN a ON x >= a.a AND (x < a.b OR (a.i = 62 AND x = a.b)), n WHERE y <= nj - 1),
      w AS (SELECT k, ci + di AS qi, cj + dj AS qj, (CASE di WHEN 1 THEN p ELSE 1 - p END) * (CASE dj WHEN 1 THEN q ELSE 1 - q END) AS w FROM l, (VALUES (0), (1)) AS a(di), (VALUES (0), (1)) AS b(dj)),
      s AS (SELECT k, CASE WHEN count(v) FILTER (WHERE w <> 0) = count(*) FILTER (WHERE w <> 0) THEN sum(w * v) END AS s FROM w JOIN h ON h.i = qi AND h.j = qj GROUP BY k)
      SELECT pts.k, round(s, 6) AS sampled FROM pts LEFT JOIN s ON s.k = pts.k""",
)
def _(spark, sf):
    """Linear samples on a grid with a stretched axis and an even one; some samples are missing."""
    x_axis = spark.range(NI).select(F.col("id").cast("int").alias("i"), (F.col("id") * F.col("id") / 63.0).alias("x"))
    y_axis = box.index_coordinate(spark, unit_grid(spark, sf).n[1], "j").withColumnRenamed("value", "y")
    out = sample.sample_stretched(points(spark, sf), gappy(spark, sf), [x_axis, y_axis], ["k"])
    return out.select("k", r6("sampled").alias("sampled"))


@query(
    "g14_cells",
    G + "SELECT k, CAST(least(floor(x), 62) AS INT) AS ci, CAST(least(floor(y), nj - 2) AS INT) AS cj FROM pts, n",
)
def _(spark, sf):
    g = unit_grid(spark, sf)
    return points(spark, sf).select("k", g.cell(0, F.col("x")).alias("ci"), g.cell(1, F.col("y")).alias("cj"))


@query(
    "g17_block_extents",
    G + """SELECT CAST(floor(i / 16.0) AS INT) AS bi, CAST(floor(j / 16.0) AS INT) AS bj, min(v) AS low, max(v) AS high, count(v) AS n_present FROM h GROUP BY 1, 2""",
)
def _(spark, sf):
    return grid.block_extents(gappy(spark, sf), 16)


@query(
    "g18_cell_nodes",
    G + """SELECT CAST(i - di AS INT) AS ci, CAST(j - dj AS INT) AS cj, CAST(di + 2 * dj AS INT) AS corner, v AS value
      FROM g, n, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) AS o(di, dj) WHERE i - di BETWEEN 0 AND 62 AND j - dj BETWEEN 0 AND nj - 2""",
)
def _(spark, sf):
    return grid.cell_corners(field(spark, sf), unit_grid(spark, sf)).select("ci", "cj", "corner", "value")


@query(
    "g19_cell_neighbours",
    G + """, c AS (SELECT i AS ci, CAST(j AS INT) AS cj FROM g, n WHERE i < 63 AND j < nj - 1)
       SELECT ci, cj, CAST(ci + di AS INT) AS ni, CAST(cj + dj AS INT) AS nj FROM c, n, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) AS o(di, dj)
       WHERE ci + di BETWEEN 0 AND 62 AND cj + dj BETWEEN 0 AND n.nj - 2""",
)
def _(spark, sf):
    g = unit_grid(spark, sf)
    cells = field(spark, sf).where((F.col("i") < g.n[0] - 1) & (F.col("j") < g.n[1] - 1)).select(F.col("i").alias("ci"), F.col("j").cast("int").alias("cj"))
    return grid.neighbours(cells, g)


@query(
    "g25_nearest_point",
    """WITH a AS (SELECT c_custkey AS k, c_acctbal AS x, CAST(c_custkey % 997 AS DOUBLE) AS y FROM customer),
       b AS (SELECT s_suppkey AS t, s_acctbal AS x, CAST(s_suppkey * 13 % 997 AS DOUBLE) AS y FROM supplier),
       d AS (SELECT k, t, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM a, b),
       m AS (SELECT k, min(struct_pack(d := d, t := t)) AS m FROM d GROUP BY k)
       SELECT a.k, m.m.t AS nearest, round(m.m.d, 6) AS distance FROM a LEFT JOIN m USING (k)""",
)
def _(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 997).cast("double").alias("y"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("t"), F.col("s_acctbal").alias("x"), (F.col("s_suppkey") * 13 % 997).cast("double").alias("y"))
    return sample.nearest_neighbour(a, b, ["k"], "t", 100.0).select("k", "nearest", r6("distance").alias("distance"))


@query(
    "g26_slice",
    G + """, p AS (SELECT CAST(id % 20 AS INT) AS row, CAST(id // 20 AS INT) AS col FROM range(400) r(id)),
      q AS (SELECT row, col, 5 + row / 19.0 * 40 + col / 19.0 * 10 AS x, 3 + row / 19.0 * 8 + col / 19.0 * 90 AS y FROM p),
      r AS (SELECT row, col, CAST(floor(x) + CASE WHEN x - floor(x) > 0.5 THEN 1 ELSE 0 END AS INT) AS qi, CAST(floor(y) + CASE WHEN y - floor(y) > 0.5 THEN 1 ELSE 0 END AS INT) AS qj FROM q)
      SELECT row, col, g.v AS sampled FROM r LEFT JOIN g ON g.i = qi AND g.j = qj""",
)
def _(spark, sf):
    plane = sample.slice_points(spark, (5, 3), (40, 8), (10, 90), 20)
    return sample.sample_nearest(plane, field(spark, sf), unit_grid(spark, sf)).select("row", "col", "sampled")


@query(
    "t1_transect",
    G + """, q AS (SELECT CAST(id AS INT) AS step, CASE id WHEN 99 THEN 60.5 ELSE 2 + id / 99.0 * 58.5 END AS x, CASE id WHEN 99 THEN 120.25 ELSE 3.5 + id / 99.0 * 116.75 END AS y, id / 99.0 * sqrt(58.5 * 58.5 + 116.75 * 116.75) AS distance FROM range(100) r(id)),
      w AS (SELECT step, floor(x) + di AS qi, floor(y) + dj AS qj, (CASE di WHEN 1 THEN x - floor(x) ELSE 1 - x + floor(x) END) * (CASE dj WHEN 1 THEN y - floor(y) ELSE 1 - y + floor(y) END) AS w FROM q, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) AS o(di, dj)),
      s AS (SELECT step, sum(w * v) AS s FROM w JOIN g ON g.i = qi AND g.j = qj GROUP BY step)
      SELECT step, round(distance, 6) AS distance, round(s, 6) AS sampled FROM q JOIN s USING (step)""",
)
def _(spark, sf):
    line = sample.transect(spark, (2.0, 3.5), (60.5, 120.25), 100)
    found = sample.sample_linear(line, field(spark, sf), unit_grid(spark, sf), ["step"])
    return line.join(found, "step").select("step", r6("distance").alias("distance"), r6("sampled").alias("sampled"))


@query(
    "t2_series_at_point",
    G + "SELECT j, round(max(CASE WHEN i = 10 THEN v END) * 0.75 + max(CASE WHEN i = 11 THEN v END) * 0.25, 6) AS sampled FROM g GROUP BY j",
)
def _(spark, sf):
    at = field(spark, sf).select("j").distinct().withColumn("x", F.lit(10.25)).withColumn("y", F.col("j").cast("double"))
    return sample.sample_linear(at, field(spark, sf), unit_grid(spark, sf), ["j"]).select("j", r6("sampled").alias("sampled"))


# Joins


@query("j1_side_by_side", G + "SELECT i, CAST(j AS BIGINT) AS j, v AS embedding, round(v, 2) AS rounded FROM g")
def _(spark, sf):
    return _dataset(spark, sf).together(["embedding", "rounded"])


AS_OF = """WITH s AS (SELECT epoch_us(ts) AS t, max(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1),
  p AS (SELECT event_id, epoch_us(ts) AS t FROM events WHERE event_type = 'click'),
  b AS (SELECT event_id, p.t, s.t AS bt, s.v AS bv FROM p ASOF LEFT JOIN s ON p.t >= s.t),
  a AS (SELECT event_id, s.t AS nt, s.v AS av FROM p ASOF LEFT JOIN s ON p.t <= s.t) """


def _views(spark, sf):
    e = table(spark, sf, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    return e.where("event_type = 'click'").select("event_id", "t"), e.where("event_type = 'view'").groupBy("t").agg(F.max("value").alias("v"))


@query(
    "j5_as_of_linear",
    AS_OF + """SELECT event_id, round(CASE WHEN bt IS NULL OR nt IS NULL THEN NULL WHEN nt = bt THEN bv
      ELSE bv * (1 - (t - bt) / CAST(nt - bt AS DOUBLE)) + av * ((t - bt) / CAST(nt - bt AS DOUBLE)) END, 6) AS v FROM a JOIN b USING (event_id)""",
)
def _(spark, sf):
    asked, steps = _views(spark, sf)
    day = lambda d: d.withColumn("one", F.lit(0))  # noqa: E731  one series
    return timeline.as_of_linear(day(asked), day(steps), ["one"], "t", "v").select("event_id", r6("v").alias("v"))


@query(
    "j6_nearest_step",
    AS_OF + "SELECT event_id, CASE WHEN bt IS NULL OR nt - t < t - bt THEN nt ELSE bt END AS step FROM a JOIN b USING (event_id)",
)
def _(spark, sf):
    asked, steps = _views(spark, sf)
    found = timeline.nearest_step(asked.select("t").distinct(), steps.select("t", F.col("t").alias("step")), "t")
    return asked.join(found, "t").select("event_id", "step")


@query(
    "j7_step_ranges",
    """WITH m AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS g, CAST(floor(value / 50) AS BIGINT) AS step FROM events WHERE event_type = 'purchase')
       SELECT step, min(g) AS first_step, max(g) AS last_step FROM m GROUP BY step""",
)
def _(spark, sf):
    from pyspark.sql import Window

    e = table(spark, sf, "events").where("event_type = 'purchase'")
    rank = F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id")) - 1
    mapping = e.select(rank.cast("long").alias("global_step"), F.floor(F.col("value") / 50).alias("step"))
    return timeline.step_ranges(mapping)


@query(
    "j8_face_nodes",
    """SELECT n_regionkey AS face, round(CASE WHEN count(b) = count(*) THEN avg(b) END, 6) AS value, count(*) AS n_nodes
       FROM nation LEFT JOIN (SELECT s_nationkey, avg(s_acctbal) AS b FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey GROUP BY 1""",
)
def _(spark, sf):
    balance = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("value"))
    nodes = table(spark, sf, "nation").join(balance, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(F.col("n_nationkey").alias("node"), "value")
    faces = table(spark, sf, "nation").select(F.col("n_regionkey").alias("face"), F.col("n_nationkey").alias("slot"), F.col("n_nationkey").alias("node"))
    return mesh.face_values(faces, nodes).select("face", r6("value").alias("value"), "n_nodes")


@query(
    "g20_node_faces",
    """SELECT c_nationkey AS node, list_sort(list(DISTINCT c_mktsegment)) AS faces FROM customer GROUP BY 1""",
)
def _(spark, sf):
    links = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("face"), F.lit(0).alias("slot"), F.col("c_nationkey").alias("node"))
    return mesh.node_faces(links)


COMPARE = """SELECT {by} count(*) AS n, round(max(abs(a - b)), 6) AS l_max, round(sqrt(avg((a - b) * (a - b))), 6) AS rms,
  round(max(abs(a - b)) / (max(a) - min(a)), 6) AS nl_max, round(sqrt(avg((a - b) * (a - b))) / (max(a) - min(a)), 6) AS nrms,
  round(max(abs(a - b)) / max(abs(a)), 6) AS relative FROM c {group}"""


@query("a13_compare", G + ", c AS (SELECT j, v AS a, round(v, 1) AS b FROM h WHERE v IS NOT NULL) " + COMPARE.format(by="", group=""))
def _(spark, sf):
    left = gappy(spark, sf)
    out = stats.compare(left, left.withColumn("value", F.round("value", 1)), ["i", "j"])
    return out.select("n", *[r6(c).alias(c) for c in out.columns if c != "n"])


@query("a14_compare_by_step", G + ", c AS (SELECT j, v AS a, round(v, 1) AS b FROM h WHERE v IS NOT NULL) " + COMPARE.format(by="j,", group="GROUP BY j"))
def _(spark, sf):
    left = gappy(spark, sf)
    out = stats.compare(left, left.withColumn("value", F.round("value", 1)), ["i", "j"], ["j"])
    return out.select("j", "n", *[r6(c).alias(c) for c in out.columns if c not in ("j", "n")])


# Aggregates

SUMMARY = "min({v}) AS low, max({v}) AS high, round(avg({v}), 6) AS mean, count({v}) AS n, round(stddev_pop({v}), 6) AS stddev"


@query("a3_summary", G + f"SELECT {SUMMARY.format(v='v')} FROM h WHERE i BETWEEN 8 AND 23 AND j BETWEEN 10 AND 109")
def summary_of_box(spark, sf):
    out = stats.summary(grid.subset(gappy(spark, sf), [(8, 23), (10, 109)]))
    return out.select("low", "high", r6("mean").alias("mean"), "n", r6("stddev").alias("stddev"))


@query("a1_range", G + "SELECT j, min(v) AS low, max(v) AS high FROM h GROUP BY j")
def _(spark, sf):
    return stats.value_range(gappy(spark, sf), ["j"])


@query("a4_upper_median", G + "SELECT list_sort(list(v))[count(v) // 2 + 1] AS median FROM h WHERE v IS NOT NULL")
def _(spark, sf):
    return stats.upper_median(gappy(spark, sf))


@query(
    "a4_upper_median_by_type",
    "SELECT event_type, list_sort(list(value))[count(*) // 2 + 1] AS median FROM events GROUP BY 1",
)
def _(spark, sf):
    return stats.upper_median_by(table(spark, sf, "events"), ["event_type"])


@query("a5_series_summary", f"SELECT event_type, {SUMMARY.format(v='value')} FROM events GROUP BY 1")
def _(spark, sf):
    out = stats.summary(table(spark, sf, "events"), ["event_type"])
    return out.select("event_type", "low", "high", r6("mean").alias("mean"), "n", r6("stddev").alias("stddev"))


HISTOGRAM = """WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events), b AS (
  SELECT CASE WHEN value < 100 THEN 'below' WHEN value > 300 THEN 'above' ELSE 'inside' END AS side,
  CAST(CASE WHEN value < 100 THEN least(4, floor((value - 0) / (100 - 0) * 5)) WHEN value > 300 THEN least(9, floor((value - 300) / (500 - 300) * 10))
  ELSE greatest(0, least(19, floor((value - 100) / 200 * 20))) END AS INT) AS bin FROM events),
  c AS (SELECT side, bin, count(*) AS n FROM b GROUP BY 1, 2) """


def _histogram(spark, sf):
    return stats.histogram(table(spark, sf, "events"), 100.0, 300.0, 20, 5, 10, (0.0, 500.0))


@query("a7_histogram", HISTOGRAM + "SELECT * FROM c")
def _(spark, sf):
    return _histogram(spark, sf)


@query("a9_max_bin", HISTOGRAM + "SELECT greatest(coalesce(max(n), 0), 1) AS largest FROM c WHERE side = 'inside' AND bin BETWEEN 3 AND 11")
def _(spark, sf):
    return stats.max_bin(_histogram(spark, sf), 3, 12)


@query("a9_strided_bins", HISTOGRAM + "SELECT CAST(bin // 4 AS INT) AS bin, max(n) AS largest FROM c WHERE side = 'inside' GROUP BY 1")
def _(spark, sf):
    return stats.strided_bins(_histogram(spark, sf), 4)


@query("a9_normalised_bins", HISTOGRAM + "SELECT bin, round(n / CAST((SELECT max(n) FROM c WHERE side = 'inside') AS DOUBLE), 6) AS share FROM c WHERE side = 'inside'")
def _(spark, sf):
    return stats.normalised_bins(_histogram(spark, sf)).select("bin", r6("share").alias("share"))


@query(
    "a10_particle_histogram",
    """WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
       SELECT CAST(floor(31 * ((l_extendedprice - lo) / (hi - lo))) AS INT) AS bin, count(*) AS n FROM lineitem, e GROUP BY 1""",
)
def _(spark, sf):
    return stats.particle_histogram(table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("value")), 32)


DENSITY = """WITH b AS (SELECT CAST(least(31, floor((l_quantity - 1) / 49 * 32)) AS INT) AS x, CAST(least(31, floor(l_discount / 0.1 * 32)) AS INT) AS y,
  CAST(least(3, floor(l_tax / 0.08 * 4)) AS INT) AS z, l_extendedprice AS p FROM lineitem),
  c AS (SELECT x, y, z, count(*) AS n, avg(p) AS m FROM b GROUP BY 1, 2, 3),
  l AS (SELECT CAST(a.range AS INT) AS x, CAST(b.range AS INT) AS y, CAST(c.range AS INT) AS z FROM range(32) a, range(32) b, range(4) c)
  SELECT x AS bl_quantity, y AS bl_discount, z AS bl_tax, coalesce(n, 0) AS density, round(m, 7) AS mean FROM l LEFT JOIN c USING (x, y, z)"""


@query("a11_particle_density", DENSITY)
def _(spark, sf):
    out = stats.particle_bins(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], (1.0, 0.0, 0.0), (50.0, 0.1, 0.08), (32, 32, 4), "l_extendedprice")
    return out.withColumn("mean", F.round("mean", 7))


@query(
    "a16_extent_intersection",
    """SELECT greatest(a.lo, b.lo) AS x_low, least(a.hi, b.hi) AS x_high FROM
       (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) a, (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier) b""",
)
def _(spark, sf):
    sides = [table(spark, sf, t).select(F.col(c).alias("x")) for t, c in (("customer", "c_acctbal"), ("supplier", "s_acctbal"))]
    return stats.extents(sides, ["x"], union=False)


@query(
    "a17_extent_union",
    """SELECT least(a.lo, b.lo) AS x_low, greatest(a.hi, b.hi) AS x_high FROM
       (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) a, (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier) b""",
)
def _(spark, sf):
    sides = [table(spark, sf, t).select(F.col(c).alias("x")) for t, c in (("customer", "c_acctbal"), ("supplier", "s_acctbal"))]
    return stats.extents(sides, ["x"])


STREAMS = """WITH s AS (SELECT l_orderkey AS stream, l_linenumber AS step, any_value(l_quantity) AS x, any_value(l_discount) AS y, any_value(l_tax) AS z, any_value(l_extendedprice) AS p,
  l_linenumber % 5 = 4 AS special FROM (SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity, min(l_discount) AS l_discount, min(l_tax) AS l_tax, min(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1, 2) GROUP BY 1, 2) """


def _streams(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("stream"), F.col("l_linenumber").alias("step")).agg(
        F.min("l_quantity").alias("x"), F.min("l_discount").alias("y"), F.min("l_tax").alias("z"), F.min("l_extendedprice").alias("p")
    )
    return rows.withColumn("special", F.col("step") % 5 == 4)


@query(
    "a20_line_integral",
    STREAMS + """, t AS (SELECT *, sum(CASE WHEN special THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY step) AS seg FROM s),
      u AS (SELECT *, coalesce(p * sqrt((x - lag(x) OVER w) ^ 2 + (y - lag(y) OVER w) ^ 2 + (z - lag(z) OVER w) ^ 2) * 0.001, 0) AS d FROM t WHERE NOT special WINDOW w AS (PARTITION BY stream, seg ORDER BY step))
      SELECT stream, step, round(sum(d) OVER (PARTITION BY stream, seg ORDER BY step), 4) AS integral FROM u""",
)
def _(spark, sf):
    return stats.running_integral(_streams(spark, sf), "p", 0.001).select("stream", "step", F.round("integral", 4).alias("integral"))


@query("a21_final_value", STREAMS + "SELECT stream, step, last_value(p) OVER (PARTITION BY stream ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS p FROM s")
def _(spark, sf):
    return stats.final_value(_streams(spark, sf), "p").select("stream", "step", "p")


# Stencils


def _difference(column: str, order: int, n: str, axis: str, other: str, dx: str) -> str:
    """SQL of a difference quotient along an axis."""
    edge, *parts = stencil.STENCILS[order]

    def terms(weights):
        out = []
        for s, w in weights.items():
            value = column if s == 0 else f"lead({column}, {s}) OVER w" if s > 0 else f"lag({column}, {-s}) OVER w"
            out.append(f"CAST({w!r} AS DOUBLE) * {value}")
        return "(" + " + ".join(out) + ")"

    start, middle, end = map(terms, parts)
    return f"(CASE WHEN {axis} < {edge} THEN {start} WHEN {axis} >= {n} - {edge} THEN {end} ELSE {middle} END) / {dx}"


for _o in (2, 4, 6):

    def _derivative(spark, sf, order=_o):
        return stencil.derivative(field(spark, sf), "i", NI, 0.5, order).select("i", "j", r6("derivative").alias("derivative"))

    query(
        f"w{_o // 2}_derivative_{_o}",
        G + f"SELECT i, j, round({_difference('v', _o, '64', 'i', 'j', '0.5')}, 6) AS derivative FROM g WINDOW w AS (PARTITION BY j ORDER BY i)",
    )(_derivative)


@query(
    "w4_derivative_by_variable",
    G + f""", s AS (SELECT i, j, v, v * 0.05 + i AS o FROM g), d AS (SELECT i, j, {_difference('v', 6, '64', 'i', 'j', '1')} AS a, {_difference('o', 6, '64', 'i', 'j', '1')} AS b FROM s WINDOW w AS (PARTITION BY j ORDER BY i))
      SELECT i, j, round(CASE WHEN b <> 0 THEN a / b END, 4) AS derivative FROM d""",
)
def _(spark, sf):
    rows = field(spark, sf).withColumn("o", F.col("value") * 0.05 + F.col("i"))
    return stencil.derivative_by(rows, "i", NI, "o").select("i", "j", F.round("derivative", 4).alias("derivative"))


VECTORS = """, s AS (SELECT i, j, v AS u, v * v + i * 0.01 AS w FROM g),
  p AS (SELECT i, j, {ui} AS ui, {wi} AS wi FROM s WINDOW w AS (PARTITION BY j ORDER BY i)),
  q AS (SELECT i, j, {uj} AS uj, {wj} AS wj FROM s, n WINDOW w AS (PARTITION BY i ORDER BY j)) """.format(
    ui=_difference("u", 6, "64", "i", "j", "1"), wi=_difference("w", 6, "64", "i", "j", "1"),
    uj=_difference("u", 6, "nj", "j", "i", "2"), wj=_difference("w", 6, "nj", "j", "i", "2"),
)


def _vectors(spark, sf):
    return field(spark, sf).select("i", "j", F.col("value").alias("u"), (F.col("value") * F.col("value") + F.col("i") * 0.01).alias("w"))


@query("w5_curl", G + VECTORS + "SELECT i, j, round(wi - uj, 6) AS curl_k FROM p JOIN q USING (i, j)")
def _(spark, sf):
    n = unit_grid(spark, sf).n
    return stencil.curl(_vectors(spark, sf), ["u", "w"], n, (1.0, 2.0)).select("i", "j", r6("curl_k").alias("curl_k"))


@query("w6_divergence", G + VECTORS + "SELECT i, j, round(ui + wj, 6) AS divergence FROM p JOIN q USING (i, j)")
def _(spark, sf):
    n = unit_grid(spark, sf).n
    return stencil.divergence(_vectors(spark, sf), ["u", "w"], n, (1.0, 2.0)).select("i", "j", r6("divergence").alias("divergence"))


@query("w7_gradient", G + VECTORS + "SELECT i, j, round(ui, 6) AS d_i, round(uj, 6) AS d_j FROM p JOIN q USING (i, j)")
def _(spark, sf):
    n = unit_grid(spark, sf).n
    return stencil.gradient(field(spark, sf), n, (1.0, 2.0)).select("i", "j", r6("d_i").alias("d_i"), r6("d_j").alias("d_j"))


@query(
    "w8_to_level",
    G + """, s AS (SELECT i, j, v, 1000 - i * 10 + v AS p FROM g), t AS (SELECT *, lag(p) OVER w AS pb, lag(v) OVER w AS vb FROM s WINDOW w AS (PARTITION BY j ORDER BY i)),
      c AS (SELECT j, min(i) FILTER (p < 655.5) AS ci, max_by(v, i) AS top FROM t GROUP BY j)
      SELECT c.j, round(CASE WHEN ci IS NULL THEN top WHEN pb IS NULL THEN v ELSE (655.5 - p) / (pb - p) * v + (1 - (655.5 - p) / (pb - p)) * vb END, 6) AS value
      FROM c LEFT JOIN t ON t.j = c.j AND t.i = ci""",
)
def _(spark, sf):
    rows = field(spark, sf).withColumn("p", 1000 - F.col("i") * 10 + F.col("value"))
    return stencil.interpolate_to_level(rows, ["j"], "i", "p", "value", 655.5).select("j", r6("value").alias("value"))


@query(
    "w9_stagger",
    G + """, s AS (SELECT i, j, v, lag(v) OVER w AS b, lead(v) OVER w AS a FROM g WINDOW w AS (PARTITION BY j ORDER BY i))
      SELECT i, j, round(CASE WHEN i = 0 THEN v - (a - v) / 2 ELSE (b + v) / 2 END, 6) AS value FROM s UNION ALL SELECT CAST(64 AS INT), j, round(v + (v - b) / 2, 6) FROM s WHERE i = 63""",
)
def _(spark, sf):
    return stencil.stagger(field(spark, sf), "i", NI).select(F.col("i").cast("int").alias("i"), "j", r6("value").alias("value"))


@query("w10_unstagger", G + "SELECT * FROM (SELECT i, j, round((v + lead(v) OVER (PARTITION BY j ORDER BY i)) / 2, 6) AS value FROM g) WHERE i < 63")
def _(spark, sf):
    return stencil.unstagger(field(spark, sf), "i").select("i", "j", r6("value").alias("value"))


@query(
    "w11_downsample",
    G + """, o AS (SELECT CAST(id AS INT) AS o, id * (64 / 24.0) + ((63 - (64 / 24.0) * 23) / 2) AS x FROM range(24) r(id))
      SELECT o AS i, a.j, round(a.v * (1 - (x - floor(x))) + b.v * (x - floor(x)), 6) AS value FROM o JOIN g a ON a.i = floor(x) JOIN g b ON b.i = floor(x) + 1 AND a.j = b.j""",
)
def _(spark, sf):
    return stencil.downsample(field(spark, sf), "i", NI, 24).select("i", "j", r6("value").alias("value"))


@query("w12_decimate", G + "SELECT CAST(i // 2 AS INT) AS i, CAST(j // 2 AS INT) AS j, round(avg(v), 6) AS value FROM h GROUP BY 1, 2")
def _(spark, sf):
    return stencil.decimate(gappy(spark, sf)).select("i", "j", r6("value").alias("value"))


@query(
    "w13_unwrap_longitude",
    """WITH s AS (SELECT event_id, user_id, value % 360 AS lon, first_value(value % 360) OVER (PARTITION BY user_id ORDER BY event_id) AS f FROM events)
       SELECT event_id, round(CASE WHEN lon < f THEN lon + 360 ELSE lon END, 6) AS lon FROM s""",
)
def _(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", (F.col("value") % 360).alias("lon"))
    return stencil.unwrap_longitude(rows, ["user_id"], "event_id", "lon").select("event_id", r6("lon").alias("lon"))


@query("w14_shift_longitude", "SELECT event_id, round(value - ceil((value - 180) / 360) * 360, 6) AS lon FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", r6(stencil.shift_longitude(F.col("value"))).alias("lon"))


@query(
    "w15_boundary",
    G + """, b AS (SELECT i, j, CASE WHEN j = 0 THEN i WHEN i = 63 THEN 63 + j WHEN j = nj - 1 THEN 63 + nj - 1 + (63 - i) WHEN i = 0 THEN 126 + nj - 1 + (nj - 1 - j) END AS ring FROM g, n)
      SELECT i, j, CAST(ring AS BIGINT) AS ring FROM b WHERE ring IS NOT NULL""",
)
def _(spark, sf):
    return stencil.boundary(field(spark, sf), unit_grid(spark, sf).n).select("i", "j", "ring")


@query(
    "w16_step_factor",
    STREAMS + """, d AS (SELECT stream, step, x - lag(x) OVER w AS ax, y - lag(y) OVER w AS ay, z - lag(z) OVER w AS az, lag(x) OVER w - lag(x, 2) OVER w AS bx, lag(y) OVER w - lag(y, 2) OVER w AS by_, lag(z) OVER w - lag(z, 2) OVER w AS bz FROM s WINDOW w AS (PARTITION BY stream ORDER BY step)),
      p AS (SELECT *, sqrt(ax * ax + ay * ay + az * az) * sqrt(bx * bx + by_ * by_ + bz * bz) AS m FROM d)
      SELECT stream, step, CASE WHEN m IS NULL OR m < 1e-7 THEN 1.0 WHEN (ax * bx + ay * by_ + az * bz) / m > cos(radians(3)) THEN 1.25 WHEN (ax * bx + ay * by_ + az * bz) / m < cos(radians(15)) THEN 0.5 ELSE 1.0 END::DOUBLE AS factor FROM p""",
)
def _(spark, sf):
    return stencil.step_factor(_streams(spark, sf)).select("stream", "step", "factor")


# Functions

AIR = """WITH a AS (SELECT l_orderkey AS o, l_linenumber AS l, l_partkey AS k, l_quantity * 100 AS p, 90000 - l_discount * 400000 AS pb, l_tax * 100 - 4 AS t, l_discount / 10 + 0.001 AS q FROM lineitem) """


def _air(spark, sf):
    c = F.col
    rows = table(spark, sf, "lineitem").select(
        c("l_orderkey").alias("o"), c("l_linenumber").alias("l"), c("l_partkey").alias("k"), (c("l_quantity") * 100).alias("p"),
        (90000 - c("l_discount") * 400000).alias("pb"), (c("l_tax") * 100 - 4).alias("t"), (c("l_discount") / 10 + 0.001).alias("q"),
    )
    return rows, c("p"), c("pb"), c("t"), c("q")


@query("f3_temperature", AIR + "SELECT o, l, k, round((t + 300) * pow((p + pb) * 1e-5, 2.0 / 7), 4) AS tk FROM a")
def _(spark, sf):
    rows, p, pb, t, q = _air(spark, sf)
    return rows.select("o", "l", "k", F.round(atmosphere.temperature(p, pb, t), 4).alias("tk"))


@query(
    "f4_relative_humidity",
    AIR + """, b AS (SELECT *, (t + 300) * pow((p + pb) * 1e-5, 2.0 / 7) AS tk FROM a), c AS (SELECT *, 6.112 * exp(17.67 * (tk - 273.15) / (tk - 29.65)) AS es FROM b)
      SELECT o, l, k, round(100 * greatest(least(q / (0.622 * es / (0.01 * (p + pb) - 0.378 * es)), 1), 0), 4) AS rh FROM c""",
)
def _(spark, sf):
    rows, p, pb, t, q = _air(spark, sf)
    return rows.select("o", "l", "k", F.round(atmosphere.relative_humidity(p, pb, t, q), 4).alias("rh"))


@query("f5_dew_point", AIR + ", b AS (SELECT *, ln(greatest(0.01 * q * (p + pb) / (0.622 + q), 0.001)) AS w FROM a) SELECT o, l, k, round((243.5 * w - 440.8) / (19.48 - w), 4) AS td FROM b")
def _(spark, sf):
    rows, p, pb, t, q = _air(spark, sf)
    return rows.select("o", "l", "k", F.round(atmosphere.dew_point(p, pb, q), 4).alias("td"))


@query(
    "f6_equivalent_temperature",
    AIR + """, b AS (SELECT *, 0.01 * (p + pb) AS h FROM a), c AS (SELECT *, (t + 300) * pow(h * 1e-3, 2.0 / 7) AS tk, q * h / (0.622 + q) AS e FROM b),
      d AS (SELECT *, 55 + 2840 / (ln(pow(tk, 3.5) / e) - 4.805) AS tl FROM c)
      SELECT o, l, k, round(tk * pow(1000 / h, (287.04 / 1004) * (1 + (0.608 - 0.887) * q)) * exp((3376 / tl - 2.54) * q * (1 + 0.81 * q)), 3) AS eth FROM d""",
)
def _(spark, sf):
    rows, p, pb, t, q = _air(spark, sf)
    return rows.select("o", "l", "k", F.round(atmosphere.equivalent_potential_temperature(p, pb, t, q), 3).alias("eth"))


@query("f1_magnitude", "SELECT l_orderkey AS o, l_linenumber AS l, l_partkey AS k, round(sqrt(l_quantity ^ 2 + l_discount ^ 2 + l_tax ^ 2), 6) AS size FROM lineitem")
def _(spark, sf):
    size = scalar.magnitude(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.col("l_partkey").alias("k"), r6(size).alias("size"))


@query(
    "f2_rotate",
    "SELECT event_id, round((cos(value) * 3 + sin(value) * value) / cos(user_id % 80 * pi() / 180), 4) AS u, round(cos(value) * value - sin(value) * 3, 4) AS v FROM events",
)
def _(spark, sf):
    u, v = scalar.rotate_to_lonlat(F.col("value"), F.col("user_id") % 80, F.lit(3.0), F.col("value"))
    return table(spark, sf, "events").select("event_id", F.round(u, 4).alias("u"), F.round(v, 4).alias("v"))


@query("f8_convert_units", "SELECT event_id, round((value * (5.0 / 9) + 459.67 * 5.0 / 9) - 273.15, 6) AS celsius, round(value / 1000, 6) AS km FROM events")
def _(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", r6(scalar.convert(v, "degF", "degC")).alias("celsius"), r6(scalar.convert(v, "m", "km")).alias("km"))


@query(
    "f10_decode_time",
    """SELECT event_id, CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month, CAST(day(ts) AS INT) AS day, CAST(hour(ts) AS INT) AS hour,
       CAST(minute(ts) AS INT) AS minute, CAST(second(ts) AS INT) AS second FROM events""",
)
def _(spark, sf):
    parts = scalar.decode_time(scalar.epoch_seconds(F.col("ts")))
    return table(spark, sf, "events").select("event_id", *[c.alias(n) for n, c in parts.items()])


@query("f11_parse_time", "SELECT o_orderkey, CAST(epoch(o_orderdate) AS DOUBLE) AS seconds FROM orders")
def _(spark, sf):
    text = F.date_format("o_orderdate", "yyyy-MM-dd_HH:mm:ss")
    return table(spark, sf, "orders").select("o_orderkey", scalar.parse_model_time(text).alias("seconds"))


@query("f12_format_time", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", scalar.format_time(scalar.epoch_seconds(F.col("ts"))).alias("text"))


@query("d6_seconds_since", "SELECT event_id, round(value * 3600 + epoch(TIMESTAMP '2000-01-01 00:00:00'), 3) AS seconds FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(scalar.seconds_since(F.col("value"), "hours since 2000-01-01 00:00:00"), 3).alias("seconds"))


@query(
    "f13_mercator",
    "SELECT event_id, round(radians(value - 180) * 6370000, 3) AS x, round(ln(tan(radians(user_id % 80) / 2 + pi() / 4)) * 6370000, 3) AS y FROM events",
)
def _(spark, sf):
    x, y = scalar.mercator(F.col("value") - 180, F.col("user_id") % 80)
    return table(spark, sf, "events").select("event_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("f13_lambert_round_trip", "SELECT event_id, round(value / 10 - 100, 6) AS lon, round(CAST(user_id % 60 + 10 AS DOUBLE), 6) AS lat FROM events")
def _(spark, sf):
    options = {"lon_0": -97.0, "lat_0": 40.0, "lat_1": 33.0, "lat_2": 45.0}
    x, y = scalar.lambert(F.col("value") / 10 - 100, F.col("user_id") % 60 + 10, **options)
    rows = table(spark, sf, "events").select("event_id", x.alias("x"), y.alias("y"))
    lon, lat = scalar.lambert_inverse(F.col("x"), F.col("y"), **options)
    return rows.select("event_id", r6(lon).alias("lon"), r6(lat).alias("lat"))


@query(
    "f15_transfer_function",
    """SELECT event_id, CAST(greatest(0, least(255, trunc(0.5 + (value - 50) * 255 / 350))) AS INT) AS entry,
       round(1 - greatest(0, least(255, trunc(0.5 + (value - 50) * 255 / 350))) / 255, 6) AS a FROM events""",
)
def _(spark, sf):
    lut = colour.table(spark, [(0.0, (0.0, 1.0, 1.0)), (1.0, (0.7, 1.0, 1.0))], [colour.opacity_points([(0.0, 1.0), (1.0, 0.0)])])
    return colour.apply_table(table(spark, sf, "events"), lut, 50.0, 400.0).select("event_id", "entry", r6("a").alias("a"))


@query(
    "f18_grey_of_hsv",
    "SELECT event_id, round(value / 500, 6) AS r, round(value / 500, 6) AS g, round(value / 500, 6) AS b FROM events",
)
def _(spark, sf):
    parts = colour.hsv_to_rgb(F.col("value") / 491, F.lit(0.0), F.col("value") / 500)
    return table(spark, sf, "events").select("event_id", *[r6(c).alias(n) for n, c in zip("rgb", parts)])


@query(
    "f21_periodic",
    "SELECT event_id, round(CASE WHEN value < 200 THEN value + ceil((200 - value) / 45) * 45 WHEN value > 245 THEN value - ceil((value - 245) / 45) * 45 ELSE value END, 6) AS v FROM events",
)
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", r6(scalar.periodic(F.col("value"), 200.0, 245.0)).alias("v"))


@query("f24_valid_name", "SELECT p_partkey, regexp_full_match(p_name, '[A-Za-z_][A-Za-z0-9_.-]*') AND NOT starts_with(lower(p_name), 'xml') AS valid FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", scalar.valid_name(F.col("p_name")).alias("valid"))


@query("f25_default_height", "SELECT c_custkey, CASE WHEN c_acctbal <= 0 AND c_acctbal + 500 >= 0 THEN 0.0::DOUBLE WHEN c_acctbal > 0 THEN c_acctbal ELSE round(c_acctbal + 500, 6) END AS z FROM customer")
def _(spark, sf):
    low = F.col("c_acctbal")
    return table(spark, sf, "customer").select("c_custkey", F.when((low <= 0) | (low > 0), r6(scalar.default_height(low, low + 500))).alias("z"))


OCEAN = """WITH a AS (SELECT l_orderkey AS o, l_linenumber AS l, l_partkey AS k, -l_discount * 10 AS s, -l_tax * 12 AS c, l_quantity / 10 AS eta, l_extendedprice / 10 AS d FROM lineitem) """


def _ocean(spark, sf):
    c = F.col
    return table(spark, sf, "lineitem").select(
        c("l_orderkey").alias("o"), c("l_linenumber").alias("l"), c("l_partkey").alias("k"), (-c("l_discount") * 10).alias("s"),
        (-c("l_tax") * 12).alias("c"), (c("l_quantity") / 10).alias("eta"), (c("l_extendedprice") / 10).alias("d"),
    )


@query("d9_ocean_s_1", OCEAN + "SELECT o, l, k, round(10 * s + (d - 10) * c + eta * (1 + (10 * s + (d - 10) * c) / d), 5) AS z FROM a")
def _(spark, sf):
    z = atmosphere.ocean_s_1(F.col("s"), F.col("c"), F.col("eta"), F.col("d"), F.lit(10.0))
    return _ocean(spark, sf).select("o", "l", "k", F.round(z, 5).alias("z"))


@query("d10_ocean_s_2", OCEAN + "SELECT o, l, k, round(eta + (eta + d) * ((10 * s + d * c) / (10 + d)), 5) AS z FROM a")
def _(spark, sf):
    z = atmosphere.ocean_s_2(F.col("s"), F.col("c"), F.col("eta"), F.col("d"), F.lit(10.0))
    return _ocean(spark, sf).select("o", "l", "k", F.round(z, 5).alias("z"))


@query("d11_hybrid_height", "SELECT l_orderkey AS o, l_linenumber AS l, l_partkey AS k, round(44331.5 - 4946.62 * pow(l_discount * 100000 + l_tax * l_extendedprice + 1, 0.190263), 3) AS z FROM lineitem")
def _(spark, sf):
    z = atmosphere.hybrid_height(F.col("l_discount"), F.col("l_tax"), F.lit(100000.0), F.col("l_extendedprice") + 1 / F.col("l_tax"))
    z = F.when(F.col("l_tax") > 0, z).otherwise(atmosphere.hybrid_height(F.col("l_discount"), F.lit(1.0), F.lit(100000.0), F.lit(1.0)))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.col("l_partkey").alias("k"), F.round(z, 3).alias("z"))


@query("d8_terrain_elevation", "SELECT c_custkey, round((c_acctbal + 5000) / 9.81, 6) AS z FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", r6(atmosphere.terrain_elevation(F.col("c_acctbal"), F.lit(5000.0))).alias("z"))


@query(
    "d13_vertex_means",
    "SELECT n_nationkey AS vertex, round(avg(b), 6) AS value FROM nation JOIN (SELECT s_nationkey, s_acctbal AS b FROM supplier) s ON s_nationkey = n_nationkey GROUP BY 1",
)
def _(spark, sf):
    s = table(spark, sf, "supplier")
    links = s.select(F.col("s_nationkey").alias("vertex"), F.col("s_suppkey").alias("cell"))
    cells = s.select(F.col("s_suppkey").alias("cell"), F.col("s_acctbal").alias("value"))
    return mesh.vertex_from_cells(links, cells).select("vertex", r6("value").alias("value"))


@query(
    "d14_vertex_winds",
    """SELECT s_nationkey AS vertex, round(avg(cos(s_suppkey) * s_acctbal - sin(s_suppkey) * s_suppkey), 5) AS zonal, round(avg(sin(s_suppkey) * s_acctbal + cos(s_suppkey) * s_suppkey), 5) AS meridional FROM supplier GROUP BY 1""",
)
def _(spark, sf):
    s = table(spark, sf, "supplier")
    links = s.select(F.col("s_nationkey").alias("vertex"), F.col("s_suppkey").alias("edge"))
    winds = s.select(F.col("s_suppkey").alias("edge"), F.col("s_suppkey").cast("double").alias("angle"), F.col("s_acctbal").alias("normal"), F.col("s_suppkey").cast("double").alias("tangential"))
    return mesh.vertex_winds(links, winds).select("vertex", F.round("zonal", 5).alias("zonal"), F.round("meridional", 5).alias("meridional"))


# Codec

HAAR = G + ", s AS (SELECT CAST(i // 2 AS INT) AS i, j, (sum(v)) * sqrt(0.5) AS approx, (max(v) FILTER (i % 2 = 0) - max(v) FILTER (i % 2 = 1)) * sqrt(0.5) AS detail FROM g GROUP BY 1, 2) "


@query("c1_haar_step", HAAR + "SELECT i, j, round(approx, 6) AS approx, round(detail, 6) AS detail FROM s")
def _(spark, sf):
    return codec.haar_step(field(spark, sf), "i").select("i", "j", r6("approx").alias("approx"), r6("detail").alias("detail"))


@query("c2_round_trip", G + "SELECT i, j, round(v, 6) AS value FROM g")
def _(spark, sf):
    back = codec.reconstruct(codec.decompose(field(spark, sf), "i", 3), "i", 3)
    return back.select(F.col("i").cast("int").alias("i"), "j", r6("value").alias("value"))


@query(
    "c3_compress",
    HAAR + """, r AS (SELECT i, j, detail, row_number() OVER (PARTITION BY j ORDER BY abs(detail) DESC, i) AS rank FROM s)
      SELECT i, j, CAST(0 AS INT) AS level, round(approx, 6) AS value FROM s UNION ALL SELECT i, j, CAST(1 AS INT), round(detail, 6) FROM r WHERE rank <= 8""",
)
def _(spark, sf):
    kept = codec.compress(codec.decompose(field(spark, sf), "i", 1), ["j"], 8)
    return kept.select("i", "j", "level", r6("value").alias("value"))


@query(
    "c6_detail_bands",
    HAAR + """, r AS (SELECT i, j, row_number() OVER (PARTITION BY j ORDER BY abs(detail) DESC, i) AS rank FROM s)
      SELECT i, j, CAST(1 AS INT) AS level, CAST(CASE WHEN rank <= 4 THEN 0 WHEN rank <= 12 THEN 1 ELSE 2 END AS INT) AS lod FROM r WHERE rank <= 28
      UNION ALL SELECT i, j, CAST(0 AS INT), CAST(0 AS INT) FROM s""",
)
def _(spark, sf):
    bands = codec.detail_bands(codec.decompose(field(spark, sf), "i", 1), ["j"], [4, 8, 16])
    return bands.select("i", "j", "level", "lod")


@query("c4_dims_at_level", "SELECT p_partkey, CAST(greatest(1, (p_size // 8) * 2 + ((p_size % 8) >> 2)) AS INT) AS n FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", codec.dims_at_level(F.col("p_size"), 8, 2).alias("n"))


# Drawing data

CONTOUR = G + """, c AS (SELECT CAST(i - di AS INT) AS ci, CAST(j - dj AS INT) AS cj, max(CASE WHEN di = 0 AND dj = 0 THEN v END) AS v0, max(CASE WHEN di = 1 AND dj = 0 THEN v END) AS v1,
  max(CASE WHEN di = 1 AND dj = 1 THEN v END) AS v2, max(CASE WHEN di = 0 AND dj = 1 THEN v END) AS v3 FROM h, n, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) AS o(di, dj)
  WHERE i - di BETWEEN 0 AND 62 AND j - dj BETWEEN 0 AND nj - 2 GROUP BY 1, 2 HAVING count(v) = 4),
  e AS (SELECT ci, cj, 0 AS edge, v0 AS a, v1 AS b, 0 AS ai, 0 AS aj, 1 AS bi, 0 AS bj FROM c UNION ALL SELECT ci, cj, 1, v1, v2, 1, 0, 1, 1 FROM c
   UNION ALL SELECT ci, cj, 2, v2, v3, 1, 1, 0, 1 FROM c UNION ALL SELECT ci, cj, 3, v3, v0, 0, 1, 0, 0 FROM c)
  SELECT ci, cj, CAST(l AS DOUBLE) AS level, CAST(edge AS INT) AS edge, round(ci + ai + (l - a) / (b - a) * (bi - ai), 5) AS x, round(cj + aj + (l - a) / (b - a) * (bj - aj), 5) AS y
  FROM e, (VALUES (0.0::DOUBLE), (0.1::DOUBLE)) AS t(l) WHERE (a <= l) <> (b <= l)"""


@query("r1_contours", CONTOUR)
def _(spark, sf):
    out = contour.contour_vertices(gappy(spark, sf), unit_grid(spark, sf), [0.0, 0.1])
    return out.select("ci", "cj", "level", "edge", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query("r3_texture", G + "SELECT i, j, coalesce(v, 0) AS value, v IS NULL AS missing FROM h")
def _(spark, sf):
    return contour.texture(gappy(spark, sf)).select("i", "j", "value", "missing")


@query("r5_particle_marks", "SELECT l_orderkey AS particle, l_linenumber AS l, l_partkey AS k, 0.5::DOUBLE AS radius FROM lineitem WHERE l_orderkey % 7 = 0")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("particle"), F.col("l_linenumber").alias("l"), F.col("l_partkey").alias("k"))
    return contour.particle_marks(rows, 7, 0.5)


@query("r6_wireframe", "SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_partkey <> l_suppkey")
def _(spark, sf):
    pair = F.array(F.struct(F.lit(0).alias("slot"), F.col("l_partkey").alias("node")), F.struct(F.lit(1).alias("slot"), F.col("l_suppkey").alias("node")))
    faces = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").where("l_partkey != l_suppkey").distinct().select(
        F.concat_ws("-", "l_partkey", "l_suppkey").alias("face"), F.inline(pair)
    )
    return mesh.wireframe(faces)


@query(
    "r10_key_frames",
    """WITH f AS (SELECT vec_id * 10 AS f, CAST(embedding[1] AS DOUBLE) AS v, lead(CAST(embedding[1] AS DOUBLE)) OVER (ORDER BY vec_id) AS w FROM embeddings)
       SELECT CAST(f + s.range AS INT) AS frame, round(v + (w - v) * s.range / 10.0, 6) AS c0 FROM f, range(10) s WHERE w IS NOT NULL OR s.range = 0 ORDER BY 1""".replace(
        "v + (w - v) * s.range / 10.0", "CASE WHEN w IS NULL THEN v ELSE v + (w - v) * s.range / 10.0 END"
    ),
)
def _(spark, sf):
    frames = table(spark, sf, "embeddings").select((F.col("vec_id") * 10).alias("frame"), F.col("embedding")[0].cast("double").alias("c0"))
    return contour.between_frames(frames).select("frame", r6("c0").alias("c0"))


# Flow


@query(
    "l12_rake",
    """SELECT id AS seed, round(lx + (id % 8 + 0.5) * ((hx - lx) / 8.0), 6) AS x, round(ly + ((id // 8) % 4 + 0.5) * ((hy - ly) / 4.0), 6) AS y
       FROM range(32) r(id), (SELECT min(l_quantity) AS lx, max(l_quantity) AS hx, min(l_discount) AS ly, max(l_discount) AS hy FROM lineitem)""",
)
def _(spark, sf):
    """A rake over the box that the particles fill."""
    ends = table(spark, sf, "lineitem").agg(F.min("l_quantity"), F.min("l_discount"), F.max("l_quantity"), F.max("l_discount")).first()
    return contour.rake(spark, ends[:2], ends[2:], (8, 4)).select("seed", r6("x").alias("x"), r6("y").alias("y"))


@query("l14_biased_seeds", "SELECT c_custkey AS seed, c_acctbal AS value FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 40")
def _(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("seed"), F.col("c_acctbal").alias("value"))
    return flow.biased_seeds(rows, "value", 40)


@query(
    "l16_reinjection",
    "SELECT s_suppkey AS seed, CAST(t.range AS INT) AS ts FROM supplier, range(20) t WHERE t.range % 6 = 0",
)
def _(spark, sf):
    steps = spark.range(20).select(F.col("id").cast("int").alias("ts"))
    return flow.reinjected(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("seed")), steps, 6)


@query(
    "l6_trace_in_rotation",
    """WITH seeds AS (SELECT s_suppkey AS stream, (s_suppkey % 17) / 20.0::DOUBLE AS x, (s_suppkey % 5) / 10.0::DOUBLE AS y FROM supplier),
      t AS (SELECT CAST(range AS INT) AS step, CASE WHEN range <= 2 THEN range * 0.05::DOUBLE ELSE 0.1::DOUBLE + (range - 2) * 0.0625::DOUBLE END AS a FROM range(41))
      SELECT stream, step, round(x * cos(a) - y * sin(a), 4) AS x, round(x * sin(a) + y * cos(a), 4) AS y, round(a, 6) AS time, false AS special FROM seeds, t WHERE step = 0 OR x <> 0 OR y <> 0
      UNION ALL SELECT stream, CAST(1 AS INT), 0, 0, 0, true FROM seeds WHERE x = 0 AND y = 0""",
)
def _(spark, sf):
    """Traces of supplier seeds in a solid rotation: a turn of less than 3 degrees a step makes
    the third step longer by a quarter, which turns by more; the middle stands still."""
    nj = table(spark, sf, "embeddings").count()
    dx, dy = 1 / 32, 0.5 ** math.floor(math.log2(nj / 2))  # exact, so that the middle is a sample
    g = RegularGrid((NI, nj), (-32 * dx, -(nj // 2) * dy), (31 * dx, (nj - 1 - nj // 2) * dy))
    places = g.with_coordinates(field(spark, sf))
    rotation = flow.field_from_tables(g, [places.select("i", "j", w.alias("value")) for w in (-F.col("y"), F.col("x"))])
    key = F.col("s_suppkey")
    seeds = table(spark, sf, "supplier").select(key.alias("seed"), ((key % 17) / 20.0).alias("x"), ((key % 5) / 10.0).alias("y"))
    out = flow.advect(seeds, rotation, 0.05, steps=40)
    return out.select("stream", "step", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), r6("time").alias("time"), "special")


@query("l13_random_rake", "SELECT count(*) AS n, count(*) AS n_distinct, true AS inside FROM supplier")
def _(spark, sf):
    """As many random seeds as suppliers, in the box that the particles fill: all different, all inside."""
    ends = table(spark, sf, "lineitem").agg(F.min("l_quantity"), F.min("l_discount"), F.max("l_quantity"), F.max("l_discount")).first()
    seeds = flow.random_rake(spark, ends[:2], ends[2:], table(spark, sf, "supplier").count())
    inside = F.col("x").between(ends[0], ends[2]) & F.col("y").between(ends[1], ends[3])
    return seeds.agg(F.count("*").alias("n"), F.count_distinct("x", "y").alias("n_distinct"), F.bool_and(inside).alias("inside"))


@query("u2_user_function", G + "SELECT i, j, round(v + round(v, 2), 6) AS value FROM g")
def _(spark, sf):
    data = _dataset(spark, sf)
    Registry(data).add("sum", "c = embedding + rounded", ["embedding", "rounded"], ["c"], pointwise=True)
    return data.variable("c").select("i", "j", r6("value").alias("value"))


@query("g12_sample_faces", G + LINEAR.format(t="h").replace("round(s.s, 6)", "round(s.s, 5)"))
def _(spark, sf):
    g = unit_grid(spark, sf)
    coordinates = g.with_coordinates(field(spark, sf)).select("i", "j", "x", "y")
    nodes, faces = mesh.curvilinear_mesh(coordinates, gappy(spark, sf), g.n)
    out = mesh.sample_faces(points(spark, sf), nodes, faces, ["k"], 4.0)
    return out.select("k", F.round("linear", 5).alias("sampled"))


# Streaming forms, here over a finished table

WINDOWS = "SELECT date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS \"end\", event_type, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, count(value) AS n FROM events GROUP BY 1, 2, 3"


@query("x1_windowed_summary", WINDOWS)
def _(spark, sf):
    out = series.windowed_summary(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value", ["event_type"], "1 day", "1 hour")
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return out.select(ntz("start"), ntz("end"), "event_type", "low", "high", r6("mean").alias("mean"), "n")


# Derived coordinates, sampling for previews, checks of smaller operators


@query("d2_index_coordinate", "SELECT CAST(id AS INT) AS j, CAST(id AS DOUBLE) AS value FROM (SELECT unnest(range(count(*))) AS id FROM embeddings)")
def _(spark, sf):
    return box.index_coordinate(spark, unit_grid(spark, sf).n[1], "j")


@query(
    "d12_span_coordinate",
    "SELECT CAST(id AS INT) AS i, round(lo + id / 31.0::DOUBLE * (hi - lo), 6) AS value FROM range(32) r(id), (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)",
)
def _(spark, sf):
    return box.span_coordinate(table(spark, sf, "lineitem").select(F.col("l_quantity").alias("value")), 32).select("i", r6("value").alias("value"))


@query(
    "d1_projected_coordinates",
    "SELECT c_custkey, round(radians(c_custkey % 360 - 180) * 6370000, 3) AS x, round(radians(c_custkey % 170 - 85) * 6370000, 3) AS y FROM customer",
)
def _(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 360 - 180).alias("lon"), (F.col("c_custkey") % 170 - 85).alias("lat"))
    return box.projected_coordinates(rows, scalar.equirectangular).select("c_custkey", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query(
    "d5_sorted_times",
    """SELECT o_orderkey AS file_step, CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS INT) AS ts, CAST(epoch(o_orderdate) AS DOUBLE) AS seconds FROM orders""",
)
def _(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("file_step"), F.date_format("o_orderdate", "yyyy-MM-dd_HH:mm:ss").alias("text")
    )
    return box.sorted_times(rows, "text", scalar.parse_model_time).select("file_step", "ts", "seconds")


@query(
    "a8_sampled_histogram",
    G + """, q AS (SELECT CAST(id % 30 AS INT) AS a, CAST(id // 30 AS INT) AS b FROM range(900) r(id)),
      p AS (SELECT (a + 0.5) * (63 / 30.0::DOUBLE) AS x, (b + 0.5) * ((nj - 1) / 30.0::DOUBLE) AS y FROM q, n),
      s AS (SELECT CAST(floor(x) + CASE WHEN x - floor(x) > 0.5 THEN 1 ELSE 0 END AS INT) AS qi, CAST(floor(y) + CASE WHEN y - floor(y) > 0.5 THEN 1 ELSE 0 END AS INT) AS qj FROM p)
      SELECT CASE WHEN v < -0.1::DOUBLE THEN 'below' WHEN v > 0.1::DOUBLE THEN 'above' ELSE 'inside' END AS side,
        CAST(CASE WHEN v < -0.1::DOUBLE THEN least(3, floor((v + 1) / 0.9::DOUBLE * 4)) WHEN v > 0.1::DOUBLE THEN least(3, floor((v - 0.1::DOUBLE) / 0.9::DOUBLE * 4))
          ELSE least(15, floor((v + 0.1::DOUBLE) / 0.2::DOUBLE * 16)) END AS INT) AS bin,
        count(*) AS n FROM s JOIN g ON g.i = qi AND g.j = qj GROUP BY 1, 2""",
)
def _(spark, sf):
    g = unit_grid(spark, sf)
    lattice = contour.rake(spark, g.low, g.high, (30, 30))
    found = sample.sample_nearest(lattice, field(spark, sf), g, "value")
    return stats.histogram(found, -0.1, 0.1, 16, below=4, above=4, extent=(-1.0, 1.0))


@query("a18_largest_component", "SELECT max(greatest(abs(c_acctbal), abs(c_custkey))) AS largest FROM customer")
def _(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_acctbal").alias("u"), F.col("c_custkey").cast("double").alias("v"))
    return contour.largest_component(rows, ["u", "v"])


@query(
    "f16_opacity",
    """SELECT event_id, round(least(1, 0.25 * (CASE WHEN x < 0.5 THEN x * 2 ELSE 2 - x * 2 END + 0.5 + sin(2 * pi() * x) / 2)), 6) AS a
       FROM (SELECT event_id, (event_id % 256) / 255.0 AS x FROM events)""",
)
def _(spark, sf):
    """Opacities of a table's rows by the 256 entries of two maps together."""
    maps = [colour.opacity_points([(0.0, 0.0), (0.5, 1.0), (1.0, 0.0)]), colour.sine(2.0, 0.0)]
    lut = colour.table(spark, [(0.0, (0.0, 0.0, 0.0)), (1.0, (0.0, 0.0, 1.0))], maps, scale=0.25)
    rows = table(spark, sf, "events").select("event_id", (F.col("event_id") % 256).cast("int").alias("entry"))
    return rows.join(F.broadcast(lut), "entry").select("event_id", r6("a").alias("a"))


@query("f17_discrete_colours", "SELECT event_id, CASE WHEN (event_id % 256) / 255.0 < 0.5 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS r FROM events")
def _(spark, sf):
    lut = colour.table(spark, [(0.0, (0.0, 0.0, 0.0)), (1.0, (0.0, 0.0, 1.0))], [], colour.discrete)
    rows = table(spark, sf, "events").select("event_id", (F.col("event_id") % 256).cast("int").alias("entry"))
    return rows.join(F.broadcast(lut), "entry").select("event_id", "r")


@query(
    "f20_linear_index",
    "SELECT p_partkey, CAST(p_size % 4 + 4 * (p_size % 7) + 28 * (p_partkey % 5) AS BIGINT) AS at, CAST(p_size % 7 AS INT) AS j FROM part",
)
def _(spark, sf):
    parts = [F.col("p_size") % 4, F.col("p_size") % 7, F.col("p_partkey") % 5]
    rows = table(spark, sf, "part").select("p_partkey", box.linear_index(parts, (4, 7, 5)).alias("at"))
    return rows.select("p_partkey", "at", box.index_of(F.col("at"), (4, 7, 5))[1].alias("j"))


@query(
    "l3_inside_volume",
    "SELECT event_id, value BETWEEN 100 AND 300 AND user_id BETWEEN 5 AND 40 AS inside FROM events",
)
def _(spark, sf):
    g = RegularGrid((2, 2), (100.0, 5.0), (300.0, 40.0))
    rows = table(spark, sf, "events").select("event_id", F.col("value").alias("x"), F.col("user_id").alias("y"))
    return rows.select("event_id", g.inside().alias("inside"))


@query(
    "k3_export_rows",
    STREAMS + """, e AS (SELECT stream, step, x, y, z, row_number() OVER (PARTITION BY stream ORDER BY step) AS n FROM s WHERE NOT special)
      SELECT stream AS "ID", step, x, y, z FROM e WHERE n <= 4""",
)
def _(spark, sf):
    return flow.export_rows(_streams(spark, sf), steps=3)


@query(
    "k4_export_until",
    STREAMS + """SELECT stream AS "ID", step, x, y, z, strftime(make_timestamp(CAST(step * 86400 AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') AS date FROM s WHERE NOT special AND step * 86400 <= 300000""",
)
def _(spark, sf):
    return flow.export_rows(_streams(spark, sf).withColumn("time", F.col("step") * 86400.0), until=300000.0)


@query("o4_merged_timeline", "SELECT ts FROM events WHERE event_type = 'view' UNION ALL SELECT ts FROM events WHERE event_type = 'click'")
def _(spark, sf):
    e = table(spark, sf, "events")
    return timeline.merge_timelines([e.where("event_type = 'view'"), e.where("event_type = 'click'")], "ts")


@query(
    "c7_significance",
    HAAR + """, r AS (SELECT i, j, row_number() OVER (PARTITION BY j ORDER BY abs(detail) DESC, i) AS rank FROM s)
      SELECT j, list_sort(list(place)) AS places FROM (SELECT j, CAST(32 + i AS BIGINT) AS place FROM r WHERE rank <= 5 UNION ALL SELECT j, CAST(i AS BIGINT) FROM s) GROUP BY j""",
)
def _(spark, sf):
    kept = codec.compress(codec.decompose(field(spark, sf), "i", 1), ["j"], 5)
    return codec.significance(kept, ["j"], 32)


@query("c5_finish", G + "SELECT i, j, CASE WHEN abs(greatest(-0.1, least(0.1, v))) < 0.02 THEN 0 ELSE greatest(-0.1, least(0.1, v)) END AS value FROM g")
def _(spark, sf):
    return codec.finish(field(spark, sf), -0.1, 0.1, 0.02)


@query("l13_seeded_draws", "SELECT count(*) AS n, count(*) AS same, CAST(0 AS BIGINT) AS same_by_another FROM customer")
def _(spark, sf):
    """Random seeds are the same for the same seed number, and others for another."""
    n = table(spark, sf, "customer").count()
    draws = [flow.random_rake(spark, (0.0,), (1.0,), n, seed=k).withColumnRenamed("x", f"x{at}") for at, k in enumerate((7, 7, 8))]
    met = draws[0].join(draws[1], "seed").join(draws[2], "seed")
    return met.agg(F.count("*").alias("n"), F.count_if(F.col("x0") == F.col("x1")).alias("same"), F.count_if(F.col("x0") == F.col("x2")).alias("same_by_another"))