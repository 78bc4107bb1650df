"""Queries over meshes without a bucket width, grids in three dimensions, and lifting wavelets."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import cells, codec, mesh
from .operators.grid import RegularGrid
from .queries import LINEAR, NI, G, field, gappy, points, query, r6, table, unit_grid
from .queries_more import CUBE, _cube, _points3

# Meshes


def _mesh(spark, sf, values):
    g = unit_grid(spark, sf)
    return mesh.curvilinear_mesh(g.with_coordinates(field(spark, sf)).select("i", "j", "x", "y"), values, g.n)


@query("g24_adaptive_faces", G + LINEAR.format(t="h").replace("round(s.s, 6)", "round(s.s, 5)"))
def _(spark, sf):
    """Samples in faces that are found through an index of their boxes."""
    nodes, faces = _mesh(spark, sf, gappy(spark, sf))
    out = mesh.sample_faces(points(spark, sf), nodes, faces, ["k"])
    return out.select("k", F.round("linear", 5).alias("sampled"))


# Two layers of heights over the plane: those of the first half of a vector and of the second.


CORNERS3 = """, q AS (SELECT *, CAST(least(floor(x), 6) AS INT) AS ci, CAST(least(floor(y), nj - 2) AS INT) AS cj, z * 2 AS pz FROM p3, n),
  l AS (SELECT *, x - ci AS p, y - cj AS q FROM q)"""


def _heights(cube):
    return cube.withColumn("value", 2.0 * F.col("k") + F.col("i") * F.col("j") % 3 * 0.2)


@query(
    "g8_layered_grid",
    CUBE + CORNERS3 + """, o AS (SELECT *, pz - 0.2 * (CASE WHEN p >= q THEN (1 - p) * (ci * cj % 3) + (p - q) * ((ci + 1) * cj % 3) ELSE (1 - q) * (ci * cj % 3) + (q - p) * (ci * (cj + 1) % 3) END + least(p, q) * ((ci + 1) * (cj + 1) % 3)) AS up FROM l),
      e AS (SELECT *, CAST(least(floor(up / 2), 6) AS INT) AS ck FROM o WHERE up BETWEEN 0 AND 14),
      w AS (SELECT key, ci + di AS qi, cj + dj AS qj, ck + dk AS qk, (CASE di WHEN 1 THEN p ELSE 1 - p END) * (CASE dj WHEN 1 THEN q ELSE 1 - q END) * (CASE dk WHEN 1 THEN up / 2 - ck ELSE 1 - (up / 2 - ck) END) AS w
        FROM e, (VALUES (0), (1)) AS a(di), (VALUES (0), (1)) AS b(dj), (VALUES (0), (1)) AS d(dk)),
      s AS (SELECT key, sum(w * v) AS s FROM w JOIN c ON c.i = qi AND c.j = qj AND c.k = qk GROUP BY key)
      SELECT p3.key, round(s, 6) AS value FROM p3 LEFT JOIN s USING (key)""",
)
def _(spark, sf):
    """Heights that are no plane over a cell: the cell is two prisms, and the value bilinear in each layer."""
    cube, nj = _cube(spark, sf), table(spark, sf, "embeddings").count()
    asked = _points3(spark, sf).withColumn("z", F.col("z") * 2)
    g = RegularGrid((8, nj), (0.0, 0.0), (7.0, nj - 1.0))
    return cells.sample_layered_grid(asked, _heights(cube), cube, g, ["key"]).select("key", r6("value").alias("value"))


@query(
    "g10_curvilinear_plane_with_heights",
    CUBE + """, q AS (SELECT *, CAST(least(floor(x), 6) AS INT) AS ci, CAST(least(floor(y), nj - 2) AS INT) AS cj, CAST(least(floor(z), 6) AS INT) AS ck FROM p3, n),
      w AS (SELECT key, ci + di AS qi, cj + dj AS qj, ck + dk AS qk,
        (CASE di WHEN 1 THEN x - ci ELSE 1 - (x - ci) END) * (CASE dj WHEN 1 THEN y - cj ELSE 1 - (y - cj) END) * (CASE dk WHEN 1 THEN z - ck ELSE 1 - (z - ck) END) AS w
        FROM q, (VALUES (0), (1)) AS a(di), (VALUES (0), (1)) AS b(dj), (VALUES (0), (1)) AS d(dk))
      SELECT key, round(sum(w * v), 5) AS value FROM w JOIN c ON c.i = qi AND c.j = qj AND c.k = qk GROUP BY key""",
)
def _(spark, sf):
    """A plane of quadrilaterals, here turned and stretched, with a stretched axis of heights."""
    cube, nj = _cube(spark, sf), table(spark, sf, "embeddings").count()
    turn = lambda x, y: [(3 * x - 4 * y).alias("x"), (4 * x + 3 * y).alias("y")]
    plane = cube.where("k = 0").select("i", "j", *turn(F.col("i"), F.col("j")), F.lit(0.0).alias("value"))
    nodes, faces = mesh.curvilinear_mesh(plane.select("i", "j", "x", "y"), plane, (8, nj))
    layers = cube.select((F.col("j").cast("long") * 8 + F.col("i")).alias("node"), F.col("k").alias("layer"), *turn(F.col("i"), F.col("j")), F.col("k").cast("double").alias("z"), "value")
    asked = _points3(spark, sf).select("key", *turn(F.col("x"), F.col("y")), "z")
    return mesh.sample_layers(asked, layers, faces, ["key"]).select("key", F.round("value", 5).alias("value"))


@query(
    "g23_hexahedra",
    CUBE + """, q AS (SELECT *, CAST(least(floor(x), 6) AS INT) AS ci, CAST(least(floor(y), nj - 2) AS INT) AS cj, CAST(least(floor(z), 6) AS INT) AS ck FROM p3, n),
      o AS (SELECT *, (ci + cj + ck) % 2 AS odd, CASE (ci + cj + ck) % 2 WHEN 1 THEN 1 - (x - ci) ELSE x - ci END AS p, y - cj AS q, z - ck AS r FROM q),
      e AS (SELECT o.key, p, q, r, map_from_entries(list((xor(di, odd) + 2 * dj + 4 * dk, v))) AS m FROM o, (VALUES (0), (1)) AS a(di), (VALUES (0), (1)) AS b(dj), (VALUES (0), (1)) AS d(dk) JOIN c ON c.i = ci + di AND c.j = cj + dj AND c.k = ck + dk GROUP BY ALL)
      SELECT key, round(CASE WHEN (1 - p) + q + r <= 1 THEN (p - q - r) * m[1] + (1 - p) * m[0] + q * m[3] + r * m[5]
        WHEN p + (1 - q) + r <= 1 THEN (q - p - r) * m[2] + p * m[3] + (1 - q) * m[0] + r * m[6]
        WHEN p + q + (1 - r) <= 1 THEN (r - p - q) * m[4] + p * m[5] + q * m[6] + (1 - r) * m[0]
        WHEN (1 - p) + (1 - q) + (1 - r) <= 1 THEN (p + q + r - 2) * m[7] + (1 - p) * m[6] + (1 - q) * m[5] + (1 - r) * m[3]
        ELSE (1 - (p + q + r) / 2) * m[0] + (p + q - r) / 2 * m[3] + (p - q + r) / 2 * m[5] + (q + r - p) / 2 * m[6] END, 5) AS value FROM e""",
)
def _(spark, sf):
    """A grid turned in space: a value is linear in the tetrahedron that holds the point."""
    cube, nj = _cube(spark, sf), table(spark, sf, "embeddings").count()
    turn = lambda x, y, z: [(2 * x - y + 2 * z).alias("x"), (2 * x + 2 * y - z).alias("y"), (-x + 2 * y + 2 * z).alias("z")]
    places = cube.select("i", "j", "k", *turn(F.col("i"), F.col("j"), F.col("k")))
    asked = _points3(spark, sf).select("key", *turn(F.col("x"), F.col("y"), F.col("z")))
    return cells.sample_hexahedra(asked, places, cube, (8, nj, 8), ["key"], 1e-7).select("key", F.round("value", 5).alias("value"))


# Lifting along the vectors, whose length is even: the last sample has its left neighbour on both sides.

PAIRS = G + ", e0 AS (SELECT j, i // 2 AS m, max(CASE WHEN i % 2 = 0 THEN v END) AS a, max(CASE WHEN i % 2 = 1 THEN v END) AS d FROM g GROUP BY j, i // 2)"


def _lift(n: int, which: str, weight: float) -> str:
    """A step: a pair's detail has approximations at m and m + 1 beside it, its approximation details at m - 1 and m."""
    after = "coalesce(lead(a) OVER (PARTITION BY j ORDER BY m), a)"
    before = "coalesce(lag(d) OVER (PARTITION BY j ORDER BY m), d)"
    new = f"a, d + (a + {after}) * {weight!r}::DOUBLE AS d" if which == "detail" else f"a + ({before} + d) * {weight!r}::DOUBLE AS a, d"
    return f", e{n + 1} AS (SELECT j, m, {new} FROM e{n})"


def _lifted(steps, scale: str) -> str:
    out = PAIRS + "".join(_lift(n, which, w) for n, (which, w) in enumerate(steps))
    last = f"e{len(steps)}"
    return out + f" SELECT CAST(m AS INT) AS i, j, round(a * {scale}, 6) AS value FROM {last} UNION ALL SELECT CAST(m + {NI // 2} AS INT), j, round(d / {scale}, 6) FROM {last}"


@query("c1_lifting_five_three", _lifted([("detail", -0.5), ("approx", 0.25)], "sqrt(2)"))
def _(spark, sf):
    out = codec.transform_lines(field(spark, sf), "i", "bior2.2")
    return out.select(F.col("i").cast("int").alias("i"), "j", r6("value").alias("value"))


@query(
    "c1_lifting_nine_seven",
    _lifted([("detail", -1.586134342059924), ("approx", -0.052980118572961), ("detail", 0.882911075530934), ("approx", 0.443506852043971)], "1.149604398860241::DOUBLE"),
)
def _(spark, sf):
    out = codec.transform_lines(field(spark, sf), "i", "bior4.4")
    return out.select(F.col("i").cast("int").alias("i"), "j", r6("value").alias("value"))


@query("c1_lifting_back", G + "SELECT i, j, round(v, 6) AS value FROM g WHERE i < 63")
def _(spark, sf):
    """Lines of 63 samples, forward and back."""
    made = codec.transform_lines(field(spark, sf).where(F.col("i") < NI - 1), "i", "bior2.6")
    back = codec.transform_lines(made, "i", "bior2.6", inverse=True)
    return back.select(F.col("i").cast("int").alias("i"), "j", r6("value").alias("value"))
