"""Queries over files: tables written in file formats and read back through the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import grid
from .plans.catalog import Dataset, Mesh, Variable
from .plans.scratch import fresh_path
from .queries import NI, G, field, query, r6, table
from .sources import netcdf, progressive, ranges

# The grid cut in steps: every fourth vector is a line of the same step.
CUT = G + ", t AS (SELECT CAST(j % 4 AS INT) AS ts, i, CAST(j // 4 AS INT) AS j, v FROM h) "


def _cut(spark, sf):
    hole = (F.col("i") * 7 + F.col("j") * 3) % 11 == 0
    value = F.when(~hole, F.col("value")).alias("value")
    return field(spark, sf).select((F.col("j") % 4).cast("int").alias("ts"), "i", F.floor(F.col("j") / 4).cast("int").alias("j"), value)


def _sizes(spark, sf) -> dict[str, int]:
    return {"lon": NI, "lat": -(-table(spark, sf, "embeddings").count() // 4)}


def _written(spark, sf, values, times, name="v") -> str:
    folder = fresh_path(spark, "files")
    lon = (list(range(NI)), {"units": "degrees_east"})
    netcdf.write_files(values, folder, name, _sizes(spark, sf), times, "hours since 2001-01-01 00:00:00", {"lon": lon}, {"units": "K"})
    return folder


@query("s2_cf_files", CUT + "SELECT ts, i, j, v AS value FROM t WHERE v IS NOT NULL")
def _(spark, sf):
    """A series of files, one for each step, written from the table."""
    data = netcdf.open_cf(spark, _written(spark, sf, _cut(spark, sf), [0.0, 6.0, 12.0, 18.0]))
    return data.table("v").where("value is not null")


@query("s2_cf_request", CUT + "SELECT i, j, v AS value FROM t WHERE ts = 2 AND i BETWEEN 10 AND 20 AND j BETWEEN 3 AND 9")
def _(spark, sf):
    """One step and box: only their rows of one file are read."""
    data = netcdf.open_cf(spark, _written(spark, sf, _cut(spark, sf), [0.0, 6.0, 12.0, 18.0]))
    return data.variable("v", 2, [(10, 20), (3, 9)]).drop("ts")


@query("s10_overlapping_files", CUT + "SELECT ts, count(*) AS n, round(sum(v), 4) AS total FROM (SELECT ts, v FROM t UNION ALL SELECT ts + 2, v + 1000 FROM t WHERE ts > 1) WHERE v IS NOT NULL GROUP BY ts")
def _(spark, sf):
    """Two sets of files whose times overlap: each step comes from the first that has it."""
    rows, base = _cut(spark, sf), fresh_path(spark, "series")
    sizes, units = _sizes(spark, sf), "hours since 2001-01-01 00:00:00"
    netcdf.write_files(rows, f"{base}/a", "v", sizes, [0.0, 1.0, 2.0, 3.0], units)
    netcdf.write_files(rows.withColumn("value", F.col("value") + 1000), f"{base}/b", "v", sizes, [2.0, 3.0, 4.0, 5.0], units)
    series = netcdf.open_cf(spark, f"{base}/*").table("v").where("value is not null")
    return series.groupBy("ts").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("s12_raw_volume", CUT + "SELECT ts, i, j, CASE WHEN v IS NULL THEN -999 ELSE CAST(floor(v * 1000) AS DOUBLE) END AS value FROM t WHERE i >= 32")
def _(spark, sf):
    """Integers in headerless files, written from the table and read back."""
    n = list(_sizes(spark, sf).values())
    whole = _cut(spark, sf).withColumn("value", F.coalesce(F.floor(F.col("value") * 1000).cast("double"), F.lit(-999.0)))
    made = ranges.write_steps(whole, fresh_path(spark, "raw"), "v", n, ">i4", fill=-12345.0)
    paths = [r["path"] for r in made.orderBy("ts").select("path").collect()]
    return ranges.read_raw(spark, paths, n, ">i4", missing=[-12345]).where("i >= 32 and value is not null")


@query("k5_raw_export", CUT + "SELECT ts, CAST(11 * 5 * 4 AS BIGINT) AS bytes, round(sum(v), 3) AS total FROM t WHERE i BETWEEN 10 AND 20 AND j BETWEEN 3 AND 7 GROUP BY ts")
def _(spark, sf):
    """A box of each step as raw binary: the files' sizes, and the sum of what they hold."""
    box = grid.subset(_cut(spark, sf), [(10, 20), (3, 7)]).withColumns({"i": F.col("i") - 10, "j": F.col("j") - 3})
    made = ranges.write_raw(box, fresh_path(spark, "raw"), "v", (11, 5), "<f4")
    files = [r["path"] for r in made.orderBy("ts").select("path").collect()]
    sizes = spark.read.format("binaryFile").load(files).select(F.regexp_extract("path", r"-(\d+)\.raw$", 1).cast("int").alias("ts"), F.col("length").alias("bytes"))
    held = ranges.read_raw(spark, files, (11, 5)).groupBy("ts").agg(F.round(F.sum(F.when(~F.isnan("value"), F.col("value"))), 3).alias("total"))
    return sizes.join(held, "ts")


# The store by level and detail.  Blocks of 16 along both axes; the last ones along j are continued by reflection.
# A block's coefficients of two Haar steps, ranked by size; a detail number keeps a part of a block's 256.

def _half(src: str, name: str) -> str:
    """One step along i and then j: band 1 has details along i, 2 along j, 3 along both."""
    c = "CAST(1 / sqrt(2) AS DOUBLE)"
    pair = "any_value(v) FILTER (WHERE {a} % 2 = 0) AS a, any_value(v) FILTER (WHERE {a} % 2 = 1) AS b"
    return f"""{name}x AS (SELECT i // 2 AS i, j, {pair.format(a="i")} FROM {src} GROUP BY i // 2, j),
  {name}y AS (SELECT i, j, 0 AS band, (a + b) * {c} AS v FROM {name}x UNION ALL SELECT i, j, 1, (a - b) * {c} FROM {name}x),
  {name}z AS (SELECT i, j // 2 AS j, band, {pair.format(a="j")} FROM {name}y GROUP BY i, j // 2, band),
  {name} AS (SELECT i, j, band, (a + b) * {c} AS v FROM {name}z UNION ALL SELECT i, j, band + 2, (a - b) * {c} FROM {name}z)"""


LEVELS = (
    G
    + """, n1 AS (SELECT nj // 16 * 16 AS base, nj % 16 AS own, unnest(range((nj + 15) // 16 * 16)) AS q FROM n),
  n2 AS (SELECT q, CASE WHEN q < base THEN q WHEN (q - base) % (2 * own) < own THEN base + (q - base) % (2 * own) ELSE base + 2 * own - 1 - (q - base) % (2 * own) END AS from_j FROM n1),
  p AS (SELECT i, q AS j, v FROM n2 JOIN g ON g.j = from_j),
  """
    + _half("p", "s1")
    + ", a1 AS (SELECT i, j, v FROM s1 WHERE band = 0), "
    + _half("a1", "s2")
    + """, co AS (SELECT i // 4 AS bi, j // 4 AS bj, 0 AS level, band, i, j, v FROM s2 WHERE band = 0
    UNION ALL SELECT i // 4, j // 4, 1, band, i, j, v FROM s2 WHERE band > 0 UNION ALL SELECT i // 8, j // 8, 2, band, i, j, v FROM s1 WHERE band > 0),
  ra AS (SELECT *, row_number() OVER (PARTITION BY bi, bj, level > 0 ORDER BY abs(v) DESC, level, band, j, i) AS rank FROM co),
  lo AS (SELECT *, CASE WHEN level = 0 OR rank <= 256 // 10 + 1 - 16 THEN 0 WHEN rank <= 256 // 4 - 16 THEN 1 ELSE 2 END AS lod FROM ra) """
)


def _back(src: str, name: str) -> str:
    """One step back: bands of a level to samples, details that aren't there as 0."""
    c = "CAST(1 / sqrt(2) AS DOUBLE)"
    pick = "coalesce(any_value(v) FILTER (WHERE band {t}), 0)"
    return f"""{name}p AS (SELECT i, j, band % 2 AS band, coalesce(any_value(v) FILTER (WHERE band < 2), 0) AS a, coalesce(any_value(v) FILTER (WHERE band > 1), 0) AS d FROM {src} GROUP BY i, j, band % 2),
  {name}q AS (SELECT i, 2 * j AS j, band, (a + d) * {c} AS v FROM {name}p UNION ALL SELECT i, 2 * j + 1, band, (a - d) * {c} FROM {name}p),
  {name}r AS (SELECT i, j, {pick.format(t="= 0")} AS a, {pick.format(t="= 1")} AS d FROM {name}q GROUP BY i, j),
  {name} AS (SELECT 2 * i AS i, j, (a + d) * {c} AS v FROM {name}r UNION ALL SELECT 2 * i + 1, j, (a - d) * {c} FROM {name}r)"""


def _store(spark, sf) -> Dataset:
    path, nj = fresh_path(spark, "levels"), table(spark, sf, "embeddings").count()
    progressive.write(field(spark, sf), path, progressive.Layout([NI, nj], 16, "haar", 2, (10, 4, 1)))
    data = Dataset(spark, "levels")
    data.add_mesh(Mesh("grid", ("ni", "nj"), ("x", "y")), {"ni": NI, "nj": nj})
    data.add_progressive(Variable("v", "grid"), path)
    return data


def _rounded(rows):
    return rows.select("i", "j", r6("value").alias("value"))


@query("s1_coefficients", LEVELS + "SELECT CAST(level AS INT) AS level, CAST(lod AS INT) AS lod, count(*) AS n, round(sum(abs(v)), 4) AS total FROM lo GROUP BY ALL")
def _(spark, sf):
    """What the store has by level and detail."""
    path = fresh_path(spark, "levels")
    progressive.write(field(spark, sf), path, progressive.Layout([NI, table(spark, sf, "embeddings").count()], 16, "haar", 2, (10, 4, 1)))
    each = progressive.coefficients(spark, path).select("level", "lod", F.explode("coefficients").alias("c"))
    return each.groupBy("level", "lod").agg(F.count("*").alias("n"), F.round(F.sum(F.abs("c")), 4).alias("total"))


CUT_AT = "(SELECT CAST(nj // 16 * {s} + (nj % 16 >> {d}) AS INT) FROM n)"


@query("p1_coarse_level", LEVELS + f"SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(v / 4, 6) AS value FROM lo WHERE level = 0 AND j < {CUT_AT.format(s=4, d=2)}")
def _(spark, sf):
    """The coarsest level: only the approximations' partition is read."""
    return _rounded(_store(spark, sf).variable("v", level=0))


@query(
    "p1_middle_level_little_detail",
    LEVELS + ", l1 AS (SELECT i, j, band, v FROM lo WHERE level < 2 AND lod = 0), " + _back("l1", "m1")
    + f" SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(v / 2, 6) AS value FROM m1 WHERE i BETWEEN 3 AND 25 AND j BETWEEN 2 AND 30 AND j < {CUT_AT.format(s=8, d=1)}",
)
def _(spark, sf):
    """A box of the middle level with the largest details only."""
    return _rounded(_store(spark, sf).variable("v", level=1, lod=0, box=[(3, 25), (2, 30)]))


@query(
    "c6_best_level_some_detail",
    LEVELS + ", l1 AS (SELECT i, j, band, v FROM lo WHERE level < 2 AND lod < 2), " + _back("l1", "m1")
    + ", l2 AS (SELECT i, j, 0 AS band, v FROM m1 UNION ALL SELECT i, j, band, v FROM lo WHERE level = 2 AND lod < 2), " + _back("l2", "m2")
    + " SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(v, 6) AS value FROM m2, n WHERE j < nj",
)
def _(spark, sf):
    """The best level from a fourth of the coefficients."""
    return _rounded(_store(spark, sf).variable("v", lod=1))


@query(
    "p12_common_accuracy",
    LEVELS + ", l1 AS (SELECT i, j, band, v FROM lo WHERE level < 2), " + _back("l1", "m1")
    + f" SELECT CAST(-2 AS INT) AS level, CAST(-1 AS INT) AS detail, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(v / 2, 6) AS value FROM m1 WHERE j < {CUT_AT.format(s=8, d=1)}",
)
def _(spark, sf):
    """A variable at the best level and detail that two variables have in common."""
    data = _store(spark, sf)
    data._stored["v"] = {(0, -1, -1), (0, -2, -1)}
    data.add_variable(Variable("b", "grid", levels=3, ratios=(10, 4, 1)), field(spark, sf), [(0, -2, -1), (0, -3, -1)])
    level, detail = data.common_accuracy(["v", "b"], 0)
    rows = _rounded(data.variable("v", level=level, lod=detail))
    return rows.select(F.lit(level).alias("level"), F.lit(detail).alias("detail"), "i", "j", "value")


@query("k9_files_to_levels_and_back", CUT + "SELECT ts, i, j, round(v, 6) AS value FROM t WHERE v IS NOT NULL")
def _(spark, sf):
    """NetCDF files to stores by level and detail, and these to NetCDF files again."""
    base = fresh_path(spark, "converted")
    progressive.from_files(spark, _written(spark, sf, _cut(spark, sf), [0.0, 6.0, 12.0, 18.0]), f"{base}/levels", block=32, family="bior4.4", steps=1, ratios=(4, 1))
    progressive.to_files(spark, f"{base}/levels/v", f"{base}/files", "v")
    back = netcdf.open_cf(spark, f"{base}/files").table("v").where("value is not null")
    return back.select("ts", "i", "j", r6("value").alias("value"))


@query("k5_raw_coarse_region", LEVELS + f"SELECT CAST(i - 2 AS INT) AS i, CAST(j - 3 AS INT) AS j, round(v / 4, 4) AS value FROM lo WHERE level = 0 AND i BETWEEN 2 AND 9 AND j BETWEEN 3 AND 20 AND j < {CUT_AT.format(s=4, d=2)}")
def _(spark, sf):
    """A region of the coarsest level as raw binary, read back."""
    path = fresh_path(spark, "levels")
    progressive.write(field(spark, sf), path, progressive.Layout([NI, table(spark, sf, "embeddings").count()], 16, "haar", 2, (10, 4, 1)))
    made = progressive.to_raw(spark, path, fresh_path(spark, "raw"), "v", level=0, box=[(2, 9), (3, 20)], kind="<f8")
    files = [r["path"] for r in made.select("path").collect()]
    return ranges.read_raw(spark, files, (8, 18), "<f8").select("i", "j", F.round("value", 4).alias("value"))
