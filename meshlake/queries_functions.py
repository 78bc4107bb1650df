"""Queries over user functions by block, projections, splines and position streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import scalar
from .operators import box, codec, stencil
from .plans.catalog import Dataset, Mesh, Variable
from .plans.registry import Registry
from .queries import NI, G, field, query, r6, stats, table


def _functions(spark, sf, script: str, **options) -> tuple[Dataset, Registry]:
    data = Dataset(spark)
    data.add_mesh(Mesh("plane", ("i", "j"), ("x", "y")), {"i": NI, "j": table(spark, sf, "embeddings").count()})
    data.add_variable(Variable("v", "plane"), field(spark, sf))
    functions = Registry(data)
    functions.block = 16
    functions.add("made", script, ["v"], ["w"], **options)
    return data, functions


CROSS = """p = np.pad(v, 1, mode="edge")
w = (p[1:-1, 1:-1] + p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]) / 5"""
CROSS_SQL = G + """, w AS (SELECT i, j, (v + coalesce(lag(v) OVER a, v) + coalesce(lead(v) OVER a, v) + coalesce(lag(v) OVER b, v) + coalesce(lead(v) OVER b, v)) / 5 AS w FROM g
  WINDOW a AS (PARTITION BY j ORDER BY i), b AS (PARTITION BY i ORDER BY j)) SELECT i, j, round(w, 6) AS value FROM w"""


@query("u2_script_with_halo", CROSS_SQL)
def _(spark, sf):
    """A mean of five neighbours, block by block: each block gets its neighbours' samples."""
    data, _ = _functions(spark, sf, CROSS, halo=1)
    return data.variable("w").select("i", "j", r6("value").alias("value"))


@query("u3_script_on_a_region", CROSS_SQL + " WHERE i BETWEEN 5 AND 40 AND j BETWEEN 10 AND 90")
def _(spark, sf):
    """A region is made from the region and its halo alone, and is that of the whole."""
    data, _ = _functions(spark, sf, CROSS, halo=1)
    return data.variable("w", 0, [(5, 40), (10, 90)]).select("i", "j", r6("value").alias("value"))


@query("u2_script_on_the_whole", G + "SELECT i, j, round(v - m, 6) AS value FROM g, (SELECT avg(v) AS m FROM g)")
def _(spark, sf):
    """Deviations from the mean of the step: Spark makes the mean, the script runs on Arrow batches."""
    data, _ = _functions(spark, sf, "w = v - m", pointwise=True, totals={"m": "avg(v)"})
    return data.variable("w").select("i", "j", r6("value").alias("value"))


@query("u5_printed", G + "SELECT i // 16 || ',' || j // 16 AS part, count(*) || ' samples' || chr(10) AS text FROM g GROUP BY 1")
def _(spark, sf):
    """What a pointwise script prints, for each block that it is called on."""
    _, functions = _functions(spark, sf, "print(v.size, 'samples')\nw = v", pointwise=True)
    return functions.printed("made").select("part", "text")


@query("a19_blocks_with_halo", G + """, b AS (SELECT i, j, v, unnest([(i - 1) // 16, (i + 1) // 16]) AS bi FROM g), d AS (SELECT DISTINCT i, j, v, CAST(bi AS INT) AS bi, unnest([(j - 1) // 16, (j + 1) // 16]) AS bj FROM b WHERE bi BETWEEN 0 AND 3),
  e AS (SELECT DISTINCT i, j, v, bi, bj FROM d, n WHERE bj >= 0 AND bj <= (nj - 1) // 16)
  SELECT bi, CAST(bj AS INT) AS bj, min(v) AS low, max(v) AS high, count(*) AS n FROM e GROUP BY ALL""")
def _(spark, sf):
    """The range of values of each block and the samples beside it."""
    from .plans.registry import with_halo

    last = (table(spark, sf, "embeddings").count() - 1) // 16
    rows = with_halo(field(spark, sf), ["i", "j"], 16, 1).where(f"_bi between 0 and 3 and _bj between 0 and {last}")
    return rows.groupBy(F.col("_bi").alias("bi"), F.col("_bj").alias("bj")).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))


@query("a4_upper_median_of_large_groups", "SELECT event_type, list_sort(list(value))[count(*) // 2 + 1] AS median FROM events GROUP BY 1")
def _(spark, sf):
    """Brackets are refined until each group has few candidates left."""
    return stats.upper_median_by(table(spark, sf, "events"), ["event_type"], 100)


@query(
    "f13_stereographic",
    """SELECT event_id, round(r * sin(radians(value - 180 + 98)), 2) AS x, round(-r * cos(radians(value - 180 + 98)), 2) AS y
       FROM (SELECT event_id, value, 6370000 * (1 + sin(radians(60))) * tan(pi() / 4 - radians(user_id % 85) / 2) AS r FROM events)""",
)
def _(spark, sf):
    forward, _ = scalar.projection("+proj=stere +lon_0=-98 +lat_0=90 +lat_ts=60 +ellps=sphere")
    x, y = forward(F.col("value") - 180, F.col("user_id") % 85)
    return table(spark, sf, "events").select("event_id", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


ROTATED = "+proj=ob_tran +o_proj=eqc +to_meter=0.0174532925199 +o_lat_p=39.25 +o_lon_p=18 +lon_0=-162 +ellps=sphere"


@query(
    "f13_rotated_pole",
    """WITH e AS (SELECT event_id, radians(value - 180 + 162) AS a, radians(user_id % 170 - 85) AS b, radians(39.25) AS p FROM events),
       o AS (SELECT event_id, degrees(atan2(cos(b) * sin(a), sin(p) * cos(b) * cos(a) + cos(p) * sin(b))) + 18 AS x, degrees(asin(sin(p) * sin(b) - cos(p) * cos(b) * cos(a))) AS y FROM e)
       SELECT event_id, round(CASE WHEN x > 180 THEN x - 360 WHEN x < -180 THEN x + 360 ELSE x END, 5) AS x, round(y, 5) AS y FROM o""",
)
def _(spark, sf):
    forward, _ = scalar.projection(ROTATED)
    x, y = forward(F.col("value") - 180, F.col("user_id") % 170 - 85)
    return table(spark, sf, "events").select("event_id", F.round(x, 5).alias("x"), F.round(y, 5).alias("y"))


@query("f13_round_trips", "SELECT event_id, round(value / 3 - 80, 5) AS lon, round(CAST(user_id % 70 + 5 AS DOUBLE), 5) AS lat, 3 AS agree FROM events")
def _(spark, sf):
    """Three projections forward and back give the place they began with; some events lie past 180 degrees, where they come back as less."""
    rows = table(spark, sf, "events").select("event_id", (F.col("value") / 3 - 80).alias("lon"), (F.col("user_id") % 70 + 5).cast("double").alias("lat"))
    agree = F.lit(0)
    for text in ("+proj=stere +lon_0=-98 +lat_0=90 +lat_ts=60", ROTATED, "+proj=lcc +lon_0=-98 +lat_0=40 +lat_1=30 +lat_2=50"):
        forward, inverse = scalar.projection(text)
        lon, lat = inverse(*forward(F.col("lon"), F.col("lat")))
        agree = agree + (scalar.same_longitude(lon, F.col("lon"), 1e-6) & (F.abs(lat - F.col("lat")) < 1e-6)).cast("int")
    return rows.select("event_id", F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat"), agree.alias("agree"))


@query("d1_projected_axes", G + "SELECT i, j, round(radians(i * 2 - 60) * 6370000 * cos(radians(30)), 3) AS x, round(radians(CAST(j % 170 AS DOUBLE) - 85) * 6370000, 3) AS y, v AS value FROM g")
def _(spark, sf):
    """Axes of longitudes and latitudes give places in the plane."""
    values = field(spark, sf)
    forward, _ = scalar.projection("+proj=eqc +lat_ts=30")
    lon = values.select("i").distinct().withColumn("lon", F.col("i") * 2.0 - 60.0)
    lat = values.select("j").distinct().withColumn("lat", F.col("j") % 170 - 85.0)
    return box.projected_axes(values, lon, lat, forward).select("i", "j", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "value")


CUBIC = G + ", c AS (SELECT j, max(v) FILTER (WHERE i = 0) AS a, max(v) FILTER (WHERE i = 1) AS b, max(v) FILTER (WHERE i = 2) AS c, max(v) FILTER (WHERE i = 3) AS d FROM g GROUP BY j) "


@query("f7_spline_midpoints", CUBIC + "SELECT CAST(s.range AS INT) AS i, j, round(a + b * t + c * t * t + d * t * t * t, 6) AS value FROM c, range(63) s, LATERAL (SELECT (s.range + 0.5) / 10.0::DOUBLE AS t)")
def _(spark, sf):
    """Splines go through cubic curves exactly; the curves' coefficients are the first samples of each vector."""
    pick = [F.col("embedding")[n].cast("double") for n in range(4)]
    t = F.col("i") / 10.0
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("j"), *[p.alias(f"c{n}") for n, p in enumerate(pick)], F.posexplode("embedding").alias("i", "_e"))
    lines = rows.select("i", "j", (F.col("c0") + F.col("c1") * t + F.col("c2") * t * t + F.col("c3") * t * t * t).alias("value"))
    return stencil.unstagger_spline(lines, "i").select("i", "j", r6("value").alias("value"))


@query("c7_streams", G + "SELECT j, list_sort(list(CAST(i AS BIGINT))) AS places, true AS small FROM g WHERE abs(v) > 0.05 OR i % 16 = 0 GROUP BY j")
def _(spark, sf):
    """Positions of large samples as streams, merged with more positions; a position takes few bytes."""
    values = field(spark, sf).withColumn("level", F.lit(0))
    large = codec.encode_significance(codec.significance(values.where("abs(value) > 0.05"), ["j"], NI))
    more = codec.encode_significance(codec.significance(values.where("i % 16 = 0"), ["j"], NI))
    both = codec.merge_significance(large, more, ["j"])
    back = codec.decode_significance(both)
    return back.join(both.select("j", (F.octet_length("stream") <= 2 * F.col("n")).alias("small")), "j")
