"""Sources, sinks, catalog, user functions, time joins, colours and streaming."""

import colorsys
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlake.functions import atmosphere, colour, scalar
from meshlake.operators import timeline
from meshlake.operators.grid import RegularGrid, missing_to_null
from meshlake.plans.catalog import Dataset, Mesh, Variable, grid_type, is_uniform, normal_level, open_dataset
from meshlake.plans.registry import Registry
from meshlake.sources import bov, tables
from meshlake.streaming import series


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{n}") for n, c in enumerate(columns)]).first()


@pytest.mark.parametrize("kind,code", [("FLOAT", "<f4"), ("INT", "<i4"), ("DOUBLE", ">f8")])
def test_bov(spark, tmp_path, kind, code):
    values = np.arange(24).reshape(4, 3, 2)
    (tmp_path / "a.bin").write_bytes(b"xx" + values.astype(code).tobytes())
    endian = "BIG" if code[0] == ">" else "LITTLE"
    for t in (5, 1):
        (tmp_path / f"h{t}.bov").write_text(
            f"# a brick\nTIME: {t}\nDATA_FILE: a.bin\nDATA_SIZE: 2 3 4\nDATA_FORMAT: {kind}\nVARIABLE: v\nBRICK_ORIGIN: 0 1 2\nBRICK_SIZE: 1 2 3\nBYTE_OFFSET: 2\nDATA_ENDIAN: {endian}\n"
        )
    rows = bov.read(spark, str(tmp_path / "*.bov")).where("ts = 1").collect()
    assert len(rows) == 24 and {r.variable for r in rows} == {"v"}
    for r in rows:
        assert r.value == values[r.k, r.j, r.i] and (r.x, r.y, r.z) == (r.i, 1 + r.j, 2 + r.k)
    for bad in ("DATA_SIZE: 1 3 4", "DATA_FORMAT: X", "VARIABLE:"):
        text = f"DATA_FILE: a\nDATA_SIZE: 2 3 4\nDATA_FORMAT: FLOAT\nVARIABLE: v\n{bad}"
        with pytest.raises(ValueError):
            bov.parse_header(text)


def test_seed_lists(spark, tmp_path):
    good, bad = tmp_path / "good.txt", tmp_path / "bad.txt"
    good.write_text("# seeds\n 1, 2,3\n1,2 ,3.0\n\n4,5,6,7\n")
    bad.write_text("1,2,3\n1,x,3\n")
    assert sorted(map(tuple, tables.read_seeds(spark, str(good)).collect())) == [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)]
    assert tables.read_seeds(spark, str(bad)).count() == 0


def test_store(spark, tmp_path):
    array = np.arange(60.0).reshape(3, 4, 5)
    path = str(tmp_path / "v")
    for ts in (0, 1):
        tables.write_variable(tables.from_numpy(spark, array + ts).withColumn("ts", F.lit(ts)), path, blocks=2)
    got = tables.read_variable(spark, path, ts=1, box=[(1, 3), (2, 3), (0, 1)], blocks=2)
    assert sorted(r.value for r in got.collect()) == sorted((array[0:2, 2:4, 1:4] + 1).ravel())
    assert "PartitionFilters: [isnotnull(ts" in got._jdf.queryExecution().toString()
    tables.copy_variable(spark, path, str(tmp_path / "w"))
    assert tables.read_variable(spark, str(tmp_path / "w")).count() == 120
    data = open_dataset(spark, path, "v", RegularGrid((5, 4, 3), (0.0,) * 3, (1.0,) * 3))
    assert data.times == [0.0, 1.0] and data.data_range("v", 1) == (1.0, 60.0)
    raw = tables.raw_bytes(data.variable("v", 0), (5, 4, 3))
    assert np.frombuffer(raw, "<f4").tolist() == array.ravel().tolist()


def test_files_as_one_series(spark):
    a, b = (spark.createDataFrame([(s, float(10 * n + s)) for s in range(2)], "step int, value double") for n in range(2))
    timed = tables.aggregate_files([(a, [5.0, 1.0]), (b, [1.0, 9.0])])
    assert sorted((r.ts, r.value) for r in timed.collect()) == [(0, 1.0), (0, 10.0), (1, 0.0), (2, 11.0)]
    counted = tables.aggregate_files([(a, None), (b, None)])
    assert sorted((r.ts, r.value) for r in counted.collect()) == [(0, 0.0), (1, 1.0), (2, 10.0), (3, 11.0)]
    plain = tables.aggregate_files([(a.drop("step"), None), (b.drop("step"), None)])
    assert {(r.ts, r.value) for r in plain.collect()} == {(0, 0.0), (0, 1.0), (1, 10.0), (1, 11.0)}


def test_catalog(spark):
    data = Dataset(spark)
    data.add_mesh(Mesh("m", ("a", "b"), ("x", "y")), {"a": 10, "b": 4})
    rows = spark.createDataFrame([(i, j, float(i), 0) for i in range(10) for j in range(4)], "i int, j int, value double, ts int")
    data.times = [0.0, 1.0]
    data.add_variable(Variable("u", "m", time_varying=True, levels=3), rows, [(0, -1, -1)])
    data.add_variable(Variable("x", "m", kind="coordinate"), rows.drop("ts"))
    data.add_derived(Variable("d", "m", inputs=("u",)), lambda d: d.variable("u").withColumn("value", F.col("value") * 2))
    assert data.names() == ["d", "u"] and data.names("coordinate") == ["x"] and data.names(ndim=3) == []
    assert data.inputs("d") == ["x", "u", "d"]
    assert data.exists("d", 0) and not data.exists("u", 1) and not data.exists("u", 0, -2) and not data.exists("nope")
    assert data.first(2) == (0, "d") and data.first(3) is None
    assert data.shape("u", -2) == (5, 2) and data.shape("u", 0) == (2, 1)  # an unfinished block of 10 is shifted, 10 >> 2
    assert data.variable("d", box=[(8, 20), (0, 0)]).agg(F.sum("value")).first()[0] == 34.0
    assert data.variable("u", box=[(1, 1), (1, 1)], exact=False, block=2).count() == 4
    assert data.describe().count() == 3 and data.dimension_table().count() == 2 and data.mesh_table().count() == 1
    data.remove_derived("d")
    assert data.names() == ["u"]
    assert (normal_level(0, 3), normal_level(9, 3), normal_level(-1, 3), normal_level(-9, 3)) == (-3, -1, -1, -3)
    assert grid_type([(1, True)] * 3) == "regular" and grid_type([(1, True), (1, False)]) == "stretched"
    assert grid_type([(1, True), (1, True), (3, False)]) == "layered" and grid_type([(2, False), (2, False), (1, True)]) == "curvilinear"
    assert is_uniform([0, 1, 2.00001]) and not is_uniform([0, 1, 3])


def test_user_functions(spark):
    data = Dataset(spark)
    data.add_mesh(Mesh("m", ("a", "b")), {"a": 4, "b": 3})
    index = tables.from_numpy(spark, np.arange(12.0).reshape(3, 4))
    data.add_variable(Variable("a", "m"), index)
    data.add_variable(Variable("t", "m", time_varying=True), index.withColumn("ts", F.explode(F.array(F.lit(0), F.lit(1)))))
    registry = Registry(data)
    registry.add("whole", "m = a - a.mean()\nn = np.flip(a, axis=1)", ["a"], ["m", "n"])
    registry.add("point", "p = np.where(a > 3, t, np.nan)", ["a", "t"], ["p"], pointwise=True)
    assert sorted(r.value for r in data.variable("m").collect()) == [x - 5.5 for x in range(12)]
    assert {(r.i, r.j): r.value for r in data.variable("n").collect()}[0, 0] == 3.0
    assert data.variables["p"].time_varying and not data.variables["m"].time_varying
    rows = data.variable("p", ts=1).collect()
    assert sorted((r.value is None, r.value or 0) for r in rows) == [(False, float(x)) for x in range(4, 12)] + [(True, 0)] * 4
    for bad in ((["a"], ["a"]), (["zz"], ["q"]), (["a"], ["1q"])):
        with pytest.raises(ValueError):
            registry.add("bad", "q = 1", *bad)
    with pytest.raises(SyntaxError):
        registry.add("bad", "q = = 1", ["a"], ["q"])
    assert registry.names() == ["point", "whole"] and registry.get("point").pointwise
    registry.remove("whole")
    assert "m" not in data.variables


def test_time_joins(spark):
    steps = spark.createDataFrame([(0, 0.0, 1.0), (0, 10.0, 3.0)], "g int, t double, v double")
    asked = spark.createDataFrame([(0, n, t) for n, t in enumerate([-1.0, 0.0, 2.5, 10.0, 11.0])], "g int, n int, t double")
    got = {r.n: r.v for r in timeline.as_of_linear(asked, steps, ["g"], "t", "v").collect()}
    assert got == {0: None, 1: 1.0, 2: 1.5, 3: 3.0, 4: None}
    merged = timeline.merge_timelines([steps, asked], "t")
    assert merged.count() == 7 and timeline.merge_timelines([steps, asked], "t", unique=True).count() == 5
    near = timeline.nearest_step(asked.select("t"), steps.select("t", F.col("v").cast("long").alias("step")), "t")
    assert {r.t: r.step for r in near.collect()} == {-1.0: 1, 0.0: 1, 2.5: 1, 10.0: 3, 11.0: 3}


def test_missing_values(spark):
    table = spark.createDataFrame([(1.0,), (-9.0,), (float("nan"),)], "value double")
    assert [r.value for r in missing_to_null(table, -9.0).collect()] == [1.0, None, None]


def test_times_and_units(spark):
    lit = F.lit
    r = one(spark, scalar.parse_model_time(lit("2001-02-03_04:05:06")), scalar.parse_model_time(lit("2001-034_04:05:06")), scalar.parse_model_time(lit("x")))
    assert r.c0 == r.c1 == 981173106.0 and r.c2 is None
    parts = scalar.decode_time(lit(981173106.0))
    assert tuple(one(spark, *parts.values())) == (2001, 2, 3, 4, 5, 6)
    assert one(spark, scalar.encode_time(*[lit(x) for x in (2001, 2, 3, 4, 5, 6)])).c0 == 981173106.0
    assert one(spark, scalar.convert(lit(1.0), "bar", "hPa")).c0 == pytest.approx(1000)
    with pytest.raises(ValueError):
        scalar.convert(lit(1.0), "m", "K")
    assert tuple(one(spark, scalar.is_latitude(lit("degrees_north")), scalar.is_longitude(lit("degrees_north")))) == (True, False)
    terms = one(spark, scalar.formula_terms(lit("s: s_rho  C: Cs_r".replace("  ", " "))), scalar.valid_formula(lit("a: x b: y"), ["b", "a"]))
    assert terms.c0 == {"s": "s_rho", "C": "Cs_r"} and terms.c1
    assert "lcc" in scalar.projection_string({"MAP_PROJ": 1}) and "merc" in scalar.projection_string({"MAP_PROJ": 3})


def test_projections_invert(spark):
    lon, lat = F.lit(12.5), F.lit(41.0)
    for there, back, options in (
        (scalar.mercator, scalar.mercator_inverse, {"lon_0": 3.0, "lat_ts": 20.0}),
        (scalar.equirectangular, scalar.equirectangular_inverse, {"lon_0": 3.0, "lat_ts": 20.0}),
        (scalar.lambert, scalar.lambert_inverse, {"lon_0": 10.0, "lat_0": 40.0, "lat_1": 30.0, "lat_2": 60.0}),
        (scalar.lambert, scalar.lambert_inverse, {"lon_0": 10.0, "lat_0": 40.0, "lat_1": 30.0, "lat_2": 30.0}),
    ):
        assert tuple(one(spark, *back(*there(lon, lat, **options), **options))) == pytest.approx((12.5, 41.0))


def test_colours(spark):
    for rgb in ((0.2, 0.5, 0.9), (1.0, 0.0, 0.0), (0.3, 0.3, 0.3), (0.1, 0.9, 0.4)):
        lit = [F.lit(c) for c in rgb]
        hsv = tuple(one(spark, *colour.rgb_to_hsv(*lit)))
        assert hsv == pytest.approx(colorsys.rgb_to_hsv(*rgb))
        assert tuple(one(spark, *colour.hsv_to_rgb(*map(F.lit, hsv)))) == pytest.approx(rgb)
        assert colour.lab_to_srgb(colour.msh_to_lab(colour.lab_to_msh(colour.srgb_to_lab(rgb)))) == pytest.approx(rgb, abs=2e-3)
    blue, red = (0.23, 0.3, 0.75), (0.7, 0.016, 0.15)
    assert colour.diverging(blue, red, 0.0) == pytest.approx(blue, abs=0.01)
    assert colour.diverging(blue, red, 1.0) == pytest.approx(red, abs=0.01)
    assert min(colour.diverging(blue, red, 0.5)) > 0.8
    assert colour.circular(0.9, 0.1, 0.5) % 1 == pytest.approx(0.0) and colour.discrete(1, 2, 0.5) == 2
    maps = [colour.gaussian(0.5, 0.1), colour.gaussian(0.5, 0.1, inverted=True)]
    assert colour.opacity(maps, 0.3) == pytest.approx(1.0) and colour.opacity(maps, 0.5, multiply=True) == 0.0
    assert colour.sine(1.0, 0.0)(0.5) == pytest.approx(1.0) and colour.opacity([], 0.1) == 0.0
    assert colour.opacity_points([(0.0, 0.0), (0.5, 1.0), (1.0, 0.0)])(0.25) == 0.5


def test_pressure_levels(spark):
    rows = []
    for k in range(20):
        rows.append((0, k, 101325.0 * math.exp(-k * 500 / 8000), 0.0, 0.0, 0.0, 500.0 * k, float(k), 2.0 * k))
    table = spark.createDataFrame(rows, "c int, k int, p double, pb double, t double, q double, height double, u double, v double")
    slp = atmosphere.sea_level_pressure(table, ["c"]).first().slp
    assert slp == pytest.approx(1013.25, rel=0.02)
    shear = atmosphere.shear(table.withColumn("pressure", F.col("p") / 100), ["c"], upper=500.0, lower=850.0).first().shear
    at = []
    for target in (500, 850):
        above = next(k for k in range(20) if rows[k][2] / 100 < target)
        share = (target - rows[above][2] / 100) / (rows[above - 1][2] / 100 - rows[above][2] / 100)
        at.append(share * above + (1 - share) * (above - 1))
    assert shear == pytest.approx((at[0] - at[1]) * math.sqrt(5))


def test_streams(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    cases = {
        "summary": lambda e: series.windowed_summary(e, "ts", "value", ["event_type"], "1 day", "60 days"),
        "histogram": lambda e: series.windowed_histogram(e, "ts", "value", 0.0, 500.0, 10, "1 day", "60 days"),
        "density": lambda e: series.windowed_density(e, "ts", ["value"], [0.0], [500.0], [5], "1 day", "60 days"),
        "sessions": lambda e: series.sessions(e, "ts", "user_id", "6 hours", "60 days"),
    }
    for name, make in cases.items():
        running = make(source).writeStream.outputMode("complete").format("memory").queryName(name).start()
        running.processAllAvailable()
        running.stop()
        got, want = (sorted(map(str, d.withColumn("mean", F.round("mean", 6)).collect() if "mean" in d.columns else d.collect())) for d in (spark.table(name), make(events)))
        assert got == want


def test_boxes():
    from meshlake.operators import box

    unit = ((0.0, 0.0, 0.0), (1.0, 1.0, 1.0))
    assert box.crop(((-1.0, 0.5, 0.5), (0.5, 2.0, 0.7)), unit) == ((0.0, 0.5, 0.5), (0.5, 1.0, 0.7))
    assert box.intersect(unit, ((0.5, 0.5, 0.5), (2.0, 2.0, 2.0))) == ((0.5,) * 3, (1.0,) * 3)
    assert box.intersect(unit, ((2.0,) * 3, (3.0,) * 3)) is None
    low, high = box.rotated_extents(unit, (0.0, 0.0, 45.0))
    assert high[0] - low[0] == pytest.approx(math.sqrt(2)) and high[2] - low[2] == pytest.approx(1.0)
    assert box.normal((90.0, 0.0, 0.0)) == pytest.approx((0.0, -1.0, 0.0))
    base, u, v = box.plane_patch(unit, (0.5, 0.5, 0.5), (0.0, 0.0, 2.0))
    size = lambda a: math.sqrt(sum(c * c for c in a))
    assert base[2] == pytest.approx(0.5) and size(u) == pytest.approx(1.0) and size(v) == pytest.approx(1.0)
    base, u, v = box.plane_patch(unit, (0.5, 0.5, 0.5), (1.0, 1.0, 0.0))
    assert size(u) * size(v) == pytest.approx(math.sqrt(2))
    assert box.plane_patch(unit, (5.0, 5.0, 5.0), (0.0, 0.0, 1.0)) is None
