"""User functions by block, projections, splines, medians of large groups, position streams, attributes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlake.functions import scalar
from meshlake.operators import codec, stats, stencil
from meshlake.plans.catalog import Dataset, Mesh, Variable
from meshlake.plans.registry import Registry
from meshlake.queries import QUERIES
from meshlake.queries_functions import CROSS  # noqa: F401  registers the queries
from meshlake.sources.tables import from_numpy


def opened(spark, data, other=None):
    out = Dataset(spark)
    out.add_mesh(Mesh("plane", ("i", "j"), ("x",)), {"i": data.shape[1], "j": data.shape[0]})
    out.add_mesh(Mesh("line", ("i",)), {"i": data.shape[1]})
    out.add_variable(Variable("v", "plane"), from_numpy(spark, data))
    out.add_variable(Variable("x", "plane", kind="coordinate"), from_numpy(spark, data * 0 + np.arange(data.shape[1])))
    return out


BLUR = "p = np.pad(v, 2, mode='reflect')\nw = sum(p[a:a + v.shape[0], b:b + v.shape[1]] for a in range(5) for b in range(5))"


def test_blocks_with_a_halo_give_the_whole(spark):
    data = np.random.default_rng(1).normal(size=(13, 22))
    out = opened(spark, data)
    functions = Registry(out)
    functions.block = 5
    functions.add("whole", BLUR, ["v"], ["w"])
    whole = {(r.i, r.j): r.value for r in out.variable("w").collect()}
    functions.remove("whole")
    functions.add("blocks", BLUR, ["v"], ["w"], halo=2)
    blocks = {(r.i, r.j): r.value for r in out.variable("w").collect()}
    assert blocks.keys() == whole.keys() and all(blocks[k] == pytest.approx(whole[k]) for k in whole)
    table = out._tables["v"]
    out._tables["v"] = table.withColumn("value", F.when(F.col("i").between(4, 14) & F.col("j").between(1, 9), F.col("value")))
    part = {(r.i, r.j): r.value for r in out.variable("w", 0, [(6, 12), (3, 7)]).collect()}
    assert len(part) == 35 and all(part[k] == pytest.approx(whole[k]) for k in part)


def test_whole_functions_take_gaps(spark):
    data = np.arange(12.0).reshape(3, 4)
    out = opened(spark, data)
    out._tables["v"] = out._tables["v"].where("not (i = 1 and j = 1)")
    functions = Registry(out)
    functions.add("f", "w = v + x", ["v"], ["w"], coordinates=True)
    got = {(r.i, r.j): r.value for r in out.variable("w").collect()}
    assert got == {(i, j): data[j, i] + i for i in range(4) for j in range(3) if (i, j) != (1, 1)}
    assert functions.inputs_of(functions.get("f")) == ["v", "x"]


def test_totals_of_a_step_need_no_task_for_all_of_it(spark, sf_dir):
    data = np.random.default_rng(3).normal(size=(9, 14))
    out = opened(spark, data)
    functions = Registry(out)
    functions.block = 4
    functions.add("f", "w = (v - m) / (top - m)", ["v"], ["w"], pointwise=True, totals={"m": "avg(v)", "top": "max(v)"})
    want = (data - data.mean()) / (data.max() - data.mean())
    for halo in (None, 1):
        got = {(r.i, r.j): r.value for r in out.variable("w").collect()}
        assert len(got) == data.size and all(got[i, j] == pytest.approx(want[j, i]) for i, j in got)
        part = {(r.i, r.j): r.value for r in out.variable("w", 0, [(6, 12), (3, 7)]).collect()}
        assert len(part) == 35 and all(part[k] == got[k] for k in part)
        functions.sync(functions.state().replace('"pointwise": true, "halo": null', '"pointwise": false, "halo": 1'))
    assert functions.get("f").halo == 1 and functions.get("f").totals == {"m": "avg(v)", "top": "max(v)"}
    for bad in ({"v": "avg(v)"}, {"i": "avg(v)"}, {"a b": "avg(v)"}):
        with pytest.raises(ValueError):
            functions.add("g", "u = v", ["v"], ["u"], pointwise=True, totals=bad)
    plan = QUERIES["u2_script_on_the_whole"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroups" not in plan


def test_other_meshes_are_whole(spark):
    out = opened(spark, np.ones((3, 4)))
    functions = Registry(out)
    functions.add("f", "w = v.sum(axis=0)", ["v"], ["w"], halo=1, mesh="line")
    assert not functions.regional(functions.get("f")) and "w" not in out._regional
    with pytest.raises(ValueError):
        functions.add("g", "u = v", ["v"], ["u"], mesh="nowhere")


def test_stored_functions(spark):
    out = opened(spark, np.ones((3, 4)))
    functions = Registry(out)
    functions.add("f", "w = v", ["v"], ["w"], pointwise=True)
    functions.add("g", "u = v", ["v"], ["u"], halo=1)
    state = functions.state()
    functions.remove("f")
    functions.add("h", "t = v", ["v"], ["t"])
    assert functions.sync(state) == ["f", "h"] and functions.names() == ["f", "g"] and functions.state() == state
    assert functions.sync(state) == [] and "t" not in out.variables
    functions.add("say", "print(v.shape)\ns = v", ["v"], ["s"])
    assert [r.text for r in functions.printed("say").collect()] == ["(3, 4)\n"]


@pytest.mark.parametrize("text", ["+proj=stere +lon_0=10 +lat_0=90 +lat_ts=60", "+proj=stere +lon_0=10 +lat_0=-90 +lat_ts=-71", "+proj=ob_tran +o_proj=eqc +o_lat_p=39.25 +o_lon_p=18 +lon_0=-162", "+proj=eqc +lat_ts=20", "+proj=merc +lon_0=5", "+proj=lcc +lon_0=0 +lat_0=40 +lat_1=30 +lat_2=50"])
def test_projections_come_back(spark, text):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(rng.uniform(-170, 170, 50), rng.uniform(-80, 80, 50))], "lon double, lat double")
    forward, inverse = scalar.projection(text)
    lon, lat = inverse(*forward(F.col("lon"), F.col("lat")))
    for r in rows.select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
        assert r.b == pytest.approx(r.lat, abs=1e-6) and (r.a - r.lon + 180) % 360 - 180 == pytest.approx(0, abs=1e-6)


def test_projections_of_known_places(spark):
    one = spark.range(1)
    north, _ = scalar.projection("+proj=stere +lon_0=0 +lat_0=90 +lat_ts=90")
    x, y = one.select(*north(F.lit(90.0), F.lit(0.0))).first()
    assert x == pytest.approx(2 * scalar.EARTH_RADIUS) and y == pytest.approx(0, abs=1e-6)
    turned, _ = scalar.projection("+proj=ob_tran +o_proj=eqc +o_lat_p=90 +o_lon_p=0 +lon_0=0")
    assert one.select(*turned(F.lit(33.0), F.lit(-12.0))).first()[:] == pytest.approx((33.0, -12.0))
    with pytest.raises(ValueError):
        scalar.projection("+proj=aea")


def test_splines(spark):
    for n in (4, 5, 9):
        x = np.arange(n, dtype=float)
        for power in range(4):
            assert np.allclose(stencil.spline_midpoints((x**power)[None])[0], (x[:-1] + 0.5) ** power)
    y = np.random.default_rng(3).normal(size=(1, 12))
    got, end = stencil.spline_midpoints(y)[0], stencil.spline_midpoints(y[:, ::-1])[0]
    assert np.allclose(got, end[::-1]) and stencil.spline_midpoints(y[:, :3]).tolist() == [((y[0, :2] + y[0, 1:3]) / 2).tolist()]


def test_medians_of_groups_of_every_size(spark):
    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(size=5000) ** 3, "b": np.repeat([1.0, 2.0, 3.0], [10, 1000, 2000]), "c": np.full(3000, 7.0), "d": np.array([4.0]), None: np.r_[rng.uniform(size=999), [1e300]], "e": np.r_[np.zeros(2500), rng.normal(size=2600) * 1e-8]}
    rows = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [("d", None), ("f", None)], "g string, value double")
    for limit in (100_000, 50):
        got = {r.g: r.median for r in stats.upper_median_by(rows, ["g"], limit).collect()}
        assert got == {g: sorted(x)[len(x) // 2] for g, x in groups.items()}


@pytest.mark.parametrize("places", [[], [0], [5], [0, 1, 2], [3, 130, 131, 20000, 2**40], list(range(0, 5000, 7))])
def test_position_streams(places):
    stream = codec.pack_gaps(places)
    assert codec.unpack_gaps(stream).tolist() == places
    assert len(stream) < 8 * max(1, len(places)) and (len(places) < 100 or len(stream) == len(places))


def test_attributes(spark):
    a, b = opened(spark, np.ones((2, 2))), opened(spark, np.ones((2, 2)))
    a.put_attribute("", "title", "x")
    a.put_attribute("v", "units", "K")
    b.copy_attributes(a, "v")
    b.copy_attributes(a, "")
    assert b.attribute("v", "units") == "K" and b.attribute("", "title") == "x" and b.attribute("v", "other") is None
    assert {tuple(r) for r in b.attribute_table().collect()} == {("", "title", "x"), ("v", "units", "K")}


def test_round_trips_past_the_date_line(spark, tmp_path):
    """Values of larger tables reach longitudes above 180, and such as are more than half a turn from a projection's meridian."""
    rows = spark.range(4000).select(F.col("id").alias("event_id"), (F.col("id") * 0.73).alias("value"), (F.col("id") % 83).alias("user_id"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    out = QUERIES["f13_round_trips"](spark, str(tmp_path))
    assert out.where("agree <> 3 or agree is null").count() == 0 and out.where("lon > 180").count() > 2000
    forward, inverse = scalar.projection("+proj=lcc +lon_0=-98 +lat_0=40 +lat_1=30 +lat_2=50")
    place = lambda lon: inverse(*forward(F.lit(lon), F.lit(20.0)))[0]
    got = spark.range(1).select(place(190.0), place(100.0), place(-300.0)).first()
    assert list(got) == pytest.approx([-170.0, 100.0, 60.0])
