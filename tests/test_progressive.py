"""The store by level and detail against the arrays that were put in."""

import numpy as np
import pytest

from meshlake.operators import codec, lifting
from meshlake.plans.catalog import Dataset, Mesh, Variable
from meshlake.plans.scratch import fresh_path
from meshlake.sources import progressive


def table_of(spark, data, steps=1):
    """Steps of an array (j, i) or (k, j, i), each 10 larger than the one before; NaN is left out."""
    rows = []
    for ts in range(steps):
        for place, v in np.ndenumerate(data):
            if not np.isnan(v):
                rows.append((ts, *[int(x) for x in reversed(place)], float(v + 10 * ts)))
    axes = "ijk"[: data.ndim]
    return spark.createDataFrame(rows, "ts int, " + ", ".join(f"{a} int" for a in axes) + ", value double")


def array_of(rows, axes="ij"):
    return {tuple(r[a] for a in axes): r.value for r in rows.collect()}


@pytest.fixture(scope="module")
def data():
    y, x = np.mgrid[0:21, 0:37]
    return np.sin(x / 5) * 10 + np.cos(y / 4) * 7 + np.random.default_rng(5).normal(size=(21, 37)) * 0.2


@pytest.fixture(scope="module")
def store(spark, data):
    path = fresh_path(spark, "progressive")
    layout = progressive.Layout([37, 21], 16, "bior2.2", 1, (20, 2, 1))
    for _ in range(2):  # a second run gives the same store
        progressive.write(table_of(spark, data, 2), path, layout)
    return path, layout


def test_best_level_gives_everything(spark, data, store):
    got = array_of(progressive.read(spark, store[0], 1))
    assert len(got) == 21 * 37
    assert all(got[i, j] == pytest.approx(data[j, i] + 10, abs=1e-9) for j in range(21) for i in range(37))
    assert progressive.read(spark, store[0]).count() == 2 * 21 * 37


def test_coarse_level_by_block(spark, data, store):
    path, layout = store
    got = array_of(progressive.read(spark, path, 0, level=0))
    want = {}
    for bj in range(2):
        for bi in range(3):
            block = data[bj * 16 : bj * 16 + 16, bi * 16 : bi * 16 + 16]
            block = np.pad(block, [(0, 16 - block.shape[0]), (0, 16 - block.shape[1])], mode="symmetric")
            levels = lifting.decompose(block, "bior2.2", 1)
            coarse = levels[0].reshape(8, 8) / 2
            ni, nj = layout.size_at(0, bi, 1), layout.size_at(1, bj, 1)
            want |= {(bi * 8 + i, bj * 8 + j): coarse[j, i] for j in range(nj) for i in range(ni)}
    assert layout.at_level(1) == (16 + 2, 8 + 2)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_details_get_better_and_fewer_are_read(spark, data, store):
    path, _ = store
    errors, counts = [], []
    for lod in (0, 1, 2):
        got = array_of(progressive.read(spark, path, 0, lod=lod))
        errors.append(max(abs(got[i, j] - data[j, i]) for j in range(21) for i in range(37)))
        rows = progressive.coefficients(spark, path).where(f"ts = 0 and lod <= {lod}")
        counts.append(rows.selectExpr("sum(size(coefficients)) n").first().n)
    assert errors[0] > errors[1] > errors[2] and errors[2] < 1e-9
    assert counts == [6 * 64, 6 * 128, 6 * 256]  # approximations alone are more than a 20th


def test_requests_filter_partitions_and_blocks(spark, store):
    path, _ = store
    rows = progressive.read(spark, path, 1, level=0, lod=0, box=[(9, 12), (0, 3)])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and all(x in plan.split("PartitionFilters")[1].split("PushedFilters")[0] for x in ("ts", "lod", "level"))
    assert "PushedFilters: [IsNotNull(bi), IsNotNull(bj)" in plan
    whole = array_of(progressive.read(spark, path, 1, level=0, lod=0))
    assert array_of(rows) == {k: v for k, v in whole.items() if 9 <= k[0] <= 12 and k[1] <= 3}


@pytest.mark.parametrize("family, steps, block", [("haar", 3, 16), ("bior1.3", 1, 16), ("bior4.4", 1, 32), ("intbior2.2", 1, 16)])
def test_families_in_three_dimensions(spark, family, steps, block):
    data = np.round(np.random.default_rng(6).normal(size=(5, 17, 9)) * 50)
    path = fresh_path(spark, "progressive")
    progressive.write(table_of(spark, data), path, progressive.Layout([9, 17, 5], block, family, steps, (8, 1)))
    got = array_of(progressive.read(spark, path), "ijk")
    assert len(got) == data.size and all(v == pytest.approx(data[k, j, i], abs=1e-8) for (i, j, k), v in got.items())


def test_missing_samples(spark):
    data = np.arange(64.0).reshape(8, 8)
    data[2:4, 2:4] = np.nan
    data[7, 0] = np.nan
    path = fresh_path(spark, "progressive")
    progressive.write(table_of(spark, data), path, progressive.Layout([8, 8], 8, "haar", 1, (2, 1)))
    got = array_of(progressive.read(spark, path))
    assert {k for k, v in got.items() if v is None} == {(2, 2), (3, 2), (2, 3), (3, 3), (0, 7)}
    assert all(v is None or v == pytest.approx(data[k[1], k[0]]) for k, v in got.items())
    coarse = array_of(progressive.read(spark, path, level=0))
    assert {k for k, v in coarse.items() if v is None} == {(1, 1)} and len(coarse) == 16


def test_dataset_requests(spark, data, store):
    path, layout = store
    out = Dataset(spark)
    out.times = [0.0, 1.0]
    out.add_mesh(Mesh("grid", ("ni", "nj"), ("x", "y")), {"ni": 37, "nj": 21})
    out.add_progressive(Variable("v", "grid", time_varying=True), path, [(t, lv, ld) for t in (0, 1) for lv in (-1, -2) for ld in (-1, -2) if t == 0 or ld == -2])
    assert out.variables["v"].levels == 2 and out.variables["v"].ratios == (20, 2, 1)
    assert out.shape("v", 0) == layout.at_level(1) and out.shape("v") == (37, 21)
    assert out.variable("v", 0, [(3, 5), (2, 2)]).count() == 3
    assert out.variable("v", 0, level=0, lod=-2).count() == 18 * 10
    with pytest.raises(ValueError):
        out.variable("v", 1, lod=-1)
    assert out.common_accuracy(["v"], 1) == (-1, -2)


def test_too_many_steps_are_refused():
    with pytest.raises(ValueError):
        progressive.Layout([64], 16, "bior4.4", 3)
    assert lifting.max_steps(64, "bior2.2") == 3 and codec.max_levels(64, 6) == 3


def test_a_store_is_opened_by_its_folder(spark, tmp_path):
    data = np.random.default_rng(8).normal(size=(9, 17))
    progressive.write(table_of(spark, data, 2), f"{tmp_path}/v", progressive.Layout([17, 9], 8, "haar", 2, (8, 1), ("lon", "lat"), (0.0, 60.0), {"units": "K"}))
    out = progressive.open_store(spark, str(tmp_path))
    assert out.names() == ["v"] and out.times == [0.0, 60.0] and out.variables["v"].units == "K" and out.shape("v", 0) == (4, 2)
    assert out.variable("v", 1, level=0).count() == 8
    progressive.to_files(spark, f"{tmp_path}/v", f"{tmp_path}/nc", "v", level=0)
    from meshlake.sources import netcdf

    back = netcdf.open_cf(spark, f"{tmp_path}/nc")
    assert back.shape("v") == (4, 2) and array_of(back.variable("v", 1)) == pytest.approx(array_of(out.variable("v", 1, level=0)))
