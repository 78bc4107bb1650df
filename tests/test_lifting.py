"""Lifting against exact inverses, filters and plain sums."""

import numpy as np
import pytest

from meshlake.operators import codec, lifting


@pytest.mark.parametrize("family", lifting.FAMILIES)
@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 8, 13, 64, 65])
def test_one_step_is_undone(family, n):
    x = np.random.default_rng(n).integers(-500, 500, (3, n)).astype(float)
    a, d = lifting.forward(x, family)
    assert a.shape == (3, -(-n // 2)) and d.shape == (3, n // 2)
    back = lifting.inverse(a, d, family)
    assert np.allclose(back, x, atol=1e-9) and (family != "intbior2.2" or (back == x).all())


@pytest.mark.parametrize("family", lifting.FAMILIES)
@pytest.mark.parametrize("shape", [(9,), (6, 7), (5, 8, 3)])
def test_levels_are_undone(family, shape):
    x = np.random.default_rng(1).normal(size=shape) * 100
    x = np.round(x) if family == "intbior2.2" else x
    levels = lifting.decompose(x, family, 2)
    assert sum(map(len, levels)) == x.size
    assert np.allclose(lifting.reconstruct(levels, shape, family, 2), x)


@pytest.mark.parametrize("family", [f for f in lifting.FAMILIES if f != "intbior2.2"])
def test_coarse_levels_keep_constants(family):
    levels = lifting.decompose(np.full((8, 12), 3.0), family, 2)
    assert all(np.allclose(d, 0, atol=1e-9) for d in levels[1:])
    for upto, shape in ((0, (2, 3)), (1, (4, 6)), (2, (8, 12))):
        got = lifting.reconstruct(levels, (8, 12), family, 2, upto)
        assert got.shape == shape and np.allclose(got, 3.0)


@pytest.mark.parametrize("family, order", [("haar", 1), ("bior1.3", 1), ("bior2.2", 2), ("bior2.4", 2), ("bior2.6", 2), ("bior4.4", 4)])
def test_polynomials_have_no_details_inside(family, order):
    x = np.arange(64.0)
    for power in range(order):
        _, d = lifting.forward((x / 10) ** power, family)
        assert np.allclose(d[8:-8], 0, atol=1e-8)
    _, d = lifting.forward((x / 10) ** order, family)
    assert not np.allclose(d[8:-8], 0, atol=1e-8)


def test_five_three_by_its_filter():
    x = np.random.default_rng(2).normal(size=9)
    wide = np.pad(x, 4, mode="reflect")
    low, high = np.array([-1, 2, 6, 2, -1]) / 8 * np.sqrt(2), np.array([-1, 2, -1]) / 2 / np.sqrt(2)
    a, d = lifting.forward(x, "bior2.2")
    assert np.allclose(a, [wide[4 + k - 2 : 4 + k + 3] @ low for k in range(0, 9, 2)])
    assert np.allclose(d, [wide[4 + k - 1 : 4 + k + 2] @ high for k in range(1, 9, 2)])


def test_one_three_by_its_filter():
    x = np.random.default_rng(3).normal(size=10)
    wide = np.pad(x, 6, mode="symmetric")
    low = np.array([-1, 1, 8, 8, 1, -1]) / 16 * np.sqrt(2)
    a, _ = lifting.forward(x, "bior1.3")
    assert np.allclose(a, [wide[6 + k - 2 : 6 + k + 4] @ low for k in range(0, 10, 2)])


def test_lines_of_tables(spark):
    rng = np.random.default_rng(4)
    lines = {j: rng.normal(size=7 if j % 2 else 6) for j in range(6)}
    rows = spark.createDataFrame([(i, j, float(v)) for j, x in lines.items() for i, v in enumerate(x)], "i int, j int, value double")
    for family in ("bior4.4", "bior1.3"):
        made = codec.transform_lines(rows, "i", family)
        got = {(r.j, r.i): r.value for r in made.collect()}
        for j, x in lines.items():
            assert np.allclose([got[j, i] for i in range(len(x))], np.concatenate(lifting.forward(x, family)))
        back = {(r.j, r.i): r.value for r in codec.transform_lines(made, "i", family, inverse=True).collect()}
        assert all(abs(back[j, i] - v) < 1e-9 for j, x in lines.items() for i, v in enumerate(x))
