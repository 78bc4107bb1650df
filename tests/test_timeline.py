"""Joins in time of long series with bursts."""

import numpy as np
import pytest

from meshlake.operators import timeline


def series(spark, rng):
    """A quiet series, one that crowds in a short time, and one with equal times."""
    out = {"a": np.sort(rng.uniform(0, 1000, 60)), "b": np.sort(np.r_[rng.uniform(500, 501, 300), rng.uniform(0, 1000, 5)]), "c": np.repeat([10.0, 20.0, 30.0], 40)}
    rows = [(s, float(t), float(np.sin(t) if s != "c" else t)) for s, times in out.items() for t in times]
    return out, spark.createDataFrame(rows, "s string, t double, v double").dropDuplicates(["s", "t"])


@pytest.mark.parametrize("rows", [50_000, 20])
def test_bursts(spark, monkeypatch, rows):
    monkeypatch.setattr(timeline, "ROWS", rows)
    rng = np.random.default_rng(1)
    known, steps = series(spark, rng)
    asked = [(s, n, float(t)) for s in "abcd" for n, t in enumerate(np.r_[rng.uniform(-10, 1010, 80), rng.uniform(499.9, 501.1, 80), [10.0, 20.0]])]
    points = spark.createDataFrame(asked, "s string, n int, t double")
    got = {(r.s, r.n): r.v for r in timeline.as_of_linear(points, steps, ["s"], "t", "v").collect()}
    assert len(got) == len(asked)
    for s, n, t in asked:
        times = np.unique(known.get(s, []))
        if not len(times) or t < times[0] or t > times[-1]:
            assert got[s, n] is None
        else:
            assert got[s, n] == pytest.approx(np.interp(t, times, np.sin(times) if s != "c" else times))
    numbers = {s: np.unique(times) for s, times in known.items()}
    listed = spark.createDataFrame([(s, float(t), n) for s, times in numbers.items() for n, t in enumerate(times)], "s string, t double, step long")
    near = {(r.s, r.t): r.step for r in timeline.nearest_step(points.select("s", "t"), listed, "t", ["s"]).collect()}
    for s, _, t in asked:
        assert near[s, t] == (int(np.abs(numbers[s] - t).argmin()) if s in numbers else None)
