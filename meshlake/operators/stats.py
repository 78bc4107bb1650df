"""Aggregates over grids, series and particles.  Missing samples are null and skipped."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import written


def value_range(values: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return values.groupBy(*by).agg(F.min("value").alias("low"), F.max("value").alias("high"))


def summary(values: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Minimum, maximum, mean, count and population standard deviation."""
    return values.groupBy(*by).agg(
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.avg("value").alias("mean"),
        F.count("value").alias("n"),
        F.stddev_pop("value").alias("stddev"),
    )


def upper_median(values: DataFrame, accuracy: int = 20_000, limit: int = 100_000) -> DataFrame:
    """(median): element n div 2, from 0, of the sorted samples.

    Exact without sorting everything: approximate quantiles bracket the middle, samples
    below the bracket are counted, and so on inside it, until at most ``limit`` samples
    are left to be ranked.
    """
    present = values.where("value is not null").select("value")
    n = present.count()
    rows, target, below, left = present, n // 2, 0, n
    while left > limit:
        share, slack = (target - below + 0.5) / left, 3.0 / accuracy
        lo, hi = rows.agg(F.percentile_approx("value", [max(0.0, share - slack), min(1.0, share + slack)], accuracy)).first()[0]
        inside = F.col("value").between(lo, hi)
        counted = present.agg(F.count_if(F.col("value") < lo).alias("below"), F.count_if(inside).alias("inside")).first()
        if counted["inside"] == left:  # ties: few distinct values are left
            break
        rows, below, left = present.where(inside), counted["below"], counted["inside"]
    running = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = rows.groupBy("value").agg(F.count("*").alias("m")).withColumn("upto", F.lit(below) + F.sum("m").over(running))
    return ranked.where(F.col("upto") > target).agg(F.min("value").alias("median"))


#: Percentages whose values cut a group's samples in parts, and what they may be off by.
_CUTS, _SLACK = [n / 64 for n in range(65)], 0.001


def upper_median_by(values: DataFrame, by: Sequence[str], limit: int = 100_000) -> DataFrame:
    """Upper median of each group, exact, however large a group is.

    While a group has more than ``limit`` distinct candidates, approximate quantiles of every group (partial aggregates)
    bracket its middle, samples below the bracket are counted, and those inside stay.  The rest is ranked by value
    with its counts, so no task holds more of a group than that.
    """
    present = values.where("value is not null").select(*by, F.col("value").cast("double").alias("value"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    on = same[0]
    for c in same[1:]:
        on = on & c
    rows = present
    state = written(present.groupBy(*by).agg(F.count("*").alias("_left")).select(*[F.col(c).alias(f"_{c}") for c in by], F.floor(F.col("_left") / 2).alias("_target"), F.lit(0).cast("long").alias("_below"), "_left"), "groups")
    while (state.agg(F.max("_left")).first()[0] or 0) > limit:
        cuts = rows.groupBy(*by).agg(F.percentile_approx("value", _CUTS, 10_000).alias("_q"))
        share = (F.col("_target") - F.col("_below") + 0.5) / F.col("_left")
        at = lambda x: F.get("_q", F.least(F.greatest(x, F.lit(0)), F.lit(64)).cast("int"))
        bracket = cuts.join(state, on).select(*state.columns, at(F.floor((share - _SLACK) * 64)).alias("_lo"), at(F.ceil((share + _SLACK) * 64)).alias("_hi"))
        bracket = written(bracket, "brackets")
        met = rows.join(bracket, on)
        counted = met.groupBy(*[f"_{c}" for c in by]).agg(
            *[F.first(c).alias(c) for c in ("_target", "_below", "_left", "_lo", "_hi")],
            F.count_if(F.col("value") < F.col("_lo")).alias("_under"), F.count_if(F.col("value").between(F.col("_lo"), F.col("_hi"))).alias("_inside"),
        )
        sure = (F.col("_below") + F.col("_under") <= F.col("_target")) & (F.col("_target") < F.col("_below") + F.col("_under") + F.col("_inside"))
        held = [F.when(sure, a).otherwise(b).alias(c) for c, a, b in (("_lo", F.col("_lo"), F.lit(-math.inf)), ("_hi", F.col("_hi"), F.lit(math.inf)), ("_below", F.col("_below") + F.col("_under"), F.col("_below")), ("_left", F.col("_inside"), F.col("_left")))]
        now = written(counted.select(*[f"_{c}" for c in by], "_target", *held), "groups")
        before, after = (t.agg(F.sum("_left")).first()[0] for t in (state, now))
        rows = written(rows.join(now, on).where(F.col("value").between(F.col("_lo"), F.col("_hi"))).select(*by, "value"), "inside")
        state = now.drop("_lo", "_hi")
        if after == before:  # ties: few distinct values are left
            break
    counts = rows.groupBy(*by, "value").agg(F.count("*").alias("_m"))
    running = Window.partitionBy(*by).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("_upto", F.sum("_m").over(running)).join(state, on).where(F.col("_below") + F.col("_upto") > F.col("_target"))
    return ranked.groupBy(*by).agg(F.min("value").alias("median"))


def bin_index(value: Column, low: float, high: float, bins: int) -> Column:
    """Bin of a value in [low, high]; the upper end falls into the last bin."""
    if high <= low:
        return F.lit(0)
    at = F.floor((value - F.lit(low)) / F.lit(high - low) * F.lit(bins))
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), at)).cast("int")


def histogram(values: DataFrame, low: float, high: float, bins: int, below: int = 0, above: int = 0, extent: tuple[float, float] | None = None) -> DataFrame:
    """(side, bin, n): counts inside [low, high] and, given the data's ``extent``, in equal bins below and above."""
    v = F.col("value")
    side = F.when(v < low, "below").when(v > high, "above").otherwise("inside")
    index = bin_index(v, low, high, bins)
    if extent is not None and below:
        index = F.when(v < low, F.least(F.lit(below - 1), F.floor((v - extent[0]) / (low - extent[0]) * below))).otherwise(index)
    else:
        index = F.when(v < low, 0).otherwise(index)
    if extent is not None and above:
        index = F.when(v > high, F.least(F.lit(above - 1), F.floor((v - high) / (extent[1] - high) * above))).otherwise(index)
    else:
        index = F.when(v > high, 0).otherwise(index)
    return (
        values.where("value is not null")
        .groupBy(side.alias("side"), index.cast("int").alias("bin"))
        .agg(F.count("*").alias("n"))
    )


def with_empty_bins(counts: DataFrame, bins: int) -> DataFrame:
    """All bins of the inside, empty ones with 0."""
    lattice = counts.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return lattice.join(F.broadcast(counts.where("side = 'inside'").select("bin", "n")), "bin", "left").select(
        "bin", F.coalesce("n", F.lit(0).cast("long")).alias("n")
    )


def max_bin(counts: DataFrame, first: int = 0, last: int | None = None) -> DataFrame:
    """(largest): the largest inside count between bin indices, at least 1."""
    inside = counts.where(f"side = 'inside' and bin >= {first}" + ("" if last is None else f" and bin < {last}"))
    return inside.agg(F.greatest(F.coalesce(F.max("n"), F.lit(0)), F.lit(1)).alias("largest"))


def strided_bins(counts: DataFrame, step: int) -> DataFrame:
    """(bin, largest): the largest of every ``step`` neighbouring bins."""
    return counts.where("side = 'inside'").groupBy(F.floor(F.col("bin") / step).cast("int").alias("bin")).agg(F.max("n").alias("largest"))


def normalised_bins(counts: DataFrame) -> DataFrame:
    """(bin, share): counts by the largest one."""
    inside = counts.where("side = 'inside'")
    top = inside.agg(F.max("n").alias("top"))
    return inside.crossJoin(F.broadcast(top)).select("bin", (F.col("n") / F.col("top")).alias("share"))


def particle_histogram(values: DataFrame, bins: int) -> DataFrame:
    """(bin, n) over the data's own range with ``(bins - 1) * share`` as index."""
    ends = values.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    share = (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    index = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.coalesce(F.floor((bins - 1) * share), F.lit(0)))).cast("int")
    return values.where("value is not null").crossJoin(F.broadcast(ends)).groupBy(index.alias("bin")).agg(F.count("*").alias("n"))


def particle_bins(particles: DataFrame, coords: Sequence[str], low: Sequence[float], high: Sequence[float], bins: Sequence[int], value: str | None = None) -> DataFrame:
    """Count, and mean of ``value``, of particles in a lattice of bins; every bin is listed,
    empty ones with count 0 and a null mean."""
    keys = [bin_index(F.col(c), lo, hi, n).alias(f"b{c}") for c, lo, hi, n in zip(coords, low, high, bins)]
    inside = F.lit(True)
    for c, lo, hi in zip(coords, low, high):
        inside = inside & F.col(c).between(lo, hi)
    aggregates = [F.count("*").alias("density")] + ([F.avg(value).alias("mean")] if value else [])
    found = particles.where(inside).groupBy(*keys).agg(*aggregates)
    total = 1
    for n in bins:
        total *= n
    lattice, left = particles.sparkSession.range(total), F.col("id")
    columns = []
    for c, n in zip(coords, bins):
        columns.append((left % n).cast("int").alias(f"b{c}"))
        left = F.floor(left / n)
    names = [f"b{c}" for c in coords]
    joined = lattice.select(*columns).join(found, names, "left")
    return joined.withColumn("density", F.coalesce("density", F.lit(0).cast("long")))


def compare(left: DataFrame, right: DataFrame, on: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Errors between two variables aligned by position; pairs with a missing side are skipped.

    ``nl_max`` is the largest difference by the range of the first, ``nrms`` the root mean
    square by that range.
    """
    pair = left.select(*on, F.col("value").alias("_a")).join(right.select(*on, F.col("value").alias("_b")), list(on))
    pair = pair.where("_a is not null and _b is not null")
    diff = F.col("_a") - F.col("_b")
    grouped = pair.groupBy(*by).agg(
        F.max(F.abs(diff)).alias("l_max"),
        F.sqrt(F.avg(diff * diff)).alias("rms"),
        (F.max("_a") - F.min("_a")).alias("_range"),
        F.max(F.abs("_a")).alias("_top"),
        F.count("*").alias("n"),
    )
    by_range = lambda c: F.when(F.col("_range") != 0, F.col(c) / F.col("_range"))
    return grouped.select(
        *by, "n", "l_max", "rms", by_range("l_max").alias("nl_max"), by_range("rms").alias("nrms"),
        F.when(F.col("_top") != 0, F.col("l_max") / F.col("_top")).alias("relative"),
    )


def extents(tables: Sequence[DataFrame], coords: Sequence[str], union: bool = True) -> DataFrame:
    """Joint extents of several tables: their union, or their intersection."""
    ends = None
    for t in tables:
        one = t.agg(*[F.min(c).alias(f"{c}_low") for c in coords], *[F.max(c).alias(f"{c}_high") for c in coords])
        ends = one if ends is None else ends.unionByName(one)
    low, high = (F.min, F.max) if union else (F.max, F.min)
    return ends.agg(*[low(f"{c}_low").alias(f"{c}_low") for c in coords], *[high(f"{c}_high").alias(f"{c}_high") for c in coords])


def running_integral(streams: DataFrame, value: str, scale: float = 1.0) -> DataFrame:
    """Streams (stream, step, x, y, z, special) with ``integral``: value times distance summed
    along the stream, starting anew behind a separator and unchanged where the value is null."""
    order = Window.partitionBy("stream").orderBy("step")
    segment = F.sum(F.when(F.col("special"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = streams.withColumn("_seg", segment)
    inner = Window.partitionBy("stream", "_seg").orderBy("step")
    plain = cut.where("not special")
    coords = [c for c in ("x", "y", "z") if c in streams.columns]
    squares = [(F.col(c) - F.lag(c).over(inner)) ** 2 for c in coords]
    distance = F.sqrt(sum(squares[1:], squares[0]))
    step = F.coalesce(F.col(value) * distance * F.lit(scale), F.lit(0.0))
    return plain.withColumn("_d", step).withColumn("integral", F.sum("_d").over(inner.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_d", "_seg")


def final_value(streams: DataFrame, value: str) -> DataFrame:
    """Every sample of a stream set to the stream's last value."""
    order = Window.partitionBy("stream").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return streams.withColumn(value, F.last(value, ignorenulls=True).over(order))
