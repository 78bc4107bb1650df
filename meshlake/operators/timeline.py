"""Joins in time: as-of with interpolation, nearest, and index ranges between timelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import written


#: Rows of one series that one sort should hold, about.
ROWS = 50_000


def _around(rows: DataFrame, by: Sequence[str], time: str, step: Column) -> DataFrame:
    """Adds ``_b`` and ``_a``: the last ``step`` at or before each row's time and the first at or after it.

    Long series are cut into stretches of about equally many rows, by range partitions of their times, so that no
    task sorts a long one whole and a burst is spread; ``step`` is carried forwards and backwards inside a stretch, and
    each stretch gets the nearest steps outside it.  Both passes are running aggregates.
    """
    seconds = F.col(time).cast("double")
    most = rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n").alias("n"), F.sum("n").alias("all")).first()
    long = (most["n"] or 0) > ROWS
    cut = rows.withColumns({"_step": step, "_cut": F.lit(0)})
    if long:
        # Equal times share a stretch; the numbers are written, so that both uses see the same.
        ranged = rows.withColumn("_step", step).repartitionByRange(-(-most["all"] // ROWS), seconds)
        cut = written(ranged.withColumn("_cut", F.when(seconds.isNotNull(), F.spark_partition_id())), "stretches")
    own = Window.partitionBy(*by, "_cut")
    so_far = lambda order: own.orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = cut.withColumns(
        {
            "_b": F.last("_step", ignorenulls=True).over(so_far(F.col(time).asc())),
            "_a": F.last("_step", ignorenulls=True).over(so_far(F.col(time).desc())),
        }
    )
    if not long:
        return inside.drop("_step", "_cut")
    names = [f"_by{i}" for i in range(len(by))]
    ends = cut.groupBy(*[F.col(c).alias(n) for c, n in zip(by, names)], F.col("_cut").alias("_of")).agg(F.min("_step").alias("_first"), F.max("_step").alias("_last"))
    other = lambda order: Window.partitionBy(*names).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(
        *names,
        "_of",
        F.last("_last", ignorenulls=True).over(other(F.col("_of").asc())).alias("_before"),
        F.last("_first", ignorenulls=True).over(other(F.col("_of").desc())).alias("_after"),
    )
    same = F.col("_cut").eqNullSafe(F.col("_of"))
    for c, n in zip(by, names):
        same &= F.col(c).eqNullSafe(F.col(n))
    return (
        inside.join(ends, same, "left")
        .withColumns({"_b": F.coalesce("_b", "_before"), "_a": F.coalesce("_a", "_after")})
        .drop("_step", "_cut", "_of", "_before", "_after", *names)
    )


def as_of_linear(points: DataFrame, series: DataFrame, by: Sequence[str], time: str, value: str) -> DataFrame:
    """Points with the series value at their time, linear between the steps around it; null outside.

    Points and steps are merged and ordered within ``by``; a point then sees the last step
    before and the first step after it, so nothing is paired up.
    """
    steps = series.select(*by, F.col(time).alias("_t"), F.col(value).alias("_v"), F.lit(None).alias("_p"))
    asked = points.select(*by, F.col(time).alias("_t"), F.lit(None).cast(series.schema[value].dataType).alias("_v"), F.struct(*points.columns).alias("_p"))
    merged = asked.unionByName(steps.withColumn("_p", F.col("_p").cast(asked.schema["_p"].dataType)))
    found = _around(merged, by, "_t", F.when(F.col("_p").isNull(), F.struct("_t", "_v"))).where("_p is not null")
    weight = (F.col("_t") - F.col("_b._t")) / (F.col("_a._t") - F.col("_b._t"))
    at = F.when(F.col("_b").isNull() | F.col("_a").isNull(), None).when(F.col("_a._t") == F.col("_b._t"), F.col("_b._v")).otherwise(
        F.col("_b._v") * (1 - weight) + F.col("_a._v") * weight
    )
    return found.select("_p.*", at.alias(value))


def merge_timelines(timelines: Sequence[DataFrame], time: str, unique: bool = False) -> DataFrame:
    """All times in one table, repeated ones kept unless ``unique``."""
    out = timelines[0].select(time)
    for t in timelines[1:]:
        out = out.union(t.select(time))
    return out.distinct() if unique else out


def nearest_step(timeline: DataFrame, steps: DataFrame, time: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, time, step): for each time the step nearest to it; of two the earlier.

    ``timeline`` has ``by`` and ``time``, ``steps`` also ``step``.  Both neighbours of a time come from one
    ordered pass.
    """
    merged = timeline.select(*by, F.col(time), F.lit(None).cast("long").alias("_s")).unionByName(
        steps.select(*by, F.col(time), F.col("step").cast("long").alias("_s"))
    )
    step = F.when(F.col("_s").isNotNull(), F.struct(F.col(time).alias("t"), "_s"))
    found = _around(merged, by, time, step).where("_s is null")
    later = F.col("_b").isNull() | (F.col("_a.t") - F.col(time) < F.col(time) - F.col("_b.t"))
    return found.select(*by, time, F.when(later & F.col("_a").isNotNull(), F.col("_a._s")).otherwise(F.col("_b._s")).alias("step"))


def step_ranges(mapping: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """First and last global step that show each local step."""
    return mapping.groupBy(*by, "step").agg(F.min("global_step").alias("first_step"), F.max("global_step").alias("last_step"))
