"""Other sources and sinks: arrays, seed lists, particle sets, multi-file series, the native store."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import AXES

#: Samples that a region in the driver's memory may have.
MOST_RAW = 10_000_000
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def from_numpy(spark: SparkSession, array: np.ndarray, coordinates: Sequence[np.ndarray] = ()) -> DataFrame:
    """(i, j, k, x, y, z, value) of an array with axes (k, j, i); NaN becomes null."""
    import pandas as pd

    index = np.indices(array.shape)
    data = {AXES[a]: index[array.ndim - 1 - a].ravel().astype(np.int32) for a in range(array.ndim)}
    for name, axis in zip(("x", "y", "z"), coordinates):
        axis = np.asarray(axis, float)
        flat = axis[data[AXES["xyz".index(name)]]] if axis.ndim == 1 else np.broadcast_to(axis, array.shape).ravel()
        data[name] = flat
    data["value"] = array.astype(float).ravel()
    out = spark.createDataFrame(pd.DataFrame(data))
    return out.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, z) of a seed list: blanks don't count, # lines are comments, the first three
    numbers of a line are used, equal seeds once.  Any other line empties the list."""
    lines = spark.read.text(path).select(F.regexp_replace("value", r"\s", "").alias("line"))
    lines = lines.where("line != '' and not startswith(line, '#')")
    parts = lines.select(F.split("line", ",").alias("p"))
    good = (F.size("p") >= 3) & F.get("p", 0).rlike(NUMBER) & F.get("p", 1).rlike(NUMBER) & F.get("p", 2).rlike(NUMBER)
    checked = parts.withColumn("good", good)
    verdict = checked.agg(F.coalesce(F.bool_and("good"), F.lit(True)).alias("all_good"))
    seeds = checked.where("good").select(*[F.get("p", n).cast("double").alias(c) for n, c in enumerate("xyz")])
    return seeds.join(F.broadcast(verdict), F.col("all_good")).select("x", "y", "z").dropDuplicates()


def write_flow_lines(rows: DataFrame, path: str) -> None:
    """Export rows as CSV, in stream and step order within each file."""
    rows.repartitionByRange("ID", "step").sortWithinPartitions("ID", "step").drop("step").write.option("header", True).csv(path)


def write_statistics(rows: DataFrame, path: str) -> None:
    """Aggregated rows, few by nature, as one CSV file with a header."""
    rows.coalesce(1).write.option("header", True).csv(path)


def write_variable(values: DataFrame, path: str, blocks: int = 64) -> None:
    """A variable in the native store: Parquet by time step, sorted by block and index so that
    a box request skips row groups.  Steps that the store has already are replaced, others stay,
    so that a second run gives the same store."""
    axes = [a for a in AXES if a in values.columns]
    keys = [F.floor(F.col(a) / blocks).alias(f"b{a}") for a in axes]
    table = values if "ts" in values.columns else values.withColumn("ts", F.lit(0))
    table = table.select("*", *keys)
    order = ["ts", *[f"b{a}" for a in axes]]
    table.repartitionByRange(*order).sortWithinPartitions(*order, *axes).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ts").parquet(path)


def read_variable(spark: SparkSession, path: str, ts: int | None = None, box: Sequence[tuple[int, int]] | None = None, blocks: int = 64) -> DataFrame:
    """A variable of the native store, cut to a time step and an index box.  The box also
    filters block columns, which are sorted, so Parquet statistics prune well."""
    out = spark.read.parquet(path)
    if ts is not None:
        out = out.where(F.col("ts") == ts)
    for axis, (lo, hi) in zip(AXES, box or ()):
        out = out.where(F.col(f"b{axis}").between(lo // blocks, hi // blocks) & F.col(axis).between(lo, hi))
    return out.drop(*[f"b{a}" for a in AXES])


def copy_variable(spark: SparkSession, source: str, target: str, blocks: int = 64) -> None:
    write_variable(read_variable(spark, source), target, blocks)


def aggregate_files(tables: Sequence[tuple[DataFrame, Sequence[float] | None]]) -> DataFrame:
    """Several files as one series: each table is one file with its times, or None.

    Files without times take their place in order; tables with a ``step`` column and no
    times continue the count; with times, the global list is sorted and repeated times
    share a step.
    """
    if all(times is not None for _, times in tables):
        every = sorted({t for _, times in tables for t in times})
        parts = []
        for table, times in tables:
            step = F.col("step") if "step" in table.columns else F.lit(0)
            chosen = F.element_at(F.array(*[F.lit(every.index(t)) for t in times]), (step + 1).cast("int"))
            parts.append(table.withColumn("ts", chosen).drop("step"))
    else:
        parts, offset = [], 0
        for table, _ in tables:
            if "step" in table.columns:
                n = table.agg(F.max("step")).first()[0]
                parts.append(table.withColumn("ts", F.col("step") + offset).drop("step"))
                offset += (-1 if n is None else n) + 1
            else:
                parts.append(table.withColumn("ts", F.lit(offset)))
                offset += 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def particles(rows: DataFrame, position: Sequence[str]) -> DataFrame:
    """A particle set: the position's columns become x, y, z, the rest stay."""
    return rows.withColumnsRenamed(dict(zip(position, "xyz")))


def raw_bytes(values: DataFrame, grid_n: Sequence[int], kind: str = "f4") -> bytes:
    """A region as raw little-endian binary, first axis fastest; larger ones go to files (``ranges.write_raw``)."""
    if int(np.prod(grid_n, dtype=np.int64)) > MOST_RAW:
        raise ValueError("the region is too large for the driver; write it with ranges.write_raw")
    axes = [a for a in AXES if a in values.columns]
    rows = values.orderBy(*reversed(axes)).select("value").toPandas()["value"].to_numpy(float)
    if len(rows) != int(np.prod(grid_n)):
        raise ValueError("the region has gaps")
    return rows.astype("<" + kind).tobytes()
