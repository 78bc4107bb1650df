"""Data parts of drawing operators: contour vertices, barbs, particle marks, displacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .grid import AXES, COORDS, RegularGrid
from .sample import sample_nearest


def contour_vertices(values: DataFrame, grid: RegularGrid, levels: Sequence[float]) -> DataFrame:
    """(ci, cj, level, edge, x, y): places where a cell's edges cross a level.

    Edges run round the cell: 0 bottom, 1 right, 2 top, 3 left.  An edge is crossed if one
    end is at most the level and the other above.  Cells with a missing corner have none.
    """
    around = [(0, 0), (1, 0), (1, 1), (0, 1)]
    spots = F.array(
        *[
            F.struct(F.lit(n).alias("n"), (F.col("i") - di).cast("int").alias("ci"), (F.col("j") - dj).cast("int").alias("cj"))
            for n, (di, dj) in enumerate(around)
        ]
    )
    cells = (
        values.withColumn("_s", F.explode(spots))
        .where(F.col("_s.ci").between(0, grid.n[0] - 2) & F.col("_s.cj").between(0, grid.n[1] - 2))
        .groupBy(F.col("_s.ci").alias("ci"), F.col("_s.cj").alias("cj"))
        .agg(*[F.max(F.when(F.col("_s.n") == n, F.col("value"))).alias(f"v{n}") for n in range(4)])
        .where("v0 is not null and v1 is not null and v2 is not null and v3 is not null")
    )
    edges = []
    for n in range(4):
        (ai, aj), (bi, bj) = around[n], around[(n + 1) % 4]
        edges.append(
            F.struct(
                F.lit(n).alias("edge"), F.col(f"v{n}").alias("a"), F.col(f"v{(n + 1) % 4}").alias("b"),
                F.lit(float(ai)).alias("ai"), F.lit(float(aj)).alias("aj"), F.lit(float(bi)).alias("bi"), F.lit(float(bj)).alias("bj"),
            )
        )
    rows = cells.select("ci", "cj", F.explode(F.array(*edges)).alias("e")).withColumn(
        "level", F.explode(F.array(*[F.lit(float(v)) for v in levels]))
    )
    a, b, level = F.col("e.a"), F.col("e.b"), F.col("level")
    t = (level - a) / (b - a)
    place = lambda c, lo, hi, axis: F.lit(grid.low[axis]) + (F.col(c) + F.col(lo) + t * (F.col(hi) - F.col(lo))) * F.lit(grid.delta(axis))
    return rows.where((a <= level) != (b <= level)).select(
        "ci", "cj", "level", F.col("e.edge").alias("edge"), place("ci", "e.ai", "e.bi", 0).alias("x"), place("cj", "e.aj", "e.bj", 1).alias("y")
    )


def rake(spark, low: Sequence[float], high: Sequence[float], n: Sequence[int]) -> DataFrame:
    """(seed, x, y, z): centres of n equal parts of each side of a box."""
    total = 1
    for m in n:
        total *= m
    rows, left = spark.range(total).withColumnRenamed("id", "seed"), F.col("seed")
    for c, lo, hi, m in zip(COORDS, low, high, n):
        rows = rows.withColumn(c, F.lit(float(lo)) + (left % m + 0.5) * F.lit((hi - lo) / m))
        left = F.floor(left / m)
    return rows


def barbs(points: DataFrame, parts: Sequence[DataFrame], grid: RegularGrid, scale: float) -> DataFrame:
    """Points with the vector sampled there and its end; points where a part is missing have none."""
    out = points
    for name, values in zip("uvw", parts):
        out = sample_nearest(out, values, grid, name)
    for name, c in zip("uvw"[: len(parts)], COORDS):
        out = out.withColumn(f"{c}_end", F.col(c) + F.col(name) * F.lit(scale)).where(F.col(name).isNotNull())
    return out


def largest_component(vectors: DataFrame, parts: Sequence[str]) -> DataFrame:
    columns = [F.abs(F.col(p)) for p in parts]
    return vectors.agg(F.max(F.greatest(*columns) if len(columns) > 1 else columns[0]).alias("largest"))


def particle_marks(particles: DataFrame, step: int, radius: float, index: str = "particle") -> DataFrame:
    """Every step-th particle with its radius."""
    return particles.where(F.col(index) % step == 0).withColumn("radius", F.lit(radius))


def auto_stride(n: int, limit: int = 1_000_000) -> int:
    return 1 if n <= limit else 1 + n // limit


def displaced(values: DataFrame, height: DataFrame) -> DataFrame:
    """Samples with ``z`` from a height variable on the same grid."""
    axes = [a for a in AXES if a in height.columns]
    return values.join(height.select(*axes, F.col("value").alias("z")), axes, "left")


def texture(values: DataFrame) -> DataFrame:
    """Values with a missing flag; missing ones as 0."""
    return values.withColumns({"missing": F.col("value").isNull(), "value": F.coalesce("value", F.lit(0.0))})


def key_frames(spark, frames: Sequence[tuple[int, Sequence[float]]]) -> DataFrame:
    """(frame, c0, c1, ...): values linear between key frames."""
    keys = sorted(frames)
    last = keys[-1][0]
    columns = []
    for c in range(len(keys[0][1])):
        value = F.lit(float(keys[-1][1][c]))
        for (fa, va), (fb, vb) in reversed(list(zip(keys, keys[1:]))):
            share = (F.col("frame") - fa) / F.lit(fb - fa)
            value = F.when(F.col("frame") < fb, F.lit(float(va[c])) + share * F.lit(float(vb[c] - va[c]))).otherwise(value)
        columns.append(value.alias(f"c{c}"))
    return spark.range(keys[0][0], last + 1).select(F.col("id").cast("int").alias("frame"), *columns)


def between_frames(frames: DataFrame) -> DataFrame:
    """(frame, c0, c1, ...): values linear between the key frames of a table.  Key frames are ordered in one task: there are few
    of them, the frames between are made in all."""
    order = Window.orderBy("frame")
    names = [c for c in frames.columns if c != "frame"]
    after = {f"_{c}": F.lead(c).over(order) for c in ["frame", *names]}
    upto = F.coalesce(F.col("_frame") - 1, F.col("frame"))
    each = frames.withColumns(after).withColumn("_at", F.explode(F.sequence("frame", upto)))
    share = (F.col("_at") - F.col("frame")) / (F.col("_frame") - F.col("frame"))
    return each.select(F.col("_at").cast("int").alias("frame"), *[F.coalesce(F.col(c) + (F.col(f"_{c}") - F.col(c)) * share, F.col(c)).alias(c) for c in names])
