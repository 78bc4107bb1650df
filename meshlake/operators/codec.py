"""Wavelet codec on tables of samples: levels, level-of-detail bands, compression.

One transform step along an axis pairs samples 2m and 2m + 1; Haar coefficients are
window-free group sums.  Other filters and lifting families run on whole lines in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import lifting
from .grid import AXES

ROOT_HALF = math.sqrt(0.5)


def haar_step(values: DataFrame, axis: str) -> DataFrame:
    """(…, axis, approx, detail): sums and differences of neighbouring pairs by sqrt(2).

    An unpaired last sample is paired with itself.
    """
    others = [c for c in values.columns if c not in (axis, "value")]
    pair = values.groupBy(*others, F.floor(F.col(axis) / 2).cast("int").alias("_m")).agg(
        F.max(F.when(F.col(axis) % 2 == 0, F.col("value"))).alias("_a"), F.max(F.when(F.col(axis) % 2 == 1, F.col("value"))).alias("_b")
    )
    b = F.coalesce("_b", "_a")
    return pair.select(
        *others, F.col("_m").alias(axis), ((F.col("_a") + b) * F.lit(ROOT_HALF)).alias("approx"), ((F.col("_a") - b) * F.lit(ROOT_HALF)).alias("detail")
    )


def haar_inverse_step(coefficients: DataFrame, axis: str) -> DataFrame:
    """Samples from one step's approx and detail."""
    low = (F.col("approx") + F.col("detail")) * F.lit(ROOT_HALF)
    high = (F.col("approx") - F.col("detail")) * F.lit(ROOT_HALF)
    both = F.array(
        F.struct((F.col(axis) * 2).cast("int").alias("a"), low.alias("v")), F.struct((F.col(axis) * 2 + 1).cast("int").alias("a"), high.alias("v"))
    )
    others = [c for c in coefficients.columns if c not in (axis, "approx", "detail")]
    return coefficients.withColumn("_s", F.explode(both)).select(*others, F.col("_s.a").alias(axis), F.col("_s.v").alias("value"))


def decompose(values: DataFrame, axis: str, levels: int) -> DataFrame:
    """Coefficients of ``levels`` Haar steps along an axis: (…, axis, level, value).

    Level 0 is the coarsest approximation, 1 the coarsest details, ``levels`` the finest.
    """
    others = [c for c in ("ts", *AXES) if c in values.columns and c != axis]
    out, current = None, values
    for step in range(levels):
        split = haar_step(current, axis)
        details = split.select(*others, axis, F.lit(levels - step).alias("level"), F.col("detail").alias("value"))
        out = details if out is None else out.unionByName(details)
        current = split.select(*others, axis, F.col("approx").alias("value"))
    return current.select(*others, axis, F.lit(0).alias("level"), "value").unionByName(out) if out is not None else current.withColumn("level", F.lit(0))


def reconstruct(coefficients: DataFrame, axis: str, levels: int, upto: int | None = None) -> DataFrame:
    """Samples from coefficients; with ``upto`` below ``levels``, the approximation at that level."""
    others = [c for c in coefficients.columns if c not in (axis, "level", "value")]
    current = coefficients.where("level = 0").drop("level")
    for level in range(1, (levels if upto is None else upto) + 1):
        details = coefficients.where(F.col("level") == level).select(*others, axis, F.col("value").alias("detail"))
        joined = current.withColumnRenamed("value", "approx").join(details, [*others, axis], "left")
        current = haar_inverse_step(joined.withColumn("detail", F.coalesce("detail", F.lit(0.0))), axis)
    return current


def decompose_nd(values: DataFrame, axes: Sequence[str], levels: int) -> DataFrame:
    """Coefficients of ``levels`` Haar steps along several axes: (…, axes, level, band, value).

    Each level splits along all axes; ``band`` has a bit for each axis along which a
    coefficient is a detail, and the part without any is split on.  Levels as in ``decompose``.
    """
    out, current = None, values.withColumn("band", F.lit(0))
    for step in range(levels):
        for bit, axis in enumerate(axes):
            split = haar_step(current, axis)
            rest = [c for c in split.columns if c not in ("approx", "detail", "band")]
            both = F.array(F.struct("band", F.col("approx").alias("value")), F.struct((F.col("band") + (1 << bit)).alias("band"), F.col("detail").alias("value")))
            current = split.select(*rest, F.explode(both).alias("_s")).select(*rest, "_s.band", "_s.value")
        details = current.where("band > 0").withColumn("level", F.lit(levels - step))
        out = details if out is None else out.unionByName(details)
        current = current.where("band = 0")
    current = current.withColumn("level", F.lit(0))
    return current if out is None else current.unionByName(out)


def reconstruct_nd(coefficients: DataFrame, axes: Sequence[str], levels: int, upto: int | None = None) -> DataFrame:
    """Samples from coefficients along several axes; missing details count as 0."""
    current = coefficients.where("level = 0").drop("level")
    for level in range(1, (levels if upto is None else upto) + 1):
        current = current.unionByName(coefficients.where(F.col("level") == level).drop("level"))
        for bit, axis in reversed(list(enumerate(axes))):
            others = [c for c in current.columns if c not in ("band", "value")]
            high = F.col("band").bitwiseAND(F.lit(1 << bit)) != 0
            pairs = current.groupBy(*others, (F.col("band") - F.when(high, 1 << bit).otherwise(0)).alias("band")).agg(
                F.coalesce(F.max(F.when(~high, F.col("value"))), F.lit(0.0)).alias("approx"), F.coalesce(F.max(F.when(high, F.col("value"))), F.lit(0.0)).alias("detail")
            )
            current = haar_inverse_step(pairs, axis)
    return current.drop("band")


def rank_by_size(coefficients: DataFrame, block: Sequence[str]) -> DataFrame:
    """Adds ``rank``, from 1, of the absolute coefficient inside its block; ties by place."""
    place = [c for c in ("level", *AXES) if c in coefficients.columns and c not in block]
    order = Window.partitionBy(*block).orderBy(F.abs("value").desc(), *place)
    return coefficients.withColumn("rank", F.row_number().over(order))


def compress(coefficients: DataFrame, block: Sequence[str], keep: int) -> DataFrame:
    """Approximation coefficients and the ``keep`` largest others of every block."""
    details = rank_by_size(coefficients.where("level > 0"), block).where(F.col("rank") <= keep).drop("rank")
    return coefficients.where("level = 0").unionByName(details)


def detail_bands(coefficients: DataFrame, block: Sequence[str], sizes: Sequence[int]) -> DataFrame:
    """Adds ``lod``: which of successive bands of ``sizes`` largest coefficients one is in.
    Approximations are in band 0; those beyond the last band are left out."""
    ranked = rank_by_size(coefficients.where("level > 0"), block)
    band, upto = None, 0
    for lod, size in enumerate(sizes):
        upto += size
        band = F.when(F.col("rank") <= upto, lod) if band is None else band.when(F.col("rank") <= upto, lod)
    ranked = ranked.withColumn("lod", band.cast("int")).where("lod is not null").drop("rank")
    return coefficients.where("level = 0").withColumn("lod", F.lit(0)).unionByName(ranked)


def upto_band(bands: DataFrame, lod: int) -> DataFrame:
    """The coefficients of a prefix of bands."""
    return bands.where(F.col("lod") <= lod).drop("lod")


def finish(values: DataFrame, low: float | None = None, high: float | None = None, epsilon: float = 0.0) -> DataFrame:
    """Decompressed values kept in a range, tiny ones set to 0."""
    v = F.col("value")
    if low is not None:
        v = F.greatest(v, F.lit(low))
    if high is not None:
        v = F.least(v, F.lit(high))
    return values.withColumn("value", F.when(F.abs(v) < epsilon, 0.0).otherwise(v))


def significance(coefficients: DataFrame, block: Sequence[str], length: int, axis: str = "i") -> DataFrame:
    """(block, places): sorted positions that a block keeps; ``level`` and the index along ``axis`` give the position."""
    position = (F.lit(length) * F.col("level") + F.col(axis)).cast("long")
    return coefficients.groupBy(*block).agg(F.sort_array(F.collect_set(position)).alias("places"))


def invert_significance(maps: DataFrame, total: int) -> DataFrame:
    """The positions 0..total-1 that a map doesn't have."""
    return maps.withColumn("places", F.array_except(F.sequence(F.lit(0).cast("long"), F.lit(total - 1).cast("long")), "places"))


def pack_gaps(places) -> bytes:
    """Ascending positions as the gaps between them less one, seven bits a byte, the lowest first; a set eighth bit goes on."""
    import numpy as np

    places = np.asarray(places, np.uint64)
    gaps = np.diff(places, prepend=np.uint64(0)) - (np.arange(len(places)) > 0).astype(np.uint64)
    width = np.ones(len(gaps), int)
    rest = gaps >> np.uint64(7)
    while rest.any():
        width += rest > 0
        rest >>= np.uint64(7)
    at = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), np.uint8)
    for n in range(int(width.max(initial=0))):
        own = width > n
        byte = (gaps[own] >> np.uint64(7 * n)) & np.uint64(127)
        out[at[own] + n] = byte.astype(np.uint8) | np.where(width[own] > n + 1, 128, 0).astype(np.uint8)
    return out.tobytes()


def unpack_gaps(stream: bytes):
    """The positions of ``pack_gaps``."""
    import numpy as np

    data = np.frombuffer(stream, np.uint8)
    if not len(data):
        return np.zeros(0, np.int64)
    last = data < 128
    number = np.cumsum(last) - last
    start = np.flatnonzero(np.concatenate([[True], last[:-1]]))
    shift = (np.arange(len(data)) - start[number]) * 7
    gaps = np.zeros(int(number[-1]) + 1, np.uint64)
    np.add.at(gaps, number, (data & 127).astype(np.uint64) << shift.astype(np.uint64))
    gaps[1:] += np.uint64(1)
    return np.cumsum(gaps).astype(np.int64)


def encode_significance(maps: DataFrame) -> DataFrame:
    """(block, n, stream): maps with their ``places`` as a stream of bytes."""
    return _streams(maps, "places", lambda places: places)


def merge_significance(streams: DataFrame, more: DataFrame, block: Sequence[str]) -> DataFrame:
    """Streams of the positions that a block has in either table of streams."""
    both = streams.select(*block, "stream").unionByName(more.select(*block, "stream"))
    return _streams(both.groupBy(*block).agg(F.collect_list("stream").alias("_streams")), "_streams", lambda all_: _union(all_))


def _union(streams: Sequence[bytes]):
    import numpy as np

    return np.unique(np.concatenate([unpack_gaps(x) for x in streams]))


def _streams(rows: DataFrame, column: str, places) -> DataFrame:
    keys = [c for c in rows.columns if c != column]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [places(x) for x in batch.column(column).to_pylist()]
            made = [pa.array([len(x) for x in found], pa.int64()), pa.array([pack_gaps(x) for x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], *made], [*keys, "n", "stream"])

    return rows.select(*keys, column).mapInArrow(run, f"{kinds}, n long, stream binary")


def decode_significance(streams: DataFrame) -> DataFrame:
    """(block, places) from streams."""
    keys = [c for c in streams.columns if c not in ("n", "stream")]
    kinds = ", ".join(f"{c} {streams.schema[c].dataType.simpleString()}" for c in keys)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = pa.array([unpack_gaps(x) for x in batch.column("stream").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], found], [*keys, "places"])

    return streams.select(*keys, "stream").mapInArrow(run, f"{kinds}, places array<long>")


def dims_at_level(n: Column, block: int, levels_down: int) -> Column:
    """Samples of an axis after halving blocks ``levels_down`` times, at least 1."""
    whole = F.floor(n / block) * max(1, -(-block // (1 << levels_down)))
    rest = F.shiftright((n % block).cast("int"), levels_down)
    return F.greatest(F.lit(1), (whole + rest).cast("int"))


def max_levels(n: int, taps: int = 2) -> int:
    """Halvings of a line of n samples that keep it as long as the filter."""
    return max(0, int(math.log2(n / max(taps - 1, 1)))) if n >= taps else 0


#: Orthogonal low-pass filters by name.
FILTERS = {
    "haar": (ROOT_HALF, ROOT_HALF),
    "db2": tuple((a + b * math.sqrt(3)) / (4 * math.sqrt(2)) for a, b in ((1, 1), (3, 1), (3, -1), (1, -1))),
}


def filter_line(line, name: str, inverse: bool = False):
    """One periodic step of an orthogonal filter over lines of even length (NumPy, along the last axis)."""
    import numpy as np

    low = np.array(FILTERS[name])
    high = low[::-1] * np.array([1, -1] * (len(low) // 2))
    x = np.asarray(line, float)
    n = x.shape[-1]
    places = (2 * np.arange(n // 2)[:, None] + np.arange(len(low))[None, :]) % n
    if not inverse:
        return np.concatenate([x[..., places] @ low, x[..., places] @ high], axis=-1)
    out = np.zeros_like(x)
    parts = x[..., : n // 2, None] * low + x[..., n // 2 :, None] * high
    for tap in range(len(low)):
        out[..., places[:, tap]] += parts[..., tap]  # a tap meets each place once
    return out


def step_of_lines(lines, name: str, inverse: bool = False):
    """One step of any family over stacked lines: approximations, then details; or back."""
    import numpy as np

    if name not in lifting.FAMILIES or name in FILTERS:
        return filter_line(lines, name, inverse)
    if not inverse:
        return np.concatenate(lifting.forward(lines, name), axis=-1)
    half = -(-lines.shape[-1] // 2)
    return lifting.inverse(lines[..., :half], lines[..., half:], name)


def map_lines(values: DataFrame, axis: str, change) -> DataFrame:
    """The grid with ``change`` of its lines along an axis: a function of stacked lines of equal length (NumPy, L x n)
    to as many lines of another length.  Lines are put together by a shuffle and changed in Arrow batches."""
    others = [c for c in ("ts", *AXES) if c in values.columns and c != axis]
    lines = values.groupBy(*others).agg(F.transform(F.array_sort(F.collect_list(F.struct(axis, "value"))), lambda s: s["value"]).alias("line"))
    schema = lines.schema

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            column = batch.column("line")
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
            offsets = column.offsets.to_numpy() - column.offsets[0].as_py()
            length = np.diff(offsets)
            made = {n: change(flat[offsets[:-1][length == n][:, None] + np.arange(n)]) for n in np.unique(length).tolist()}
            ends = np.concatenate([[0], np.cumsum([made[n].shape[1] for n in length.tolist()])]).astype(np.int32)
            done = np.empty(ends[-1])
            for n, lines in made.items():
                done[ends[:-1][length == n][:, None] + np.arange(lines.shape[1])] = lines
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), pa.array(done, from_pandas=True))], batch.schema.names)

    return lines.mapInArrow(run, schema).select(*others, F.posexplode("line").alias(axis, "value"))


def transform_lines(values: DataFrame, axis: str, name: str, inverse: bool = False) -> DataFrame:
    """One filter step along each line of a grid; families with lifting steps (``lifting.FAMILIES``) take lines of
    any length, orthogonal filters even ones."""
    return map_lines(values, axis, lambda lines: step_of_lines(lines, name, inverse))


def pad_axis(values: DataFrame, axis: str, n: int, block: int, mode: str = "symmetric") -> DataFrame:
    """Samples with the axis filled up to whole blocks: ``symmetric`` mirrors the end with its
    last sample repeated, ``reflect`` without, ``periodic`` goes on at the start, ``smooth``
    repeats the last sample, ``zero`` fills with 0.  Meant for padding shorter than the axis."""
    end = -(-n // block) * block
    at = F.col(axis)
    if mode in ("smooth", "zero"):
        more = F.when(at == n - 1, F.sequence(F.lit(n), F.lit(end - 1)))
    elif mode in ("symmetric", "reflect", "periodic"):
        place = {"symmetric": 2 * n - 1 - at, "reflect": 2 * n - 2 - at, "periodic": n + at}[mode]
        more = F.when((place >= n) & (place < end), F.array(place))
    else:
        raise ValueError(f"unknown padding {mode}")
    if end == n:
        return values
    added = values.withColumn("_at", F.explode(more)).withColumn(axis, F.col("_at").cast(values.schema[axis].dataType)).drop("_at")
    if mode == "zero":
        added = added.withColumn("value", F.lit(0.0))
    return values.unionByName(added)


def cut_axis(values: DataFrame, axis: str, n: int) -> DataFrame:
    """Samples without their padding."""
    return values.where(F.col(axis) < n)


def blocks(values: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Adds the block of each sample along the axes of ``sizes`` (``b`` and the axis) and its place there (``o`` and the axis)."""
    return values.withColumns({f"b{a}": F.floor(F.col(a) / n).cast("int") for a, n in sizes.items()} | {f"o{a}": (F.col(a) % n).cast("int") for a, n in sizes.items()})


def unblock(values: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """The index of each sample from its block and place."""
    return values.withColumns({a: F.col(f"b{a}") * n + F.col(f"o{a}") for a, n in sizes.items()}).drop(*[f"{p}{a}" for p in "bo" for a in sizes])
