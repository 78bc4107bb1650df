"""Sharding by a Feistel permutation over global row numbers.

Every row has a number 0..N-1 in (doc_id, checksum, size) order.  A keyed
permutation of 0..N-1 shuffles the numbers; ``shard = p mod k`` and
``slot = p div k``.  Law ``rows``: shard counts differ by one at most and the
slots of a shard have no gaps.  Anyone who knows N, k and the seed can compute
a row's place (``place``) or the row at a place without a table.

Cases: a null text has size 1 and the checksum of the empty text; null ids sort
first; equal rows get different numbers (they tie, so which gets which number
does not show); an empty table gives no rows; other columns are ignored, names
that clash with working columns included.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

SHARDS = 8
ROUNDS = 6
SEED = 20240229
PRIME = 2_147_483_647
#: Steps of the walk.  Less than 3 in 4 numbers of the domain leave 0..N-1 for
#: N = 3 and 1 in sqrt(N) for large N, so the bound is never met in practice;
#: meeting it raises an error instead of giving a wrong place.
WALK = 128


def _keys(seed: int) -> list[tuple[int, int]]:
    out, x = [], seed % PRIME or 1
    for _ in range(ROUNDS):
        a = x = x * 48_271 % PRIME
        b = x = x * 48_271 % PRIME
        out.append((a, b))
    return out


def _sides(n: int) -> tuple[int, int]:
    """a * b >= n with a and b near sqrt(n): the two halves of the Feistel network."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def place(number: int, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """Shard and slot of a row number, computed alone."""
    a, b = _sides(n)
    while True:
        left, right = number % a, number // a
        for i, (m, c) in enumerate(_keys(seed)):
            if i % 2:
                f = (left * m + c) % PRIME
                right = (right + f * f % PRIME) % b
            else:
                f = (right * m + c) % PRIME
                left = (left + f * f % PRIME) % a
        number = right * a + left
        if number < n:
            return number % shards, number // shards


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _div(x: Column, by: int) -> Column:
    return ((x - x % by) / by).cast("long")


def _step(x: Column, n: int, seed: int) -> Column:
    """One pass of the network: two rounds an entry of the key table."""
    a, b = _sides(n)
    keys = _keys(seed)
    pairs = [F.struct(*[F.lit(v).cast("long").alias(k) for k, v in zip("mcno", keys[i] + keys[i + 1])]) for i in range(0, ROUNDS, 2)]

    def square(half: Column, m: Column, c: Column) -> Column:
        v = (half * m + c) % PRIME
        return v * v % PRIME

    def rounds(s: Column, k: Column) -> Column:
        left = (s["l"] + square(s["r"], k["m"], k["c"])) % a
        return F.struct(left.alias("l"), ((s["r"] + square(left, k["n"], k["o"])) % b).alias("r"))

    start = F.struct((x % a).alias("l"), _div(x, a).alias("r"))
    return F.aggregate(F.array(*pairs), start, rounds, lambda s: s["r"] * F.lit(a).cast("long") + s["l"])


def permute(x: Column, n: int, seed: int = SEED) -> Column:
    """The permuted number: the network, walked on until it falls below n."""

    def walk(first):
        walked = F.aggregate(
            F.sequence(F.lit(1), F.lit(WALK)),
            first,
            lambda acc, _: F.when(acc < n, acc).otherwise(_step(acc, n, seed)),
        )
        return _let(walked, lambda v: F.when(v < n, v).otherwise(F.raise_error(F.lit("walk too long")).cast("long")))

    return _let(_step(x, n, seed), lambda first: F.when(first < n, first).otherwise(walk(first)))


def number_rows(rows: DataFrame, order: list[str], ws: Workspace) -> tuple[DataFrame, int]:
    """Adds ``row_no``, dense from 0 in the given order, without a single-task window.

    Rows are range-partitioned and sorted, numbered inside their partition, and
    written; the offsets are running counts over one row per partition.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = ws.save(
        rows.repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in order])
        .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
        .withColumn("_at", F.monotonically_increasing_id()),
        "sorted",
    )
    part = F.shiftright("_at", 33)
    counts = [
        (r["p"], r["n"])  # one row per range partition, bounded by the partition setting
        for r in sorted_rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
    ]
    offsets, total = {}, 0
    for p, n in counts:
        offsets[p], total = total, total + n
    table = rows.sparkSession.createDataFrame(list(offsets.items()), "_p long, _off long")
    numbered = (
        sorted_rows.withColumn("_p", part)
        .join(F.broadcast(table), "_p")
        .withColumn("row_no", F.col("_off") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_p", "_off", "_at")
    )
    return numbered, total


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    ws = Workspace(docs.sparkSession, "shards")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    numbered, n = number_rows(rows, ["doc_id", "text_crc32", "size"], ws)
    return numbered.withColumn("_p", permute(F.col("row_no"), n, seed)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_p") % shards).cast("int").alias("shard"),
        _div(F.col("_p"), shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_no",
    )
