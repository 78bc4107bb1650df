"""Exact deduplication with a two-pass Bloom filter.

Pass 1 sets, for every text hash, two bits in a fixed-size filter and keeps the
bits that were set twice or more.  Pass 2 tests every row: a row with a bit that
was set only once is unique and passes straight through; only the others, the
possibly repeated ones, shuffle.  They are compared by SHA-256, so a false hit of
the filter costs a shuffled row, never a wrong answer.

The filter has 8 to 16 bits a row in each of its two halves, at most ``MAX_BITS``, which
bounds the broadcast: 2^21 words of 16 bytes a half.  Its power fades beyond: at 10^8 rows
some 3 in 10 unique rows look repeated, at 10^9 nearly all do.  More rows shuffle then, by
their hash and without their text in ``report``; the result stays the same.

Cases: a null text counts as empty; of equal texts the row with the largest
doc_id stays and null ids never win over others; rows that repeat both doc_id and
text are one document: the report marks each as kept, ``deduplicate`` returns one
of them; an empty table gives no rows; further columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

MAX_BITS = 1 << 27
MIN_BITS = 1 << 16


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _bits(rows: int) -> int:
    return max(MIN_BITS, min(MAX_BITS, 1 << (8 * max(rows, 1) - 1).bit_length()))


def _places(sha: Column, bits: int) -> list[Column]:
    """The two bits of a hash: one in each half of the filter."""
    h = F.xxhash64(sha)
    return [F.pmod(h, F.lit(bits)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(bits)) + F.lit(bits)]


def build_filter(shas: DataFrame, bits: int) -> DataFrame:
    """(word, mask): the bits that at least two rows set, 64 to a word."""
    return (
        shas.select(F.explode(F.array(*_places(F.col("_sha"), bits))).alias("bit"))
        .groupBy("bit")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask"))
    )


def test_filter(rows: DataFrame, words: DataFrame, bits: int) -> DataFrame:
    """Adds ``_hit``: whether both bits of ``_sha`` were set more than once."""
    first, second = _places(F.col("_sha"), bits)
    for i, place in enumerate((first, second)):
        half = words.where(F.col("word") < bits >> 6 if i == 0 else F.col("word") >= bits >> 6)
        side = F.broadcast(half.select(F.col("word").alias(f"_w{i}"), F.col("mask").alias(f"_m{i}")))
        rows = rows.withColumn(f"_b{i}", place)
        rows = rows.join(side, F.shiftright(f"_b{i}", 6) == F.col(f"_w{i}"), "left")
    hit = [F.coalesce(F.getbit(f"_m{i}", F.col(f"_b{i}").bitwiseAND(F.lit(63)).cast("int")), F.lit(0).cast("byte")) for i in (0, 1)]
    return rows.withColumn("_hit", (hit[0] == 1) & (hit[1] == 1)).drop(
        *[f"_{c}{i}" for c in "bwm" for i in (0, 1)]
    )


def _passes(docs: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Hashes of all rows with the filter's verdict, the filter, and one row for each group of suspects."""
    shas = ws.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(_text(), 256).alias("_sha")), "hashes")
    bits = _bits(shas.count())
    words = ws.save(build_filter(shas, bits), "filter")
    tested = ws.save(test_filter(shas, words, bits), "tested")
    groups = ws.save(tested.where("_hit").groupBy("_sha").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    ws.drop(shas)
    return tested, words, groups, bits


def report(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    Suspects meet their group in a merge join of two written tables, whose hot
    partitions Spark splits.
    """
    ws = Workspace(docs.sparkSession, "exact")
    tested, _, groups, _ = _passes(docs, ws)
    alone = tested.where("not _hit").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("_sha").alias("text_sha256")
    )
    shared = (
        tested.where("_hit")
        .join(groups.hint("merge"), "_sha")
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_sha").alias("text_sha256"))
    )
    return alone.unionByName(shared)


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows that stay, with their own columns.

    Rows whose hash the filter calls unique are projected and written where they
    are read; possibly repeated rows meet their group by (hash, doc_id), a pair
    that no hot group shares.
    """
    ws = Workspace(docs.sparkSession, "exact")
    _, words, groups, bits = _passes(docs, ws)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("doc_id").cast("long").alias("_id"), F.sha2(_text(), 256).alias("_sha"))
    tested = test_filter(packed, words, bits)
    winners = groups.select(F.col("_sha").alias("_g"), F.col("keep_id").alias("_keep"))
    stay = (
        tested.where("_hit")
        .join(winners, (F.col("_sha") == F.col("_g")) & F.col("_id").eqNullSafe(F.col("_keep")), "left_semi")
        .dropDuplicates(["_sha"])
    )
    return tested.where("not _hit").select("_doc.*").unionByName(stay.select("_doc.*"))
