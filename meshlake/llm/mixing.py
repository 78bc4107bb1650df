"""Mixing sources to target weights along a time-varying curriculum.

Training runs over time t in [0, 1].  Source s has the weight schedule
``w_s(t) = w_s * (1 + g_s * (2t - 1))``: its slope g_s moves it towards the start
(negative) or the end (positive) of training and leaves its integral w_s.  The
integrals fix the targets: shares of the word budget, stopped at ``MAX_EPOCHS``
times a source's size, the excess reshared by weight.  Cumulative demand of s at
t is ``target_s * ((1 - g) t + g t^2)``.  Each source is laid out as a stream of
its documents in hash order, repeated; a document copy that starts at word c of
the stream gets the training position at which the demand reaches c.  The
mixed corpus is range-sorted by position.

The stream of a source ends at its target, so the copy across the end counts for only
the words that remain: taken words of a source equal its target rounded.  ``mix``, which
puts out texts, takes that copy whole or not at all, whichever is nearer.

Cases: a null text has size 0 and is never taken; the null source is a source of
its own, last in order; empty sources get target 0; rows that tie on doc_id are
ordered by checksum and size; equal rows are interchangeable; empty tables give
no rows; further columns pass through ``mix`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
#: Slopes of the schedules, by the source's place in order.
SLOPES = (-0.5, 0.0, 0.5)
#: Words that one running-sum group should hold at most, about.
CHUNK_WORDS = 2_000_000
WORD_BREAK = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than space and tab to return."""
    pieces = F.split(F.coalesce(text, F.lit("")), WORD_BREAK)
    blank_ends = F.when(F.element_at(pieces, 1) == "", 1).otherwise(0) + F.when(
        (F.size(pieces) > 1) & (F.element_at(pieces, -1) == ""), 1
    ).otherwise(0)
    return (F.size(pieces) - blank_ends).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, weight, slope, target) from (source, source_size), one row a source.

    The cap binds for the sources with the least ``size / weight``; ordered by
    that, the level of the others follows from running sums.  Nulls-last code
    point order gives the weights.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("_rank") % len(values) + 1).cast("int"))
    ranked = sizes.withColumn("_rank", rank).select(
        "source", "source_size", "_rank", pick(WEIGHTS).cast("double").alias("weight"), pick(SLOPES).cast("double").alias("slope")
    )
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "_rank")
    cap = F.col("source_size") * F.lit(MAX_EPOCHS)
    budget = F.sum("source_size").over(everything) * F.lit(SHARE)
    capped_before = F.coalesce(F.sum(cap).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight_left = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (budget - capped_before) / weight_left
    levels = ranked.withColumn("_level", level).withColumn("_capped", cap <= F.col("_level") * F.col("weight"))
    common = F.min(F.when(~F.col("_capped"), F.struct(F.col("source_size") / F.col("weight"), "_rank", "_level"))).over(everything)["_level"]
    return levels.withColumn("_common", common).select(
        "source",
        "source_size",
        "weight",
        "slope",
        F.when(F.col("_capped"), cap.cast("double")).otherwise(F.col("_common") * F.col("weight")).alias("target"),
    )


def _position(offset: Column, target: Column, slope: Column) -> Column:
    """Inverse of cumulative demand: t with (1 - g) t + g t^2 = offset / target."""
    q = offset / target
    return 2 * q / ((1 - slope) + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * q))


def plan(docs: DataFrame) -> DataFrame:
    """One row a document: its size, its source's size and target, and for each of
    up to ``MAX_EPOCHS`` copies the words taken and the training position."""
    ws = Workspace(docs.sparkSession, "mixing")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = ws.save(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            word_count(F.col("text")).alias("size"),
            F.xxhash64(F.col("doc_id").cast("long"), text).alias("_h"),
        ),
        "sizes",
    )
    sources = ws.save(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    return _laid_out(rows, sources, ws)


def _laid_out(rows: DataFrame, sources: DataFrame, ws: Workspace) -> DataFrame:
    """Stream offsets by two levels of running sums: over hash ranges of a source,
    then inside a range, so that a source of any size is spread over many tasks."""
    total = rows.agg(F.sum("size").alias("n"), F.count("*").alias("rows")).first()
    chunks = 1
    while chunks < (total["n"] or 0) / CHUNK_WORDS * 4 or chunks < (total["rows"] or 0) / 5_000:
        chunks *= 2
    shift = 64 - chunks.bit_length() + 1
    chunk = F.lit(0).cast("long") if chunks == 1 else F.shiftrightunsigned("_h", shift)
    cut = rows.withColumn("_chunk", chunk)
    parts = cut.groupBy("source", "_chunk").agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("source").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(
        sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))
    )
    parts = ws.save(parts.select(F.col("source").alias("_ps"), F.col("_chunk").alias("_pc"), "_base", "source_size", "slope", "target"), "ranges")
    inside = Window.partitionBy("source", "_chunk").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = (
        cut.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(parts, F.col("source").eqNullSafe(F.col("_ps")) & (F.col("_chunk") == F.col("_pc")))
        .withColumn("_at", F.col("_base") + F.col("_in"))
    )
    copies = []
    for k in range(MAX_EPOCHS):
        start = F.col("_at") + F.lit(k) * F.col("source_size")
        take = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.round("target").cast("long") - start))
        at = F.when(take > 0, _position(start, F.col("target"), F.col("slope")))
        copies.append(F.struct(take.alias("take"), at.alias("position")))
    return out.withColumn("copies", F.array(*copies)).select(
        "doc_id", "source", "size", "source_size", "target", "copies", "_h",
        F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["take"]).alias("taken"),
    )


def in_order(placed: DataFrame, position: str) -> DataFrame:
    """Range-sorted by training position; rows that are never trained on come last."""
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(position).asc_nulls_last(), F.col("_h")]
    return placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and the positions of the copies, in training order."""
    placed = plan(docs).withColumn("position", F.col("copies")[0]["position"])
    return in_order(placed, "position").select(
        "doc_id", "size", "source_size", "target", "taken", "position", F.col("copies")[1]["position"].alias("second_position")
    )


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, a row for each copy taken, in
    training order.  Texts stay whole: the copy across a source's end is taken if at least half of its words are."""
    none = F.lit(-(1 << 63)).cast("long")
    placed = (
        plan(docs)
        .select(F.coalesce("doc_id", none).alias("_k"), "_h", F.col("size").alias("_size"), F.explode("copies").alias("_c"))
        .where((F.col("_c.take") > 0) & (2 * F.col("_c.take") >= F.col("_size")))
    )
    # Rows that repeat id and text are laid out one by one; their copies all come from the first.
    same = Window.partitionBy("_k", "_h", "_size").orderBy("_size")
    full = (
        docs.select(
            F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
            F.coalesce(F.col("doc_id").cast("long"), none).alias("_k"),
            F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))).alias("_h"),
            word_count(F.col("text")).alias("_size"),
        )
        .withColumn("_nth", F.row_number().over(same))
        .where("_nth = 1")
    )
    copies = full.join(placed, ["_k", "_h", "_size"])
    return in_order(copies.withColumn("_pos", F.col("_c.position")), "_pos").select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])
