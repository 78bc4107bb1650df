"""Streaming forms of the series aggregates: windows with watermarks, and arbitrary state.

An extension: the batch operators see a finite list of steps; these keep up with steps
that are still arriving.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stats import bin_index


def windowed_summary(events: DataFrame, time: str, value: str, by: Sequence[str], window: str, late: str) -> DataFrame:
    """Range, mean and count in tumbling windows; events later than ``late`` are dropped."""
    return (
        events.withWatermark(time, late)
        .groupBy(F.window(time, window), *by)
        .agg(F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), F.count(value).alias("n"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "low", "high", "mean", "n")
    )


def windowed_histogram(events: DataFrame, time: str, value: str, low: float, high: float, bins: int, window: str, late: str) -> DataFrame:
    """Histogram counts in tumbling windows."""
    return (
        events.withWatermark(time, late)
        .where(F.col(value).between(low, high))
        .groupBy(F.window(time, window), bin_index(F.col(value), low, high, bins).alias("bin"))
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("start"), "bin", "n")
    )


def windowed_density(particles: DataFrame, time: str, coords: Sequence[str], low, high, bins, window: str, late: str) -> DataFrame:
    """Particle counts per bin in tumbling windows."""
    keys = [bin_index(F.col(c), lo, hi, n).alias(f"b{c}") for c, lo, hi, n in zip(coords, low, high, bins)]
    return (
        particles.withWatermark(time, late)
        .groupBy(F.window(time, window), *keys)
        .agg(F.count("*").alias("density"))
        .select(F.col("window.start").alias("start"), *[f"b{c}" for c in coords], "density")
    )


def sessions(events: DataFrame, time: str, by: str, gap: str, late: str) -> DataFrame:
    return (
        events.withWatermark(time, late)
        .groupBy(F.session_window(time, gap), by)
        .agg(F.count("*").alias("n"))
        .select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
    )
