"""Transfer functions: values to colours and opacities by lookup tables.

A table has 256 entries over [low, high]; a value picks entry
``int(0.5 + (value - low) * 255 / (high - low))``, kept in 0..255.  Tables are small and
fixed in size, so they're built on the driver and joined by broadcast or indexed as an
array literal.
"""

from __future__ import annotations

import colorsys
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRIES = 256


def entry(value: Column, low: float, high: float) -> Column:
    at = F.lit(0.5) + (value - F.lit(low)) * (ENTRIES - 1) / F.lit(high - low)
    return F.greatest(F.lit(0), F.least(F.lit(ENTRIES - 1), at.cast("int")))


def linear(a: float, b: float, r: float) -> float:
    return a * (1 - r) + b * r


def discrete(a: float, b: float, r: float) -> float:
    return a if r < 0.5 else b


def circular(a: float, b: float, r: float, mix: Callable = linear) -> float:
    """Between two hues (0..1) the short way round."""
    if mix is discrete or abs(b - a) <= 0.5:
        return mix(a, b, r)
    out = mix(a + 1, b, r) if a <= b else mix(a, b + 1, r)
    return out - 1 if out >= 1 else out


def _segment(points: Sequence[tuple], at: float) -> tuple[tuple, tuple, float]:
    """The control points around a place and the share of the way between them."""
    left = max((i for i, p in enumerate(points) if p[0] <= at), default=0)
    right = min(left + 1, len(points) - 1)
    width = points[right][0] - points[left][0]
    return points[left], points[right], min(1.0, max(0.0, (at - points[left][0]) / width)) if width else 0.0


def hsv_at(points: Sequence[tuple[float, tuple[float, float, float]]], at: float, mix: Callable = linear) -> tuple[float, float, float]:
    """Colour of a map of (place 0..1, (h, s, v)) control points."""
    (_, a), (_, b), r = _segment(points, at)
    return circular(a[0], b[0], r, mix), mix(a[1], b[1], r), mix(a[2], b[2], r)


def opacity_points(points: Sequence[tuple[float, float]], mix: Callable = linear) -> Callable[[float], float]:
    def at(x: float) -> float:
        (_, a), (_, b), r = _segment(points, min(1.0, max(0.0, x)))
        return mix(a, b, r)

    return at


def gaussian(mean: float, ssq: float, inverted: bool = False) -> Callable[[float], float]:
    def at(x: float) -> float:
        g = math.exp(-((x - mean) ** 2) / (2 * ssq))
        return 1 - g if inverted else g

    return at


def sine(frequency: float, phase: float) -> Callable[[float], float]:
    return lambda x: 0.5 + math.sin(frequency * math.pi * x + phase) / 2


def opacity(maps: Sequence[Callable[[float], float]], x: float, scale: float = 1.0, multiply: bool = False) -> float:
    """Several opacity maps added or multiplied, scaled and capped at 1; none give 0."""
    if not maps:
        return 0.0
    total = math.prod(m(x) for m in maps) if multiply else sum(m(x) for m in maps)
    return min(1.0, total * scale)


def table(spark, colours: Sequence[tuple], opacities: Sequence[Callable], mix: Callable = linear, scale: float = 1.0) -> DataFrame:
    """(entry, r, g, b, a) of a transfer function."""
    rows = []
    for i in range(ENTRIES):
        x = i / (ENTRIES - 1)
        rows.append((i, *colorsys.hsv_to_rgb(*hsv_at(colours, x, mix)), float(opacity(opacities, x, scale))))
    return spark.createDataFrame(rows, "entry int, r double, g double, b double, a double")


def apply_table(values: DataFrame, lut: DataFrame, low: float, high: float, value: str = "value") -> DataFrame:
    """Values with their colour; null values have none."""
    return values.withColumn("entry", entry(F.col(value), low, high)).join(F.broadcast(lut), "entry", "left")


def hsv_to_rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    """Colours from hue, saturation and value, all 0..1."""
    part = lambda n: v - v * s * F.greatest(F.lit(0.0), F.least(_mod6(h * 6 + n), 4 - _mod6(h * 6 + n), F.lit(1.0)))
    return part(5), part(3), part(1)


def _mod6(x: Column) -> Column:
    return x - F.floor(x / 6) * 6


def rgb_to_hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    top, bottom = F.greatest(r, g, b), F.least(r, g, b)
    span = top - bottom
    hue = (
        F.when(span == 0, 0.0)
        .when(top == r, _mod6((g - b) / span))
        .when(top == g, (b - r) / span + 2)
        .otherwise((r - g) / span + 4)
    )
    return hue / 6, F.when(top == 0, 0.0).otherwise(span / top), top


def srgb_to_lab(rgb: Sequence[float]) -> tuple[float, float, float]:
    """CIE L*a*b* (D65) of an sRGB colour."""
    r, g, b = (((c + 0.055) / 1.055) ** 2.4 if c > 0.04045 else c / 12.92 for c in rgb)
    xyz = (
        (0.4124 * r + 0.3576 * g + 0.1805 * b) / 0.9505,
        0.2126 * r + 0.7152 * g + 0.0722 * b,
        (0.0193 * r + 0.1192 * g + 0.9505 * b) / 1.089,
    )
    x, y, z = (t ** (1 / 3) if t > 0.008856 else 7.787 * t + 16 / 116 for t in xyz)
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def lab_to_srgb(lab: Sequence[float]) -> tuple[float, float, float]:
    y = (lab[0] + 16) / 116
    x, z = lab[1] / 500 + y, y - lab[2] / 200
    x, y, z = (t**3 if t**3 > 0.008856 else (t - 16 / 116) / 7.787 for t in (x, y, z))
    x, z = x * 0.9505, z * 1.089
    lin = (3.2406 * x - 1.5372 * y - 0.4986 * z, -0.9689 * x + 1.8758 * y + 0.0415 * z, 0.0557 * x - 0.204 * y + 1.057 * z)
    return tuple(min(1.0, max(0.0, 1.055 * c ** (1 / 2.4) - 0.055 if c > 0.0031308 else 12.92 * c)) for c in lin)


def lab_to_msh(lab: Sequence[float]) -> tuple[float, float, float]:
    """Polar form of L*a*b*: magnitude, saturation angle, hue angle."""
    m = math.sqrt(sum(c * c for c in lab))
    s = math.acos(lab[0] / m) if m > 0.001 else 0.0
    return m, s, math.atan2(lab[2], lab[1]) if s > 0.001 else 0.0


def msh_to_lab(msh: Sequence[float]) -> tuple[float, float, float]:
    m, s, h = msh
    return m * math.cos(s), m * math.sin(s) * math.cos(h), m * math.sin(s) * math.sin(h)


def diverging(rgb1: Sequence[float], rgb2: Sequence[float], x: float) -> tuple[float, float, float]:
    """Colour at x in 0..1 of a diverging map through white, linear in polar L*a*b*."""
    a, b = lab_to_msh(srgb_to_lab(rgb1)), lab_to_msh(srgb_to_lab(rgb2))
    apart = abs(a[2] - b[2])
    if a[1] > 0.05 and b[1] > 0.05 and min(apart, 2 * math.pi - apart) > math.pi / 3:
        middle = max(a[0], b[0], 88.0)
        if x < 0.5:
            b, x = (middle, 0.0, 0.0), 2 * x
        else:
            a, x = (middle, 0.0, 0.0), 2 * x - 1
    a, b = _same_hue(a, b), _same_hue(b, a)
    return lab_to_srgb(msh_to_lab([linear(p, q, x) for p, q in zip(a, b)]))


def _same_hue(colour: Sequence[float], other: Sequence[float]) -> Sequence[float]:
    """An unsaturated colour gets the hue that keeps the path to the other one even."""
    if colour[1] >= 0.05 or other[1] < 0.05:
        return colour
    m, s, h = other
    if m >= colour[0]:
        return colour[0], colour[1], h
    spin = s * math.sqrt(max(colour[0] ** 2 - m**2, 0.0)) / (m * math.sin(s))
    return colour[0], colour[1], h + spin if h > -math.pi / 3 else h - spin
