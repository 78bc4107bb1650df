"""Atmospheric and ocean quantities as column expressions.

Pressures in Pa, ``p`` the perturbation and ``pb`` the base part, ``t`` the potential
temperature less 300 K, ``q`` the vapour mixing ratio.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published constants of the formulas.
KAPPA = 2.0 / 7.0
EPSILON = 0.622
MAGNUS_A, MAGNUS_B, MAGNUS_T0 = 17.67, 29.65, 273.15
SVP0_HPA = 6.112


def temperature(p: Column, pb: Column, t: Column) -> Column:
    """Temperature in kelvin."""
    return (t + 300.0) * F.pow((p + pb) * 1e-5, F.lit(KAPPA))


def relative_humidity(p: Column, pb: Column, t: Column, q: Column) -> Column:
    """Percent of saturation, kept in 0..100."""
    tk = temperature(p, pb, t)
    es = F.lit(SVP0_HPA) * F.exp(MAGNUS_A * (tk - MAGNUS_T0) / (tk - MAGNUS_B))
    saturated = EPSILON * es / (0.01 * (p + pb) - (1.0 - EPSILON) * es)
    return 100.0 * F.greatest(F.least(q / saturated, F.lit(1.0)), F.lit(0.0))


def dew_point(p: Column, pb: Column, q: Column) -> Column:
    """Dew point in degrees Celsius."""
    wet = F.greatest(q, F.lit(0.0))
    vapour = F.greatest(0.01 * wet * (p + pb) / (EPSILON + wet), F.lit(0.001))
    return (243.5 * F.log(vapour) - 440.8) / (19.48 - F.log(vapour))


def equivalent_potential_temperature(p: Column, pb: Column, t: Column, q: Column) -> Column:
    """Equivalent potential temperature in kelvin."""
    hpa, wet = 0.01 * (p + pb), F.greatest(q, F.lit(1e-15))
    tk = (t + 300.0) * F.pow(hpa * 1e-3, F.lit(KAPPA))
    vapour = wet * hpa / (EPSILON + wet)
    lifted = 55.0 + 2840.0 / (F.log(F.pow(tk, F.lit(3.5)) / vapour) - 4.805)
    power = (287.04 / 1004.0) * (1.0 + (0.608 - 0.887) * wet)
    return tk * F.pow(1000.0 / hpa, power) * F.exp((3376.0 / lifted - 2.54) * wet * (1.0 + 0.81 * wet))


def terrain_elevation(ph: Column, phb: Column, gravity: float = 9.81) -> Column:
    """Height of a level from geopotentials."""
    return (ph + phb) / gravity


def ocean_s_1(s: Column, c: Column, eta: Column, depth: Column, depth_c: Column) -> Column:
    """Height of an ocean s-coordinate, form 1; 0 where the depth is 0 or an input is missing."""
    t = depth_c * s + (depth - depth_c) * c
    known = c.isNotNull() & eta.isNotNull() & depth.isNotNull() & (depth != 0)
    return F.when(known, t + eta * (1 + t / depth)).otherwise(0.0)


def ocean_s_2(s: Column, c: Column, eta: Column, depth: Column, depth_c: Column) -> Column:
    """Height of an ocean s-coordinate, form 2; 0 where depths add to 0 or an input is missing."""
    t = (depth_c * s + depth * c) / (depth_c + depth)
    known = c.isNotNull() & eta.isNotNull() & depth.isNotNull() & (depth_c + depth != 0)
    return F.when(known, eta + (eta + depth) * t).otherwise(0.0)


def hybrid_height(a: Column, b: Column, p0: Column, ps: Column) -> Column:
    """Metres of a hybrid sigma-pressure level; a missing surface pressure counts as 0."""
    p = a * p0 + b * F.coalesce(ps, F.lit(0.0))
    return 44331.5 - 4946.62 * F.pow(p, F.lit(0.190263))


def sea_level_pressure(columns, by, level: str = "k"):
    """(by, slp): sea-level pressure in hPa of each column of air.

    ``columns`` has ``p``, ``pb``, ``t``, ``q``, ``height``.  The first level 100 hPa above
    the lowest and the one over it give temperature and height there; a standard lapse
    rate leads down to the sea.
    """
    from pyspark.sql import Window

    r, g, lapse, tc, drop = 287.04, 9.81, 0.0065, 273.16 + 17.05, 10_000.0
    order = Window.partitionBy(*by).orderBy(level)
    pressure = F.col("p") + F.col("pb")
    virtual = temperature(F.col("p"), F.col("pb"), F.col("t")) * (1.0 + 0.608 * F.col("q"))
    rows = columns.select(*by, level, pressure.alias("_p"), virtual.alias("_t"), F.col("height").alias("_z"))
    here = F.struct(F.col(level).alias("l"), *[F.col(c).alias(c[1:]) for c in ("_p", "_t", "_z")])
    rows = rows.withColumns({"_here": here, "_up": F.coalesce(F.lead(here).over(order), here), "_p0": F.first("_p").over(order)})
    found = rows.groupBy(*by).agg(
        F.min(F.when(F.col("_p") < F.col("_p0") - drop, F.struct(F.col(level), "_here", "_up"))).alias("_c"),
        F.min_by("_here", level).alias("_base"),
    )
    lo, hi, base = F.col("_c._here"), F.col("_c._up"), F.col("_base")
    at = base["p"] - drop
    blend = F.log(at / hi["p"]) * F.log(lo["p"] / hi["p"])
    t_at = hi["t"] - (hi["t"] - lo["t"]) * blend
    z_at = hi["z"] - (hi["z"] - lo["z"]) * blend
    t_surface = t_at * F.pow(base["p"] / at, F.lit(lapse * r / g))
    t_sea = t_at + lapse * z_at
    fixed = F.when((t_surface <= tc) & (t_sea >= tc), tc).otherwise(tc - 0.005 * (t_surface - tc) ** 2)
    slp = 0.01 * (base["p"] * F.exp(2.0 * g * base["z"] / (r * (fixed + t_surface))))
    return found.select(*by, F.when(F.col("_c").isNotNull(), slp).alias("slp"))


def shear(columns, by, level: str = "k", upper: float = 200.0, lower: float = 850.0):
    """(by, shear): size of the wind difference between two pressure levels (hPa); ``u``, ``v``, ``pressure``."""
    from ..operators.stencil import interpolate_to_level

    out = None
    for name in ("u", "v"):
        for tag, target in (("1", upper), ("2", lower)):
            one = interpolate_to_level(columns, by, level, "pressure", name, target).withColumnRenamed("value", f"{name}{tag}")
            out = one if out is None else out.join(one, list(by))
    return out.select(*by, F.sqrt((F.col("u1") - F.col("u2")) ** 2 + (F.col("v1") - F.col("v2")) ** 2).alias("shear"))
