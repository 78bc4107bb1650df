"""Scalar functions: vectors, units, times, names, periodic values, projections."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unit -> (dimension, scale, offset) to the dimension's base unit.
UNITS = {
    "m": ("length", 1.0, 0.0),
    "meter": ("length", 1.0, 0.0),
    "meters": ("length", 1.0, 0.0),
    "km": ("length", 1000.0, 0.0),
    "cm": ("length", 0.01, 0.0),
    "ft": ("length", 0.3048, 0.0),
    "Pa": ("pressure", 1.0, 0.0),
    "hPa": ("pressure", 100.0, 0.0),
    "mbar": ("pressure", 100.0, 0.0),
    "bar": ("pressure", 100000.0, 0.0),
    "K": ("temperature", 1.0, 0.0),
    "degC": ("temperature", 1.0, 273.15),
    "degF": ("temperature", 5.0 / 9.0, 459.67 * 5.0 / 9.0),
    "s": ("time", 1.0, 0.0),
    "seconds": ("time", 1.0, 0.0),
    "minutes": ("time", 60.0, 0.0),
    "hours": ("time", 3600.0, 0.0),
    "days": ("time", 86400.0, 0.0),
    "m/s": ("speed", 1.0, 0.0),
    "knot": ("speed", 1852.0 / 3600.0, 0.0),
}
LATITUDE_UNITS = ("degrees_north", "degree_north", "degree_N", "degrees_N", "degreeN", "degreesN")
LONGITUDE_UNITS = ("degrees_east", "degree_east", "degree_E", "degrees_E", "degreeE", "degreesE")


def magnitude(*parts: Column) -> Column:
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def rotate_to_lonlat(angle: Column, lat: Column, u: Column, v: Column) -> tuple[Column, Column]:
    """A vector turned by an angle (radians); its first part divided by the cosine of the latitude."""
    east = (F.cos(angle) * u + F.sin(angle) * v) / F.cos(lat * math.pi / 180.0)
    return east, F.cos(angle) * v - F.sin(angle) * u


def convertible(a: str, b: str) -> bool:
    return a in UNITS and b in UNITS and UNITS[a][0] == UNITS[b][0]


def convert(value: Column, a: str, b: str) -> Column:
    if not convertible(a, b):
        raise ValueError(f"{a} can't be converted to {b}")
    (_, scale_a, offset_a), (_, scale_b, offset_b) = UNITS[a], UNITS[b]
    return (value * F.lit(scale_a) + F.lit(offset_a - offset_b)) / F.lit(scale_b)


def is_latitude(unit: Column) -> Column:
    return unit.isin(*LATITUDE_UNITS)


def is_longitude(unit: Column) -> Column:
    return unit.isin(*LONGITUDE_UNITS)


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without zone, a double."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def decode_time(seconds: Column) -> dict[str, Column]:
    """Year, month, day, hour, minute and second of epoch seconds, in UTC."""
    at = F.timestamp_micros(F.round(seconds * 1e6).cast("long"))
    return {
        "year": F.year(at), "month": F.month(at), "day": F.dayofmonth(at),
        "hour": F.hour(at), "minute": F.minute(at), "second": F.second(at),
    }


def encode_time(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    return epoch_seconds(F.make_timestamp(year, month, day, hour, minute, second))


def parse_model_time(text: Column) -> Column:
    """Epoch seconds of ``2001-02-03_04:05:06`` or ``0001-02-03_04:05:06``-like year-day forms; null if neither."""
    plain = F.try_to_timestamp(text, F.lit("yyyy-MM-dd_HH:mm:ss"))
    by_day = F.try_to_timestamp(text, F.lit("yyyy-DDD_HH:mm:ss"))
    return epoch_seconds(F.coalesce(plain, by_day))


def format_time(seconds: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(F.timestamp_micros(F.round(seconds * 1e6).cast("long")), pattern)


def seconds_since(value: Column, unit: str) -> Column:
    """Epoch seconds of a number in ``<unit> since <date>``."""
    name, _, start = unit.partition(" since ")
    if not start or name not in UNITS or UNITS[name][0] != "time":
        raise ValueError(f"not a time unit: {unit}")
    origin = epoch_seconds(F.to_timestamp(F.lit(start.strip())))
    return value * F.lit(UNITS[name][1]) + origin


def periodic(value: Column, low: float, high: float) -> Column:
    """A value moved into [low, high] by whole spans; ends and empty ranges stay."""
    if low >= high:
        return value
    span = high - low
    return (
        F.when(value < low, value + F.ceil((F.lit(low) - value) / span) * span)
        .when(value > high, value - F.ceil((value - F.lit(high)) / span) * span)
        .otherwise(value)
    )


def valid_name(name: Column) -> Column:
    """Whether a variable name can be an XML element name."""
    return name.rlike("^[A-Za-z_][A-Za-z0-9_.-]*$") & ~F.lower(name).startswith("xml")


def formula_terms(text: Column) -> Column:
    """``a: x b: y`` as a map from term to variable."""
    return F.str_to_map(F.regexp_replace(F.trim(text), r"\s*:\s*", ":"), F.lit(" "), F.lit(":"))


def valid_formula(text: Column, terms: list[str]) -> Column:
    """Whether a formula has exactly these terms."""
    return F.array_sort(F.map_keys(formula_terms(text))) == F.array_sort(F.array(*map(F.lit, terms)))


def default_height(low: Column, high: Column) -> Column:
    """The plane of [low, high] that is nearest to 0."""
    return F.when((low <= 0) & (high >= 0), F.lit(0.0)).when(low > 0, low).otherwise(high)


# Projections on a sphere; angles in degrees, results in metres.
EARTH_RADIUS = 6370000.0


def equirectangular(lon: Column, lat: Column, lon_0: float = 0.0, lat_ts: float = 0.0, r: float = EARTH_RADIUS) -> tuple[Column, Column]:
    return F.radians(lon - lon_0) * (r * math.cos(math.radians(lat_ts))), F.radians(lat) * r


def equirectangular_inverse(x: Column, y: Column, lon_0: float = 0.0, lat_ts: float = 0.0, r: float = EARTH_RADIUS) -> tuple[Column, Column]:
    return F.degrees(x / (r * math.cos(math.radians(lat_ts)))) + lon_0, F.degrees(y / r)


def mercator(lon: Column, lat: Column, lon_0: float = 0.0, lat_ts: float = 0.0, r: float = EARTH_RADIUS) -> tuple[Column, Column]:
    k = r * math.cos(math.radians(lat_ts))
    return F.radians(lon - lon_0) * k, F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * k


def mercator_inverse(x: Column, y: Column, lon_0: float = 0.0, lat_ts: float = 0.0, r: float = EARTH_RADIUS) -> tuple[Column, Column]:
    k = r * math.cos(math.radians(lat_ts))
    return F.degrees(x / k) + lon_0, F.degrees(2 * F.atan(F.exp(y / k)) - math.pi / 2)


def _cone(lat_0: float, lat_1: float, lat_2: float, r: float) -> tuple[float, float, float]:
    p1, p2 = math.radians(lat_1), math.radians(lat_2)
    half = lambda p: math.tan(math.pi / 4 + p / 2)
    n = math.sin(p1) if lat_1 == lat_2 else math.log(math.cos(p1) / math.cos(p2)) / math.log(half(p2) / half(p1))
    f = r * math.cos(p1) * half(p1) ** n / n
    return n, f, f / half(math.radians(lat_0)) ** n


def lambert(lon: Column, lat: Column, lon_0: float, lat_0: float, lat_1: float, lat_2: float, r: float = EARTH_RADIUS) -> tuple[Column, Column]:
    n, f, rho0 = _cone(lat_0, lat_1, lat_2, r)
    rho = F.lit(f) / F.pow(F.tan(F.radians(lat) / 2 + math.pi / 4), F.lit(n))
    theta = F.radians(_turned(lon - lon_0)) * n  # a turn around the earth is none around the cone
    return rho * F.sin(theta), F.lit(rho0) - rho * F.cos(theta)


def lambert_inverse(x: Column, y: Column, lon_0: float, lat_0: float, lat_1: float, lat_2: float, r: float = EARTH_RADIUS) -> tuple[Column, Column]:
    n, f, rho0 = _cone(lat_0, lat_1, lat_2, r)
    sign = math.copysign(1.0, n)
    rho = F.sqrt(x * x + (F.lit(rho0) - y) ** 2) * sign
    theta = F.atan2(x * sign, (F.lit(rho0) - y) * sign)
    return _turned(F.degrees(theta / n) + lon_0), F.degrees(2 * F.atan(F.pow(F.lit(f) / rho, F.lit(1 / n))) - math.pi / 2)


def stereographic(lon: Column, lat: Column, lon_0: float = 0.0, lat_0: float = 90.0, lat_ts: float | None = None, r: float = EARTH_RADIUS) -> tuple[Column, Column]:
    """The polar aspect, true to scale at ``lat_ts``; ``lat_0`` is the pole, 90 or -90."""
    pole = math.copysign(1.0, lat_0)
    k = r * (1 + math.sin(math.radians(abs(lat_0 if lat_ts is None else lat_ts))))
    rho = F.tan(F.lit(math.pi / 4) - F.radians(lat) * (pole / 2)) * k
    theta = F.radians(lon - lon_0)
    return rho * F.sin(theta), rho * F.cos(theta) * -pole


def stereographic_inverse(x: Column, y: Column, lon_0: float = 0.0, lat_0: float = 90.0, lat_ts: float | None = None, r: float = EARTH_RADIUS) -> tuple[Column, Column]:
    pole = math.copysign(1.0, lat_0)
    k = r * (1 + math.sin(math.radians(abs(lat_0 if lat_ts is None else lat_ts))))
    lat = F.degrees(F.lit(math.pi / 2) - 2 * F.atan(F.sqrt(x * x + y * y) / k)) * pole
    return _turned(F.degrees(F.atan2(x, y * -pole)) + lon_0), lat


def _turned(lon: Column) -> Column:
    """A longitude between -180 and 180."""
    return F.when(lon.between(-180.0, 180.0), lon).otherwise(lon - F.floor((lon + 180.0) / 360.0) * 360.0)


def same_longitude(a: Column, b: Column, within: float) -> Column:
    """Whether two longitudes are at most so many degrees apart, whole turns aside."""
    return F.abs(_turned(a - b)) < within


def rotated(lon: Column, lat: Column, pole_lat: float, pole_lon: float, lon_0: float = 0.0) -> tuple[Column, Column]:
    """Longitude and latitude, in degrees, on a sphere turned so that its pole is at ``pole_lat``; ``pole_lon`` is
    added to turned longitudes, ``lon_0`` is the meridian that is taken from the given ones."""
    lam, phi, p = F.radians(lon - lon_0), F.radians(lat), math.radians(pole_lat)
    s, c = math.sin(p), math.cos(p)
    out = F.atan2(F.cos(phi) * F.sin(lam), F.cos(phi) * F.cos(lam) * s + F.sin(phi) * c)
    height = F.sin(phi) * s - F.cos(phi) * F.cos(lam) * c
    return _turned(F.degrees(out) + pole_lon), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), height))))


def rotated_inverse(x: Column, y: Column, pole_lat: float, pole_lon: float, lon_0: float = 0.0) -> tuple[Column, Column]:
    lam, phi, p = F.radians(x - pole_lon), F.radians(y), math.radians(pole_lat)
    s, c = math.sin(p), math.cos(p)
    out = F.atan2(F.cos(phi) * F.sin(lam), F.cos(phi) * F.cos(lam) * s - F.sin(phi) * c)
    height = F.sin(phi) * s + F.cos(phi) * F.cos(lam) * c
    return _turned(F.degrees(out) + lon_0), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), height))))


def projection(text: str) -> tuple[Callable[[Column, Column], tuple[Column, Column]], Callable[[Column, Column], tuple[Column, Column]]]:
    """Forward and inverse of a PROJ string, on a sphere: eqc, merc, lcc, polar stere, and ob_tran of eqc in degrees."""
    found = dict(re.findall(r"\+(\w+)(?:=(\S+))?", text))
    number = lambda name, default=0.0: float(found.get(name) or default)
    kind = found.get("proj")
    if kind == "eqc":
        forward, inverse, args = equirectangular, equirectangular_inverse, (number("lon_0"), number("lat_ts"))
    elif kind == "merc":
        forward, inverse, args = mercator, mercator_inverse, (number("lon_0"), number("lat_ts"))
    elif kind == "lcc":
        lat_1 = number("lat_1")
        forward, inverse, args = lambert, lambert_inverse, (number("lon_0"), number("lat_0"), lat_1, number("lat_2", lat_1))
    elif kind == "stere" and abs(number("lat_0")) == 90:
        forward, inverse, args = stereographic, stereographic_inverse, (number("lon_0"), number("lat_0"), number("lat_ts", number("lat_0")))
    elif kind == "ob_tran" and found.get("o_proj") == "eqc":
        forward, inverse, args = rotated, rotated_inverse, (number("o_lat_p"), number("o_lon_p"), number("lon_0"))
    else:
        raise ValueError(f"not a projection that is offered: {text}")
    return (lambda lon, lat: forward(lon, lat, *args)), (lambda x, y: inverse(x, y, *args))


def projection_string(attributes: dict) -> str:
    """A PROJ string from a weather model's global attributes: MAP_PROJ 0 or 6 (lat-lon),
    1 (Lambert), 2 (polar stereographic), 3 (Mercator)."""
    kind = int(attributes.get("MAP_PROJ", 0))
    lat_1, lat_2 = attributes.get("TRUELAT1", 0.0), attributes.get("TRUELAT2", 0.0)
    lon_0, lat_0 = attributes.get("STAND_LON", 0.0), attributes.get("MOAD_CEN_LAT", attributes.get("CEN_LAT", 0.0))
    if kind in (0, 6):
        if float(attributes.get("POLE_LAT", 90.0)) < 90.0:
            pole_lon = attributes.get("POLE_LON", 0.0)
            return f"+proj=ob_tran +o_proj=eqc +to_meter=0.0174532925199 +o_lat_p={attributes['POLE_LAT']} +o_lon_p={180.0 - pole_lon} +lon_0={-lon_0} +ellps=sphere"
        return f"+proj=eqc +lon_0={lon_0} +ellps=WGS84"
    if kind == 1:
        return f"+proj=lcc +lon_0={lon_0} +lat_0={lat_0} +lat_1={lat_1} +lat_2={lat_2} +ellps=sphere"
    if kind == 2:
        pole = 90.0 if float(attributes.get("CEN_LAT", 1.0)) > 0 else -90.0
        return f"+proj=stere +lon_0={lon_0} +lat_0={pole} +lat_ts={lat_1} +ellps=sphere"
    if kind == 3:
        return f"+proj=merc +lon_0={lon_0} +lat_ts={lat_1} +ellps=sphere"
    raise ValueError(f"unknown map projection {kind}")
