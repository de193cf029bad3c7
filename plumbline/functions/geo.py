"""Distances and planes on the earth, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The radius of each formula, and metres per degree.
EARTH_M, WGS84_M, DEGREE_M = 6_371_000.0, 6_378_137.0, 111_320.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_M) -> Column:
    """Great-circle metres; null if any coordinate is."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(0.0))))


def haversine_asin(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_M) -> Column:
    """Great-circle distance by the arc sine, in the unit of the radius; null if any coordinate is."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def equirectangular(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on the plane through the mean latitude."""
    return F.sqrt(F.pow((lat2 - lat1) * DEGREE_M, 2) + F.pow((lon2 - lon1) * DEGREE_M * F.cos(F.radians((lat1 + lat2) / 2)), 2))


def tangent_plane(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Metres east and north of an origin."""
    return F.radians(lon - lon0) * WGS84_M * F.cos(F.radians(lat0)), F.radians(lat - lat0) * WGS84_M


def valid_fix(lat: Column, lon: Column, fix_type: Column | None = None) -> Column:
    """Finite coordinates in range, and a fix in three dimensions where the type is known."""
    ok = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90, 90) & lon.between(-180, 180)
    return ok if fix_type is None else ok & (F.coalesce(fix_type, F.lit(3)) >= 3)


def degrees_of(text: Column) -> Column:
    """Degrees from degrees, minutes and seconds with a letter for the side (``47 38' 37.3" N``);
    minutes and seconds may be missing. Other texts and values out of range are null."""
    form = r"^\s*(\d{1,3})\s*[\u00b0d:\s]\s*(?:(\d{1,2}(?:\.\d+)?)\s*['m:\s]\s*)?(?:(\d{1,2}(?:\.\d+)?)\s*(?:\"|''|s)?\s*)?([NSEWnsew])\s*$"
    part = [F.nullif(F.regexp_extract(text, form, k), F.lit("")).try_cast("double") for k in (1, 2, 3)]
    side = F.upper(F.regexp_extract(text, form, 4))
    minutes, seconds = F.coalesce(part[1], F.lit(0.0)), F.coalesce(part[2], F.lit(0.0))
    value = (part[0] + minutes / 60 + seconds / 3600) * F.when(side.isin("S", "W"), -1).otherwise(1)
    limit = F.when(side.isin("N", "S"), 90).otherwise(180)
    return F.when((F.abs(value) <= limit) & (minutes < 60) & (seconds < 60), value)


def iso6709(text: Column) -> Column:
    """``(latitude, longitude, altitude_m)`` of a text like ``+47.6436+016.4759+512.9/``; null
    where it has another form or lies out of range."""
    form = r"^\s*([+-]\d{1,2}(?:\.\d+)?)([+-]\d{1,3}(?:\.\d+)?)([+-]\d+(?:\.\d+)?)?(?:CRS\w*)?/?\s*$"
    lat, lon, alt = (F.nullif(F.regexp_extract(text, form, k), F.lit("")).try_cast("double") for k in (1, 2, 3))
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("latitude"), lon.alias("longitude"), alt.alias("altitude_m")))


def turned(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    """A vector of the plane, turned to the left by an angle in radians."""
    return x * F.cos(angle) - y * F.sin(angle), x * F.sin(angle) + y * F.cos(angle)


def east_north_up(north: Column, east: Column, down: Column) -> tuple[Column, Column, Column]:
    """A vector given as north, east, down, in the order of the other tables."""
    return east, north, -down


def by_quaternion(q: tuple[Column, Column, Column, Column], v: tuple[Column, Column, Column], tolerance: float = 0.01) -> tuple[Column, Column, Column]:
    """A vector of the body turned into the frame of the quaternion ``(w, x, y, z)``; null
    unless its length is one within the tolerance."""
    w, x, y, z = q
    a, b, c = v
    ok = F.abs(F.sqrt(w * w + x * x + y * y + z * z) - 1) <= tolerance
    out = (
        a * (1 - 2 * (y * y + z * z)) + b * 2 * (x * y - w * z) + c * 2 * (x * z + w * y),
        a * 2 * (x * y + w * z) + b * (1 - 2 * (x * x + z * z)) + c * 2 * (y * z - w * x),
        a * 2 * (x * z - w * y) + b * 2 * (y * z + w * x) + c * (1 - 2 * (x * x + y * y)),
    )
    return tuple(F.when(ok, o) for o in out)
