"""Coordinate, distance and heading expressions (all Catalyst built-ins)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The country box (degrees, inclusive) and the earth radius (metres).
COUNTRY_LNG = (72.004, 137.8347)
COUNTRY_LAT = (0.8293, 55.8281)
EARTH_RADIUS_M = 6371000.0

# Fixed values of the public GCJ-02 datum. Offsets are taken at x = lng - 105,
# y = lat - 35. Polynomials list the factors of 1, x, y, the square term, x*y and
# sqrt|x|; sine terms list (amplitude, half-turns per degree).
SEMI_MAJOR_M = 6378245.0
ECCENTRICITY_SQ = 0.00669342162296594323
ORIGIN_LNG, ORIGIN_LAT = 105.0, 35.0
LNG_POLY = (300.0, 1.0, 2.0, 0.1, 0.1, 0.1)
LAT_POLY = (-100.0, 2.0, 3.0, 0.2, 0.1, 0.2)
COMMON_SINES_X = ((20.0, 6.0), (20.0, 2.0))
LNG_SINES_X = ((20.0, 1.0), (40.0, 1 / 3), (150.0, 1 / 12), (300.0, 1 / 30))
LAT_SINES_Y = ((20.0, 1.0), (40.0, 1 / 3), (160.0, 1 / 12), (320.0, 1 / 30))


def in_country(lng: Column, lat: Column) -> Column:
    return lng.between(*COUNTRY_LNG) & lat.between(*COUNTRY_LAT)


def in_city(lng: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    """Strictly inside ``(lng_min, lng_max, lat_min, lat_max)``."""
    x0, x1, y0, y1 = box
    return (lng > x0) & (lng < x1) & (lat > y0) & (lat < y1)


def _waves(angle: Column, terms: tuple[tuple[float, float], ...]) -> Column:
    total = F.lit(0.0)
    for amplitude, turns in terms:
        total = total + F.lit(amplitude) * F.sin(angle * F.lit(turns * math.pi))
    return total


def _offset_m(poly, x: Column, y: Column, squared: Column, waves: Column) -> Column:
    one, fx, fy, fsq, fxy, froot = poly
    smooth = (
        F.lit(one) + x * fx + y * fy + squared * squared * fsq + x * y * fxy
        + F.sqrt(F.abs(x)) * froot
    )
    return smooth + waves * (2.0 / 3.0)


def to_gcj(lng: Column, lat: Column) -> tuple[Column, Column]:
    """WGS-84 to GCJ-02, rounded to 6 decimals. The caller drops points outside the country."""
    x, y = lng - ORIGIN_LNG, lat - ORIGIN_LAT
    common = _waves(x, COMMON_SINES_X)
    east = _offset_m(LNG_POLY, x, y, x, common + _waves(x, LNG_SINES_X))
    north = _offset_m(LAT_POLY, x, y, y, common + _waves(y, LAT_SINES_Y))
    phi = F.radians(lat)
    curvature = F.lit(1.0) - F.pow(F.sin(phi), F.lit(2.0)) * ECCENTRICITY_SQ
    parallel_m = F.cos(phi) * SEMI_MAJOR_M / F.sqrt(curvature)
    meridian_m = F.lit(SEMI_MAJOR_M * (1 - ECCENTRICITY_SQ)) / (curvature * F.sqrt(curvature))
    return (
        F.round(lng + F.degrees(east / parallel_m), 6),
        F.round(lat + F.degrees(north / meridian_m), 6),
    )


def haversine_m(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    half_lat = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    half_lng = F.sin((F.radians(lng2) - F.radians(lng1)) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lng * half_lng
    return F.asin(F.sqrt(chord)) * (2 * EARTH_RADIUS_M)


def squared_degrees(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    dx, dy = lng1 - lng2, lat1 - lat2
    return dx * dx + dy * dy


def degrees_apart(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    return F.sqrt(squared_degrees(lng1, lat1, lng2, lat2))


def closeness(distance: Column) -> Column:
    """The similarity kernel exp(-d)."""
    return F.exp(-distance)


def heading(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Compass bearing in [0, 360), north 0, east 90; 0 for a zero hop."""
    return F.pmod(F.degrees(F.atan2(lng2 - lng1, lat2 - lat1)), F.lit(360.0))


def line_distance(px, py, ax, ay, bx, by) -> Column:
    """Distance of p to the infinite line through a and b; to a when a = b."""
    dx, dy = bx - ax, by - ay
    length = F.sqrt(dx * dx + dy * dy)
    across = F.abs(dx * (ay - py) - (ax - px) * dy)
    return F.when((dx == 0) & (dy == 0), degrees_apart(px, py, ax, ay)).otherwise(
        across / F.when(length > 0, length)
    )


def foot_fraction(px, py, ax, ay, bx, by) -> Column:
    """Where p projects on the line a-b, as an unclamped fraction of a-b; NULL when a = b."""
    dx, dy = bx - ax, by - ay
    span = dx * dx + dy * dy
    return (dx * (px - ax) + dy * (py - ay)) / F.when(span > 0, span)


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970; naive timestamps are read in the session zone (UTC here)."""
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (epoch_micros(later) - epoch_micros(earlier)) / F.lit(1e6)


def parse_time(text: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` text to a timestamp; NULL when malformed."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))


def epoch_seconds(text: Column) -> Column:
    return F.unix_timestamp(parse_time(text))
