"""Column expressions on latitude and longitude."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from cellweave.constants import EQUAL_AREA_PARALLEL, WGS84_A, WGS84_INV_F

# Room left around a pushed-down range, so that rounding in ``lon - 360`` never drops a row.
_SLACK = 1e-6


def normalize_lon(lon: Column) -> Column:
    """0..360 longitudes to -180..180; 180 itself stays."""
    return F.when(lon > 180, lon - 360).otherwise(lon)


def check_box(box: dict) -> dict:
    missing = {"min_lat", "max_lat", "min_lon", "max_lon"} - set(box)
    if missing:
        raise ValueError(f"box lacks {sorted(missing)}")
    return box


def lat_in_box(lat: Column, box: dict) -> Column:
    return lat.between(float(box["min_lat"]), float(box["max_lat"]))


def lon_near_box(lon: Column, box: dict) -> Column:
    """A superset of :func:`lon_in_box` that compares the stored column with literals only.

    In this form the test reaches the Parquet reader and skips row groups.
    """
    low, high = float(box["min_lon"]), float(box["max_lon"])
    return ((lon <= 180) & lon.between(low, high)) | (
        (lon > 180) & lon.between(low + 360 - _SLACK, high + 360 + _SLACK)
    )


def normalized_in_box(lon: Column, box: dict) -> Column:
    """Inclusive test on the normalised longitude."""
    return normalize_lon(lon).between(float(box["min_lon"]), float(box["max_lon"]))


def lon_in_box(lon: Column, box: dict) -> Column:
    """The same with its pushable superset in front."""
    return lon_near_box(lon, box) & normalized_in_box(lon, box)


_ECC = math.sqrt(2 / WGS84_INV_F - 1 / WGS84_INV_F**2)
_SIN0 = math.sin(math.radians(EQUAL_AREA_PARALLEL))
_K0 = math.cos(math.radians(EQUAL_AREA_PARALLEL)) / math.sqrt(1 - (_ECC * _SIN0) ** 2)


def equal_area_x(lon: Column) -> Column:
    """Metres east on the cylindrical equal-area grid (EPSG:6933)."""
    return F.radians(lon) * F.lit(WGS84_A * _K0)


def equal_area_y(lat: Column) -> Column:
    """Metres north on the cylindrical equal-area grid (EPSG:6933)."""
    s = F.sin(F.radians(lat))
    es = s * _ECC
    q = F.lit(1 - _ECC**2) * (s / (1 - es * es) - F.log((1 - es) / (1 + es)) / (2 * _ECC))
    return q * (WGS84_A / (2 * _K0))


def metres_to_lon(metres: float) -> float:
    """Degrees of longitude of a distance east, as a number."""
    return math.degrees(metres / (WGS84_A * _K0))


def lat_to_metres(lat: float) -> float:
    """:func:`equal_area_y` of a number."""
    s = math.sin(math.radians(lat))
    es = s * _ECC
    q = (1 - _ECC**2) * (s / (1 - es * es) - math.log((1 - es) / (1 + es)) / (2 * _ECC))
    return q * WGS84_A / (2 * _K0)


def lat_of_metres(y: float) -> float:
    """The latitude at so many equal-area metres north, by halving; beyond a pole, the pole."""
    low, high = -90.0, 90.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if lat_to_metres(middle) < y else (low, middle)
    return low if y < 0 else high


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance from a point to the closed segment, in the units of the inputs."""
    dx, dy = x2 - x1, y2 - y1
    length2 = dx * dx + dy * dy
    along = F.when(length2 > 0, ((px - x1) * dx + (py - y1) * dy) / length2).otherwise(0.0)
    along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    ex, ey = px - (x1 + along * dx), py - (y1 + along * dy)
    return F.sqrt(ex * ex + ey * ey)
