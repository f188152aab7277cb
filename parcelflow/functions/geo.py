"""Distances, boxes and the national grid (transverse Mercator by Krueger's series, both ways in closed form)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius, the grid's ellipsoid, origin, scale and false origin.
EARTH_KM = 6371.0088
MAJOR, MINOR = 6_378_137.0, 6_356_752.314140356
LAT0, LNG0 = math.radians(53.5), math.radians(-8)
SCALE, FALSE_E, FALSE_N = 0.99982, 600_000.0, 750_000.0

_N = (MAJOR - MINOR) / (MAJOR + MINOR)
_RADIUS = SCALE * MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_FORWARD = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BACK = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_LATITUDE = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_K = 2 * math.sqrt(_N) / (1 + _N)
_XI0 = math.atan(math.sinh(math.atanh(math.sin(LAT0)) - _K * math.atanh(_K * math.sin(LAT0))))
_NORTH0 = _RADIUS * (_XI0 + sum(c * math.sin(2 * j * _XI0) for j, c in enumerate(_FORWARD, 1)))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in kilometres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def in_box(lat: Column, lng: Column) -> Column:
    return lat.between(51, 56) & lng.between(-11, -5)


def to_grid(lat: Column, lng: Column) -> Column:
    """struct<easting,northing> of a position; null outside the box."""
    phi, lam = F.radians(lat), F.radians(lng) - LNG0
    t = F.sinh(F.atanh(F.sin(phi)) - _K * F.atanh(_K * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(_FORWARD, 1):
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.when(in_box(lat, lng), F.struct((FALSE_E + _RADIUS * east).alias("easting"), (FALSE_N - _NORTH0 + _RADIUS * north).alias("northing")))


def from_grid(easting: Column, northing: Column) -> Column:
    """struct<lat,lng> of a grid position; null outside the grid."""
    xi, eta = (northing - FALSE_N + _NORTH0) / _RADIUS, (easting - FALSE_E) / _RADIUS
    x, e = xi, eta
    for j, c in enumerate(_BACK, 1):
        x = x - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        e = e - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(e))
    lat = chi
    for j, c in enumerate(_LATITUDE, 1):
        lat = lat + c * F.sin(2 * j * chi)
    sound = easting.between(400_000, 800_000) & northing.between(450_000, 1_000_000)
    return F.when(sound, F.struct(F.degrees(lat).alias("lat"), F.degrees(LNG0 + F.atan2(F.sinh(e), F.cos(x))).alias("lng")))


def grid_pair(value: Column) -> Column:
    """struct<easting,northing> of an `E,N` text."""
    parts = F.split(value, ",")
    return F.struct(F.btrim(F.get(parts, F.lit(0))).try_cast("double").alias("easting"), F.btrim(F.get(parts, F.lit(1))).try_cast("double").alias("northing"))


def box_degrees(lat: Column, km: float) -> tuple[Column, Column]:
    """Half height and half width in degrees of a box around a latitude that holds a circle of `km`."""
    return F.lit(km / 110.574), km / (111.320 * F.cos(F.radians(lat)))
