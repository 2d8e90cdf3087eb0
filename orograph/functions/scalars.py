"""Scalar functions as columns: angles, ranges, projections and encodings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
LIGHT_M_S = 299_792_458.0


def azimuth(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north."""
    return F.pmod(F.degrees(F.atan2(dx, dy)) + 360, F.lit(360.0))


def turn(a: Column, b: Column) -> Column:
    """Absolute difference of two angles, at most 180 degrees."""
    return F.abs(F.pmod(a - b + 180, F.lit(360.0)) - 180)


def between_angles(start: Column, end: Column, t: Column) -> Column:
    """An angle on the shorter arc."""
    return F.pmod(start + (F.pmod(end - start + 540, F.lit(360.0)) - 180) * t, F.lit(360.0))


def in_sector(az: Column, centre: Column, width: Column) -> Column:
    return (width >= 360) | (turn(az, centre) <= width / 2)


def bulge(total: Column, part: Column, coefficient: float) -> Column:
    """How far the curved earth stands above the chord at a part of a path."""
    return max(0.0, coefficient) * part * (total - part) / (2 * EARTH_M)


def horizon(height: Column, coefficient: float) -> Column:
    return F.sqrt(2 * (EARTH_M / coefficient) * F.greatest(height, F.lit(0.0)))


def radar_equation_range(power_w: Column, frequency_hz: Column, gain_db: Column, sensitivity_dbm: Column, rcs_m2: Column, loss_db: Column) -> Column:
    """Fourth-root range; null where an input is missing or not positive, a missing cross-section counts as 1."""
    wave = F.lit(LIGHT_M_S) / frequency_hz
    linear = lambda db: F.pow(F.lit(10.0), db / 10)
    rcs = F.coalesce(rcs_m2, F.lit(1.0))
    over = power_w * linear(gain_db) * linear(gain_db) * wave * wave * rcs
    under = F.lit((4 * math.pi) ** 3) * linear(sensitivity_dbm - 30) * linear(F.coalesce(loss_db, F.lit(0.0)))
    return F.when((power_w > 0) & (frequency_hz > 0) & (rcs > 0), F.pow(over / under, F.lit(0.25)))


def utm_epsg(lon: Column, lat: Column) -> Column:
    zone = F.greatest(F.lit(1), F.least(F.lit(60), F.floor((lon + 180) / 6) + 1))
    return (F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700)) + zone).cast("int")


def utm(lon: Column, lat: Column, central: Column, south: Column) -> tuple[Column, Column]:
    """Easting and northing on the WGS 84 ellipsoid by the Krueger series to third order."""
    flat = 1 / 298.257223563
    n = flat / (2 - flat)
    radius = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - central)
    atanh = lambda x: F.log((1 + x) / (1 - x)) / 2
    t = F.sinh(atanh(F.sin(phi)) - e * atanh(e * F.sin(phi)))
    xi = F.atan2(t, F.cos(lam))
    eta = atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(alpha, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    scale = 0.9996 * radius
    return 500000 + scale * x, scale * y + F.when(south, F.lit(10_000_000.0)).otherwise(F.lit(0.0))


#: WGS 84: third flattening, and the radius of the rectifying sphere times the scale on the central meridian.
_FLAT = 1 / 298.257223563
_N = _FLAT / (2 - _FLAT)
_RADIUS = 0.9996 * 6378137.0 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_E = 2 * math.sqrt(_N) / (1 + _N)
#: Coefficients of the Krueger series to fourth order, there and back.
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)


def to_utm(lon: Column, lat: Column, central: float | Column) -> tuple[Column, Column]:
    """Easting and northing (no false northing) to less than a tenth of a micrometre inside a zone."""
    sine = F.sin(F.radians(lat))
    lam = F.radians(lon - central)
    t = F.sinh(F.atanh(sine) - _E * F.atanh(_E * sine))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + _RADIUS * x, _RADIUS * y


def from_utm(east: Column, north: Column, central: float | Column) -> tuple[Column, Column]:
    """Longitude and latitude of an easting and northing (no false northing), the inverse of ``to_utm``."""
    xi, eta = north / _RADIUS, (east - 500000) / _RADIUS
    y, x = xi, eta
    for j, b in enumerate(_BETA, 1):
        y = y - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        x = x - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    isometric = F.atanh(F.sin(y) / F.cosh(x))
    sine = F.tanh(isometric)
    for _ in range(7):  # each round leaves less than a hundredth of the error
        sine = F.tanh(isometric + _E * F.atanh(_E * sine))
    return central + F.degrees(F.atan2(F.sinh(x), F.cos(y))), F.degrees(F.asin(sine))


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Spherical web-map coordinates in metres."""
    r = 6378137.0
    return r * F.radians(lon), r * F.asinh(F.tan(F.radians(lat)))


def bearing(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    """Initial bearing on a sphere."""
    d = F.radians(lon1 - lon0)
    a, b = F.radians(lat0), F.radians(lat1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))) + 360, F.lit(360.0))


def terrarium(z: Column) -> list[Column]:
    """Red, green and blue of an elevation."""
    v = F.greatest(F.lit(0.0), F.least(F.lit(65535.996), z + 32768))
    return [F.floor(v / 256).cast("int").alias("red"), F.floor(v % 256).cast("int").alias("green"), F.floor((v - F.floor(v)) * 256).cast("int").alias("blue")]


def tile_bounds(zoom: Column, x: Column, y: Column) -> list[Column]:
    """West, south, east and north of a web-map tile in degrees."""
    n = F.pow(F.lit(2.0), zoom)
    lat = lambda v: F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * v / n))))
    return [x / n * 360 - 180, lat(y + 1), (x + 1) / n * 360 - 180, lat(y)]
