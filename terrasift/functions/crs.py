"""Coordinates: longitude and latitude to Web Mercator and to the British grid, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ellipsoids, the seven parameters from WGS84 to OSGB36, and the grid's projection (Ordnance Survey, public).
_EARTH = 6378137.0
_WGS = (6378137.0, 6356752.314245)
_AIRY = (6377563.396, 6356256.909)
_SHIFT = (-446.448, 125.157, -542.060, 20.4894e-6, -0.1502, -0.2470, -0.8421)
_F0, _LAT0, _LON0, _E0, _N0 = 0.9996012717, math.radians(49), math.radians(-2), 400000.0, -100000.0


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * _EARTH, F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)) * _EARTH


def british_grid(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing, to some five metres (one shift for the whole grid)."""
    la, lo = F.radians(lat), F.radians(lon)
    a, b = _WGS
    e2 = 1 - (b * b) / (a * a)
    nu = a / F.sqrt(1 - e2 * F.sin(la) * F.sin(la))
    x, y, z = nu * F.cos(la) * F.cos(lo), nu * F.cos(la) * F.sin(lo), nu * (1 - e2) * F.sin(la)
    tx, ty, tz, s, rx, ry, rz = (*_SHIFT[:4], *(math.radians(r / 3600) for r in _SHIFT[4:]))
    x, y, z = tx + (1 + s) * x - rz * y + ry * z, ty + rz * x + (1 + s) * y - rx * z, tz - ry * x + rx * y + (1 + s) * z
    a, b = _AIRY
    e2 = 1 - (b * b) / (a * a)
    p = F.hypot(x, y)
    la = F.atan2(z, p * (1 - e2))
    for _ in range(4):
        la = F.atan2(z + e2 * (a / F.sqrt(1 - e2 * F.sin(la) * F.sin(la))) * F.sin(la), p)
    lo = F.atan2(y, x)
    n = (a - b) / (a + b)
    sin, cos, tan = F.sin(la), F.cos(la), F.tan(la)
    nu = a * _F0 / F.sqrt(1 - e2 * sin * sin)
    rho = a * _F0 * (1 - e2) / F.pow(1 - e2 * sin * sin, F.lit(1.5))
    eta = nu / rho - 1
    d, t = la - _LAT0, la + _LAT0
    m = b * _F0 * (
        (1 + n + 1.25 * n**2 + 1.25 * n**3) * d - (3 * n + 3 * n**2 + 2.625 * n**3) * F.sin(d) * F.cos(t)
        + (1.875 * n**2 + 1.875 * n**3) * F.sin(2 * d) * F.cos(2 * t) - 35 / 24 * n**3 * F.sin(3 * d) * F.cos(3 * t)
    )
    k = lo - _LON0
    north = m + _N0 + nu / 2 * sin * cos * k**2 + nu / 24 * sin * cos**3 * (5 - tan**2 + 9 * eta) * k**4 + nu / 720 * sin * cos**5 * (61 - 58 * tan**2 + tan**4) * k**6
    east = _E0 + nu * cos * k + nu / 6 * cos**3 * (nu / rho - tan**2) * k**3 + nu / 120 * cos**5 * (5 - 18 * tan**2 + tan**4 + 14 * eta - 58 * tan**2 * eta) * k**5
    return east, north
