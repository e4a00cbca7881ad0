"""Coordinate systems: codes, and transforms between lon/lat, web Mercator and UTM.

Transverse Mercator is the Krüger series in the third flattening, to the sixth order, on WGS 84.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

A, INV_F = 6378137.0, 298.257223563  # WGS 84
_N = (1 / INV_F) / (2 - 1 / INV_F)
_RECT = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
_E = math.sqrt((1 / INV_F) * (2 - 1 / INV_F))
K0, FALSE_EAST, FALSE_NORTH = 0.9996, 500_000.0, 10_000_000.0

# The coefficients of the Krüger series by powers of the third flattening.
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180 - 127 * _N**5 / 288 + 7891 * _N**6 / 37800,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440 + 281 * _N**5 / 630 - 1983433 * _N**6 / 1935360,
    61 * _N**3 / 240 - 103 * _N**4 / 140 + 15061 * _N**5 / 26880 + 167603 * _N**6 / 181440,
    49561 * _N**4 / 161280 - 179 * _N**5 / 168 + 6601661 * _N**6 / 7257600,
    34729 * _N**5 / 80640 - 3418889 * _N**6 / 1995840,
    212378941 * _N**6 / 319334400,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360 - 81 * _N**5 / 512 + 96199 * _N**6 / 604800,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440 + 46 * _N**5 / 105 - 1118711 * _N**6 / 3870720,
    17 * _N**3 / 480 - 37 * _N**4 / 840 - 209 * _N**5 / 4480 + 5569 * _N**6 / 90720,
    4397 * _N**4 / 161280 - 11 * _N**5 / 504 - 830251 * _N**6 / 7257600,
    4583 * _N**5 / 161280 - 108847 * _N**6 / 3991680,
    20648693 * _N**6 / 638668800,
)


def utm_zone(epsg: int) -> tuple[int, bool] | None:
    """(zone, south) of a WGS 84 UTM code."""
    hundred, zone = divmod(epsg, 100)
    return (zone, hundred == 327) if hundred in (326, 327) and 1 <= zone <= 60 else None


def _check(epsg: int) -> None:
    if epsg not in (4326, 3857, 4979) and utm_zone(epsg) is None:
        raise ValueError(f"EPSG:{epsg} is not supported; 4326, 3857 and UTM (326xx, 327xx) are")


def _to_lonlat(x: np.ndarray, y: np.ndarray, epsg: int) -> tuple[np.ndarray, np.ndarray]:
    if epsg in (4326, 4979):
        return x, y
    if epsg == 3857:
        return np.degrees(x / A), np.degrees(np.arctan(np.sinh(y / A)))
    zone, south = utm_zone(epsg)
    xi, eta = (y - (FALSE_NORTH if south else 0)) / (K0 * _RECT), (x - FALSE_EAST) / (K0 * _RECT)
    xp, ep = xi.copy(), eta.copy()
    for j, b in enumerate(_BETA, 1):
        xp -= b * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
        ep -= b * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
    conformal = np.sin(xp) / np.sqrt(np.sinh(ep) ** 2 + np.cos(xp) ** 2)
    t = conformal
    for _ in range(6):  # Newton's steps from the conformal to the geodetic latitude's tangent
        s = np.sinh(_E * np.arctanh(_E * t / np.sqrt(1 + t * t)))
        f = t * np.sqrt(1 + s * s) - s * np.sqrt(1 + t * t) - conformal
        d = (np.sqrt(1 + s * s) * np.sqrt(1 + t * t) - s * t) * (1 - _E**2) * np.sqrt(1 + t * t) / (1 + (1 - _E**2) * t * t)
        t = t - f / d
    return np.degrees(np.arctan2(np.sinh(ep), np.cos(xp))) + (zone * 6 - 183), np.degrees(np.arctan(t))


def _from_lonlat(lon: np.ndarray, lat: np.ndarray, epsg: int) -> tuple[np.ndarray, np.ndarray]:
    if epsg in (4326, 4979):
        return lon, lat
    if epsg == 3857:
        return np.radians(lon) * A, np.arcsinh(np.tan(np.radians(lat))) * A
    zone, south = utm_zone(epsg)
    phi, lam = np.radians(lat), np.radians(lon - (zone * 6 - 183))
    s = np.sin(phi)
    t = np.sinh(np.arctanh(s) - _E * np.arctanh(_E * s))
    xp, ep = np.arctan2(t, np.cos(lam)), np.arcsinh(np.sin(lam) / np.sqrt(t * t + np.cos(lam) ** 2))
    xi, eta = xp.copy(), ep.copy()
    for j, a in enumerate(_ALPHA, 1):
        xi += a * np.sin(2 * j * xp) * np.cosh(2 * j * ep)
        eta += a * np.cos(2 * j * xp) * np.sinh(2 * j * ep)
    return FALSE_EAST + K0 * _RECT * eta, (FALSE_NORTH if south else 0) + K0 * _RECT * xi


def transform(x, y, source: int, target: int) -> tuple[np.ndarray, np.ndarray]:
    """Points between supported systems, x before y, lon before lat."""
    _check(source), _check(target)
    x, y = np.asarray(x, "f8"), np.asarray(y, "f8")
    if source == target:
        return x, y
    return _from_lonlat(*_to_lonlat(x, y, source), target)


def transform_bbox(box, source: int, target: int, densify: int = 21) -> tuple[float, float, float, float]:
    """Bounds of a box's outline, each side densified."""
    x0, y0, x1, y1 = box
    u = np.linspace(0, 1, densify + 2)
    xs = np.concatenate([x0 + u * (x1 - x0), x0 + u * (x1 - x0), np.full_like(u, x0), np.full_like(u, x1)])
    ys = np.concatenate([np.full_like(u, y0), np.full_like(u, y1), y0 + u * (y1 - y0), y0 + u * (y1 - y0)])
    tx, ty = transform(xs, ys, source, target)
    return float(tx.min()), float(ty.min()), float(tx.max()), float(ty.max())


def lonlat_columns(x: Column, y: Column, epsg: Column) -> tuple[Column, Column]:
    """Lon and lat of points in 4326 or 3857 as column expressions; other systems give null."""
    return (
        F.when(epsg == 4326, x).when(epsg == 3857, F.degrees(x / A)),
        F.when(epsg == 4326, y).when(epsg == 3857, F.degrees(F.atan(F.sinh(y / A)))),
    )


def mercator_columns(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * A, F.asinh(F.tan(F.radians(lat))) * A


_ID = r'ID\s*\[\s*"EPSG"\s*,\s*"?(\d+)"?\s*\]'


def parse_epsg(value) -> int | None:
    """Of an int, ``EPSG:n``, digits, WKT (its last ID) or PROJJSON."""
    if value is None or isinstance(value, bool):
        return None
    if isinstance(value, (int, np.integer)):
        return int(value)
    if isinstance(value, dict):
        own = value.get("id") or {}
        return int(own["code"]) if str(own.get("authority", "")).upper() == "EPSG" and str(own.get("code", "")).isdigit() else None
    text = str(value).strip()
    m = re.fullmatch(r"(?i)(?:EPSG:)?(\d+)", text)
    if m:
        return int(m[1])
    found = re.findall(_ID, text)
    return int(found[-1]) if found else None


def epsg_column(c: Column) -> Column:
    """``parse_epsg`` for text columns of codes, digits and WKT."""
    t = F.trim(c)
    wkt = F.element_at(F.regexp_extract_all(t, F.lit(_ID), 1), -1)
    return F.coalesce(F.when(t.rlike(r"^(?i:EPSG:)?\d+$"), F.regexp_extract(t, r"(\d+)$", 1).try_cast("int")), F.when(t.rlike(_ID), wkt.try_cast("int")))


def crs_code_column(epsg: Column) -> Column:
    return F.when(epsg.isNotNull(), F.concat(F.lit("EPSG:"), epsg.cast("string")))
