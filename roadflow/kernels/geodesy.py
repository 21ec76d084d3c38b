"""Distances on the WGS84 ellipsoid and UTM, over arrays."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# WGS84 and UTM.
A, F_ = 6378137.0, 1 / 298.257223563
B = A * (1 - F_)
E = math.sqrt(F_ * (2 - F_))
K0, FALSE_EASTING, FALSE_NORTHING = 0.9996, 500000.0, 10000000.0
N = F_ / (2 - F_)
RECTIFYING = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64 + N**6 / 256)
# Krueger's series to the fifth order, as polynomials in N (coefficient of N**1 first).
FORWARD = tuple(
    sum(c * N ** (k + 1) for k, c in enumerate(p))
    for p in (
        (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288),
        (0, 13 / 48, -3 / 5, 557 / 1440, 281 / 630),
        (0, 0, 61 / 240, -103 / 140, 15061 / 26880),
        (0, 0, 0, 49561 / 161280, -179 / 168),
        (0, 0, 0, 0, 34729 / 80640),
    )
)
INVERSE = tuple(
    sum(c * N ** (k + 1) for k, c in enumerate(p))
    for p in (
        (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512),
        (0, 1 / 48, 1 / 15, -437 / 1440, 46 / 105),
        (0, 0, 17 / 480, -37 / 840, -209 / 4480),
        (0, 0, 0, 4397 / 161280, -11 / 504),
        (0, 0, 0, 0, 4583 / 161280),
    )
)
LATITUDE = tuple(
    sum(c * N ** (k + 1) for k, c in enumerate(p))
    for p in (
        (2, -2 / 3, -2, 116 / 45, 26 / 45),
        (0, 7 / 3, -8 / 5, -227 / 45, 2704 / 315),
        (0, 0, 56 / 15, -136 / 35, -1262 / 105),
        (0, 0, 0, 4279 / 630, -332 / 35),
        (0, 0, 0, 0, 4174 / 315),
    )
)
TOLERANCE, MOST_STEPS = 1e-12, 200


def geodesic(lon1, lat1, lon2, lat2) -> np.ndarray:
    """Metres between points (Vincenty's inverse formula); NaN where a coordinate is missing. Raises for nearly antipodal points."""
    lon1, lat1, lon2, lat2 = np.broadcast_arrays(*(np.asarray(x, float) for x in (lon1, lat1, lon2, lat2)))
    out = np.full(lon1.shape, np.nan)
    ok = np.isfinite(lon1) & np.isfinite(lat1) & np.isfinite(lon2) & np.isfinite(lat2)
    dlon, u1, u2 = np.radians(lon2[ok] - lon1[ok]), np.arctan((1 - F_) * np.tan(np.radians(lat1[ok]))), np.arctan((1 - F_) * np.tan(np.radians(lat2[ok])))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam, settled = dlon.copy(), 0
    for _ in range(MOST_STEPS):
        across, along = c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam)
        sin_s, cos_s = np.hypot(across, along), s1 * s2 + c1 * c2 * np.cos(lam)
        arc = np.arctan2(sin_s, cos_s)
        azimuth = c1 * across / np.where(sin_s == 0, 1, sin_s)
        q = 1 - azimuth**2
        mid = np.where(q == 0, 0, cos_s - 2 * s1 * s2 / np.where(q == 0, 1, q))
        w = F_ / 16 * q * (4 + F_ * (4 - 3 * q))
        new = dlon + (1 - w) * F_ * azimuth * (arc + w * sin_s * (mid + w * cos_s * (2 * mid**2 - 1)))
        moved, lam = np.abs(new - lam), new
        # what goes into the distance was worked out before the last move, and 1e-12 is micrometres: two moves more
        settled = settled + 1 if settled or not (moved >= TOLERANCE).any() else 0
        if settled > 2:
            break
    else:
        raise ValueError("two points lie on opposite sides of the globe: their distance can't be told")
    k = q * (A**2 - B**2) / B**2
    scale = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
    p = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
    bend = p * sin_s * (mid + p / 4 * (cos_s * (2 * mid**2 - 1) - p / 6 * mid * (4 * sin_s**2 - 3) * (4 * mid**2 - 3)))
    out[ok] = B * scale * (arc - bend)
    return out


def central_meridian(zone: int) -> float:
    return math.radians(6 * zone - 183)


def _c(name: str, *x: np.ndarray) -> np.ndarray:
    """A function of the C library. numpy has its own for some processors, which differ in the last bit: enough to settle a tie another way."""
    return np.asarray(getattr(pc, name)(*(pa.array(v.ravel()) for v in x))).reshape(x[0].shape)


def utm(lon, lat, zone: int, north: bool) -> tuple[np.ndarray, np.ndarray]:
    """Easting and northing, the same to the last bit on every processor."""
    lon, lat = np.broadcast_arrays(np.asarray(lon, float), np.asarray(lat, float))
    lam, sin_phi = np.radians(lon) - central_meridian(zone), _c("sin", np.radians(lat))
    t = _c("sinh", _c("atanh", sin_phi) - E * _c("atanh", E * sin_phi))
    x0, y0 = _c("atan2", t, _c("cos", lam)), _c("atanh", _c("sin", lam) / np.sqrt(1 + t * t))
    x, y = x0.copy(), y0.copy()
    for j, a in enumerate(FORWARD, 1):
        x += a * _c("sin", 2 * j * x0) * _c("cosh", 2 * j * y0)
        y += a * _c("cos", 2 * j * x0) * _c("sinh", 2 * j * y0)
    return K0 * RECTIFYING * y + FALSE_EASTING, K0 * RECTIFYING * x + (0 if north else FALSE_NORTHING)


def utm_to_lonlat(x, y, zone: int, north: bool) -> tuple[np.ndarray, np.ndarray]:
    a0 = (np.asarray(y, float) - (0 if north else FALSE_NORTHING)) / (K0 * RECTIFYING)
    b0 = (np.asarray(x, float) - FALSE_EASTING) / (K0 * RECTIFYING)
    a, b = a0.copy(), b0.copy()
    for j, c in enumerate(INVERSE, 1):
        a -= c * np.sin(2 * j * a0) * np.cosh(2 * j * b0)
        b -= c * np.cos(2 * j * a0) * np.sinh(2 * j * b0)
    chi = np.arcsin(np.clip(np.sin(a) / np.cosh(b), -1, 1))
    lat = chi + sum(c * np.sin(2 * j * chi) for j, c in enumerate(LATITUDE, 1))
    lon = np.degrees(np.arctan2(np.sinh(b), np.cos(a)) + central_meridian(zone))
    return (lon + 180) % 360 - 180, np.degrees(lat)


def web_mercator_to_lonlat(x, y) -> tuple[np.ndarray, np.ndarray]:
    return np.degrees(np.asarray(x, float) / A), np.degrees(2 * np.arctan(np.exp(np.asarray(y, float) / A)) - math.pi / 2)
