"""Geodesy as Columns, and the reading of coordinate reference systems."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from roadflow.kernels import geodesy as g

WGS84_CODES = (4326, 4979)
WEB_MERCATOR = 3857
# Outermost WKT keywords of geographic systems.
GEOGRAPHIC = {"GEOGCS", "GEOGCRS", "GEODCRS", "GEODETICCRS", "GEOGRAPHICCRS"}


@F.pandas_udf(DoubleType())
def geodesic_distance(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
    """Metres on the WGS84 ellipsoid; NULL where a coordinate is missing; fails for nearly antipodal points."""
    out = pd.Series(g.geodesic(lon1, lat1, lon2, lat2))
    return out.where(out.notna(), None)


def _total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def utm_forward(lon: Column, lat: Column, zone: int, north: bool) -> tuple[Column, Column]:
    """Easting and northing, inside whole-stage codegen."""
    lam, sin_phi = F.radians(lon) - g.central_meridian(zone), F.sin(F.radians(lat))
    t = F.sinh(F.atanh(sin_phi) - g.E * F.atanh(g.E * sin_phi))
    x0, y0 = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.hypot(F.lit(1.0), t))
    x = x0 + _total([F.lit(a) * F.sin(2 * j * x0) * F.cosh(2 * j * y0) for j, a in enumerate(g.FORWARD, 1)])
    y = y0 + _total([F.lit(a) * F.cos(2 * j * x0) * F.sinh(2 * j * y0) for j, a in enumerate(g.FORWARD, 1)])
    k = g.K0 * g.RECTIFYING
    return F.lit(k) * y + g.FALSE_EASTING, F.lit(k) * x + (0.0 if north else g.FALSE_NORTHING)


def utm_of_points(points: Column, zone: int, north: bool) -> Column:
    """An array of (lon, lat) as an array of (x, y), by the kernel that projects fixes: a place has the same numbers in both."""

    @F.arrow_udf("array<struct<x:double,y:double>>")
    def project(p: pa.Array) -> pa.Array:
        flat = p.flatten()
        lon, lat = (np.asarray(flat.field(c).fill_null(np.nan)) for c in ("lon", "lat"))
        xy = [pa.array(v, mask=np.isnan(v)) for v in g.utm(lon, lat, zone, north)]
        start = np.append(0, np.cumsum(np.asarray(p.value_lengths().fill_null(0), np.int64)))
        return pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.StructArray.from_arrays(xy, ["x", "y"]))

    return project(points)


def utm_inverse(x: Column, y: Column, zone: int, north: bool) -> tuple[Column, Column]:
    k = g.K0 * g.RECTIFYING
    a0, b0 = (y - (0.0 if north else g.FALSE_NORTHING)) / k, (x - g.FALSE_EASTING) / k
    a = a0 - _total([F.lit(c) * F.sin(2 * j * a0) * F.cosh(2 * j * b0) for j, c in enumerate(g.INVERSE, 1)])
    b = b0 - _total([F.lit(c) * F.cos(2 * j * a0) * F.sinh(2 * j * b0) for j, c in enumerate(g.INVERSE, 1)])
    chi = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(a) / F.cosh(b))))
    lat = chi + _total([F.lit(c) * F.sin(2 * j * chi) for j, c in enumerate(g.LATITUDE, 1)])
    lon = F.degrees(F.atan2(F.sinh(b), F.cos(a)) + g.central_meridian(zone))
    return F.pmod(lon + 180, F.lit(360.0)) - 180, F.degrees(lat)


def web_mercator_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    half_pi = 1.5707963267948966
    return F.degrees(x / g.A), F.degrees(2 * F.atan(F.exp(y / g.A)) - half_pi)


def parse_epsg(crs) -> int | None:
    m = re.fullmatch(r"\s*epsg\s*:\s*(\d+)\s*", str(crs or ""), re.I)
    return int(m[1]) if m else None


def is_wgs84(crs) -> bool:
    """Whether coordinates in this system are WGS84 longitudes and latitudes: by code, by OGC name, or by the name in a geographic WKT.

    The base of a projected system may bear the same name; it says nothing about the system's own coordinates.
    """
    text = str(crs or "")
    code = parse_epsg(text)
    if code is not None:
        return code in WGS84_CODES
    if re.fullmatch(r"\s*ogc\s*:\s*crs84\s*", text, re.I):
        return True
    word = re.match(r"\s*([A-Za-z_]+)\s*\[", text)
    return bool(word and word[1].upper() in GEOGRAPHIC and re.search(r'(?:authority|id)\s*\[\s*"ogc"\s*,\s*"?crs84"?\s*\]', text, re.I))


def utm_zone_of(epsg: int) -> tuple[int, bool]:
    """Zone and whether it is northern."""
    hemisphere, zone = divmod(int(epsg) - 32600, 100)
    if hemisphere not in (0, 1) or not 1 <= zone <= 60:
        raise ValueError(f"EPSG:{epsg} is no WGS84 UTM zone (32601 to 32660, 32701 to 32760)")
    return zone, hemisphere == 0


def utm_epsg_for(lon: float, lat: float) -> int:
    return (32600 if lat >= 0 else 32700) + min(60, max(1, int((lon + 180) // 6) + 1))


def geojson_crs(collection: dict) -> str | None:
    """The name in a collection's old-style crs member, as ``EPSG:n`` or ``OGC:CRS84``, else as it stands; None without one."""
    member = collection.get("crs")
    name = ((member or {}).get("properties") or {}).get("name") if isinstance(member, dict) else None
    if not name:
        return None
    m = re.search(r"epsg:[\d.]*:?(\d+)$", str(name), re.I)
    return f"EPSG:{m[1]}" if m else "OGC:CRS84" if re.search(r"crs:?[\d.]*:?crs84$|ogc:crs84$", str(name), re.I) else str(name)
