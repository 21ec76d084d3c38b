from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadflow.functions import days, geo, parse, units
from roadflow.kernels import geodesy

# Published distances and coordinates.
GEODESICS = [
    (0, 0, 1, 0, 111319.490793), (15, 50, 15.01, 50, 716.957536), (0, 0, 0, 1, 110574.388558), (144.42486788888889, -37.95103341666667, 143.92649552777778, -37.65282113888889, 54972.271),
]
UTM = [
    (15, 50, 32633, 500000.000000, 5538630.702867), (-122.4194, 37.7749, 32610, 551130.768481, 4180998.881499), (151.2093, -33.8688, 32756, 334368.633648, 6250948.345385),
    (0, 0, 32631, 166021.443081, 0), (-74.006, 40.7128, 32618, 583959.372324, 4507350.998243),
]


@pytest.mark.parametrize("lon1,lat1,lon2,lat2,metres", GEODESICS)
def test_geodesic(lon1, lat1, lon2, lat2, metres):
    assert geodesy.geodesic(lon1, lat1, lon2, lat2) == pytest.approx(metres, abs=1e-3)
    assert geodesy.geodesic(lon2, lat2, lon1, lat1) == pytest.approx(metres, abs=1e-3)


def test_geodesic_edges():
    assert np.isnan(geodesy.geodesic(np.nan, 0, 1, 1)) and geodesy.geodesic(3, 4, 3, 4) == 0
    with pytest.raises(ValueError):
        geodesy.geodesic(0, 0, 179.9999, 0.0001)


@pytest.mark.parametrize("lon,lat,epsg,x,y", UTM)
def test_utm(spark, lon, lat, epsg, x, y):
    zone, north = geo.utm_zone_of(epsg)
    got = geodesy.utm(lon, lat, zone, north)
    assert got == (pytest.approx(x, abs=1e-5), pytest.approx(y, abs=1e-5))
    assert geodesy.utm_to_lonlat(*got, zone, north) == (pytest.approx(lon, abs=1e-9), pytest.approx(lat, abs=1e-9))
    assert geo.utm_epsg_for(lon, lat) == epsg
    fx, fy = geo.utm_forward(F.col("lon"), F.col("lat"), zone, north)
    row = spark.createDataFrame([(float(lon), float(lat))], "lon double, lat double").select(fx.alias("x"), fy.alias("y"))
    bx, by = geo.utm_inverse(F.col("x"), F.col("y"), zone, north)
    r = row.select("x", "y", bx.alias("lon"), by.alias("lat")).first()
    assert (r["x"], r["y"]) == (pytest.approx(x, abs=1e-5), pytest.approx(y, abs=1e-5))
    assert (r["lon"], r["lat"]) == (pytest.approx(lon, abs=1e-9), pytest.approx(lat, abs=1e-9))


def test_reference_systems():
    assert geo.parse_epsg(" epsg:32618 ") == 32618 and geo.parse_epsg("GEOGCS[...]") is None
    assert geo.is_wgs84("EPSG:4979") and geo.is_wgs84("OGC:CRS84") and geo.is_wgs84('GEOGCRS["WGS 84",ID["OGC","CRS84"]]')
    assert not geo.is_wgs84('PROJCRS["x",BASEGEOGCRS["WGS 84",ID["OGC","CRS84"]]]') and not geo.is_wgs84(None)
    for bad in (32600, 32661, 4326):
        with pytest.raises(ValueError):
            geo.utm_zone_of(bad)


def test_units():
    assert units.SpeedUnit.parse(" Km/H ") is units.SpeedUnit.KPH and units.SpeedUnit.MPH == "mph"
    assert units.to_mps(10, "mph") == pytest.approx(4.4704) and units.from_mps(units.to_mps(33.0, "kph"), "kph") == pytest.approx(33.0)
    assert units.unit_of_name("Speed (km/h)") == "kph" and units.unit_of_name("spd_mps") == "mps" and units.unit_of_name("speed") is None
    with pytest.raises(ValueError):
        units.SpeedUnit.parse("knots")


def test_days():
    assert days.resolve_days("weekday") == {0, 1, 2, 3, 4} and days.resolve_days(["Sat", 6]) == {5, 6} and days.resolve_days(np.int64(0)) == {0}
    assert days.resolve_days(None) is None and days.resolve_days(["mon", "all"]) is None
    for bad in ([], "someday", 7):
        with pytest.raises(ValueError):
            days.resolve_days(bad)
    with pytest.raises(ValueError):
        days.valid_hours([24], "peak_hours")


@pytest.mark.parametrize("text,mps", [("50", 50 / 3.6), ("35 mph", 35 * 0.44704), (" 50 KM/H ", 50 / 3.6), ("none", None), ("50;30", None), ("0", None), ("30 knots", None), (None, None), ("7.5", 7.5 / 3.6)])
def test_maxspeed(spark, text, mps):
    got = spark.createDataFrame([(text,)], "t string").select(parse.parse_maxspeed(F.col("t"))).first()[0]
    assert got == (pytest.approx(mps) if mps is not None else None)


@pytest.mark.parametrize(
    "text,unit,tz,local",
    [
        ("2026-06-01T08:00:00", None, None, "2026-06-01 08:00:00"),
        ("2026-06-01 08:00:10.25", None, "America/New_York", "2026-06-01 04:00:10.25"),
        ("2026-06-01T08:00:00Z", None, "America/New_York", "2026-06-01 04:00:00"),
        ("2026-06-01T08:00:00+02:00", None, None, "2026-06-01 08:00:00"),
        ("2026-06-01T08:00:00-0530", None, "UTC", "2026-06-01 13:30:00"),
        ("1780300800", "s", None, "2026-06-01 08:00:00"),
        ("1780300800123", "ms", "UTC", "2026-06-01 08:00:00.123"),
        ("1780300800.5", "s", None, "2026-06-01 08:00:00.5"),
        ("nonsense", None, None, None),
        (None, None, "UTC", None),
    ],
)
def test_times(spark, text, unit, tz, local):
    got = spark.createDataFrame([(text,)], "t string").select(parse.parse_time(F.col("t"), timestamp_unit=unit, tz=tz).cast("string")).first()[0]
    assert got == local
