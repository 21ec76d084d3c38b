"""GPS fixes: reading and writing."""

from __future__ import annotations

import warnings
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadflow.functions.parse import OFFSET, parse_time
from roadflow.functions.units import SpeedUnit, from_mps, to_mps, unit_of_name
from roadflow.operators.speeds import chord_speeds
from roadflow.operators.trajectories import dense_number
from roadflow.report import Report

# Column names that are recognised, the first of each list first.
NAMES = {
    "lon": ("lon", "longitude", "lng", "x", "long"),
    "lat": ("lat", "latitude", "y"),
    "time": ("time", "timestamp", "datetime", "date_time", "t", "utc"),
    "speed": ("speed", "speed_mph", "speed_kph", "speed_mps", "velocity", "spd"),
    "id": ("traj_id", "track_id", "trip_id", "id", "uid", "unit_id", "device_id"),
}
#: Faster than any road traffic: a sign of a wrong unit.
IMPLAUSIBLE_MPS = 120.0

_reports: WeakKeyDictionary = WeakKeyDictionary()


def report_of(points: DataFrame) -> Report:
    """What was left out or odd when these fixes were loaded; ``warn()`` says so, after an action on them."""
    return _reports[points]


def detect(columns: list[str], what: str) -> str | None:
    low = {c.lower(): c for c in columns}
    return next((low[n] for n in NAMES[what] if n in low), None)


def _read(spark: SparkSession, path: str, sep: str | None, by_line: bool = False) -> DataFrame:
    """Rows as text columns, with __order: their place in the file."""
    low = path.lower()
    if low.endswith((".geojson", ".json")):
        feature = "struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>"
        if by_line:
            f = spark.read.text(path).select(F.monotonically_increasing_id().alias("__order"), F.from_json(F.regexp_replace("value", r",\s*$", ""), feature).alias("f"))
        else:
            f = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", f"struct<features:array<{feature}>>")["features"]).alias("__order", "f"))
        f = f.filter("f.geometry.type = 'Point'")
        at = F.from_json("f.geometry.coordinates", "array<double>")
        keys = sorted(r[0] for r in f.select(F.explode(F.map_keys("f.properties"))).distinct().collect())
        out = f.select("__order", at[0].alias("lon"), at[1].alias("lat"), *(F.try_element_at("f.properties", F.lit(k)).alias(k if k not in ("lon", "lat") else f"{k}_src") for k in keys))
        if out.isEmpty():
            raise ValueError(f"no points in {path}")
        return out
    sep = sep or ("\t" if low.endswith((".tsv", ".tab")) else ",")
    return spark.read.csv(path, header=True, sep=sep).withColumn("__order", F.monotonically_increasing_id())


def load_points(spark: SparkSession, path: str, **options) -> DataFrame:
    """Fixes of a CSV, TSV or GeoJSON file: see ``points_from`` for the options. by_line: each line of the GeoJSON is a feature, so that tasks share a file."""
    sep, by_line = options.pop("sep", None), options.pop("by_line", False)
    return points_from(_read(spark, path, sep, by_line), order_col="__order", **options)


def points_from(
    df: DataFrame,
    *,
    speed_unit=None,
    lon_col: str | None = None,
    lat_col: str | None = None,
    time_col: str | None = None,
    speed_col: str | None = None,
    id_col: str | None = None,
    timestamp_unit: str | None = None,
    tz: str | None = None,
    derive_speed: bool = False,
    keep_cols: list[str] | None = None,
    order_col: str | None = None,
    dense_ids: bool = True,
) -> DataFrame:
    """point_id, traj_id (if there is an id), lon, lat, time, speed_mps (if there is a speed) and the other columns.

    Rows without an id where one is expected, without position, time or speed, or off the globe are left out, and counted on the way: ``report_of``
    tells how many. point_id numbers the rest in order (``dense_ids``), or keeps the order column's own numbers.
    """
    report = Report()
    columns = [c for c in df.columns if c != order_col]
    lon_col, lat_col = lon_col or detect(columns, "lon"), lat_col or detect(columns, "lat")
    if lon_col is None or lat_col is None:
        raise ValueError("no longitude or latitude column is recognised: pass lon_col= and lat_col=")
    time_col, speed_col, id_col = time_col or detect(columns, "time"), speed_col or detect(columns, "speed"), id_col or detect(columns, "id")
    if time_col is None:
        raise ValueError("no time column is recognised: pass time_col=")
    if derive_speed and id_col is None:
        raise ValueError("derive_speed=True needs an id, so that fixes of different movers are never joined: pass id_col=")
    unit = SpeedUnit.MPH
    if speed_col is not None and not derive_speed:
        named = unit_of_name(speed_col)
        unit = SpeedUnit.parse(speed_unit or named or "mph")
        if speed_unit is not None and named is not None and SpeedUnit.parse(named) is not unit:
            warnings.warn(f"column {speed_col!r} reads like {named}, but speed_unit={unit.value!r} holds", stacklevel=2)
    number = lambda c: F.nanvl(F.col(f"`{c}`").try_cast("double"), F.lit(None).cast("double"))
    out: dict[str, Column] = {}
    if id_col is not None:
        out["traj_id"] = F.col(f"`{id_col}`").cast("string")
    out |= {"lon": number(lon_col), "lat": number(lat_col), "time": parse_time(F.col(f"`{time_col}`"), timestamp_unit=timestamp_unit, tz=tz)}
    if speed_col is not None and not derive_speed:
        out["speed_mps"] = to_mps(number(speed_col), unit)
    extras = [c for c in columns if c not in {lon_col, lat_col, time_col, speed_col, id_col}]
    if keep_cols is not None:
        if missing := sorted(set(keep_cols) - set(columns)):
            warnings.warn(f"keep_cols names columns that are not there: {missing}", stacklevel=2)
        extras = [c for c in extras if c in keep_cols]
    taken = {"point_id", *out} | ({"speed_mps"} if derive_speed else set())
    for c in extras:
        out[f"{c}_src" if c in taken else c] = F.col(f"`{c}`")
    order = F.col(order_col) if order_col else F.monotonically_increasing_id()
    fixes = df.select(order.alias("point_id"), *(c.alias(k) for k, c in out.items()))
    watched: dict[str, tuple[Column, str]] = {}
    if timestamp_unit is None:
        aware = F.trim(F.col(f"`{time_col}`").cast("string")).rlike(OFFSET)
        fixes = df.select(order.alias("point_id"), *(c.alias(k) for k, c in out.items()), aware.alias("__aware"))
        if tz is None:
            watched["n_aware_without_tz"] = (F.col("__aware"), "times have an offset, but there is no tz=: they keep their own clocks")
        watched["n_naive"] = (~F.col("__aware") & F.lit(tz is not None), f"times have no offset: they count as UTC and are converted to {tz}")
    if id_col is not None:
        watched["n_without_id"] = (F.col("traj_id").isNull(), f"rows are left out: no {id_col}")
    fixes = report.watch(fixes, **watched).drop("__aware")
    if id_col is not None:
        fixes = fixes.filter("traj_id IS NOT NULL")
    if derive_speed:
        fixes = chord_speeds(fixes)
    needed = ["lon", "lat", "time", *(["speed_mps"] if "speed_mps" in fixes.columns else [])]
    whole = F.lit(True)
    for c in needed:
        whole &= F.col(c).isNotNull()
    off = (F.abs("lat") > 90) | (F.abs("lon") > 180)
    odd = {f"n_without_{c}": (F.col(c).isNull(), f"rows are left out: no usable {c}") for c in needed} | {"n_off_globe": (whole & off, "rows are left out: a latitude beyond 90 or a longitude beyond 180")}
    if "speed_mps" in needed:
        odd["n_implausible"] = (whole & ((F.col("speed_mps") < 0) | (F.col("speed_mps") > IMPLAUSIBLE_MPS)), f"speeds are negative or above {IMPLAUSIBLE_MPS} m/s: is {unit.value} the right unit?")
    fixes = report.watch(fixes, **odd).filter(whole & ~off)
    if dense_ids:
        fixes = dense_number(fixes.withColumnRenamed("point_id", "__order"), "__order", "point_id").select("point_id", *(c for c in fixes.columns if c != "point_id"))
    _reports[fixes] = report
    return fixes


def suspect_speeds(points: DataFrame) -> DataFrame:
    """One row: how many speeds are negative or faster than any traffic, and the range of all."""
    v = F.col("speed_mps")
    return points.agg(F.count("*").alias("n"), F.count_if((v < 0) | (v > IMPLAUSIBLE_MPS)).alias("n_implausible"), F.min(v).alias("slowest_mps"), F.max(v).alias("fastest_mps"))


def lone_fixes(points: DataFrame) -> DataFrame:
    """One row: how many trajectories there are, and how many of them have a single fix, from which no speed can be derived."""
    return points.groupBy("traj_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_trajectories"), F.count_if(F.col("n") == 1).alias("n_lone"))


def to_frame(points: DataFrame, *, speed_unit="mph") -> DataFrame:
    """points with ISO times and, if they have speeds, speed in ``speed_unit`` too."""
    out = points.withColumn("time", F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).withColumn("time", F.regexp_replace("time", r"\.000000$", ""))
    unit = SpeedUnit.parse(speed_unit)
    if "speed_mps" in points.columns and unit is not SpeedUnit.MPS:
        out = out.withColumn(f"speed_{unit.value}", from_mps(F.col("speed_mps"), unit))
    return out


def save_points(points: DataFrame, path: str, *, speed_unit="mph") -> None:
    """As GeoJSON lines (one feature a row) if the path says so, else as CSV with a header. A folder of part files either way."""
    frame = to_frame(points, speed_unit=speed_unit)
    if path.lower().endswith((".geojson", ".json")):
        rest = [c for c in frame.columns if c not in ("lon", "lat")]
        geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
        frame.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*rest).alias("properties"))).alias("value")).write.mode("overwrite").text(path)
    else:
        frame.write.mode("overwrite").csv(path, header=True)
