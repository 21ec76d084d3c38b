"""Movers: evidence by mover, the speed valley between walkers and drivers, classes, and a filter by class."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadflow.functions.units import SpeedUnit, finite, from_mps, to_mps
from roadflow.operators.aggregate import require

VEHICLE, PEDESTRIAN, UNKNOWN = "vehicle", "pedestrian", "unknown"

# Fixed values, in m/s where they are speeds: where a valley may lie, where walkers' hump may lie, and how marked both must be.
SEARCH = (0.5, 6.0)
WALK = (0.6, 2.5)
LEAST_MOVERS = 20
LEAST_PROMINENCE = 1.5
LEAST_HUMP_SHARE = 0.15
BANDWIDTH = 0.20
GRID = 1200


def percentile_column(percentile: float, unit="mph") -> str:
    return f"speed_p{percentile:g}_{SpeedUnit.parse(unit).value}"


def mover_features(obs: DataFrame, *, percentile: float = 85.0, unit="mph") -> DataFrame:
    """One row for each mover (NULL ids are one mover): intervals, a high percentile and the median of speed, distance, snap."""
    require(obs, {"traj_id", "speed_mps"}, "mover_features")
    unit = SpeedUnit.parse(unit)
    df = obs
    if "interval_id" in df.columns:
        df = df.dropDuplicates(["interval_id"])
    df = df.withColumn("speed_mps", F.nanvl("speed_mps", F.lit(None).cast("double"))).filter("speed_mps IS NOT NULL")
    q = F.percentile("speed_mps", F.array(F.lit(percentile / 100.0), F.lit(0.5)))
    out = [F.count("*").alias("n_intervals"), from_mps(q[0], unit).alias(percentile_column(percentile, unit)), from_mps(q[1], unit).alias(f"speed_median_{unit.value}")]
    # a distance that is missing adds nothing; without the column there is no distance
    out.append(F.coalesce(F.sum(finite(F.col("distance_m"))), F.lit(0.0)).alias("distance_m") if "distance_m" in df.columns else F.any_value(F.lit(None).cast("double")).alias("distance_m"))
    if "snap_dist_m" in df.columns:
        out.append(F.median(finite(F.col("snap_dist_m"))).alias("snap_dist_m"))
    return df.groupBy("traj_id").agg(*out)


def mode_threshold(speeds: DataFrame, column: str, *, unit="mph") -> DataFrame:
    """One row: ``threshold`` in ``unit``, NULL where no population at walking pace can be told from the rest.

    A Gaussian kernel density of log speed on a fixed grid, in relational terms: each mover adds to each grid point, so the product is
    a partial aggregate of GRID rows. A valley counts if both sides rise well above it and the highest hump below it stands at walking pace
    and is more than a ripple.
    """
    spark = speeds.sparkSession
    x = F.ln(to_mps(finite(F.col(column).cast("double")), unit))
    logs = speeds.filter(finite(F.col(column).cast("double")) > 0).select(x.alias("x"))
    sample = logs.agg(F.count("*").alias("n"), (BANDWIDTH * F.stddev_samp("x")).alias("h"))
    low, high = math.log(SEARCH[0] / 4), math.log(SEARCH[1] * 8)
    points = F.transform(F.sequence(F.lit(0), F.lit(GRID - 1)), lambda i: F.struct(i.alias("i"), (F.lit(low) + i * F.lit((high - low) / (GRID - 1))).alias("g")))
    each = logs.crossJoin(F.broadcast(sample)).filter((F.col("n") >= LEAST_MOVERS) & (F.col("h") > 1e-12))  # one row beside each mover
    each = each.select("n", "h", "x", F.inline(points))
    weight = F.exp(-0.5 * F.pow((F.col("g") - F.col("x")) / F.col("h"), F.lit(2.0)))
    density = each.groupBy("i", "g").agg((F.sum(weight) / (F.max("n") * F.max("h") * math.sqrt(2 * math.pi))).alias("d"))
    order = Window.orderBy("i")  # GRID rows
    left, right = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    d, before, after = F.col("d"), F.lag("d").over(order), F.lead("d").over(order)
    density = density.withColumns({"turns_up": (d < before) & (d < after), "turns_down": (d > before) & (d > after), "left": F.max("d").over(left), "right": F.max("d").over(right), "peak": F.max("d").over(Window.partitionBy())})
    hump = F.max(F.when(F.col("turns_down"), F.struct(F.col("d").alias("d"), (-F.col("i")).alias("first"), F.col("g").alias("g")))).over(left)
    density = density.withColumn("hump", hump).withColumn("prominence", F.least("left", "right") / d)
    at = F.exp(F.col("hump.g"))
    valley = density.filter(
        F.col("turns_up") & F.col("g").between(math.log(SEARCH[0]), math.log(SEARCH[1])) & (F.col("prominence") >= LEAST_PROMINENCE) & at.between(*WALK) & (F.col("hump.d") >= LEAST_HUMP_SHARE * F.col("peak"))
    )
    best = F.max_by("g", F.struct("prominence", -F.col("i")))
    return valley.agg(from_mps(F.exp(best), unit).alias("threshold"))


def suggest_mode_threshold(speeds: DataFrame, column: str, *, unit="mph") -> float | None:
    return mode_threshold(speeds, column, unit=unit).first()["threshold"]


def classify_movers(obs: DataFrame, *, threshold, percentile: float = 85.0, min_intervals: int = 3, min_distance_m: float = 0.0, unit="mph") -> DataFrame:
    """mover_features with ``mode``. Too little evidence is unknown; a slow vehicle is not. threshold: in ``unit``, or "auto"."""
    feat = mover_features(obs, percentile=percentile, unit=unit)
    col = percentile_column(percentile, unit)
    if isinstance(threshold, str):
        if threshold != "auto":
            raise ValueError(f"threshold is a number or 'auto', not {threshold!r}")
        threshold = suggest_mode_threshold(feat, col, unit=unit)
        if threshold is None:
            raise ValueError("no population at walking pace stands out: look at the speeds and pass a threshold")
    enough = F.col("n_intervals") >= min_intervals
    if min_distance_m > 0:
        enough = enough & F.coalesce(F.col("distance_m") >= min_distance_m, F.lit(False))
    return feat.withColumn("mode", F.when(~enough, UNKNOWN).when(F.col(col) >= float(threshold), VEHICLE).otherwise(PEDESTRIAN))


def filter_by_mode(obs: DataFrame, movers: DataFrame, *, keep=(VEHICLE,)) -> DataFrame:
    """All observations of the movers whose mode is kept; observations without an id are those of the mover without one."""
    require(obs, {"traj_id"}, "filter_by_mode")
    require(movers, {"traj_id", "mode"}, "filter_by_mode")
    chosen = movers.filter(F.col("mode").isin(*([keep] if isinstance(keep, str) else sorted(set(keep))))).select(F.col("traj_id").alias("__id"))
    return obs.join(chosen, F.col("traj_id").eqNullSafe(F.col("__id")), "left_semi")
