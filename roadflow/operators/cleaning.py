"""Cleaning of observations: speed bounds, robust outliers, stationary dwells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadflow.functions.units import finite, to_mps
from roadflow.kernels.dwell import dwells
from roadflow.operators.aggregate import matched_only, require
from roadflow.operators.trajectories import column, over_trajectories, seconds_of
from roadflow.session import ship_package

#: Scales a deviation by the median deviation so that it reads like a standard score.
MAD_SCALE = 0.6745


def modified_z(df: DataFrame, column: str = "speed_mps", keys: tuple[str, ...] = ()) -> DataFrame:
    """df with ``mad_z``: 0 where the median deviation is 0, NULL where the value is missing.

    Two aggregates and joins, so no group of rows is ever held together.
    """
    x = finite(F.col(column))

    def joined(left: DataFrame, stats: DataFrame) -> DataFrame:
        if not keys:
            return left.crossJoin(F.broadcast(stats))  # one row
        other = stats.withColumnsRenamed({k: f"__{k}" for k in keys})
        return left.join(other, [left[k].eqNullSafe(other[f"__{k}"]) for k in keys], "left").drop(*(f"__{k}" for k in keys))

    mid = df.groupBy(*keys).agg(F.median(x).alias("__med"))
    df = joined(df, mid)
    off = F.abs(x - F.col("__med"))
    df = joined(df, df.groupBy(*keys).agg(F.median(off).alias("__mad")))
    z = F.when(F.col("__mad") == 0, F.lit(0.0)).otherwise(F.lit(MAD_SCALE) * (x - F.col("__med")) / F.col("__mad"))
    return df.withColumn("mad_z", F.when(x.isNotNull(), z)).drop("__med", "__mad")


def filter_by_speed(obs: DataFrame, *, min_speed: float | None = None, max_speed: float | None = None, unit="mph", drop_unmatched: bool = True, mad_outliers: bool = False, mad_threshold: float = 3.5, per_edge: bool = False) -> DataFrame:
    """Rows within inclusive bounds and, if asked for, without outliers of what the bounds left. A missing speed fails any bound."""
    require(obs, {"speed_mps"}, "filter_by_speed")
    df = matched_only(obs) if drop_unmatched else obs
    speed = finite(F.col("speed_mps"))
    if min_speed is not None:
        df = df.filter(speed >= to_mps(float(min_speed), unit))
    if max_speed is not None:
        df = df.filter(speed <= to_mps(float(max_speed), unit))
    if mad_outliers:
        df = modified_z(df, keys=("edge_id",) if per_edge else ()).filter(F.abs("mad_z") <= mad_threshold).drop("mad_z")
    return df


def filter_trajectory_speed(obs: DataFrame, *, drop_unmatched: bool = True, drop_missing_speed: bool = True, dwell_radius_m: float = 25.0, dwell_min_s: float = 120.0, max_speed: float | None = None, unit="mph") -> DataFrame:
    """Rows without stationary dwells; slow travel stays. ``max_speed`` applies before dwells are looked for, so it can join them.

    A dwell is a run of a trajectory's fixes, in time order (ties by point_id, where there is one), all within the radius of the run's first
    fix and at least that long. Where a run starts depends on how the one before ended, which no window frame can express.
    """
    require(obs, {"traj_id", "time", "lon", "lat", "speed_mps"}, "filter_trajectory_speed")
    ship_package(obs.sparkSession)
    df = matched_only(obs) if drop_unmatched else obs
    if max_speed is not None:
        df = df.filter(finite(F.col("speed_mps")) <= to_mps(float(max_speed), unit))

    def kernel(block: pa.RecordBatch, start: np.ndarray, more: bool, _: object) -> tuple[pa.RecordBatch, int, None]:
        mask, n = dwells(column(block, "lon"), column(block, "lat"), seconds_of(block), start, dwell_radius_m, dwell_min_s, more)
        return block.slice(0, n).filter(pa.array(~mask[:n])), n, None

    out = over_trajectories(df, kernel, df.schema)
    return out.filter(finite(F.col("speed_mps")).isNotNull()) if drop_missing_speed else out


__all__ = ["MAD_SCALE", "filter_by_speed", "filter_trajectory_speed", "modified_z"]
