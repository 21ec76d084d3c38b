"""Speeds from the way along roads between matched fixes, and chord speeds between fixes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadflow.functions.geo import geodesic_distance
from roadflow.kernels.intervals import Rules, derive
from roadflow.operators.aggregate import require
from roadflow.operators.network import Network, project_arrays
from roadflow.operators.trajectories import column, numbered, over_trajectories, seconds_of

# Columns of the public result.
INTERVAL_COLUMNS = ("interval_id", "traj_id", "point_id_from", "point_id_to", "time", "t_from", "t_to", "dt_s", "distance_m", "speed_mps", "edge_from", "edge_to", "n_edges", "snap_dist_m", "speed_sigma_mps", "speed_var", "quality")


@dataclass(frozen=True)
class DerivedSpeeds:
    intervals: DataFrame
    edge_observations: DataFrame


def derive_speeds(
    network: Network,
    matched: DataFrame,
    points: DataFrame | None = None,
    *,
    pos_accuracy_col: str | None = None,
    default_pos_sigma_m: float = 15.0,
    min_dt_s: float = 0.5,
    max_dt_s: float = 120.0,
    max_snap_dist_m: float = 60.0,
    max_speed_mps: float = 60.0,
    min_snr: float = 3.0,
    max_route_dist_factor: float = 6.0,
    route_cutoff_floor_m: float = 300.0,
    min_baseline_m: float | None = None,
    interval_id_start: int = 0,
    dense_ids: bool = False,
    dealt: bool = False,
) -> DerivedSpeeds:
    """Intervals between fixes of each trajectory and, for each, one row for every edge it touched.

    points: where the accuracy column is, if matched lacks it. An interval's id is the point_id of the fix it starts from (ids of fixes are
    unique, and a fix starts at most one); ``dense_ids`` numbers them from ``interval_id_start`` by the time of their first fixes. Fixes of a
    trajectory that share a timestamp: of such a group only the last has an interval after it; ``tied_fixes`` counts them. dealt: matched comes
    straight from ``hmm_match``, so its trajectories are dealt out and in order already, and need no second shuffle.
    """
    require(matched, {"point_id", "edge_id", "lon", "lat", "time"}, "derive_speeds")
    graph = network.graph()
    df = matched if "traj_id" in matched.columns else matched.withColumn("traj_id", F.lit(None).cast("string"))
    if pos_accuracy_col and pos_accuracy_col not in df.columns and points is not None and pos_accuracy_col in points.columns:
        df = df.join(points.select("point_id", pos_accuracy_col), "point_id", "left")
    has_sigma, has_snap = bool(pos_accuracy_col) and pos_accuracy_col in df.columns, "snap_dist_m" in df.columns
    df = df.select("point_id", "traj_id", "lon", "lat", "time", "edge_id", *(["snap_dist_m"] if has_snap else []), *([F.col(pos_accuracy_col).try_cast("double").alias("sigma")] if has_sigma else []))
    rules = Rules(min_dt_s, max_dt_s, max_snap_dist_m, max_speed_mps, min_snr, max_route_dist_factor, route_cutoff_floor_m, min_baseline_m)
    kind = {c: df.schema[c].dataType.simpleString() for c in ("traj_id", "point_id", "time")}
    t = kind["time"]
    schema = f"traj_id {kind['traj_id']}, point_id_from {kind['point_id']}, point_id_to {kind['point_id']}, time {t}, t_from {t}, t_to {t}, dt_s double, distance_m double, speed_mps double, edge_from long, edge_to long, n_edges int, snap_dist_m double, speed_sigma_mps double, speed_var double, quality boolean, edge_ids array<long>"
    names = [c.split()[0] for c in schema.split(", ")]

    def kernel(block: pa.RecordBatch, start: np.ndarray, more: bool, _: object) -> tuple[pa.RecordBatch, int, None]:
        shared = graph.value
        x, y = project_arrays(shared, column(block, "lon"), column(block, "lat"))
        sigma = column(block, "sigma") if has_sigma else np.full(len(x), np.nan)
        sigma = np.where(np.isfinite(sigma) & (sigma > 0), sigma, default_pos_sigma_m)
        edge = np.asarray(pc.cast(block.column(block.schema.get_field_index("edge_id")), pa.int64()).fill_null(-1))
        got, n = derive(shared["graph"], start, seconds_of(block), x, y, edge, column(block, "snap_dist_m") if has_snap else None, sigma, rules, more)
        a, b = pa.array(got["from"]), pa.array(got["to"])
        tid, pid, when = (block.column(block.schema.get_field_index(c)) for c in ("traj_id", "point_id", "time"))
        t_from, t_to = when.take(a), when.take(b)
        mid = pc.cast(pc.divide(pc.add(pc.cast(t_from, pa.int64()), pc.cast(t_to, pa.int64())), 2), pa.timestamp("us")).cast(when.type)
        edges = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(got["n_edges"])), pa.int32()), pa.array(got["edges"]))
        snap = pa.array(got["snap"], mask=np.isnan(got["snap"]))
        cols = [tid.take(a), pid.take(a), pid.take(b), mid, t_from, t_to, *(pa.array(got[c]) for c in ("dt_s", "distance_m", "speed_mps")), pa.array(edge[got["from"]]), pa.array(edge[got["to"]])]
        cols += [pa.array(got["n_edges"], pa.int32()), snap, pa.array(got["sigma"]), pa.array(got["sigma"] ** 2), pa.array(got["quality"]), edges]
        return pa.RecordBatch.from_arrays(cols, names), n, None

    found = over_trajectories(df, kernel, schema, dealt=dealt)
    if dense_ids:
        found = numbered(found, ("t_from", "point_id_from"), "interval_id", interval_id_start)
    else:  # a fix starts one interval at most, so its id names the interval
        found = found.withColumn("interval_id", F.col("point_id_from") + interval_id_start)
    intervals = found.select(*INTERVAL_COLUMNS)
    each = found.select("interval_id", F.explode("edge_ids").alias("edge_id"), "speed_mps", "time", "traj_id", "dt_s", "distance_m", "snap_dist_m", "speed_sigma_mps", "speed_var", "quality")
    return DerivedSpeeds(intervals, each)


def tied_fixes(points: DataFrame) -> DataFrame:
    """Trajectories in which fixes share a timestamp, and how many do: only the last of each such group counts."""
    same = points.groupBy("traj_id", "time").agg(F.count("*").alias("n")).filter("n > 1")
    return same.groupBy("traj_id").agg(F.sum("n").alias("n_tied"))


def chord_speeds(points: DataFrame) -> DataFrame:
    """points with speed_mps: the geodesic from the fix before over the time since, NULL unless that is positive; the first fix has the second's."""
    require(points, {"point_id", "lon", "lat", "time"}, "chord_speeds")
    keys = ["traj_id"] if "traj_id" in points.columns else []
    w = Window.partitionBy(*keys).orderBy(F.col("time").asc_nulls_last(), "point_id")
    before = {f"__{c}": F.lag(c).over(w) for c in ("lon", "lat", "time")}
    df = points.withColumns(before | {"__nth": F.row_number().over(w)})
    dt = F.expr("timestampdiff(MICROSECOND, __time, time)") / 1e6
    df = df.withColumn("__v", F.when(dt > 0, geodesic_distance("__lon", "__lat", "lon", "lat") / dt))
    df = df.withColumn("speed_mps", F.when(F.col("__nth") == 1, F.lead("__v").over(w)).otherwise(F.col("__v")))
    return df.drop(*before, "__nth", "__v")
