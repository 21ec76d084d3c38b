"""Map matching: each fix to its nearest edge, or each trajectory to its likeliest edges.

Fixes are DataFrames with point_id, lon, lat, time and, for trajectories, traj_id. Matched rows carry point_id, edge_id (-1: unmatched),
snap_dist_m (NULL: unmatched), lon, lat, time, and speed_mps and traj_id where the fixes have them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadflow.kernels.viterbi import Model, decode
from roadflow.operators.aggregate import require
from roadflow.operators.network import PIECE_M, Network, project_arrays
from roadflow.operators.trajectories import column, over_trajectories

_CARRIED = ("lon", "lat", "time", "speed_mps", "traj_id")


def _matched(points: DataFrame) -> list[str]:
    return [c for c in _CARRIED if c in points.columns]


def nearest_match(network: Network, points: DataFrame, *, max_dist: float = 50.0, k: int = 10) -> DataFrame:
    """Each fix on its nearest edge within ``max_dist``. k counts pieces of directed edges, as the shortlist does."""
    require(points, {"point_id", "lon", "lat", "time"}, "nearest_match")
    graph, pieces, carried = network.graph(), network.pieces(max_dist), _matched(points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lon, lat = (np.asarray(b.column(c).cast(pa.float64()).fill_null(np.nan)) for c in (1, 2))
            edge, dist = pieces.value.nearest(*project_arrays(graph.value, lon, lat), k)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(edge), pa.array(dist, mask=np.isnan(dist)), *b.columns[1:]], ["point_id", "edge_id", "snap_dist_m", *carried])

    df = points.select("point_id", *carried)
    kind = lambda c: df.schema[c].dataType.simpleString()
    return df.mapInArrow(run, f"point_id {kind('point_id')}, edge_id long, snap_dist_m double, " + ", ".join(f"{c} {kind(c)}" for c in carried))


def nearest_match_join(network: Network, points: DataFrame, *, max_dist: float = 50.0, k: int = 10) -> DataFrame:
    """The same by an equi-join of fixes with pieces on grid cells: for networks too large to send to every executor.

    A piece within reach of a fix has its middle within ``max_dist`` and half a piece; with cells that wide, each piece is dealt to
    the nine cells around its middle and a fix needs its own cell alone.
    """
    require(points, {"point_id", "lon", "lat", "time"}, "nearest_match_join")
    carried, cell = _matched(points), max_dist + PIECE_M / 2
    x, y = network.project(F.col("lon"), F.col("lat"))
    fixes = points.select("point_id", *carried, x.alias("x"), y.alias("y")).withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    s = network.segments().withColumns({"mx": (F.col("x0") + F.col("x1")) / 2, "my": (F.col("y0") + F.col("y1")) / 2})
    around = F.sequence(F.lit(-1), F.lit(1))
    s = s.withColumn("cx", F.explode(F.transform(around, lambda d: F.floor(F.col("mx") / cell) + d))).withColumn("cy", F.explode(F.transform(around, lambda d: F.floor(F.col("my") / cell) + d)))
    far = F.hypot(F.col("x") - F.col("mx"), F.col("y") - F.col("my"))
    met = fixes.select("point_id", "x", "y", "cx", "cy").join(s, ["cx", "cy"]).withColumn("far", far).filter(F.col("far") <= cell)
    short = Window.partitionBy("point_id").orderBy(F.round("far", 6), "edge_id", "seg_no")
    met = met.withColumn("nth", F.row_number().over(short)).filter(F.col("nth") <= k)
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    size2 = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("x0")) * dx + (F.col("y") - F.col("y0")) * dy) / F.when(size2 == 0, 1e-12).otherwise(size2)))
    off = F.hypot(F.col("x") - F.col("x0") - t * dx, F.col("y") - F.col("y0") - t * dy)
    best = met.withColumn("off", off).filter(F.col("off") <= max_dist).groupBy("point_id").agg(F.min(F.struct(F.round("off", 6).alias("r"), "edge_id", "off")).alias("best"))
    out = fixes.join(best, "point_id", "left")
    return out.select("point_id", F.coalesce("best.edge_id", F.lit(-1)).cast("long").alias("edge_id"), F.col("best.off").alias("snap_dist_m"), *carried)


def hmm_match(network: Network, points: DataFrame, *, sigma_z: float = 6.0, beta: float = 30.0, max_dist: float = 50.0, k: int = 8, max_route_dist_factor: float = 8.0) -> DataFrame:
    """The likeliest edges of each trajectory (NULL ids are one). Trajectories of a task are decoded side by side; a very long one in parts."""
    if "traj_id" not in points.columns:
        raise ValueError("hmm_match needs traj_id; nearest_match takes fixes without one")
    require(points, {"point_id", "lon", "lat", "time"}, "hmm_match")
    graph, pieces, carried = network.graph(), network.pieces(max_dist), _matched(points)
    model = Model(sigma_z, beta, max_dist, k, max_route_dist_factor)

    def kernel(block: pa.RecordBatch, start: np.ndarray, more: bool, state: object) -> tuple[pa.RecordBatch, int, object]:
        x, y = project_arrays(graph.value, column(block, "lon"), column(block, "lat"))
        edge, dist, n, state = decode(graph.value["graph"], pieces.value, x, y, start, model, state, more)
        cols = [block.column(0), pa.array(edge), pa.array(dist, mask=np.isnan(dist)), *block.columns[1:]]
        return pa.RecordBatch.from_arrays([c[:n] for c in cols], ["point_id", "edge_id", "snap_dist_m", *carried]), n, state

    df = points.select("point_id", *carried)
    kind = lambda c: df.schema[c].dataType.simpleString()
    return over_trajectories(df, kernel, f"point_id {kind('point_id')}, edge_id long, snap_dist_m double, " + ", ".join(f"{c} {kind(c)}" for c in carried))


class NearestMatcher:
    """Nearest edges with fixed settings."""

    def __init__(self, network: Network, *, max_dist: float = 50.0, k: int = 10) -> None:
        self.network, self.options = network, {"max_dist": max_dist, "k": k}

    def match(self, points: DataFrame) -> DataFrame:
        return nearest_match(self.network, points, **self.options)


class HMMMatcher:
    """Likeliest edges with fixed settings. Partitions decide how many trajectories are decoded at once."""

    def __init__(self, network: Network, *, sigma_z: float = 6.0, beta: float = 30.0, max_dist: float = 50.0, k: int = 8, max_route_dist_factor: float = 8.0) -> None:
        self.network, self.options = network, {"sigma_z": sigma_z, "beta": beta, "max_dist": max_dist, "k": k, "max_route_dist_factor": max_route_dist_factor}

    def match(self, points: DataFrame) -> DataFrame:
        return hmm_match(self.network, points, **self.options)


def emission_logp(off: Column, sigma_z: float = 6.0) -> Column:
    return -0.5 * F.pow(off / sigma_z, F.lit(2.0)) - float(np.log(np.sqrt(2 * np.pi) * sigma_z))


def transition_logp(gap: Column, beta: float = 30.0) -> Column:
    return -gap / beta - float(np.log(beta))
