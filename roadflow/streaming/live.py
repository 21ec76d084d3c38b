"""Live observations: the hourly statistics of a stream, by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadflow.functions.units import from_mps
from roadflow.operators.aggregate import usable


def live_speeds(stream: DataFrame, *, window: str = "1 hour", late: str = "30 minutes", by_edge: bool = True, output_unit="mph", require_quality: bool = False) -> DataFrame:
    """Count, mean and spread of speeds for each event-time window (and edge); observations later than ``late`` are left out.

    stream: observations with a TIMESTAMP ``time``. Each statistic is a partial aggregate with state of fixed size for each key, so the state
    follows windows x edges, not observations. Medians would keep every value; take them from the batch functions.
    """
    df = usable(stream, require_quality=require_quality, what="live_speeds").withWatermark("time", late)
    keys = [F.window("time", window).alias("w"), *(["edge_id"] if by_edge else [])]
    v = F.col("speed_mps")
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), from_mps(F.avg(v), output_unit).alias("mean_speed"), from_mps(F.stddev_samp(v), output_unit).alias("std_speed"))
    return out.select(F.col("w.start").alias("window_start"), *(["edge_id"] if by_edge else []), "n", "mean_speed", "std_speed")
