"""Time-of-day and per-edge speed statistics, hour classes, and speeds written back on edges.

Inputs are DataFrames of observations: ``time`` (TIMESTAMP_NTZ, local clock), ``speed_mps`` and, as a function needs them, ``edge_id`` (-1:
unmatched), ``interval_id``, ``speed_var``, ``quality``. Missing numbers are NULL; NaN counts as NULL. Nothing is changed in place: where
speeds go onto edges, a new edges DataFrame comes back. Functions stay lazy but for small results that decide what comes next
(hour classes).
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadflow.functions.days import block_label, on_days, resolve_days, valid_hours, with_blocks
from roadflow.functions.units import SpeedUnit, finite, from_mps, usable_speed

REGIMES = ("overall", "peak", "offpeak")


def require(df: DataFrame, columns: set[str], what: str) -> None:
    if missing := sorted(columns - set(df.columns)):
        raise ValueError(f"{what} needs the columns {missing}")


def matched_only(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("edge_id").eqNullSafe(F.lit(-1))) if "edge_id" in df.columns else df


def usable(obs: DataFrame, *, days=None, require_quality: bool = False, what: str = "aggregate_speeds") -> DataFrame:
    """Matched rows with a speed, on the chosen days, of good quality if asked for."""
    require(obs, {"time", "speed_mps"}, what)
    df = matched_only(obs).withColumn("speed_mps", F.nanvl("speed_mps", F.lit(None).cast("double"))).filter("speed_mps IS NOT NULL")
    wanted = on_days(F.col("time"), days)
    if wanted is not None:
        df = df.filter(wanted)
    if require_quality:
        require(df, {"quality"}, f"{what}(require_quality=True)")
        df = df.filter("quality")
    return df


def one_per_interval(df: DataFrame, what: str) -> DataFrame:
    """One row for each interval_id. An id that names different measurements fails the query, where and when it is met.

    Rows of one interval differ in their edge alone, so whichever stays is as good; NULL ids count as one interval.
    """
    identity = [c for c in ("traj_id", "time", "speed_mps") if c in df.columns]
    rest = [c for c in df.columns if c not in ("interval_id", *identity)]
    same = F.struct(*identity) if identity else F.struct(F.lit(1).alias("one"))
    got = df.groupBy("interval_id").agg(F.min(same).alias("low"), F.max(same).alias("high"), *(F.any_value(c).alias(c) for c in rest))
    clash = F.raise_error(F.concat(F.lit(f"{what}: interval_id "), F.coalesce(F.col("interval_id").cast("string"), F.lit("NULL")), F.lit(" names more than one measurement; offset the ids of separate runs, or pass dedup_intervals=False")))
    got = got.withColumn("low", F.when(F.col("low").eqNullSafe(F.col("high")), F.col("low")).otherwise(clash))
    return got.select("interval_id", *(F.col(f"low.{c}").alias(c) for c in identity), *rest)


def _statistics(statistic: str, unit: SpeedUnit, weighted: bool) -> list[tuple[str, Column]]:
    """Names and aggregates, in ``unit``."""
    v, n = F.col("speed_mps"), F.count("*")
    out: list[tuple[str, Column]] = []

    def add(**given: Column) -> None:
        out.extend((k, from_mps(c, unit)) for k, c in given.items())

    if statistic in ("mean", "both"):
        spread = F.when(n > 1, F.stddev_samp(v))
        if weighted:
            weight = F.sum(1 / F.col("speed_var"))
            mean, sem = F.sum(v / F.col("speed_var")) / weight, F.sqrt(1 / weight)
        else:
            mean, sem = F.avg(v), spread / F.sqrt(n.cast("double"))
        add(mean_speed=mean, std_speed=spread, sem_speed=sem, ci95_low=mean - 1.96 * sem, ci95_high=mean + 1.96 * sem)
    if statistic in ("median", "both"):
        q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        add(median_speed=q[1], q1_speed=q[0], q3_speed=q[2], iqr_speed=q[2] - q[0])
    return out


def aggregate_speeds(
    obs: DataFrame,
    *,
    block_hours: int = 1,
    statistic: str = "mean",
    output_unit="mph",
    by_edge: bool = False,
    min_samples: int = 1,
    dedup_intervals: bool = True,
    days=None,
    weight_by_variance: bool = False,
    require_quality: bool = False,
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """Speed statistics for each block of hours, and for each edge too if ``by_edge``. keys: further columns to group by.

    A block with one observation has no spread (NULL), unless variances weight it. Network-wide, an interval counts once.
    """
    unit = SpeedUnit.parse(output_unit)
    if statistic not in ("mean", "median", "both"):
        raise ValueError("statistic is 'mean', 'median' or 'both'")
    if weight_by_variance and statistic == "median":
        raise ValueError("variances weight a mean; use statistic='mean' or 'both'")
    if 24 % block_hours:
        warnings.warn(f"block_hours={block_hours} does not divide 24: the last block is narrower", stacklevel=2)
    df = usable(obs, days=days, require_quality=require_quality)
    if weight_by_variance:
        require(df, {"speed_var"}, "weight_by_variance=True")
        df = df.filter(finite(F.col("speed_var").cast("double")) > 0)
    if not by_edge and dedup_intervals and "interval_id" in df.columns:
        df = one_per_interval(df, "aggregate_speeds")
    by = [*keys, *(["edge_id"] if by_edge else []), "block_start_hour"]
    wanted = _statistics(statistic, unit, weight_by_variance)
    out = with_blocks(df, block_hours).groupBy(*by).agg(F.count("*").alias("n"), *(c.alias(k) for k, c in wanted))
    if min_samples > 1:
        out = out.filter(F.col("n") >= min_samples)
    return out.select(*by, "n", block_label(F.col("block_start_hour"), block_hours).alias("block_label"), *(k for k, _ in wanted), F.lit(unit.value).alias("unit"))


def _speed_column(statistic: str) -> str:
    return "mean_speed" if statistic == "mean" else "median_speed"


def rank_blocks(aggregated: DataFrame, *, statistic: str = "mean", n_peak: int = 1, n_offpeak: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    """Blocks by speed, slowest first (ties: earlier block), each marked peak and off-peak or not."""
    col = _speed_column(statistic)
    if "edge_id" in aggregated.columns:
        raise ValueError("peaks are those of the whole network: aggregate with by_edge=False")
    require(aggregated, {col}, f"peak_analysis(statistic={statistic!r})")
    up = Window.partitionBy(*keys).orderBy(col, "block_start_hour")  # at most 24 blocks for each key
    n = F.count("*").over(Window.partitionBy(*keys))
    ranked = aggregated.withColumn("rank", F.row_number().over(up)).withColumn("is_peak", F.col("rank") <= n_peak).withColumn("is_offpeak", F.col("rank") > n - n_offpeak)
    return ranked


def peak_analysis(aggregated: DataFrame, *, statistic: str = "mean", n_peak: int = 1, n_offpeak: int = 1) -> dict:
    """The slowest and the fastest blocks, and all in order, as lists of dicts."""
    col = _speed_column(statistic)
    rows = [r.asDict() for r in rank_blocks(aggregated, statistic=statistic, n_peak=n_peak, n_offpeak=n_offpeak).orderBy("rank").collect()]  # at most 24
    if not rows:
        raise ValueError("peak_analysis: no block has observations")
    if n_peak + n_offpeak > len(rows):
        warnings.warn(f"{n_peak} peak and {n_offpeak} off-peak blocks overlap: there are only {len(rows)}", stacklevel=2)
    peak, off = ([r for r in rows if r[k]] for k in ("is_peak", "is_offpeak"))
    if peak and off and not max(r[col] for r in off) > min(r[col] for r in peak):
        warnings.warn("all blocks have one and the same speed: there is no peak", stacklevel=2)
    bare = lambda rs: [{k: v for k, v in r.items() if k not in ("rank", "is_peak", "is_offpeak")} for r in rs]
    return {"speed_column": col, "peak": bare(peak), "off_peak": bare(off), "ranked": [{k: r[k] for k in ("block_label", col, "n")} for r in rows]}


def hour_windows(hourly: DataFrame, width: int) -> DataFrame:
    """For each start hour the mean of the observed hours of a window of ``width`` hours around the clock. hourly: hour, speed."""
    spark = hourly.sparkSession
    starts = spark.range(24).select(F.col("id").cast("int").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("k"))
    return starts.withColumn("hour", (F.col("start") + F.col("k")) % 24).join(F.broadcast(hourly), "hour").groupBy("start").agg(F.avg("speed").alias("score"))


@dataclass(frozen=True)
class HourClasses:
    peak_hours: list[int]
    offpeak_hours: list[int]
    source: str
    threshold_speed_mps: float | None = None
    peak_speed_mps: float | None = None
    offpeak_speed_mps: float | None = None


def classify_hours(obs: DataFrame, *, statistic: str = "median", peak_hours=None, offpeak_hours=None, n_peak: int | None = None, n_offpeak: int | None = None, min_samples: int = 1, days=None, require_quality: bool = False) -> HourClasses:
    """Peak and off-peak hours: as given, or the slowest and the fastest disjoint windows, or split at the median hour."""
    if peak_hours is not None or offpeak_hours is not None:
        whole = set(range(24))
        peak = valid_hours(peak_hours, "peak_hours") if peak_hours is not None else whole - valid_hours(offpeak_hours, "offpeak_hours")
        off = valid_hours(offpeak_hours, "offpeak_hours") if offpeak_hours is not None else whole - peak
        if both := sorted(peak & off):
            raise ValueError(f"hours {both} are in peak_hours and in offpeak_hours")
        return HourClasses(sorted(peak), sorted(off), "override")
    if (n_peak is None) != (n_offpeak is None):
        raise ValueError("n_peak and n_offpeak go together")
    if n_peak is not None and not (1 <= n_peak <= 23 and 1 <= n_offpeak <= 23 and n_peak + n_offpeak <= 24):
        raise ValueError("n_peak and n_offpeak are 1 to 23 hours each, at most 24 together")
    agg = aggregate_speeds(obs, statistic=statistic, output_unit="mps", min_samples=min_samples, days=days, require_quality=require_quality)
    hourly = {r["block_start_hour"]: r[_speed_column(statistic)] for r in agg.collect()}  # at most 24
    if not hourly:
        raise ValueError("classify_hours: no observations")
    if n_peak is not None:
        return _windows(hourly, n_peak, n_offpeak)
    order = sorted(hourly.values())
    middle = (order[(len(order) - 1) // 2] + order[len(order) // 2]) / 2
    peak, off = (sorted(h for h, v in hourly.items() if (v <= middle) is slow) for slow in (True, False))
    if not off:
        warnings.warn("every hour is at or below the median hour: no off-peak hours", stacklevel=2)
    return HourClasses(peak, off, "auto", threshold_speed_mps=middle)


def _windows(hourly: dict[int, float], n_peak: int, n_offpeak: int) -> HourClasses:
    def scored(width: int, without: set[int]):
        for start in range(24):
            hours = [(start + k) % 24 for k in range(width)]
            seen = [hourly[h] for h in hours if h in hourly]
            if seen and not without & set(hours):
                # added one by one: sum() carries the rounding error along, and windows as slow as each other would be settled otherwise than in SQL
                yield reduce(add, seen) / len(seen), start, hours

    slow, _, peak = min(scored(n_peak, set()))
    fast = min(((-s, start, s, hours) for s, start, hours in scored(n_offpeak, set(peak))), default=None)
    if fast is None:
        raise ValueError("no off-peak window apart from the peak has observations")
    return HourClasses(sorted(peak), sorted(fast[3]), "window", peak_speed_mps=slow, offpeak_speed_mps=fast[2])


def edge_speeds(df: DataFrame, statistic: str, regimes: dict[str, Column]) -> DataFrame:
    """One pass: the speed of each edge in each regime (a condition on its rows), NULL where it has none."""
    stat = F.median if statistic == "median" else F.avg
    return df.groupBy("edge_id").agg(*(stat(F.when(c, F.col("speed_mps"))).alias(r) for r, c in regimes.items()))


def _on_edges(edges: DataFrame, speeds: DataFrame, names: dict[str, str], default_speed_mps: float | None) -> DataFrame:
    """edges with obs_speed_mps<suffix>, travel_time_s<suffix> and observed<suffix> for each regime (name: suffix)."""
    fresh = [f"{c}{s}" for s in names.values() for c in ("obs_speed_mps", "travel_time_s", "observed")]
    out = edges.drop(*fresh).join(speeds, "edge_id", "left")
    for regime, suffix in names.items():
        speed = F.coalesce(F.col(regime), F.lit(default_speed_mps).cast("double"))
        out = out.withColumns({f"obs_speed_mps{suffix}": F.when(speed >= 0, speed), f"travel_time_s{suffix}": F.when(speed > 0, F.col("length_m") / speed), f"observed{suffix}": F.col(regime).isNotNull()})
    return out.drop(*names)


def assign_speeds(edges: DataFrame, obs: DataFrame, *, statistic: str = "median", default_speed_mps: float | None = None, block_hours: int = 24, target_hour: int | None = None, days=None, require_quality: bool = False) -> DataFrame:
    """edges with obs_speed_mps and travel_time_s (NULL at 0 m/s), and whether the speed was observed or is the default."""
    df = usable(obs, days=days, require_quality=require_quality, what="assign_speeds")
    if target_hour is not None:
        start = target_hour // block_hours * block_hours
        df = df.filter((F.hour("time") >= start) & (F.hour("time") < start + block_hours))
    return _on_edges(edges, edge_speeds(df, statistic, {"__speed": F.lit(True)}), {"__speed": ""}, default_speed_mps)


@dataclass(frozen=True)
class SegmentSpeeds:
    edges: DataFrame
    hours: HourClasses
    days: list[int] | None = field(default=None)

    def coverage(self) -> dict[str, int]:
        """How many edges each regime observed, and how many edges there are."""
        return self.edges.agg(F.count("*").alias("n_edges_total"), *(F.count_if(f"observed_{r}").alias(r) for r in REGIMES)).first().asDict()


def assign_segment_speeds(edges: DataFrame, obs: DataFrame, *, statistic: str = "median", peak_hours=None, offpeak_hours=None, n_peak: int | None = None, n_offpeak: int | None = None, default_speed_mps: float | None = None, min_samples: int = 1, days=None, require_quality: bool = False) -> SegmentSpeeds:
    """edges with speeds and travel times of the whole time, of the peak and of the off-peak hours; the plain columns are the first."""
    hours = classify_hours(obs, statistic=statistic, peak_hours=peak_hours, offpeak_hours=offpeak_hours, n_peak=n_peak, n_offpeak=n_offpeak, min_samples=min_samples, days=days, require_quality=require_quality)
    df = usable(obs, days=days, require_quality=require_quality, what="assign_segment_speeds")
    hour = F.hour("time")
    speeds = edge_speeds(df, statistic, {"__overall": F.lit(True), "__peak": hour.isin(hours.peak_hours), "__offpeak": hour.isin(hours.offpeak_hours)})
    out = _on_edges(edges, speeds, {f"__{r}": f"_{r}" for r in REGIMES}, default_speed_mps)
    out = out.withColumns({c: F.col(f"{c}_overall") for c in ("obs_speed_mps", "travel_time_s")})
    chosen = resolve_days(days)
    return SegmentSpeeds(out, hours, sorted(chosen) if chosen is not None else None)


def by_day_type(obs: DataFrame, groups: dict | None = None) -> DataFrame:
    """Each observation once for each group of days it falls in, with the group's label as ``day_type``."""
    groups = {"weekday": "weekday", "weekend": "weekend"} if groups is None else groups
    if not groups:
        raise ValueError("groups has no day type")
    day = F.weekday("time")
    labels = []
    for label, days in groups.items():
        chosen = resolve_days(days)
        labels.append(F.lit(label) if chosen is None else F.when(day.isin(*sorted(chosen)), F.lit(label)))
    return obs.withColumn("day_type", F.explode(F.array_compact(F.array(*labels))))


@dataclass(frozen=True)
class DayTypes:
    """hourly: statistics by day type and block. overall: one row for each day type. comparison: a column of speeds for each day type."""

    labels: list[str]
    hourly: DataFrame
    overall: DataFrame
    ranked: DataFrame
    comparison: DataFrame


def day_type_report(obs: DataFrame, *, statistic: str = "median", output_unit="mph", block_hours: int = 1, groups: dict | None = None, n_peak: int = 1, n_offpeak: int = 1, min_samples: int = 1, weight_by_variance: bool = False, require_quality: bool = False) -> DayTypes:
    """Speeds by day type; with two types also the second less the first, and that in per cent of the first.

    The overall speeds keep blocks below ``min_samples``; a type without observations has n = 0.
    """
    if statistic not in ("mean", "median"):
        raise ValueError("statistic is 'mean' or 'median'")
    groups = {"weekday": "weekday", "weekend": "weekend"} if groups is None else groups
    col, labels = _speed_column(statistic), list(groups)
    df = usable(obs, require_quality=require_quality, what="day_type_report")
    if "interval_id" in df.columns:
        df = one_per_interval(df, "day_type_report")
    df = by_day_type(df, groups)
    common = {"statistic": statistic, "output_unit": output_unit, "dedup_intervals": False, "weight_by_variance": weight_by_variance, "keys": ("day_type",)}
    hourly = aggregate_speeds(df, block_hours=block_hours, min_samples=min_samples, **common)
    whole = aggregate_speeds(df, block_hours=24, **common).select("day_type", "n", F.col(col).alias("overall_speed"))
    names = df.sparkSession.createDataFrame([(x,) for x in labels], "day_type string")
    overall = names.join(F.broadcast(whole), "day_type", "left").fillna(0, ["n"])
    comparison = hourly.groupBy("block_start_hour", "block_label").pivot("day_type", labels).agg(F.first(col))
    comparison = comparison.withColumnsRenamed({x: f"{x}_speed" for x in labels})
    if len(labels) == 2:
        first, second = (F.col(f"`{x}_speed`") for x in labels)
        comparison = comparison.withColumn("delta_speed", second - first).withColumn("delta_pct", F.try_divide(100.0 * F.col("delta_speed"), first))
    return DayTypes(labels, hourly, overall, rank_blocks(hourly, statistic=statistic, n_peak=n_peak, n_offpeak=n_offpeak, keys=("day_type",)), comparison)


@dataclass(frozen=True)
class Congestion:
    edges: DataFrame
    unit: str
    statistic: str

    def summary(self) -> DataFrame:
        ratio = F.col("ratio")
        return self.edges.agg(
            F.count("*").alias("n_rows"), F.count_distinct("edge_id").alias("n_edges_observed"), F.count_distinct(F.when(ratio.isNotNull(), F.col("edge_id"))).alias("n_edges_rated"),
            F.median(ratio).alias("median_ratio"), F.avg(ratio).alias("mean_ratio"),
        )


def congestion_report(edges: DataFrame, obs: DataFrame, *, statistic: str = "median", output_unit="mph", block_hours: int | None = None, days=None, min_samples: int = 1, require_quality: bool = False, weight_by_variance: bool = False) -> Congestion:
    """Observed speed over the posted limit (``maxspeed_mps`` of edges), not clipped; NULL without a usable limit."""
    if statistic not in ("mean", "median"):
        raise ValueError("statistic is 'mean' or 'median'")
    unit = SpeedUnit.parse(output_unit)
    agg = aggregate_speeds(obs, by_edge=True, statistic=statistic, output_unit=unit, block_hours=block_hours or 24, days=days, min_samples=min_samples, require_quality=require_quality, weight_by_variance=weight_by_variance)
    keep = ["edge_id", *(["block_start_hour", "block_label"] if block_hours else [])]
    limits = edges.select("edge_id", from_mps(usable_speed(F.col("maxspeed_mps").cast("double")), unit).alias("speed_limit"))
    out = agg.select(*keep, F.col(_speed_column(statistic)).alias("observed_speed"), "n").join(limits, "edge_id", "left")
    return Congestion(out.withColumn("ratio", F.col("observed_speed") / F.col("speed_limit")), unit.value, statistic)
