"""Whole studies, as a sequence of operators: files in, tables out. ``python -m roadflow.plans.study --help``."""

from __future__ import annotations

import argparse
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadflow.functions.units import SpeedUnit, from_mps
from roadflow.operators import aggregate, analysis, cleaning, matching, modes, speeds
from roadflow.operators.network import Network
from roadflow.session import written
from roadflow.sources import export, points


@dataclass(frozen=True)
class Study:
    observations: DataFrame
    hourly: DataFrame
    by_edge: DataFrame
    congestion: DataFrame
    network: Network
    structure: dict


def speed_study(network: Network, fixes: DataFrame, *, derive: bool = True, min_baseline_m: float | None = None, mode_threshold=None, unit="mph", require_quality: bool = False, max_dist: float = 50.0) -> Study:
    """Match, derive and clean speeds, aggregate them by hour and edge, rate them against limits, and write them on the network.

    derive: speeds from the way along roads; otherwise the fixes' own, without dwells. mode_threshold: keep vehicles only (a speed, or "auto").
    """
    has_traj = "traj_id" in fixes.columns
    matched = matching.hmm_match(network, fixes, max_dist=max_dist) if has_traj else matching.nearest_match(network, fixes, max_dist=max_dist)
    if derive and has_traj:
        obs = speeds.derive_speeds(network, matched, fixes, min_baseline_m=min_baseline_m).edge_observations
    else:
        obs = cleaning.filter_trajectory_speed(matched) if has_traj else matched
    if mode_threshold is not None:
        obs = modes.filter_by_mode(obs, modes.classify_movers(obs, threshold=mode_threshold, unit=unit))
    obs = cleaning.filter_by_speed(obs, mad_outliers=True, per_edge=True)
    done = aggregate.assign_segment_speeds(network.edges, obs, require_quality=require_quality)
    annotated = network.with_edges(done.edges)
    return Study(
        obs,
        aggregate.aggregate_speeds(obs, statistic="both", output_unit=unit, require_quality=require_quality),
        aggregate.aggregate_speeds(obs, statistic="both", output_unit=unit, by_edge=True, require_quality=require_quality),
        aggregate.congestion_report(network.edges, obs, output_unit=unit, require_quality=require_quality).edges,
        annotated,
        analysis.network_stats(network),
    )


def peaks(study: Study, *, statistic: str = "median", n_peak: int = 3, n_offpeak: int = 3) -> DataFrame:
    """The blocks of hours by speed, slowest first, each marked peak and off-peak or not."""
    return aggregate.rank_blocks(study.hourly, statistic=statistic, n_peak=n_peak, n_offpeak=n_offpeak)


def choke_points(network: Network, *, top: int = 5, weight: str | None = "length_m", k: int | None = None) -> DataFrame:
    """The ``top`` roads by betweenness: road_id, name, betweenness. A road's two directions count once, with the larger score."""
    score = analysis.edge_betweenness_centrality(network, weight=weight, k=k)
    named = network.edges.select("edge_id", "road_id", F.try_element_at("props", F.lit("name")).alias("name"))
    roads = score.join(named, "edge_id").groupBy("road_id").agg(F.max("betweenness").alias("betweenness"), F.min_by("name", "edge_id").alias("name"))
    return roads.select("road_id", "name", "betweenness").orderBy(F.desc("betweenness"), "road_id").limit(top)


def report_tables(network: Network, fixes: DataFrame, *, unit="mph", top: int = 10, min_samples: int = 5, **options) -> dict[str, DataFrame]:
    """The tables of a report on a study: headline, hourly, day_types, day_type_hours, slowest, fastest, congestion, movers.

    headline: fixes, matched fixes, movers, lone ones, intervals, those of good quality, edges observed and in all, in one row. slowest and fastest:
    the ``top`` roads with ``min_samples`` observations or more.
    """
    study = speed_study(network, fixes, unit=unit, **options)
    obs = written(study.observations, "observations")
    matched = matching.nearest_match(network, fixes).agg(F.count("*").alias("n_fixes"), F.count_if(F.col("edge_id") != -1).alias("n_matched"))
    seen = obs.agg(F.count_distinct("interval_id").alias("n_intervals"), F.count_distinct(F.when(F.col("quality"), F.col("interval_id"))).alias("n_good"), F.count_distinct("edge_id").alias("n_edges_observed"))
    lone = points.lone_fixes(fixes)
    rows = {k: v for part in (matched, lone, seen) for k, v in part.first().asDict().items()} | {"n_edges": network.counts()[0]}
    headline = network.edges.sparkSession.createDataFrame([tuple(rows.values())], ", ".join(f"{k} long" for k in rows))
    days = aggregate.day_type_report(obs, output_unit=unit)
    named = network.edges.select("edge_id", "road_id", F.try_element_at("props", F.lit("name")).alias("name"))
    roads = obs.join(named, "edge_id").groupBy("road_id").agg(F.min("name").alias("name"), F.count("*").alias("n"), from_mps(F.median("speed_mps"), SpeedUnit.parse(unit)).alias("median_speed")).filter(F.col("n") >= min_samples)
    return {
        "headline": headline, "hourly": study.hourly, "day_types": days.overall, "day_type_hours": days.comparison, "slowest": roads.orderBy("median_speed", "road_id").limit(top), "fastest": roads.orderBy(F.desc("median_speed"), "road_id").limit(top),
        "congestion": study.congestion, "movers": modes.mover_features(obs.dropDuplicates(["interval_id"]), unit=unit),
    }


def screen_movers(network: Network, fixes: DataFrame, *, threshold="auto", min_baseline_m: float = 150.0, unit="mph", keep=(modes.VEHICLE,)) -> tuple[DataFrame, DataFrame]:
    """Movers with their classes, and the fixes of those that are kept."""
    obs = speeds.derive_speeds(network, matching.hmm_match(network, fixes), fixes, min_baseline_m=min_baseline_m).intervals
    movers = modes.classify_movers(obs, threshold=threshold, unit=unit)
    return movers, modes.filter_by_mode(fixes, movers, keep=keep)


def _session() -> SparkSession:
    return SparkSession.builder.appName("roadflow").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _fixes(spark: SparkSession, a: argparse.Namespace, **more) -> DataFrame:
    return points.load_points(spark, a.points, tz=a.tz, id_col=a.id_col, time_col=a.time_col, lon_col=a.lon_col, lat_col=a.lat_col, **more)


def run_study(a: argparse.Namespace) -> None:
    spark = _session()
    net = Network.from_geojson(spark, a.network)
    fixes = _fixes(spark, a, speed_unit=a.speed_unit)
    threshold = a.mode_threshold if a.mode_threshold in (None, "auto") else float(a.mode_threshold)
    study = speed_study(net, fixes, min_baseline_m=a.baseline, mode_threshold=threshold, unit=a.unit)
    days = aggregate.day_type_report(study.observations, output_unit=a.unit)
    tables = {"hourly": study.hourly, "by_edge": study.by_edge, "congestion": study.congestion, "peaks": peaks(study), "day_types": days.overall, "day_type_hours": days.comparison}
    if a.choke_points:
        tables["choke_points"] = choke_points(net, top=a.choke_points)
    for name, table in tables.items():
        table.write.mode("overwrite").csv(f"{a.out}/{name}", header=True)
    export.to_geojson(study.network, f"{a.out}/map", speed_unit=a.unit)
    connected = analysis.connectivity_report(net).summary
    rows = [(k, json.dumps(v)) for k, v in {**study.structure, **connected}.items()]
    spark.createDataFrame(rows, "name string, value string").write.mode("overwrite").csv(f"{a.out}/structure", header=True)
    points.report_of(fixes).warn()
    net.report.warn()


def run_report(a: argparse.Namespace) -> None:
    spark = _session()
    net = Network.from_geojson(spark, a.network)
    for name, table in report_tables(net, _fixes(spark, a), unit=a.unit, min_baseline_m=a.baseline).items():
        table.write.mode("overwrite").csv(f"{a.out}/{name}", header=True)


def run_screen(a: argparse.Namespace) -> None:
    """Without a threshold a diagnosis alone: the features of movers, and the threshold that their speeds suggest."""
    spark = _session()
    net, fixes = Network.from_geojson(spark, a.network), _fixes(spark, a)
    if "traj_id" not in fixes.columns:
        raise SystemExit("movers are told apart by an id: pass --id-col")
    accuracy = a.accuracy_col if a.accuracy_col in fixes.columns else None
    obs = written(speeds.derive_speeds(net, matching.hmm_match(net, fixes, max_dist=a.max_dist), fixes, pos_accuracy_col=accuracy, min_baseline_m=a.baseline).intervals, "intervals")
    if obs.isEmpty():
        raise SystemExit("no interval could be derived: check --id-col")
    features = modes.mover_features(obs, percentile=a.percentile, unit=a.unit)
    suggested = modes.suggest_mode_threshold(features, modes.percentile_column(a.percentile, a.unit), unit=a.unit)
    print(f"suggested threshold: {f'{suggested:.1f} {a.unit}' if suggested is not None else 'none, the speeds show no second population'}")
    movers = features
    if a.threshold is not None:
        movers = modes.classify_movers(obs, threshold=a.threshold if a.threshold == "auto" else float(a.threshold), percentile=a.percentile, min_intervals=a.min_intervals, unit=a.unit)
        keep = (modes.VEHICLE, modes.UNKNOWN) if a.keep_unclassified else (modes.VEHICLE,)
        for row in movers.groupBy("mode").count().orderBy("mode").collect():
            print(f"{row['mode']}: {row['count']}")
        if a.out_points:
            points.save_points(modes.filter_by_mode(fixes, movers, keep=keep), a.out_points)
    if a.out_movers:
        movers.write.mode("overwrite").csv(a.out_movers, header=True)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Speeds by hour and road from a network and GPS fixes.")
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, text: str) -> argparse.ArgumentParser:
        c = commands.add_parser(name, help=text)
        c.set_defaults(run=run)
        c.add_argument("network", help="GeoJSON of lines")
        c.add_argument("points", help="CSV, TSV or GeoJSON of fixes")
        c.add_argument("--unit", default="mph", choices=["mph", "kph", "mps"])
        c.add_argument("--tz", help="time zone of the study area")
        for what in ("id", "time", "lon", "lat"):
            c.add_argument(f"--{what}-col")
        c.add_argument("--baseline", type=float, default=150.0 if name == "screen" else None, help="least metres of an interval")
        return c

    c = command("study", run_study, "tables by hour and road, congestion, peaks, day types, structure, choke points, and a map")
    c.add_argument("out", help="folder for the tables")
    c.add_argument("--speed-unit", help="unit of the speed column")
    c.add_argument("--mode-threshold", help="a speed, or auto: keep vehicles only")
    c.add_argument("--choke-points", type=int, default=5, help="how many roads to list; 0: none")
    c = command("report", run_report, "the tables of a report")
    c.add_argument("out", help="folder for the tables")
    c = command("screen", run_screen, "vehicles and pedestrians")
    c.add_argument("--accuracy-col", default="accuracy")
    c.add_argument("--max-dist", type=float, default=50.0)
    c.add_argument("--percentile", type=float, default=85.0)
    c.add_argument("--threshold", help="a speed, or auto; without one nothing is left out")
    c.add_argument("--min-intervals", type=int, default=3)
    c.add_argument("--keep-unclassified", action="store_true")
    c.add_argument("--out-points", help="fixes of the movers that stay")
    c.add_argument("--out-movers", help="features and classes of movers")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(a)


if __name__ == "__main__":
    main()
