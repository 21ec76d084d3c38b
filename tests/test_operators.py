"""Traffic operators: hand-computed cases, closed forms, and brute force on small networks."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from roadflow.kernels import structure
from roadflow.operators import aggregate, analysis, cleaning, matching, modes, routing, speeds
from roadflow.operators.network import RECORDS, Network
from roadflow.sources import export

T0 = datetime(2026, 6, 1, 8)  # a Monday


def observations(spark, rows):
    return spark.createDataFrame([(T0 + timedelta(hours=h), v, e, i) for h, v, e, i in rows], "time timestamp_ntz, speed_mps double, edge_id long, interval_id long")


def line(*points, **props):
    return [{"lon": float(x), "lat": float(y)} for x, y in points], {k: str(v) for k, v in props.items()}


def network(spark, *roads, **options):
    return Network.from_records(spark.createDataFrame([(i, c, p) for i, (c, p) in enumerate(roads)], RECORDS), **options)


def grid(n, step=0.001):
    at = lambda i, j: (step * i, step * j)
    return [line(at(i, j), at(i + 1, j)) for j in range(n) for i in range(n - 1)] + [line(at(i, j), at(i, j + 1)) for j in range(n - 1) for i in range(n)]


def test_mean_of_blocks(spark):
    obs = observations(spark, [(0, 10.0, 1, 1), (0, 20.0, 1, 2), (1, 5.0, 2, 3), (1, None, 2, 4), (1, float("nan"), 2, 5), (0, 99.0, -1, 6), (0, 20.0, 2, 2)])
    got = {r["block_start_hour"]: r for r in aggregate.aggregate_speeds(obs, output_unit="mps").collect()}
    assert got[8]["n"] == 2 and got[8]["mean_speed"] == 15 and got[8]["std_speed"] == pytest.approx(50**0.5) and got[8]["block_label"] == "08:00-09:00"
    assert got[9]["n"] == 1 and got[9]["std_speed"] is None and got[9]["ci95_low"] is None
    assert aggregate.aggregate_speeds(obs, by_edge=True).count() == 3 and aggregate.aggregate_speeds(obs, min_samples=2).count() == 1
    with pytest.warns(UserWarning):
        assert aggregate.aggregate_speeds(obs, block_hours=7).filter("block_start_hour = 7").first()["block_label"] == "07:00-14:00"


def test_colliding_intervals_fail(spark):
    obs = observations(spark, [(0, 10.0, 1, 1), (0, 20.0, 1, 1)])
    with pytest.raises(PySparkException, match="names more than one measurement"):
        aggregate.aggregate_speeds(obs).collect()
    assert aggregate.aggregate_speeds(obs, dedup_intervals=False).first()["n"] == 2


def test_hours(spark):
    obs = observations(spark, [(h, float(v), 1, h) for h, v in enumerate([10, 4, 6, 20, 22, 8])])
    c = aggregate.classify_hours(obs, n_peak=2, n_offpeak=2)
    assert (c.peak_hours, c.offpeak_hours, c.peak_speed_mps) == ([8, 9], [11, 12], 5.0) or (c.peak_hours, c.peak_speed_mps) == ([9, 10], 5.0)
    auto = aggregate.classify_hours(obs)
    assert auto.threshold_speed_mps == 9.0 and auto.peak_hours == [9, 10, 13] and auto.offpeak_hours == [8, 11, 12]
    assert aggregate.classify_hours(obs, peak_hours=[7]).offpeak_hours == [h for h in range(24) if h != 7]
    for bad in ({"peak_hours": [1], "offpeak_hours": [1]}, {"n_peak": 3}, {"n_peak": 20, "n_offpeak": 5}):
        with pytest.raises(ValueError):
            aggregate.classify_hours(obs, **bad)
    peaks = aggregate.peak_analysis(aggregate.aggregate_speeds(obs, output_unit="mps"))
    assert peaks["peak"][0]["block_start_hour"] == 9 and peaks["off_peak"][0]["mean_speed"] == 22
    with pytest.raises(ValueError):
        aggregate.peak_analysis(aggregate.aggregate_speeds(obs.limit(0)))


def test_speeds_on_edges(spark):
    net = network(spark, *grid(2))
    obs = observations(spark, [(0, 0.0, 0, 1), (0, 10.0, 1, 2), (4, 20.0, 1, 3)])
    got = {r["edge_id"]: r for r in aggregate.assign_speeds(net.edges, obs, default_speed_mps=5.0).collect()}
    assert got[0]["obs_speed_mps"] == 0 and got[0]["travel_time_s"] is None and got[0]["observed"]
    assert got[1]["obs_speed_mps"] == 15 and got[2]["obs_speed_mps"] == 5 and not got[2]["observed"]
    done = aggregate.assign_segment_speeds(net.edges, obs, peak_hours=[8], offpeak_hours=[12])
    assert done.coverage() == {"n_edges_total": 8, "overall": 2, "peak": 2, "offpeak": 1}
    report = aggregate.day_type_report(obs)
    overall = {r["day_type"]: r for r in report.overall.collect()}
    assert overall["weekend"]["n"] == 0 and overall["weekend"]["overall_speed"] is None and overall["weekday"]["n"] == 3
    assert report.comparison.filter("weekend_speed IS NOT NULL").count() == 0


def test_congestion_is_not_clipped(spark):
    net = network(spark, line((0, 0), (0.001, 0), maxspeed="36"), line((0, 0.001), (0.001, 0.001)))
    edges = {r["edge_id"]: r for r in aggregate.congestion_report(net.edges, observations(spark, [(0, 20.0, 0, 1), (0, 5.0, 2, 2)]), output_unit="mps").edges.collect()}
    assert edges[0]["ratio"] == pytest.approx(2.0) and edges[2]["ratio"] is None


def test_outliers(spark):
    values = [10.0, 10.5, 9.5, 10.2, 9.8, 100.0]
    obs = observations(spark, [(0, v, 1, i) for i, v in enumerate(values)] + [(0, 7.0, 2, 9), (0, 7.0, 2, 10), (0, None, 2, 11)])
    kept = cleaning.filter_by_speed(obs, mad_outliers=True, per_edge=True)
    assert sorted(r["speed_mps"] for r in kept.collect()) == sorted([*values[:-1], 7.0, 7.0])
    assert cleaning.filter_by_speed(obs, max_speed=10.0, unit="mps").count() == 5 and cleaning.filter_by_speed(obs).count() == 9


def test_dwells(spark):
    rows = [("a", T0 + timedelta(seconds=30 * i), 0.0 if 3 <= i < 10 else 0.001 * i, 0.0, 1.0) for i in range(14)]
    rows += [("b", T0 + timedelta(seconds=30 * i), None if i == 5 else 0.0, 0.0, 1.0) for i in range(8)]
    df = spark.createDataFrame(rows, "traj_id string, time timestamp_ntz, lon double, lat double, speed_mps double")
    left = cleaning.filter_trajectory_speed(df)
    assert left.filter("traj_id = 'a'").count() == 7
    assert left.filter("traj_id = 'b'").count() == 3  # five fixes before the gap are a dwell, two after it are too short


def test_modes(spark):
    rng = np.random.default_rng(0)
    rows = [(f"m{m}", float(v), 10.0 * m + k, 100.0) for m in range(60) for k, v in enumerate(np.abs(rng.normal(1.3 if m < 20 else 12.0, 0.3 if m < 20 else 2.5, 8)))] + [(None, 9.0, -1.0, 1.0)]
    obs = spark.createDataFrame(rows, "traj_id string, speed_mps double, interval_id double, distance_m double")
    movers = modes.classify_movers(obs, threshold="auto", unit="mps")
    counts = {r["mode"]: r["count"] for r in movers.groupBy("mode").count().collect()}
    assert counts == {"pedestrian": 20, "vehicle": 40, "unknown": 1}
    assert modes.filter_by_mode(obs, movers, keep=("unknown",)).count() == 1 and modes.filter_by_mode(obs, movers).count() == 320
    fast = obs.filter("traj_id > 'm2'").filter("speed_mps > 5")
    with pytest.raises(ValueError):
        modes.classify_movers(fast, threshold="auto", unit="mps")
    assert modes.suggest_mode_threshold(spark.createDataFrame([(3.0,)] * 40, "v double"), "v") is None


def test_network_rules(spark):
    net = network(spark, line((0, 0), (0.001, 0), oneway="yes"), line((0, 0), (0.001, 0), oneway="-1", length_m="7"), line((0, 0), (0, 0.001), (0.001, 0.001)), line((0, 0), (0.001, 0.001), (0, 0)), line((5, 5)))
    e = {r["edge_id"]: r for r in net.edges.collect()}
    assert sorted(e) == [0, 1, 2, 3] and e[0]["reverse_id"] is None and (e[1]["u"], e[1]["v"]) == (e[0]["v"], e[0]["u"])
    assert e[1]["props"]["length_m_src"] == "7" and (e[2]["reverse_id"], e[3]["reverse_id"], e[3]["road_id"]) == (3, 2, 2)
    assert e[2]["length_m"] == pytest.approx(e[3]["length_m"]) and e[3]["xy"][0] == e[2]["xy"][-1]
    pieces = net.segments().filter("edge_id = 2").orderBy("seg_no").collect()
    assert all(math.hypot(p["x1"] - p["x0"], p["y1"] - p["y0"]) <= 25.001 for p in pieces)
    assert net.counts() == (4, 3) and net.edge(2)["road_id"] == 2 and {r[0] for r in net.road_edge_ids(3).collect()} == {2, 3}
    with pytest.raises(KeyError):
        net.edge(99)
    assert pieces[-1]["arc0"] < e[2]["length_m"] and net.edges_between(e[0]["u"], e[0]["v"]).count() == 2
    with pytest.raises(ValueError):
        network(spark, line((5, 5)))


def brute_nearest(net, x, y, reach):
    best = (math.inf, None)
    for e in net.edges.collect():
        for a, b in zip(e["xy"], e["xy"][1:]):
            dx, dy = b["x"] - a["x"], b["y"] - a["y"]
            t = min(1, max(0, ((x - a["x"]) * dx + (y - a["y"]) * dy) / (dx * dx + dy * dy)))
            best = min(best, (round(math.hypot(x - a["x"] - t * dx, y - a["y"] - t * dy), 6), e["road_id"]))
    return best if best[0] <= reach else (None, -1)


def test_matching(spark):
    net = network(spark, *grid(4))
    rng = np.random.default_rng(3)
    rows = [(i, f"t{i % 3}", float(rng.uniform(-0.0008, 0.0038)), float(rng.uniform(-0.0008, 0.0038)), T0 + timedelta(seconds=i)) for i in range(80)]
    points = spark.createDataFrame(rows, "point_id long, traj_id string, lon double, lat double, time timestamp_ntz")
    from roadflow.kernels.geodesy import utm

    roads = {r["edge_id"]: r["road_id"] for r in net.edges.collect()} | {-1: -1}
    edges = net.edges.collect()
    net_like = type("N", (), {"edges": type("E", (), {"collect": staticmethod(lambda: edges)})})
    for fn in (matching.nearest_match, matching.nearest_match_join):
        got = {r["point_id"]: r for r in fn(net, points).collect()}
        for i, _, lon, lat, _ in rows:
            x, y = utm(lon, lat, net.zone, net.north)
            far, road = brute_nearest(net_like, float(x), float(y), 50)
            assert roads[got[i]["edge_id"]] == road and (got[i]["snap_dist_m"] is None if far is None else abs(got[i]["snap_dist_m"] - far) < 1e-5)
    one = matching.hmm_match(net, points).orderBy("point_id").collect()
    assert one == matching.hmm_match(net, points.repartition(7)).orderBy("point_id").collect() and {r["edge_id"] >= 0 for r in one} == {True, False}
    with pytest.raises(ValueError):
        matching.hmm_match(net, points.drop("traj_id"))


def drive(spark, path, v=10.0, dt=5.0):
    metres = 111319.49
    return spark.createDataFrame([(k, "car", x / metres, y / metres, T0 + timedelta(seconds=dt * k)) for k, (x, y) in enumerate(path(v * dt))], "point_id long, traj_id string, lon double, lat double, time timestamp_ntz")


def test_derived_speed_of_a_straight_drive(spark):
    net = network(spark, line((0, 0), (0.01, 0)))
    points = drive(spark, lambda d: [(d * k, 0) for k in range(20)])
    got = speeds.derive_speeds(net, matching.hmm_match(net, points), default_pos_sigma_m=2.0, dense_ids=True, interval_id_start=100)
    rows = got.intervals.orderBy("interval_id").collect()
    assert [r["interval_id"] for r in rows] == list(range(100, 119)) and all(r["speed_mps"] == pytest.approx(10, rel=2e-3) and r["quality"] for r in rows)
    assert all(r["n_edges"] == 2 and r["time"] == r["t_from"] + timedelta(seconds=2.5) for r in rows) and got.edge_observations.count() == 38
    merged = speeds.derive_speeds(net, matching.hmm_match(net, points), min_baseline_m=120.0).intervals.orderBy("t_from").collect()
    assert [round(r["distance_m"] / 50) for r in merged] == [3, 3, 3, 3, 3, 3, 1] and not merged[-1]["quality"]


def test_derived_speed_around_a_corner_and_over_a_gap(spark):
    net = network(spark, line((0, 0), (0.001, 0)), line((0.001, 0), (0.001, 0.001)))
    side = 111.3
    points = drive(spark, lambda d: [(40.0, 0), (90.0, 0), (side, 30.0), (5000.0, 5000.0), (side, 80.0), (side, 100.0)])
    rows = speeds.derive_speeds(net, matching.hmm_match(net, points)).intervals.orderBy("t_from").collect()
    assert [(r["point_id_from"], r["point_id_to"]) for r in rows] == [(0, 1), (1, 2), (4, 5)]
    assert rows[1]["distance_m"] == pytest.approx(side - 90 + 30, abs=0.7) and rows[1]["n_edges"] == 4


def test_chord_speed(spark):
    points = drive(spark, lambda d: [(0, 0), (50, 0), (150, 0)])
    assert [r["speed_mps"] for r in speeds.chord_speeds(points).orderBy("point_id").collect()] == pytest.approx([10, 10, 20], rel=1e-6)
    tied = points.unionByName(points.limit(1))
    assert speeds.tied_fixes(tied).first()["n_tied"] == 2 and speeds.chord_speeds(tied).filter("speed_mps IS NULL").count() >= 1


def brute_betweenness(links, n, edges):
    """Shares of all shortest paths, by listing them."""
    total = np.zeros(edges)
    for s in range(n):
        for t in range(n):
            best, paths, stack = math.inf, [], [(s, 0.0, [], {s})]
            while stack and s != t:
                a, d, way, seen = stack.pop()
                if d > best:
                    continue
                if a == t:
                    if d < best:
                        best, paths = d, []
                    paths.append(way)
                    continue
                for b, (w, _) in links[a].items():
                    if b not in seen:
                        stack.append((b, d + w, [*way, (a, b)], seen | {b}))
            for way in paths:
                for a, b in way:
                    total[links[a][b][1]] += 1 / len(paths) / len(links[a][b][1])
    return total


def test_betweenness_matches_listed_paths():
    rng = np.random.default_rng(1)
    for _ in range(5):
        u, v = rng.integers(0, 7, 22), rng.integers(0, 7, 22)
        ok = u != v
        u, v = u[ok], v[ok]
        w = rng.integers(1, 4, len(u)).astype(float)
        assert structure.betweenness(u, v, w, 7, np.arange(7)) == pytest.approx(brute_betweenness(structure.cheapest(u, v, w, 7), 7, len(u)))
    zero = structure.betweenness(np.array([0, 1, 1, 2]), np.array([1, 0, 2, 1]), np.array([0.0, 0.0, 1.0, 1.0]), 3, np.arange(3))
    assert zero.tolist() == [2.0, 2.0, 2.0, 2.0]


def test_structure(spark):
    net = network(spark, *grid(3))
    stats = analysis.network_stats(net)
    assert (stats["n_nodes"], stats["n_edges"], stats["n_physical_roads"], stats["n_dead_ends"], stats["n_intersections"]) == (9, 24, 12, 0, 5)
    assert stats["circuity_avg"] == pytest.approx(1, abs=2e-3) and stats["area_km2"] == pytest.approx(0.2226**2, rel=0.02) and stats["streets_per_node_counts"] == {2: 4, 3: 4, 4: 1}
    assert analysis.network_stats(net, area_km2_=2.0)["area_method"] == "supplied" and analysis.area_km2(net, "bbox") == pytest.approx(stats["area_km2"], rel=0.01)
    b = analysis.edge_betweenness_centrality(net, weight=None, normalized=False)
    assert b.count() == 24 and b.agg(F.sum("betweenness")).first()[0] == pytest.approx(sum(abs(i - k) + abs(j - m) for i in range(3) for j in range(3) for k in range(3) for m in range(3)))
    with pytest.raises(ValueError):
        analysis.edge_betweenness_centrality(net, weight="travel_time_s")


def test_connectivity_and_routes(spark):
    one = {"oneway": "yes"}
    net = network(spark, line((0, 0), (0.001, 0), **one), line((0.001, 0), (0.001, 0.001), **one), line((0.001, 0.001), (0, 0), **one), line((0.001, 0), (0.002, 0), **one), line((0.01, 0.01), (0.011, 0.01)))
    c = analysis.connectivity_report(net)
    assert c.summary["strongly_connected_component_sizes"] == {3: 1, 2: 1, 1: 1} and c.summary["n_weakly_connected_components"] == 2 and not c.summary["is_strongly_connected"]
    assert {r["edge_id"] for r in c.edges.filter("NOT in_largest").collect()} == {3, 4, 5}
    r = routing.Router(net)
    found = r.route((0.001, 0.001), (0.001, 0.0))
    assert found["edge_ids"] == [2, 0] and found["n_edges_default"] == 2 and found["travel_time_s"] == pytest.approx(found["distance_m"] / routing.DEFAULT_SPEED_MPS)
    assert r.route((0, 0), (0.00001, 0))["n_edges"] == 0
    with pytest.raises(ValueError, match="one-way"):
        r.route((0.002, 0), (0, 0))
    with pytest.raises(ValueError, match="unconnected"):
        r.route((0, 0), (0.01, 0.01))
    with pytest.raises(ValueError):
        r.route((0, 0), (0.5, 0.5), snap=False)
    trips = spark.createDataFrame([(1, 0.001, 0.001, 0.001, 0.0), (2, 0.002, 0.0, 0.0, 0.0)], "trip_id long, o_lon double, o_lat double, d_lon double, d_lat double")
    many = {x["trip_id"]: x for x in r.route_many(trips, mode="cost", cost=F.col("length_m") * 2).collect()}
    assert many[1]["edge_ids"] == [2, 0] and many[2]["path"] is None
    assert len(r.route_geometry_lonlat(r.route_many(trips)).filter("trip_id = 1").first()["lonlat"]) == 4


def test_parallel_roads_route_on_the_cheaper(spark):
    net = network(spark, line((0, 0), (0.0005, 0.0004), (0.001, 0), maxspeed="100"), line((0, 0), (0.001, 0), maxspeed="10"))
    assert routing.Router(net).route((0, 0), (0.001, 0))["edge_ids"] == [0]
    assert routing.Router(net).route((0, 0), (0.001, 0), mode="distance")["edge_ids"] == [2]


def test_export(spark):
    net = network(spark, line((0, 0), (0.001, 0), name="Main", speed="x"))
    done = net.with_edges(aggregate.assign_speeds(net.edges, observations(spark, [(0, 10.0, 0, 1), (0, 20.0, 1, 2)])))
    row = export.speed_features(done, speed_unit="mps").first()
    assert row["speed"] == 15 and row["edge_ids"] == [0, 1] and row["travel_time_s"] == pytest.approx(row["length_m"] / 15)
    assert export.speed_features(done, directional=True).count() == 2
    assert '"speed_src":"x"' in export.to_geojson(done, keep_tags=("speed", "name")).first()["feature"]
