from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from roadflow.operators.network import Network
from roadflow.plans import adapters, study
from roadflow.sources import networks, points
from roadflow.streaming.live import live_speeds


def test_points_from_csv(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("UID,Longitude,lat,timestamp,speed_kph,accuracy,point_id\na,1.0,2.0,2026-06-01T08:00:00Z,36,5,x\n,1,2,2026-06-01 08:00:00,1,,y\nb,oops,2,2026-06-01 08:00:00,1,,z\nb,1,95,2026-06-01 08:00:00,1,,q\nb,1.5,2.5,2026-06-01 08:00:05,18,7,w\n")
    got = points.load_points(spark, str(path)).orderBy("point_id").collect()
    assert [(r["point_id"], r["traj_id"], r["lon"], r["speed_mps"], r["accuracy"], r["point_id_src"]) for r in got] == [(0, "a", 1.0, pytest.approx(10.0), "5", "x"), (1, "b", 1.5, pytest.approx(5.0), "7", "w")]
    with pytest.warns(UserWarning):
        assert points.load_points(spark, str(path), speed_unit="mps", keep_cols=["accuracy", "nope"]).columns == ["point_id", "traj_id", "lon", "lat", "time", "speed_mps", "accuracy"]
    out = str(tmp_path / "saved")
    points.save_points(points.load_points(spark, str(path)), out)
    assert set(spark.read.csv(out, header=True).columns) >= {"lon", "lat", "time", "speed_mps", "speed_mph"}
    with pytest.raises(ValueError):
        points.points_from(spark.createDataFrame([(1,)], "a int"))


def test_points_from_geojson(spark, tmp_path):
    path = tmp_path / "p.geojson"
    feature = lambda x, t: {"type": "Feature", "geometry": {"type": "Point", "coordinates": [x, 0.0]}, "properties": {"id": "m", "time": t}}
    shape = {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}, "properties": {}}
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [feature(0.0, "2026-06-01T08:00:00"), shape, feature(0.001, "2026-06-01T08:00:10")]}))
    got = points.load_points(spark, str(path), derive_speed=True).orderBy("point_id").collect()
    assert [r["speed_mps"] for r in got] == pytest.approx([11.1319, 11.1319], rel=1e-4)


def test_networks(spark, tmp_path):
    path = tmp_path / "n.geojson"
    shapes = [{"type": "LineString", "coordinates": [[0, 0], [0.001, 0]]}, {"type": "MultiLineString", "coordinates": [[[0, 0], [0, 0.001]], [[0.001, 0], [0.001, 0.001]]]}, {"type": "Point", "coordinates": [0, 0]}, {"type": "LineString", "coordinates": [[0, 0]]}]
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": g, "properties": {"name": f"r{i}", "lanes": 2}} for i, g in enumerate(shapes)]}))
    net = Network.from_geojson(spark, str(path))
    assert net.edges.count() == 6 and net.edges.orderBy("edge_id").first()["props"] == {"name": "r0", "lanes": "2"}
    way = {"type": "way", "id": 7, "geometry": [{"lat": 0, "lon": 0}, {"lat": 0, "lon": 0.001}], "tags": {"highway": "primary", "maxspeed": "50"}}
    over = tmp_path / "o.json"
    over.write_text(json.dumps({"elements": [way, {"type": "node", "id": 1}, {**way, "id": 8, "geometry": way["geometry"][:1]}]}))
    edge = Network.from_overpass_json(spark, str(over)).edges.first()
    assert edge["props"]["osm_id"] == "7" and edge["maxspeed_mps"] == pytest.approx(50 / 3.6)
    assert "(38.0,-77.0,39.0,-76.0)" in networks.build_query((-77, 38, -76, 39))
    with pytest.raises(ValueError):
        networks.build_query((1, 0, 0, 1))


def test_whole_study(spark, sf_dir):
    net, fixes = adapters.network(spark), adapters.fixes(spark, sf_dir)
    s = study.speed_study(net, fixes)
    assert s.hourly.count() > 0 and s.by_edge.count() > 100 and s.structure["n_edges"] == 528
    assert s.network.edges.filter("obs_speed_mps IS NOT NULL").count() > 100
    movers, kept = study.screen_movers(net, fixes, threshold=5.0, min_baseline_m=50.0)
    assert movers.count() > 0 and kept.count() <= fixes.count()


def test_stream(spark, sf_dir, tmp_path):
    obs = adapters.observations(spark, sf_dir).withColumn("time", F.col("time").cast("timestamp"))
    obs.select("time", "speed_mps", "edge_id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("time timestamp, speed_mps double, edge_id long").parquet(str(tmp_path / "in"))
    q = live_speeds(stream, by_edge=False).writeStream.format("memory").queryName("live").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("live").agg(F.sum("n")).first()[0] == obs.filter("edge_id <> -1 AND speed_mps IS NOT NULL").count()


def test_what_is_left_out_is_told(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text(
        "uid,lon,lat,time,speed_mps\na,1,2,2026-06-01T08:00:00Z,10\n,1,2,2026-06-01 08:00:00,1\na,oops,2,2026-06-01 08:00:00,1\na,1,95,2026-06-01 08:00:00,1\na,1,2,later,1\na,1,2,2026-06-01 08:00:05,\na,1,2,2026-06-01 08:00:06,500\nb,1,2,2026-06-01 08:00:07,3\n"
    )
    fixes = points.load_points(spark, str(path))
    assert fixes.count() == 3
    with pytest.warns(UserWarning) as said:
        counts = points.report_of(fixes).warn()
    assert counts == {"n_aware_without_tz": 1, "n_naive": 0, "n_without_id": 1, "n_without_lon": 1, "n_without_lat": 0, "n_without_time": 1, "n_without_speed_mps": 1, "n_off_globe": 1, "n_implausible": 1}
    assert len(said) == 7 and any("no uid" in str(w.message) for w in said)
    mixed = points.load_points(spark, str(path), tz="America/New_York")
    mixed.collect()
    assert points.report_of(mixed).counts["n_naive"] == 7 and "n_aware_without_tz" not in points.report_of(mixed).counts
    assert points.lone_fixes(fixes).first().asDict() == {"n_trajectories": 2, "n_lone": 1}


def test_network_tells_what_it_leaves_out(spark):
    at = lambda *p: [{"lon": x, "lat": y} for x, y in p]
    rows = [(0, at((0.0, 0.0), (0.001, 0.0)), {}), (1, at((0.0, 0.0), (0.001, 0.001), (0.0, 0.0)), {}), (2, at((5.0, 5.0)), {})]
    from roadflow.operators.network import RECORDS

    net = Network.from_records(spark.createDataFrame(rows, RECORDS))
    assert net.edges.count() == 2
    with pytest.warns(UserWarning, match="end where they start"):
        assert net.report.warn() == {"n_without_line": 1, "n_loops": 1}


def test_features_by_line(spark, tmp_path):
    path = tmp_path / "n.geojson"
    feature = lambda x: json.dumps({"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[x, 0], [x + 0.001, 0]]}, "properties": {"name": f"r{x}"}})
    path.write_text('{"type": "FeatureCollection", "features": [\n' + ",\n".join(feature(0.001 * i) for i in range(5)) + "\n]}\n")
    assert Network.from_geojson(spark, str(path), by_line=True).edges.count() == Network.from_geojson(spark, str(path)).edges.count() == 10
    fix = lambda i: json.dumps({"type": "Feature", "geometry": {"type": "Point", "coordinates": [i * 0.001, 0]}, "properties": {"id": "m", "time": f"2026-06-01T08:00:{i:02d}"}})
    path = tmp_path / "p.geojson"
    path.write_text("\n".join(fix(i) for i in range(7)))
    assert [r["point_id"] for r in points.load_points(spark, str(path), by_line=True).orderBy("lon").collect()] == list(range(7))


def test_commands(spark, sf_dir, tmp_path, capsys):
    line = lambda r: {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[p["lon"], p["lat"]] for p in r["coords"]]}, "properties": r["props"]}
    (tmp_path / "n.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [line(r.asDict(True)) for r in adapters.road_records(spark).orderBy("record_no").collect()]}))
    adapters.fixes(spark, sf_dir).select("traj_id", "lon", "lat", "time").write.csv(str(tmp_path / "p.csv"), header=True)
    files = [str(tmp_path / "n.geojson"), str(tmp_path / "p.csv")]
    study.main(["screen", *files, "--threshold", "5", "--baseline", "50", "--out-movers", str(tmp_path / "movers"), "--out-points", str(tmp_path / "kept")])
    said = capsys.readouterr().out
    assert "suggested threshold" in said and "vehicle" in said and spark.read.csv(str(tmp_path / "movers"), header=True).count() > 0
    study.main(["study", *files, str(tmp_path / "out"), "--choke-points", "3"])
    for name in ("hourly", "by_edge", "congestion", "peaks", "day_types", "day_type_hours", "choke_points", "structure"):
        assert spark.read.csv(str(tmp_path / "out" / name), header=True).count() > 0, name
    tables = study.report_tables(adapters.network(spark), adapters.fixes(spark, sf_dir), top=3)
    head = tables["headline"].first()
    assert head["n_fixes"] == 1000 and head["n_edges"] == 528 and tables["slowest"].count() == 3
