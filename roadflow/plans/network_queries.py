"""Registered queries on networks and trajectories, with DuckDB SQL that works each of them out by another way: recursive queries.

Networks: the grid of ``adapters.roads``, and a town that grows with the supplier table and has one-way roads in both directions, parallel
roads, loops and islands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadflow.functions import geo, units
from roadflow.kernels import geodesy as g
from roadflow.operators import aggregate, analysis, cleaning, matching, routing, speeds
from roadflow.operators.network import Network
from roadflow.plans import adapters
from roadflow.sources import export, points
from roadflow.sources.networks import read_overpass
from roadflow.session import shared_folder

DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# ------------------------------------------------------------------ the town

_TOWN = """
SELECT k, CASE WHEN k % 13 = 0 THEN m + (k {div} 13) % 9 ELSE (k*7 + k {div} 5) % m END AS a,
       CASE WHEN k % 13 = 0 THEN m + (k {div} 13 + 1 + k % 2) % 9 WHEN k % 17 = 3 THEN (k*7 + k {div} 5) % m
            ELSE ((k*7 + k {div} 5) % m + CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 12 ELSE 13 END) % m END AS b,
       CASE k % 5 WHEN 0 THEN 1 WHEN 3 THEN -1 ELSE 0 END AS way, CASE k % 4 WHEN 0 THEN '30 mph' WHEN 1 THEN '50' ELSE 'none' END AS maxspeed
FROM (SELECT s_suppkey * 3 + j AS k, (SELECT count(*) FROM {supplier}) + 12 AS m FROM {source})
"""
_LON, _LAT = "(-77.30 + 0.001 * ({0} % 12))", "(38.80 + 0.001 * ({0} {div} 12) + 0.00001 * ({0} % 7))"
_towns: dict[tuple[str, str], Network] = {}


def town(spark, sf_dir: str) -> Network:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _towns:
        s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey")
        r = spark.sql(_TOWN.format(div="DIV", supplier="{s}", source="(SELECT *, explode(sequence(0,2)) AS j FROM {s})"), s=s)
        at = lambda c: F.struct(F.expr(_LON.format(c)).cast("double").alias("lon"), F.expr(_LAT.format(c, div="DIV")).cast("double").alias("lat"))
        way = F.when(F.col("way") == 1, "yes").when(F.col("way") == -1, "-1").otherwise("no")
        records = r.select(F.col("k").alias("record_no"), F.array(at("a"), at("b")).alias("coords"), F.create_map(F.lit("oneway"), way, F.lit("maxspeed"), F.col("maxspeed")).alias("props"))
        _towns.clear()
        _towns[key] = Network.from_records(records, metric_epsg=adapters.EPSG)
    return _towns[key]


def town_edges(spark, sf_dir):
    return town(spark, sf_dir).edges.select("edge_id", "u", "v", "reverse_id", "road_id", F.round("length_m", 3).alias("length_m"), F.round("maxspeed_mps", DIGITS).alias("maxspeed_mps"))


def town_pieces(spark, sf_dir):
    s = town(spark, sf_dir).segments()
    return s.groupBy("edge_id").agg(F.count("*").alias("pieces"), F.round(F.max("arc0"), 3).alias("last_arc"), F.round(F.sum(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))), 3).alias("length"))


def town_node_pairs(spark, sf_dir):
    return town(spark, sf_dir).node_pairs().select("u", "v", F.round("length_m", 3).alias("length_m"), "edge_id")


def town_accessors(spark, sf_dir):
    """What the accessors tell of the edges with ids 0, 5 and 10."""
    net = town(spark, sf_dir)
    rows = []
    for e in (0, 5, 10):
        edge = net.edge(e)
        rows.append((e, edge["u"], edge["v"], net.edges_between(edge["u"], edge["v"]).count(), net.road_edge_ids(e).count(), *net.counts()))
    return spark.createDataFrame(rows, "edge_id long, u long, v long, n_between long, n_road long, n_edges long, n_nodes long")


def network_stats(spark, sf_dir):
    stats = analysis.network_stats(town(spark, sf_dir), area_method="bbox")
    names = ("n_nodes", "n_edges", "n_physical_roads", "n_intersections", "n_dead_ends", "streets_per_node_avg", "circuity_avg", "area_km2", "intersection_density_km2", "edge_density_km2")
    row = [stats[n] for n in names]
    kind = ", ".join(f"{n} {'long' if n[:2] == 'n_' else 'double'}" for n in names)
    out = spark.createDataFrame([tuple(float(v) if n[:2] != "n_" else int(v) for n, v in zip(names, row))], kind)
    return rounded(out, 4)


def weak_components(spark, sf_dir):
    return analysis.weak_components(town(spark, sf_dir))


def strong_components(spark, sf_dir):
    return analysis.strong_components(town(spark, sf_dir))


def connectivity(spark, sf_dir):
    c = analysis.connectivity_report(town(spark, sf_dir))
    return c.sizes.select(F.col("size").cast("long").alias("size"), "components").withColumns({"n_weak": F.lit(c.summary["n_weakly_connected_components"]).cast("long"), "strong": F.lit(c.summary["is_strongly_connected"])})


def stranded_edges(spark, sf_dir):
    return analysis.connectivity_report(town(spark, sf_dir)).edges


def betweenness_hops(spark, sf_dir):
    return rounded(analysis.edge_betweenness_centrality(town(spark, sf_dir), weight=None))


def _trips(spark, sf_dir) -> DataFrame:
    """From a node's neighbourhood to another's: the number of nodes decides which."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey")
    return spark.sql(_TRIPS.format(div="DIV", n="{s}"), s=s).select("trip_id", *(F.expr(t.format(c, div="DIV")).cast("double").alias(f"{c}_{n}") for c in "od" for t, n in ((_LON, "lon"), (_LAT, "lat"))))


_TRIPS = "SELECT s_suppkey AS trip_id, s_suppkey % ((SELECT count(*) FROM {n}) + 12) AS o, (s_suppkey * 5 + 3) % ((SELECT count(*) FROM {n}) + 12) AS d FROM {n}"


def routes_distance(spark, sf_dir):
    t = _trips(spark, sf_dir).withColumns({"o_lon": F.col("o_lon") + 0.0001, "d_lat": F.col("d_lat") - 0.0001})  # snapped back to the nodes
    return rounded(routing.Router(town(spark, sf_dir)).route_many(t, mode="distance").select("trip_id", "distance_m"), 3)


def routes_time(spark, sf_dir):
    return rounded(routing.Router(town(spark, sf_dir)).route_many(_trips(spark, sf_dir), mode="time").select("trip_id", "travel_time_s"), 4)


def routes_cost(spark, sf_dir):
    got = routing.Router(town(spark, sf_dir)).route_many(_trips(spark, sf_dir), mode="cost", cost=F.lit(1.0))
    return got.select("trip_id", F.col("n_edges").cast("long").alias("n_edges"), (F.size(F.col("path")) - 1).cast("long").alias("hops"))


# ------------------------------------------------------------------ trajectories on the grid


def hmm_edges(spark, sf_dir):
    net = adapters.network(spark)
    return matching.hmm_match(net, adapters.fixes(spark, sf_dir)).select("point_id", "traj_id", "edge_id", F.round("snap_dist_m", 3).alias("snap_dist_m"))


def derived_speeds(spark, sf_dir):
    net = adapters.network(spark)
    i = speeds.derive_speeds(net, matching.hmm_match(net, adapters.fixes(spark, sf_dir)), min_baseline_m=50.0, dealt=True).intervals
    return rounded(i.drop("n_edges"), 4)


def derived_observations(spark, sf_dir):
    """How many edges each interval touched: an even number on two-way roads, and its own edges among them."""
    net = adapters.network(spark)
    d = speeds.derive_speeds(net, matching.hmm_match(net, adapters.fixes(spark, sf_dir)), dealt=True, interval_id_start=7)
    each = d.edge_observations.groupBy("interval_id").agg(F.count("*").alias("n"), F.count_distinct("edge_id").alias("edges"))
    same = d.intervals.filter("edge_from = edge_to").select("interval_id", "edge_from")
    return same.join(each, "interval_id").select("interval_id", "edge_from", "n", "edges")


def interval_numbers(spark, sf_dir):
    net = adapters.network(spark)
    i = speeds.derive_speeds(net, matching.hmm_match(net, adapters.fixes(spark, sf_dir)), min_baseline_m=50.0, dealt=True, dense_ids=True, interval_id_start=1000).intervals
    return i.select("interval_id", "point_id_from")


def chord_speeds(spark, sf_dir):
    return rounded(speeds.chord_speeds(adapters.fixes(spark, sf_dir)).select("point_id", "speed_mps"), 3)


def without_dwells(spark, sf_dir):
    f = adapters.fixes(spark, sf_dir).withColumn("speed_mps", F.lit(5.0))
    return cleaning.filter_trajectory_speed(f, dwell_radius_m=20.0, dwell_min_s=6.0).select("point_id", "traj_id")


def model_odds(spark, sf_dir):
    return rounded(spark.range(0, 100).select("id", matching.emission_logp(F.col("id") * 0.5, 6.0).alias("emission"), matching.transition_logp(F.col("id") * 3.0, 30.0).alias("transition")), 9)


# ------------------------------------------------------------------ sources, sinks, scalars


def _raw_fixes(spark, sf_dir) -> DataFrame:
    """Fixes as text, as a file has them, with rows to leave out."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "value")
    return spark.sql(
        """SELECT CASE WHEN event_id % 11 = 0 THEN NULL ELSE concat('u', CAST(user_id AS STRING)) END AS Trip_ID, CASE WHEN event_id % 17 = 0 THEN 'x' WHEN event_id % 19 = 0 THEN '190.5' ELSE CAST(event_id % 90 AS STRING) END AS Longitude,
        CAST(event_id % 80 AS STRING) AS lat, date_format(ts, "yyyy-MM-dd'T'HH:mm:ss") AS Timestamp, CAST(event_id % 100 AS STRING) AS speed_kph, CAST(event_id AS STRING) AS point_id FROM {e}""",
        e=e,
    )


def loaded_points(spark, sf_dir):
    """Through a CSV file and back, with the columns recognised by name."""
    path = f"{shared_folder(spark)}/roadflow/points-{sf_dir.strip('/').replace('/', '-')}.csv"
    _raw_fixes(spark, sf_dir).write.mode("overwrite").csv(path, header=True)
    got = points.load_points(spark, path, dense_ids=False)
    return got.select(F.col("point_id_src").cast("long").alias("event_id"), "traj_id", "lon", "lat", F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("time"), F.round("speed_mps", DIGITS).alias("speed_mps"))


def numbered_points(spark, sf_dir):
    """Dense ids in the order of the file, after the drops."""
    raw = _raw_fixes(spark, sf_dir).withColumn("n", F.col("point_id").cast("long"))
    return points.points_from(raw.drop("point_id"), order_col="n", keep_cols=[]).select("point_id", "lon", "lat")


def lone_fixes(spark, sf_dir):
    p = adapters.fixes(spark, sf_dir).withColumn("traj_id", F.when(F.col("point_id") % 5 == 0, F.col("point_id") * 1000).otherwise(F.col("traj_id")))
    return points.lone_fixes(p)


def suspect_speeds(spark, sf_dir):
    obs = adapters.observations(spark, sf_dir).select((F.col("speed_mps") * 6 - 5).alias("speed_mps"))
    return rounded(points.suspect_speeds(obs))


def saved_points(spark, sf_dir):
    f = adapters.observations(spark, sf_dir).filter("j = 0").select(F.col("interval_id").alias("point_id"), "time", "speed_mps")
    return points.to_frame(f, speed_unit="kph").select("point_id", F.substring("time", 1, 19).alias("time"), F.round("speed_kph", DIGITS).alias("speed_kph"))


def geojson_network(spark, sf_dir):
    """The grid through a GeoJSON file and back."""
    path = f"{shared_folder(spark)}/roadflow/grid.geojson"
    lines = adapters.road_records(spark).select(
        "record_no",
        F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), F.transform("coords", lambda p: F.array(p["lon"], p["lat"])).alias("coordinates")).alias("geometry"), F.col("props").alias("properties"))).alias("f"),
    )
    whole = lines.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("record_no", "f"))), lambda x: x["f"]), ","), F.lit("]}")).alias("value"))
    whole.write.mode("overwrite").text(path)
    e = Network.from_geojson(spark, path).edges
    return e.select("edge_id", "reverse_id", "road_id", F.round("maxspeed_mps", DIGITS).alias("maxspeed_mps"), F.round("length_m", 3).alias("length_m"))


def overpass_ways(spark, sf_dir):
    """Ways of a map service's answer as records."""
    path = f"{shared_folder(spark)}/roadflow/ways.json"
    answer = '{"elements":[{"type":"node","id":1},{"type":"way","id":7,"geometry":[{"lat":1.0,"lon":2.0},{"lat":1.5,"lon":2.5}],"tags":{"name":"Main","oneway":"yes"}},{"type":"way","id":8,"geometry":[{"lat":1.0,"lon":2.0}]},{"type":"way","id":9,"geometry":[{"lat":3.0,"lon":4.0},{"lat":3.0,"lon":5.0},{"lat":3.0,"lon":6.0}]}]}'
    spark.createDataFrame([(answer,)], "value string").write.mode("overwrite").text(path)
    return read_overpass(spark, path).select("record_no", F.size("coords").cast("long").alias("vertices"), F.col("coords")[0]["lon"].alias("lon"), F.col("props")["osm_id"].alias("osm_id"), F.col("props")["name"].alias("name"))


def exported_map(spark, sf_dir):
    """The features of a map read back from their JSON."""
    net = adapters.network(spark)
    done = net.with_edges(aggregate.assign_speeds(net.edges, adapters.observations(spark, sf_dir)))
    f = export.to_geojson(done, directional=True, speed_unit="mps", keep_tags=("maxspeed",)).select("edge_id", F.from_json("feature", "type string, geometry struct<type:string,coordinates:array<array<double>>>, properties struct<speed:double,has_speed:boolean,travel_time_s:double,maxspeed:string>").alias("f"))
    return rounded(f.select("edge_id", "f.type", F.col("f.geometry.type").alias("shape"), F.size("f.geometry.coordinates").cast("long").alias("vertices"), "f.properties.speed", "f.properties.has_speed", "f.properties.maxspeed"))


def colour_limits(spark, sf_dir):
    net = adapters.network(spark)
    done = net.with_edges(aggregate.assign_speeds(net.edges, adapters.observations(spark, sf_dir)))
    table, low, high = export.plot_table(done, speed_unit="mps")
    return rounded(table.agg(F.count("*").alias("n"), F.count_if("has_speed").alias("observed")).withColumns({"low": F.lit(low), "high": F.lit(high)}))


def round_trips(spark, sf_dir):
    """UTM there and back, and the inverse of web Mercator."""
    lon, lat = -179.5 + F.col("id") * 359.0 / 200, -79.0 + F.col("id") * 158.0 / 200
    df = spark.range(0, 201).select("id", lon.alias("lon"), lat.alias("lat"))
    x, y = geo.utm_forward(F.lit(-77.0) + F.col("lon") / 60, F.col("lat"), 18, False)
    back_lon, back_lat = geo.utm_inverse(x, y, 18, False)
    m_lon, m_lat = geo.web_mercator_inverse(F.col("lon") * 111319.49, F.col("lat") * 111319.49)
    return rounded(df.select("id", back_lon.alias("lon"), back_lat.alias("lat"), m_lon.alias("m_lon"), m_lat.alias("m_lat")), 7)


def geodesics(spark, sf_dir):
    df = spark.range(0, 300).select("id", (-170.0 + F.col("id") * 1.1).alias("lon"), (-80.0 + F.col("id") * 0.5).alias("lat"))
    return rounded(df.select("id", geo.geodesic_distance("lon", "lat", F.col("lon") + 0.01 * (F.col("id") % 100), F.col("lat") + 0.3 - 0.01 * (F.col("id") % 60)).alias("metres")), 4)


_UNITS = ("mph", "MPH ", "mi/h", "kph", "km/h", " kmh", "mps", "m/s")


def unit_names(spark, sf_dir):
    rows = []
    for name in _UNITS:
        try:
            unit = units.SpeedUnit.parse(name)
            rows.append((name, unit.value, float(units.to_mps(10.0, unit)), float(units.from_mps(10.0, unit))))
        except ValueError:
            rows.append((name, None, None, None))
    return rounded(spark.createDataFrame(rows, "name string, unit string, ten_in_mps double, ten_mps_in double"))


def epsg_codes(spark, sf_dir):
    """Zones by position, and what is read from names of systems."""
    places = [(15.0, 50.0), (-122.4, 37.8), (151.2, -33.9), (0.0, 0.0), (-74.0, 40.7), (179.9, -1.0)]
    rows = [(f"{lon} {lat}", int(geo.utm_epsg_for(lon, lat)), *map(int, geo.utm_zone_of(geo.utm_epsg_for(lon, lat)))) for lon, lat in places]
    member = {"crs": {"properties": {"name": "urn:ogc:def:crs:EPSG::3857"}}}  # as GeoJSON files have it
    named = [(s, geo.parse_epsg(s)) for s in ("EPSG:32618", " epsg:4326 ", geo.geojson_crs(member))]
    rows += [(s, int(code), None, None) for s, code in named]
    return spark.createDataFrame(rows, "place string, epsg long, zone long, north long")


def peak_windows(spark, sf_dir):
    """Contiguous peak and off-peak hours, the second away from the first."""
    c = aggregate.classify_hours(adapters.observations(spark, sf_dir), n_peak=4, n_offpeak=5)
    rows = [("peak", h) for h in c.peak_hours] + [("offpeak", h) for h in c.offpeak_hours]
    return spark.createDataFrame(rows, "regime string, hour long")


QUERIES = {
    f.__name__: f
    for f in (
        town_edges, town_pieces, town_node_pairs, town_accessors, network_stats, weak_components, strong_components, connectivity, stranded_edges, betweenness_hops, routes_distance, routes_time, routes_cost,
        hmm_edges, derived_speeds, derived_observations, interval_numbers, chord_speeds, without_dwells, model_odds, loaded_points, numbered_points, lone_fixes, suspect_speeds, saved_points, geojson_network, overpass_ways,
        exported_map, colour_limits, round_trips, geodesics, unit_names, epsg_codes, peak_windows,
    )
}

# ------------------------------------------------------------------ DuckDB


def utm(lon: str, lat: str) -> tuple[str, str]:
    """Easting and northing in zone 18 north, as SQL on columns."""
    lam, s = f"(radians({lon}) - {g.central_meridian(18)!r})", f"sin(radians({lat}))"
    t = f"sinh(atanh({s}) - {g.E!r} * atanh({g.E!r} * {s}))"
    x0, y0 = f"atan2({t}, cos({lam}))", f"atanh(sin({lam}) / sqrt(1 + pow({t}, 2)))"
    x = " + ".join([f"({x0})", *(f"{a!r} * sin({2 * j} * {x0}) * cosh({2 * j} * {y0})" for j, a in enumerate(g.FORWARD, 1))])
    y = " + ".join([f"({y0})", *(f"{a!r} * cos({2 * j} * {x0}) * sinh({2 * j} * {y0})" for j, a in enumerate(g.FORWARD, 1))])
    k = g.K0 * g.RECTIFYING
    return f"({k!r} * ({y}) + 500000.0)", f"({k!r} * ({x}))"


def geodesic(source: str, name: str = "geo") -> str:
    """CTEs that end in ``name`` (key, metres), from ``source`` (key, lon1, lat1, lon2, lat2): Vincenty's formula, its iteration as a recursion."""
    n = name
    step = f"""sqrt(pow(cos(u2)*sin(lam),2) + pow(cos(u1)*sin(u2) - sin(u1)*cos(u2)*cos(lam),2)) AS ss, sin(u1)*sin(u2) + cos(u1)*cos(u2)*cos(lam) AS cs"""
    more = "atan2(ss, cs) AS arc, CASE WHEN ss = 0 THEN 0 ELSE cos(u1)*cos(u2)*sin(lam)/ss END AS az"
    mid = "CASE WHEN 1-az*az = 0 THEN 0 ELSE cs - 2*sin(u1)*sin(u2)/(1-az*az) END AS mid, 1-az*az AS q"
    w = f"({g.F_!r}/16*q*(4+{g.F_!r}*(4-3*q)))"
    inner = lambda src: f"(SELECT *, {mid} FROM (SELECT *, {more} FROM (SELECT *, {step} FROM {src})))"
    k = f"(q*{(g.A**2 - g.B**2) / g.B**2!r})"
    return f"""{n}_0(key, dlon, u1, u2) AS (SELECT key, radians(lon2-lon1), atan({1 - g.F_!r}*tan(radians(lat1))), atan({1 - g.F_!r}*tan(radians(lat2))) FROM {source}),
{n}_i(key, dlon, u1, u2, lam, n) AS (SELECT *, dlon, 0 FROM {n}_0 UNION ALL SELECT key, dlon, u1, u2, dlon + (1-{w})*{g.F_!r}*az*(arc + {w}*ss*(mid + {w}*cs*(2*mid*mid-1))), n+1 FROM {inner(f'{n}_i')} WHERE n < 10),
{n}_k AS (SELECT *, {k} AS k, 1 + {k}/16384*(4096+{k}*(-768+{k}*(320-175*{k}))) AS scale, {k}/1024*(256+{k}*(-128+{k}*(74-47*{k}))) AS p FROM {inner(f'(SELECT * FROM {n}_i WHERE n = 10)')}),
{n} AS (SELECT key, {g.B!r}*scale*(arc - p*ss*(mid + p/4*(cs*(2*mid*mid-1) - p/6*mid*(4*ss*ss-3)*(4*mid*mid-3)))) AS metres FROM {n}_k)"""


_MPH, _KPH = "(1609.344 / 3600)::DOUBLE", "(1000.0 / 3600)::DOUBLE"
_LIMIT = f"CASE maxspeed WHEN '30 mph' THEN 30 * {_MPH} WHEN '50' THEN 50 * {_KPH} END"
_lon, _lat = (lambda c: _LON.format(c)), (lambda c: _LAT.format(c, div="//"))
_TOWN_SQL = f"""WITH RECURSIVE town AS ({_TOWN.format(div='//', supplier='supplier', source='(SELECT *, unnest(range(0,3)) AS j FROM supplier)')}),
rec AS (SELECT *, CASE WHEN way = 0 THEN 2 ELSE 1 END AS n, {utm(_lon('a'), _lat('a'))[0]} AS x0, {utm(_lon('a'), _lat('a'))[1]} AS y0, {utm(_lon('b'), _lat('b'))[0]} AS x1, {utm(_lon('b'), _lat('b'))[1]} AS y1 FROM town WHERE a <> b),
num AS (SELECT *, (sum(n) OVER (ORDER BY k) - n)::BIGINT AS first, sqrt(pow(x1-x0,2) + pow(y1-y0,2)) AS len, {_LIMIT} AS mps FROM rec),
te AS (SELECT first AS edge_id, CASE WHEN way = -1 THEN b ELSE a END AS p, CASE WHEN way = -1 THEN a ELSE b END AS q, len, mps, first AS road_id, CASE WHEN way = 0 THEN first + 1 END AS reverse_id FROM num
       UNION ALL SELECT first + 1, b, a, len, mps, first, first FROM num WHERE way = 0),
tn AS (SELECT j, min(id) AS node_id FROM (SELECT p AS j, 2*edge_id AS id FROM te UNION ALL SELECT q, 2*edge_id + 1 FROM te) GROUP BY j),
e AS (SELECT te.*, a.node_id AS u, b.node_id AS v FROM te JOIN tn a ON a.j = p JOIN tn b ON b.j = q)"""
_WEAK = f"""{_TOWN_SQL}, links AS (SELECT u AS a, v AS b FROM e UNION SELECT v, u FROM e), wreach(a, b) AS (SELECT DISTINCT a, a FROM links UNION SELECT wreach.a, links.b FROM wreach JOIN links ON wreach.b = links.a),
weak AS (SELECT a AS node_id, min(b) AS component FROM wreach GROUP BY a)"""
_STRONG = f"""{_WEAK}, sreach(a, b) AS (SELECT node_id, node_id FROM tn UNION SELECT sreach.a, e.v FROM sreach JOIN e ON sreach.b = e.u),
strong AS (SELECT x.a AS node_id, min(x.b) AS component FROM sreach x JOIN sreach y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
sizes AS (SELECT component, count(*) AS n FROM strong GROUP BY component), top AS (SELECT component FROM sizes ORDER BY n DESC, component LIMIT 1)"""


def _cheapest(weight: str, digits: int, name: str, east: float = 0.0, south: float = 0.0) -> str:
    """Least sums of a weight along edges, for the trips, from the node nearest to one end (so far east of its own) to that nearest to the other (so far south)."""
    start, end = utm(f"({_lon('o')} + {east})", _lat("o")), utm(_lon("d"), f"({_lat('d')} - {south})")
    return f"""{_TOWN_SQL}, w AS (SELECT u, v, min({weight}) AS w FROM e GROUP BY u, v), trips AS ({_TRIPS.format(div='//', n='supplier')}),
nx AS (SELECT node_id, {utm(_lon('j'), _lat('j'))[0]} AS x, {utm(_lon('j'), _lat('j'))[1]} AS y FROM tn), tx AS (SELECT trip_id, {start[0]} AS ox, {start[1]} AS oy, {end[0]} AS dx, {end[1]} AS dy FROM trips),
ends AS (SELECT trip_id, arg_min(node_id, pow(x - ox, 2) + pow(y - oy, 2)) AS o, arg_min(node_id, pow(x - dx, 2) + pow(y - dy, 2)) AS d FROM tx, nx GROUP BY trip_id),
walk(s, v, k, d) AS (SELECT DISTINCT o, o, 0, 0.0::DOUBLE FROM ends UNION ALL SELECT s, w.v, k + 1, min(d + w.w)::DOUBLE FROM walk JOIN w ON walk.v = w.u WHERE k < 70 GROUP BY s, w.v, k),
far AS (SELECT s, v, min(d) AS d FROM walk GROUP BY s, v)
SELECT trip_id, round(far.d, {digits}) AS {name} FROM ends LEFT JOIN far ON far.s = o AND far.v = ends.d"""


# The grid's edges in metres, pieces of 25 m, node distances, and the likeliest edges by a recursion over fixes.
_MATCH = f"""WITH RECURSIVE fixes AS ({adapters.DUCK['fixes']}), roads AS ({adapters.DUCK['roads']}),
f0 AS MATERIALIZED (SELECT point_id, traj_id, k, time, {utm('lon', 'lat')[0]} AS x, {utm('lon', 'lat')[1]} AS y FROM fixes),
ends AS (SELECT road_no, r0 * 12 + c0 AS a, (r0 + vertical) * 12 + c0 + 1 - vertical AS b, -77.30 + 0.001*c0 AS lon0, 38.80 + 0.001*r0 AS lat0, -77.30 + 0.001*(c0 + 1 - vertical) AS lon1, 38.80 + 0.001*(r0 + vertical) AS lat1 FROM roads),
xy AS MATERIALIZED (SELECT road_no, a, b, {utm('lon0', 'lat0')[0]} AS x0, {utm('lon0', 'lat0')[1]} AS y0, {utm('lon1', 'lat1')[0]} AS x1, {utm('lon1', 'lat1')[1]} AS y1 FROM ends),
e AS MATERIALIZED (SELECT 2*road_no AS edge, a AS u, b AS v, x0, y0, x1, y1, sqrt(pow(x1-x0,2) + pow(y1-y0,2)) AS len FROM xy UNION ALL SELECT 2*road_no + 1, b, a, x1, y1, x0, y0, sqrt(pow(x1-x0,2) + pow(y1-y0,2)) FROM xy),
pieces AS MATERIALIZED (SELECT edge, i, x0 + i/m*(x1-x0) AS x0, y0 + i/m*(y1-y0) AS y0, x0 + (i+1)/m*(x1-x0) AS x1, y0 + (i+1)/m*(y1-y0) AS y1, i/m*len AS arc FROM (SELECT *, greatest(1, ceil(len/25))::DOUBLE AS m, unnest(range(0, greatest(1, ceil(len/25))::INT)) AS i FROM e)),
near AS (SELECT point_id, x, y, p.*, sqrt(pow(x - (x0+x1)/2, 2) + pow(y - (y0+y1)/2, 2)) AS far FROM f0, pieces p WHERE abs(x - (x0+x1)/2) <= 62.5 AND abs(y - (y0+y1)/2) <= 62.5),
short AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY round(far, 6), edge, i) AS nth FROM near WHERE far <= 62.5),
onto AS (SELECT *, greatest(0, least(1, ((x-x0)*(x1-x0) + (y-y0)*(y1-y0)) / (pow(x1-x0,2) + pow(y1-y0,2)))) AS t FROM short WHERE nth <= 8),
off AS (SELECT point_id, edge, sqrt(pow(x-x0-t*(x1-x0),2) + pow(y-y0-t*(y1-y0),2)) AS off, arc + t*sqrt(pow(x1-x0,2) + pow(y1-y0,2)) AS along, nth FROM onto),
one AS (SELECT *, row_number() OVER (PARTITION BY point_id, edge ORDER BY round(off, 6), nth) AS again FROM off WHERE off <= 50),
cand AS MATERIALIZED (SELECT one.*, row_number() OVER (PARTITION BY point_id ORDER BY round(off, 6), edge) AS c, -0.5*pow(off/6, 2) - ln(sqrt(2*pi())*6) AS odds FROM one WHERE again = 1),
seen AS MATERIALIZED (SELECT point_id, traj_id, x, y, row_number() OVER (PARTITION BY traj_id ORDER BY time, point_id) AS i FROM f0 WHERE point_id IN (SELECT point_id FROM cand)),
moves AS MATERIALIZED (SELECT b.traj_id, b.i, a.point_id AS p0, b.point_id AS p1, sqrt(pow(b.x-a.x,2) + pow(b.y-a.y,2)) AS step FROM seen a JOIN seen b ON a.traj_id = b.traj_id AND b.i = a.i + 1),
d1 AS (SELECT u, v, min(len) AS d FROM e GROUP BY u, v), d0 AS (SELECT DISTINCT u, u AS v, 0.0::DOUBLE AS d FROM e UNION ALL SELECT * FROM d1),
d2 AS (SELECT a.u, b.v, min(a.d + b.d) AS d FROM d0 a JOIN d0 b ON a.v = b.u GROUP BY a.u, b.v), d4 AS MATERIALIZED (SELECT a.u, b.v, min(a.d + b.d) AS d FROM d2 a JOIN d2 b ON a.v = b.u GROUP BY a.u, b.v),
pairs AS (SELECT m.traj_id, m.i, a.edge AS e0, a.c AS c0, b.edge AS e1, b.c AS c1, b.odds, step, greatest(8*step, 200) AS cutoff, ea.len - a.along AS rest, b.along AS lead, d4.d FROM moves m JOIN cand a ON a.point_id = m.p0 JOIN cand b ON b.point_id = m.p1 JOIN e ea ON ea.edge = a.edge JOIN e eb ON eb.edge = b.edge LEFT JOIN d4 ON d4.u = ea.v AND d4.v = eb.u),
way AS MATERIALIZED (SELECT traj_id, i, c0, c1, odds, -cutoff/30 - ln(30) AS lost, CASE WHEN e0 = e1 THEN -ln(30) WHEN d <= cutoff THEN -abs(step - (rest + d + lead))/30 - ln(30) END AS go FROM pairs),
v(traj_id, i, c, score, came) AS (SELECT s.traj_id, s.i, cand.c, cand.odds, NULL::BIGINT FROM seen s JOIN cand USING (point_id) WHERE s.i = 1
  UNION ALL SELECT traj_id, i, c1, CASE WHEN best.s IS NULL THEN top.s + lost + odds ELSE best.s END, CASE WHEN best.s IS NULL THEN -top.c ELSE -best.c END
  FROM (SELECT v.traj_id, way.i, way.c1, any_value(lost) AS lost, any_value(odds) AS odds, max(CASE WHEN go IS NOT NULL THEN {{'s': v.score + (go + odds), 'c': -v.c}} END) AS best, max({{'s': v.score, 'c': -v.c}}) AS top FROM v JOIN way ON way.traj_id = v.traj_id AND way.i = v.i + 1 AND way.c0 = v.c GROUP BY v.traj_id, way.i, way.c1)),
ending AS (SELECT traj_id, max(i) AS i FROM seen GROUP BY traj_id),
back(traj_id, i, c) AS (SELECT v.traj_id, i, -(max({{'s': score, 'c': -c}}).c) FROM v JOIN ending USING (traj_id, i) GROUP BY v.traj_id, i UNION ALL SELECT back.traj_id, back.i - 1, v.came FROM back JOIN v ON v.traj_id = back.traj_id AND v.i = back.i AND v.c = back.c WHERE back.i > 1),
hmm AS MATERIALIZED (SELECT f0.point_id, f0.traj_id, f0.time, f0.x, f0.y, coalesce(cand.edge, -1) AS edge_id, cand.off AS off FROM f0 LEFT JOIN (SELECT seen.point_id, back.c FROM seen JOIN back USING (traj_id, i)) b ON b.point_id = f0.point_id LEFT JOIN cand ON cand.point_id = f0.point_id AND cand.c = b.c)"""

# Hops between fixes whichever way roads run (all are two-way here, so distances are those along edges), and intervals by a recursion.
_HOPS = f"""{_MATCH},
pos AS MATERIALIZED (SELECT hmm.*, row_number() OVER (PARTITION BY traj_id ORDER BY time, point_id) AS n, e.u, e.v, e.len, e.len * greatest(0, least(1, ((x-x0)*(x1-x0) + (y-y0)*(y1-y0)) / pow(len, 2))) AS arc FROM hmm LEFT JOIN e ON e.edge = edge_id),
hop0 AS (SELECT a.traj_id, b.n, a.edge_id AS e0, b.edge_id AS e1, a.arc AS s0, b.arc AS s1, a.len AS l0, greatest(6*sqrt(pow(b.x-a.x,2) + pow(b.y-a.y,2)), 300) AS cutoff, a.u AS au, a.v AS av, b.u AS bu, b.v AS bv, b.len AS l1 FROM pos a JOIN pos b ON a.traj_id = b.traj_id AND b.n = a.n + 1 AND a.edge_id >= 0 AND b.edge_id >= 0),
sides AS (SELECT traj_id, n, cutoff, unnest([{{'p': au, 'c': s0}}, {{'p': av, 'c': l0 - s0}}]) AS o, bu, bv, s1, l1 FROM hop0),
ways2 AS (SELECT traj_id, n, cutoff, o.p AS p, o.c AS c0, unnest([{{'p': bu, 'c': s1}}, {{'p': bv, 'c': l1 - s1}}]) AS t FROM sides),
routed AS (SELECT traj_id, n, min(c0 + d4.d + t.c) AS m FROM ways2 JOIN d4 ON d4.u = ways2.p AND d4.v = t.p AND d4.d <= cutoff GROUP BY traj_id, n),
hops AS MATERIALIZED (SELECT hop0.traj_id, hop0.n, least(coalesce(m, 'inf'::DOUBLE), CASE WHEN e0 = e1 THEN abs(s0 - s1) WHEN e0 // 2 = e1 // 2 THEN abs(l0 - s0 - s1) ELSE 'inf'::DOUBLE END) AS m FROM hop0 LEFT JOIN routed USING (traj_id, n)),
steps AS MATERIALIZED (SELECT pos.traj_id, pos.n, nullif(hops.m, 'inf'::DOUBLE) AS m, pos.n = max(pos.n) OVER (PARTITION BY pos.traj_id) AS last FROM pos LEFT JOIN hops USING (traj_id, n)),
grow(traj_id, n, head, total, done, from_n, metres) AS (SELECT traj_id, n, n, 0.0::DOUBLE, false, NULL::BIGINT, NULL::DOUBLE FROM steps WHERE n = 1
  UNION ALL SELECT s.traj_id, s.n, CASE WHEN m IS NULL OR g.total + m >= 50 THEN s.n ELSE g.head END, CASE WHEN m IS NULL OR g.total + m >= 50 THEN 0.0::DOUBLE ELSE g.total + m END,
  coalesce(g.total + m >= 50, false), CASE WHEN m IS NOT NULL AND (last OR g.total + m >= 50) THEN g.head END, CASE WHEN m IS NOT NULL AND (last OR g.total + m >= 50) THEN g.total + m END FROM grow g JOIN steps s ON s.traj_id = g.traj_id AND s.n = g.n + 1),
made AS (SELECT a.traj_id, a.point_id AS p0, b.point_id AS p1, a.time AS t0, b.time AS t1, epoch(b.time - a.time)::DOUBLE AS dt, g.metres, a.edge_id AS e0, b.edge_id AS e1, greatest(a.off, b.off) AS snap, g.done, sqrt(15.0*15.0 + 15.0*15.0) AS noise FROM grow g JOIN pos a ON a.traj_id = g.traj_id AND a.n = g.from_n JOIN pos b ON b.traj_id = g.traj_id AND b.n = g.n WHERE g.from_n IS NOT NULL)"""

_SAME_ROAD = f"""{_HOPS} SELECT a.point_id + 7 AS interval_id, a.edge_id AS edge_from, 2 AS n, 2 AS edges FROM pos a JOIN pos b ON a.traj_id = b.traj_id AND b.n = a.n + 1 JOIN hops ON hops.traj_id = b.traj_id AND hops.n = b.n WHERE a.edge_id = b.edge_id AND a.edge_id >= 0"""

_RAW = "(SELECT event_id, user_id, ts, event_id % 90 AS lon, event_id % 80 AS lat FROM events WHERE event_id % 11 <> 0 AND event_id % 17 <> 0 AND event_id % 19 <> 0)"

ORACLE_SQL = {
    "town_edges": f"{_TOWN_SQL} SELECT edge_id, u, v, reverse_id, road_id, round(len, 3) AS length_m, round(mps, 6) AS maxspeed_mps FROM e",
    "town_pieces": f"{_TOWN_SQL} SELECT edge_id, greatest(1, ceil(len/25))::BIGINT AS pieces, round(len * (greatest(1, ceil(len/25)) - 1) / greatest(1, ceil(len/25)), 3) AS last_arc, round(len, 3) AS length FROM e",
    "town_node_pairs": f"{_TOWN_SQL} SELECT u, v, round(min(len), 3) AS length_m, min({{'l': len, 'e': edge_id}}).e AS edge_id FROM e GROUP BY u, v",
    "town_accessors": f"{_TOWN_SQL} SELECT x.edge_id, x.u, x.v, (SELECT count(*) FROM e y WHERE (y.u = x.u AND y.v = x.v) OR (y.u = x.v AND y.v = x.u)) AS n_between, (SELECT count(*) FROM e y WHERE y.road_id = x.road_id) AS n_road, (SELECT count(*) FROM e) AS n_edges, (SELECT count(*) FROM tn) AS n_nodes FROM e x WHERE x.edge_id IN (0, 5, 10)",
    "network_stats": f"""{_TOWN_SQL}, deg AS (SELECT j, count(DISTINCT road_id) AS d FROM (SELECT p AS j, road_id FROM te UNION ALL SELECT q, road_id FROM te) GROUP BY j),
src AS (SELECT edge_id AS key, {_lon('p')}::DOUBLE AS lon1, {_lat('p')}::DOUBLE AS lat1, {_lon('q')}::DOUBLE AS lon2, {_lat('q')}::DOUBLE AS lat2 FROM te), {geodesic('src')},
box AS (SELECT (max(x) - min(x)) * (max(y) - min(y)) / 1e6 AS a FROM (SELECT x0 AS x, y0 AS y FROM rec UNION ALL SELECT x1, y1 FROM rec)),
road AS (SELECT sum(len) AS m, count(*) AS n FROM num)
SELECT (SELECT count(*) FROM tn) AS n_nodes, (SELECT count(*) FROM te) AS n_edges, road.n AS n_physical_roads, (SELECT count(*) FROM deg WHERE d >= 3) AS n_intersections, (SELECT count(*) FROM deg WHERE d = 1) AS n_dead_ends,
round((SELECT avg(d) FROM deg), 4) AS streets_per_node_avg, round((SELECT sum(len) FROM te) / (SELECT sum(metres) FROM geo), 4) AS circuity_avg, round(box.a, 4) AS area_km2, round((SELECT count(*) FROM deg WHERE d >= 3) / box.a, 4) AS intersection_density_km2, round(road.m / box.a, 4) AS edge_density_km2 FROM box, road""",
    "weak_components": f"{_WEAK} SELECT node_id, component FROM weak",
    "strong_components": f"{_STRONG} SELECT node_id, component FROM strong",
    "connectivity": f"{_STRONG} SELECT n AS size, count(*) AS components, (SELECT count(DISTINCT component) FROM weak) AS n_weak, (SELECT count(*) FROM sizes) <= 1 AS strong FROM sizes GROUP BY n",
    "stranded_edges": f"{_STRONG} SELECT edge_id, a.component = (SELECT component FROM top) AND b.component = (SELECT component FROM top) AS in_largest FROM e JOIN strong a ON a.node_id = u JOIN strong b ON b.node_id = v",
    "betweenness_hops": f"""{_TOWN_SQL}, l AS (SELECT DISTINCT u, v FROM e), walk(s, v, k) AS (SELECT node_id, node_id, 0 FROM tn UNION SELECT s, l.v, k + 1 FROM walk JOIN l ON walk.v = l.u WHERE k < 70),
dist AS (SELECT s, v, min(k) AS d FROM walk GROUP BY s, v),
tight AS (SELECT a.s, a.v AS p, b.v AS q, b.d FROM dist a JOIN l ON l.u = a.v JOIN dist b ON b.s = a.s AND b.v = l.v AND b.d = a.d + 1),
ways(s, v, d, n) AS (SELECT s, v, 0, 1.0::DOUBLE FROM dist WHERE d = 0 UNION ALL SELECT t.s, t.q, t.d, sum(n)::DOUBLE FROM ways JOIN tight t ON t.s = ways.s AND t.p = ways.v AND t.d = ways.d + 1 GROUP BY t.s, t.q, t.d),
rest(s, p, q, t, d, n) AS (SELECT s, p, q, q, d, 1.0::DOUBLE FROM tight UNION ALL SELECT t.s, t.p, t.q, rest.t, t.d, sum(rest.n)::DOUBLE FROM rest JOIN tight t ON t.s = rest.s AND t.q = rest.p AND t.d = rest.d - 1 GROUP BY t.s, t.p, t.q, rest.t, t.d),
use AS (SELECT r.p, r.q, sum(w.n * r.n / z.n) AS b FROM (SELECT s, p, q, t, d, sum(n) AS n FROM rest GROUP BY ALL) r JOIN ways w ON w.s = r.s AND w.v = r.p JOIN ways z ON z.s = r.s AND z.v = r.t GROUP BY r.p, r.q),
same AS (SELECT u, v, count(*) AS n FROM e GROUP BY u, v)
SELECT edge_id, round(coalesce(b, 0) / same.n / ((SELECT count(*) FROM tn) * ((SELECT count(*) FROM tn) - 1)), 6) AS betweenness FROM e JOIN same USING (u, v) LEFT JOIN use ON use.p = e.u AND use.q = e.v""",
    "routes_distance": _cheapest("len", 3, "distance_m", 0.0001, 0.0001),
    "routes_time": _cheapest(f"len / coalesce(mps, {routing.DEFAULT_SPEED_MPS})", 4, "travel_time_s"),
    "routes_cost": _cheapest("1.0", 0, "h").replace("SELECT trip_id, round(far.d, 0) AS h", "SELECT trip_id, far.d::BIGINT AS n_edges, far.d::BIGINT AS hops"),
    "hmm_edges": f"{_MATCH} SELECT point_id, traj_id, edge_id, round(off, 3) AS snap_dist_m FROM hmm",
    "derived_speeds": f"""{_HOPS} SELECT p0 AS interval_id, traj_id, p0 AS point_id_from, p1 AS point_id_to, t0 + (t1 - t0) / 2 AS time, t0 AS t_from, t1 AS t_to, dt AS dt_s, round(metres, 4) AS distance_m, round(metres / dt, 4) AS speed_mps, e0 AS edge_from, e1 AS edge_to, round(snap, 4) AS snap_dist_m,
round(noise / dt, 4) AS speed_sigma_mps, round(pow(noise / dt, 2), 4) AS speed_var, metres >= 3 * noise AND dt BETWEEN 0.5 AND 120 AND metres / dt BETWEEN 0 AND 60 AND snap <= 60 AND done AS quality FROM made WHERE dt > 0""",
    "derived_observations": _SAME_ROAD,
    "interval_numbers": f"{_HOPS} SELECT 1000 + row_number() OVER (ORDER BY t0, p0) - 1 AS interval_id, p0 AS point_id_from FROM made WHERE dt > 0",
    "chord_speeds": f"""{adapters.with_tables('fixes').replace('WITH', 'WITH RECURSIVE', 1)}, o AS (SELECT *, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0, lag(time) OVER w AS t0, row_number() OVER w AS n FROM fixes WINDOW w AS (PARTITION BY traj_id ORDER BY time, point_id)),
src AS (SELECT point_id AS key, lon0 AS lon1, lat0 AS lat1, lon AS lon2, lat AS lat2 FROM o WHERE n > 1), {geodesic('src')},
s AS (SELECT o.*, metres / epoch(time - t0) AS s FROM o LEFT JOIN geo ON key = point_id)
SELECT point_id, round(CASE WHEN n = 1 THEN lead(s) OVER w ELSE s END, 3) AS speed_mps FROM s WINDOW w AS (PARTITION BY traj_id ORDER BY time, point_id)""",
    "without_dwells": f"""{adapters.with_tables('fixes').replace('WITH', 'WITH RECURSIVE', 1)}, f AS (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY time, point_id) AS n FROM fixes),
src AS (SELECT {{'t': a.traj_id, 'i': a.n, 'j': b.n}} AS key, a.lon AS lon1, a.lat AS lat1, b.lon AS lon2, b.lat AS lat2 FROM f a JOIN f b ON a.traj_id = b.traj_id AND b.n > a.n), {geodesic('src')},
far AS (SELECT key.t AS t, key.i AS i, min(key.j) AS j FROM geo WHERE NOT metres <= 20 GROUP BY key.t, key.i), size AS (SELECT traj_id, max(n) AS n FROM f GROUP BY traj_id),
run AS MATERIALIZED (SELECT f.traj_id, f.n AS i, coalesce(far.j, size.n + 1) - 1 AS j FROM f JOIN size USING (traj_id) LEFT JOIN far ON far.t = f.traj_id AND far.i = f.n),
lasts AS MATERIALIZED (SELECT run.*, run.j > run.i AND epoch(b.time - a.time) >= 6 AS dwell FROM run JOIN f a ON a.traj_id = run.traj_id AND a.n = i JOIN f b ON b.traj_id = run.traj_id AND b.n = j),
go(traj_id, i) AS (SELECT traj_id, 1 FROM size UNION ALL SELECT go.traj_id, CASE WHEN dwell THEN l.j + 1 ELSE go.i + 1 END FROM go JOIN lasts l ON l.traj_id = go.traj_id AND l.i = go.i)
SELECT point_id, traj_id FROM f WHERE NOT EXISTS (SELECT 1 FROM go JOIN lasts l ON l.traj_id = go.traj_id AND l.i = go.i WHERE l.dwell AND l.traj_id = f.traj_id AND f.n BETWEEN l.i AND l.j)""",
    "model_odds": "SELECT id, round(-0.5 * pow(id * 0.5 / 6, 2) - ln(sqrt(2 * pi()) * 6), 9) AS emission, round(-id * 3.0 / 30 - ln(30), 9) AS transition FROM range(100) AS t(id)",
    "loaded_points": f"SELECT event_id, 'u' || user_id AS traj_id, lon::DOUBLE AS lon, lat::DOUBLE AS lat, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, round((event_id % 100) * {_KPH}, 6) AS speed_mps FROM {_RAW}",
    "numbered_points": f"SELECT row_number() OVER (ORDER BY event_id) - 1 AS point_id, lon::DOUBLE AS lon, lat::DOUBLE AS lat FROM {_RAW}",
    "lone_fixes": f"{adapters.with_tables('fixes')}, p AS (SELECT CASE WHEN point_id % 5 = 0 THEN point_id * 1000 ELSE traj_id END AS traj_id FROM fixes) SELECT count(*) AS n_trajectories, count(*) FILTER (n = 1) AS n_lone FROM (SELECT traj_id, count(*) AS n FROM p GROUP BY traj_id)",
    "suspect_speeds": f"{adapters.with_tables('obs')}, s AS (SELECT speed_mps * 6 - 5 AS v FROM obs) SELECT count(*) AS n, count(*) FILTER (v < 0 OR v > 120) AS n_implausible, round(min(v), 6) AS slowest_mps, round(max(v), 6) AS fastest_mps FROM s",
    "saved_points": f"{adapters.with_tables('obs')} SELECT interval_id AS point_id, strftime(time, '%Y-%m-%dT%H:%M:%S') AS time, round(speed_mps / {_KPH}, 6) AS speed_kph FROM obs WHERE j = 0",
    "overpass_ways": "SELECT * FROM (VALUES (0::BIGINT, 2::BIGINT, 2.0::DOUBLE, '7', 'Main'), (1, 3, 4.0, '9', NULL)) AS t(record_no, vertices, lon, osm_id, name)",
    "exported_map": f"""{adapters.with_tables('obs', 'roads')}, s AS (SELECT edge_id, median(speed_mps) AS o FROM obs WHERE edge_id <> -1 AND speed_mps IS NOT NULL GROUP BY edge_id)
SELECT 2 * road_no + d AS edge_id, 'Feature' AS type, 'LineString' AS shape, 2::BIGINT AS vertices, round(o, 6) AS speed, o IS NOT NULL AS has_speed, maxspeed FROM (SELECT road_no, maxspeed, unnest([0, 1]) AS d FROM roads) LEFT JOIN s ON s.edge_id = 2 * road_no + d""",
    "colour_limits": f"""{adapters.with_tables('obs')}, s AS (SELECT edge_id, median(speed_mps) AS o FROM obs WHERE edge_id <> -1 AND speed_mps IS NOT NULL GROUP BY edge_id),
r AS (SELECT r, avg(o) AS o FROM range(264) AS a(r) LEFT JOIN s ON s.edge_id // 2 = r GROUP BY r) SELECT count(*) AS n, count(o) AS observed, round(quantile_cont(o, 0.05), 6) AS low, round(quantile_cont(o, 0.95), 6) AS high FROM r""",
    "round_trips": f"SELECT id, round(-77.0 + (-179.5 + id * 359.0 / 200) / 60, 7) AS lon, round(-79.0 + id * 158.0 / 200, 7) AS lat, round(degrees((-179.5 + id * 359.0 / 200) * 111319.49 / {g.A!r}), 7) AS m_lon, round(degrees(2 * atan(exp((-79.0 + id * 158.0 / 200) * 111319.49 / {g.A!r})) - pi() / 2), 7) AS m_lat FROM range(201) AS t(id)",
    "geodesics": f"WITH RECURSIVE src AS (SELECT id AS key, -170.0 + id * 1.1 AS lon1, -80.0 + id * 0.5 AS lat1, -170.0 + id * 1.1 + 0.01 * (id % 100) AS lon2, -80.0 + id * 0.5 + 0.3 - 0.01 * (id % 60) AS lat2 FROM range(300) AS t(id)), {geodesic('src')} SELECT key AS id, round(metres, 4) AS metres FROM geo",
    "unit_names": f"""SELECT name, unit, round(10 * f, 6) AS ten_in_mps, round(10 / f, 6) AS ten_mps_in FROM (VALUES ('mph', 'mph', {_MPH}), ('MPH ', 'mph', {_MPH}), ('mi/h', 'mph', {_MPH}), ('kph', 'kph', {_KPH}), ('km/h', 'kph', {_KPH}), (' kmh', 'kph', {_KPH}), ('mps', 'mps', 1.0), ('m/s', 'mps', 1.0)) AS t(name, unit, f)""",
    "epsg_codes": "SELECT * FROM (VALUES ('15.0 50.0', 32633::BIGINT, 33::BIGINT, 1::BIGINT), ('-122.4 37.8', 32610, 10, 1), ('151.2 -33.9', 32756, 56, 0), ('0.0 0.0', 32631, 31, 1), ('-74.0 40.7', 32618, 18, 1), ('179.9 -1.0', 32760, 60, 0), ('EPSG:32618', 32618, NULL, NULL), (' epsg:4326 ', 4326, NULL, NULL), ('EPSG:3857', 3857, NULL, NULL)) AS t(place, epsg, zone, north)",
    "peak_windows": f"""{adapters.with_tables('obs')}, u AS (SELECT interval_id, any_value(time) AS time, any_value(speed_mps) AS v FROM obs WHERE edge_id <> -1 AND speed_mps IS NOT NULL GROUP BY interval_id), h AS (SELECT hour(time) AS hour, median(v) AS s FROM u GROUP BY 1),
w AS (SELECT n, st, avg(s) AS score, list((st + k) % 24) AS hours FROM (VALUES (4), (5)) AS z(n), range(24) AS a(st), range(5) AS b(k) JOIN h ON h.hour = (st + k) % 24 WHERE k < n GROUP BY n, st HAVING count(*) = n),
p AS (SELECT hours FROM w WHERE n = 4 ORDER BY score, st LIMIT 1), o AS (SELECT w.hours FROM w, p WHERE n = 5 AND len(list_intersect(w.hours, p.hours)) = 0 ORDER BY score DESC, st LIMIT 1)
SELECT 'peak' AS regime, unnest(hours)::BIGINT AS hour FROM p UNION ALL SELECT 'offpeak', unnest(hours)::BIGINT FROM o""",
}
