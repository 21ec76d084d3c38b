"""The registered traffic queries, and DuckDB SQL for those that SQL can express. Doubles are rounded alike on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadflow.functions import geo
from roadflow.functions.parse import oneway, parse_maxspeed, parse_time
from roadflow.operators import aggregate, analysis, cleaning, matching, modes
from roadflow.plans import adapters, network_queries
from roadflow.sources import export

DIGITS = 6


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, DIGITS).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def hourly_both(spark, sf_dir):
    return rounded(aggregate.aggregate_speeds(adapters.observations(spark, sf_dir), statistic="both"))


def hourly_weekdays(spark, sf_dir):
    return rounded(aggregate.aggregate_speeds(adapters.observations(spark, sf_dir), statistic="median", days="weekday", block_hours=2, output_unit="kph"))


def hourly_weighted(spark, sf_dir):
    return rounded(aggregate.aggregate_speeds(adapters.observations(spark, sf_dir), weight_by_variance=True, require_quality=True, output_unit="mps"))


def edge_hourly(spark, sf_dir):
    return rounded(aggregate.aggregate_speeds(adapters.observations(spark, sf_dir), statistic="both", by_edge=True, block_hours=6, min_samples=3))


def peak_blocks(spark, sf_dir):
    agg = aggregate.aggregate_speeds(adapters.observations(spark, sf_dir), statistic="median")
    ranked = aggregate.rank_blocks(agg, statistic="median", n_peak=3, n_offpeak=3)
    return rounded(ranked.select("block_start_hour", "n", "median_speed", "rank", "is_peak", "is_offpeak"))


def hour_windows(spark, sf_dir):
    agg = aggregate.aggregate_speeds(adapters.observations(spark, sf_dir), statistic="median", output_unit="mps")
    return rounded(aggregate.hour_windows(agg.select(F.col("block_start_hour").alias("hour"), F.col("median_speed").alias("speed")), 3))


def hour_classes(spark, sf_dir):
    c = aggregate.classify_hours(adapters.observations(spark, sf_dir))
    return spark.range(24).select(F.col("id").cast("int").alias("hour"), F.when(F.col("id").isin(c.peak_hours), "peak").when(F.col("id").isin(c.offpeak_hours), "offpeak").alias("regime")).filter("regime IS NOT NULL")


def edge_regimes(spark, sf_dir):
    net = adapters.network(spark)
    done = aggregate.assign_segment_speeds(net.edges, adapters.observations(spark, sf_dir), peak_hours=[7, 8, 9, 16, 17, 18], offpeak_hours=[0, 1, 2, 3])
    return rounded(done.edges.select("edge_id", *(f"obs_speed_mps_{r}" for r in aggregate.REGIMES), *(f"observed_{r}" for r in aggregate.REGIMES)))


def edge_speeds_at_hour(spark, sf_dir):
    done = aggregate.assign_speeds(adapters.network(spark).edges, adapters.observations(spark, sf_dir), statistic="mean", target_hour=8, block_hours=4, default_speed_mps=10.0)
    return rounded(done.select("edge_id", "obs_speed_mps", "observed"))


def day_types(spark, sf_dir):
    return rounded(aggregate.day_type_report(adapters.observations(spark, sf_dir)).comparison.drop("block_label"))


def day_type_overall(spark, sf_dir):
    return rounded(aggregate.day_type_report(adapters.observations(spark, sf_dir), groups={"early": [0, 1, 2], "all": "all"}).overall)


def congestion(spark, sf_dir):
    return rounded(aggregate.congestion_report(adapters.network(spark).edges, adapters.observations(spark, sf_dir), block_hours=8).edges.drop("block_label"))


def congestion_summary(spark, sf_dir):
    return rounded(aggregate.congestion_report(adapters.network(spark).edges, adapters.observations(spark, sf_dir)).summary())


def speed_bounds(spark, sf_dir):
    kept = cleaning.filter_by_speed(adapters.observations(spark, sf_dir), min_speed=2, max_speed=60)
    return rounded(kept.groupBy("edge_id").agg(F.count("*").alias("n"), F.avg("speed_mps").alias("mean_mps")))


def mad_network(spark, sf_dir):
    kept = cleaning.filter_by_speed(adapters.observations(spark, sf_dir), mad_outliers=True)
    return kept.groupBy("edge_id").agg(F.count("*").alias("n"))


def mad_by_edge(spark, sf_dir):
    kept = cleaning.filter_by_speed(adapters.observations(spark, sf_dir), mad_outliers=True, per_edge=True)
    return kept.groupBy("edge_id").agg(F.count("*").alias("n"))


def movers(spark, sf_dir):
    return rounded(modes.mover_features(adapters.observations(spark, sf_dir)))


def mover_classes(spark, sf_dir):
    return modes.classify_movers(adapters.observations(spark, sf_dir), threshold=60.0, min_distance_m=5000.0).select("traj_id", "n_intervals", "mode")


def vehicles_only(spark, sf_dir):
    obs = adapters.observations(spark, sf_dir)
    kept = modes.filter_by_mode(obs, modes.classify_movers(obs, threshold=60.0))
    return kept.groupBy("edge_id").agg(F.count("*").alias("n"))


def _walkers(spark, sf_dir):
    """One speed for each mover, every third slowed to walking pace."""
    obs = adapters.observations(spark, sf_dir).withColumn("speed_mps", F.col("speed_mps") / F.when(F.col("traj_id") % 3 == 0, 25.0).otherwise(1.0))
    return modes.mover_features(obs)


def mode_threshold(spark, sf_dir):
    return rounded(modes.mode_threshold(_walkers(spark, sf_dir), "speed_p85_mph"))


def network_roads(spark, sf_dir):
    e = adapters.network(spark).edges
    return e.select("edge_id", "reverse_id", "road_id", F.round("maxspeed_mps", DIGITS).alias("maxspeed_mps"), F.round("length_m", 3).alias("length_m"))


def road_degrees(spark, sf_dir):
    return analysis.road_degrees(adapters.network(spark)).groupBy("degree").agg(F.count("*").alias("nodes"))


def fixes_projected(spark, sf_dir):
    x, y = geo.utm_forward(F.col("lon"), F.col("lat"), 18, True)
    return adapters.fixes(spark, sf_dir).select("point_id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


def nearest_edges(spark, sf_dir):
    net = adapters.network(spark)
    return _by_road(net, matching.nearest_match(net, adapters.fixes(spark, sf_dir)))


def nearest_edges_join(spark, sf_dir):
    net = adapters.network(spark)
    return _by_road(net, matching.nearest_match_join(net, adapters.fixes(spark, sf_dir)))


def _by_road(net, matched):
    return matched.join(net.edges.select("edge_id", "road_id"), "edge_id", "left").select("point_id", F.coalesce("road_id", F.lit(-1)).cast("long").alias("road_id"), F.round("snap_dist_m", 3).alias("snap_dist_m"))


def road_features(spark, sf_dir):
    net = adapters.network(spark)
    done = net.with_edges(aggregate.assign_speeds(net.edges, adapters.observations(spark, sf_dir)))
    return export.speed_features(done).select("edge_id", F.array_join("edge_ids", ",").alias("edge_ids"), "has_speed", F.round("speed", DIGITS).alias("speed"))


_TAGS = ("50", "35 mph", " 50 KM/H ", "none", "50;30", "0", "30 knots", "7.5", "walk", "10 m/s", "RU:urban", "25mph")
_ONEWAYS = ("yes", "TRUE", " 1 ", "-1", "reverse", "no", "", "t")
_TIMES = ("2026-06-01T08:00:00", "2026-06-01 08:00:10.5", "2026-06-01T08:00:00Z", "2026-06-01T08:00:00+02:00", "2026-06-01 08:00:00-0530", "nonsense")


def _values(spark, texts):
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{t}')" for t in texts) + " AS t(text)")


def parsed_maxspeed(spark, sf_dir):
    return _values(spark, _TAGS).select("text", F.round(parse_maxspeed(F.col("text")), DIGITS).alias("mps"))


def parsed_oneway(spark, sf_dir):
    return _values(spark, _ONEWAYS).select("text", oneway(F.col("text")).alias("way"))


def parsed_times(spark, sf_dir):
    return _values(spark, _TIMES).select("text", parse_time(F.col("text"), tz="America/New_York").cast("string").alias("local"))


QUERIES = {
    f.__name__: f
    for f in (
        hourly_both, hourly_weekdays, hourly_weighted, edge_hourly, peak_blocks, hour_windows, hour_classes, edge_regimes, edge_speeds_at_hour, day_types, day_type_overall, congestion, congestion_summary,
        speed_bounds, mad_network, mad_by_edge, movers, mover_classes, vehicles_only, mode_threshold, network_roads, road_degrees, fixes_projected, nearest_edges, nearest_edges_join, road_features, parsed_maxspeed, parsed_oneway, parsed_times,
    )
} | network_queries.QUERIES

# ------------------------------------------------------------------ DuckDB

_MPH, _KPH = "(1609.344 / 3600)::DOUBLE", "(1000.0 / 3600)::DOUBLE"
_USE = adapters.with_tables("obs") + """,
u AS (SELECT * FROM obs WHERE edge_id <> -1 AND speed_mps IS NOT NULL),
iv AS (SELECT interval_id, any_value(traj_id) AS traj_id, any_value(time) AS time, any_value(speed_mps) AS v, any_value(speed_var) AS w, bool_and(quality) AS quality, any_value(distance_m) AS distance_m FROM u GROUP BY interval_id)"""
_LABEL = "lpad({0}::VARCHAR, 2, '0') || ':00-' || lpad(least({0} + {1}, 24)::VARCHAR, 2, '0') || ':00'"


def _mean(v: str, unit: str) -> str:
    sem = f"(stddev_samp({v}) / sqrt(count(*)))"
    return f"round(avg({v}) / {unit}, 6) AS mean_speed, round(stddev_samp({v}) / {unit}, 6) AS std_speed, round({sem} / {unit}, 6) AS sem_speed, round((avg({v}) - 1.96 * {sem}) / {unit}, 6) AS ci95_low, round((avg({v}) + 1.96 * {sem}) / {unit}, 6) AS ci95_high"


def _median(v: str, unit: str) -> str:
    q = lambda p: f"quantile_cont({v}, {p})"
    return f"round({q(0.5)} / {unit}, 6) AS median_speed, round({q(0.25)} / {unit}, 6) AS q1_speed, round({q(0.75)} / {unit}, 6) AS q3_speed, round(({q(0.75)} - {q(0.25)}) / {unit}, 6) AS iqr_speed"


_GRID = adapters.with_tables("roads") + """,
ends AS (SELECT *, -77.30 + 0.001*c0 AS lon0, 38.80 + 0.001*r0 AS lat0, -77.30 + 0.001*(c0 + 1 - vertical) AS lon1, 38.80 + 0.001*(r0 + vertical) AS lat1 FROM roads)"""
_LIMIT = f"CASE maxspeed WHEN '25 mph' THEN 25 * {_MPH} WHEN '35 mph' THEN 35 * {_MPH} WHEN '50' THEN 50 * {_KPH} END"
_LIMITS = f"limits AS (SELECT 2 * road_no + d AS edge_id, {_LIMIT} AS mps FROM roads, (VALUES (0), (1)) AS t(d))"


_utm = network_queries.utm
_FX, _FY = _utm("lon", "lat")
_NEAREST = adapters.with_tables("fixes", "roads") + f""",
f AS (SELECT point_id, {_FX} AS x, {_FY} AS y FROM fixes),
ends AS (SELECT road_no, -77.30 + 0.001*c0 AS lon0, 38.80 + 0.001*r0 AS lat0, -77.30 + 0.001*(c0 + 1 - vertical) AS lon1, 38.80 + 0.001*(r0 + vertical) AS lat1 FROM roads),
e AS (SELECT road_no, {_utm("lon0", "lat0")[0]} AS x0, {_utm("lon0", "lat0")[1]} AS y0, {_utm("lon1", "lat1")[0]} AS x1, {_utm("lon1", "lat1")[1]} AS y1 FROM ends),
d AS (SELECT point_id, road_no, x - x0 AS px, y - y0 AS py, x1 - x0 AS dx, y1 - y0 AS dy FROM f, e WHERE abs(x - (x0 + x1) / 2) < 200 AND abs(y - (y0 + y1) / 2) < 200),
t AS (SELECT *, greatest(0, least(1, (px*dx + py*dy) / (dx*dx + dy*dy))) AS t FROM d),
off AS (SELECT point_id, road_no, sqrt(pow(px - t*dx, 2) + pow(py - t*dy, 2)) AS off FROM t),
best AS (SELECT point_id, arg_min(road_no, round(off, 6) * 1000 + road_no / 1e6) AS road_no, min(off) AS off FROM off WHERE off <= 50 GROUP BY point_id)
SELECT point_id, coalesce(2 * road_no, -1) AS road_id, round(off, 3) AS snap_dist_m FROM f LEFT JOIN best USING (point_id)"""

_FEATURES = f"""{_USE}
, m AS (SELECT traj_id, count(*) AS n_intervals, quantile_cont(v, 0.85) / {_MPH} AS p85, quantile_cont(v, 0.5) / {_MPH} AS med, sum(distance_m) AS distance_m FROM (SELECT interval_id, any_value(traj_id) AS traj_id, any_value(speed_mps) AS v, any_value(distance_m) AS distance_m FROM obs GROUP BY interval_id) GROUP BY traj_id)"""


def _mad(by: str) -> str:
    join = "USING (edge_id)" if by else "ON true"
    group = "GROUP BY edge_id" if by else ""
    return f"""{_USE}
, med AS (SELECT {by} median(speed_mps) AS med FROM u {group}), dev AS (SELECT u.*, med, abs(speed_mps - med) AS dev FROM u JOIN med {join}),
mad AS (SELECT {by} median(dev) AS mad FROM dev {group})
SELECT edge_id, count(*) AS n FROM dev JOIN mad {join} WHERE mad = 0 OR abs(0.6745 * (speed_mps - med) / mad) <= 3.5 GROUP BY edge_id"""


_LIT = lambda texts: ", ".join(f"('{t}')" for t in texts)
_HOURLY = f"{_USE}, h AS (SELECT hour(time) AS hour, median(v) AS speed FROM iv GROUP BY 1)"

ORACLE_SQL = {
    "hourly_both": f"{_USE} SELECT hour(time)::INT AS block_start_hour, count(*) AS n, {_LABEL.format('hour(time)', 1)} AS block_label, {_mean('v', _MPH)}, {_median('v', _MPH)}, 'mph' AS unit FROM iv GROUP BY hour(time)",
    "hourly_weekdays": f"{_USE}, b AS (SELECT (hour(time) // 2 * 2)::INT AS block_start_hour, v FROM iv WHERE isodow(time) <= 5) SELECT block_start_hour, count(*) AS n, {_LABEL.format('block_start_hour', 2)} AS block_label, {_median('v', _KPH)}, 'kph' AS unit FROM b GROUP BY block_start_hour",
    "hourly_weighted": f"""{_USE}, b AS (SELECT hour(time)::INT AS block_start_hour, v, w FROM iv WHERE quality)
SELECT block_start_hour, count(*) AS n, {_LABEL.format('block_start_hour', 1)} AS block_label, round(sum(v/w)/sum(1/w), 6) AS mean_speed, round(stddev_samp(v), 6) AS std_speed, round(sqrt(1/sum(1/w)), 6) AS sem_speed,
round(sum(v/w)/sum(1/w) - 1.96*sqrt(1/sum(1/w)), 6) AS ci95_low, round(sum(v/w)/sum(1/w) + 1.96*sqrt(1/sum(1/w)), 6) AS ci95_high, 'mps' AS unit FROM b GROUP BY block_start_hour""",
    "edge_hourly": f"{_USE}, b AS (SELECT edge_id, (hour(time) // 6 * 6)::INT AS block_start_hour, speed_mps AS v FROM u) SELECT edge_id, block_start_hour, count(*) AS n, {_LABEL.format('block_start_hour', 6)} AS block_label, {_mean('v', _MPH)}, {_median('v', _MPH)}, 'mph' AS unit FROM b GROUP BY edge_id, block_start_hour HAVING count(*) >= 3",
    "peak_blocks": f"""{_USE}, b AS (SELECT hour(time)::INT AS block_start_hour, count(*) AS n, median(v) / {_MPH} AS m FROM iv GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY m, block_start_hour) AS rank, count(*) OVER () AS k FROM b)
SELECT block_start_hour, n, round(m, 6) AS median_speed, rank::INT AS rank, rank <= 3 AS is_peak, rank > k - 3 AS is_offpeak FROM r""",
    "hour_windows": f"{_HOURLY} SELECT s::INT AS start, round(avg(speed), 6) AS score FROM range(24) AS a(s), range(3) AS b(k) JOIN h ON h.hour = (s + k) % 24 GROUP BY s",
    "hour_classes": f"{_HOURLY} SELECT hour::INT AS hour, CASE WHEN speed <= (SELECT median(speed) FROM h) THEN 'peak' ELSE 'offpeak' END AS regime FROM h",
    "edge_regimes": f"""{_USE}, s AS (SELECT edge_id, median(speed_mps) AS o, median(speed_mps) FILTER (hour(time) IN (7,8,9,16,17,18)) AS p, median(speed_mps) FILTER (hour(time) IN (0,1,2,3)) AS q FROM u GROUP BY edge_id)
SELECT e.id AS edge_id, round(o, 6) AS obs_speed_mps_overall, round(p, 6) AS obs_speed_mps_peak, round(q, 6) AS obs_speed_mps_offpeak, o IS NOT NULL AS observed_overall, p IS NOT NULL AS observed_peak, q IS NOT NULL AS observed_offpeak FROM range(528) AS e(id) LEFT JOIN s ON s.edge_id = e.id""",
    "edge_speeds_at_hour": f"{_USE}, s AS (SELECT edge_id, avg(speed_mps) AS o FROM u WHERE hour(time) BETWEEN 8 AND 11 GROUP BY edge_id) SELECT e.id AS edge_id, round(coalesce(o, 10.0), 6) AS obs_speed_mps, o IS NOT NULL AS observed FROM range(528) AS e(id) LEFT JOIN s ON s.edge_id = e.id",
    "day_types": f"""{_USE}, b AS (SELECT hour(time)::INT AS block_start_hour, median(v) FILTER (isodow(time) <= 5) / {_MPH} AS a, median(v) FILTER (isodow(time) > 5) / {_MPH} AS b FROM iv GROUP BY 1)
SELECT block_start_hour, round(a, 6) AS weekday_speed, round(b, 6) AS weekend_speed, round(b - a, 6) AS delta_speed, round(100.0 * (b - a) / a, 6) AS delta_pct FROM b""",
    "day_type_overall": f"{_USE} SELECT 'early' AS day_type, count(*) AS n, round(median(v) / {_MPH}, 6) AS overall_speed FROM iv WHERE isodow(time) <= 3 UNION ALL SELECT 'all', count(*), round(median(v) / {_MPH}, 6) FROM iv",
    "congestion": f"""{_USE.replace('WITH obs', 'WITH roads AS (' + adapters.DUCK['roads'] + '), obs')}, {_LIMITS}
SELECT edge_id, block_start_hour, round(o, 6) AS observed_speed, n, round(mps / {_MPH}, 6) AS speed_limit, round(o / (mps / {_MPH}), 6) AS ratio FROM (SELECT edge_id, (hour(time) // 8 * 8)::INT AS block_start_hour, median(speed_mps) / {_MPH} AS o, count(*) AS n FROM u GROUP BY 1, 2) LEFT JOIN limits USING (edge_id)""",
    "congestion_summary": f"""{_USE.replace('WITH obs', 'WITH roads AS (' + adapters.DUCK['roads'] + '), obs')}, {_LIMITS}, r AS (SELECT edge_id, o / (mps / {_MPH}) AS ratio FROM (SELECT edge_id, median(speed_mps) / {_MPH} AS o FROM u GROUP BY 1) LEFT JOIN limits USING (edge_id))
SELECT count(*) AS n_rows, count(DISTINCT edge_id) AS n_edges_observed, count(ratio) AS n_edges_rated, round(median(ratio), 6) AS median_ratio, round(avg(ratio), 6) AS mean_ratio FROM r""",
    "speed_bounds": f"{_USE} SELECT edge_id, count(*) AS n, round(avg(speed_mps), 6) AS mean_mps FROM u WHERE speed_mps BETWEEN 2 * {_MPH} AND 60 * {_MPH} GROUP BY edge_id",
    "mad_network": _mad(""),
    "mad_by_edge": _mad("edge_id,"),
    "movers": f"{_FEATURES} SELECT traj_id, n_intervals, round(p85, 6) AS speed_p85_mph, round(med, 6) AS speed_median_mph, round(distance_m, 6) AS distance_m FROM m",
    "mover_classes": f"{_FEATURES} SELECT traj_id, n_intervals, CASE WHEN n_intervals < 3 OR NOT distance_m >= 5000 THEN 'unknown' WHEN p85 >= 60 THEN 'vehicle' ELSE 'pedestrian' END AS mode FROM m",
    "vehicles_only": f"{_FEATURES} SELECT edge_id, count(*) AS n FROM obs JOIN m USING (traj_id) WHERE n_intervals >= 3 AND p85 >= 60 GROUP BY edge_id",
    "mode_threshold": f"""{adapters.with_tables("obs")},
m AS (SELECT ln(quantile_cont(v, 0.85)) AS x FROM (SELECT interval_id, any_value(traj_id) AS traj_id, any_value(speed_mps) / CASE WHEN any_value(traj_id) % 3 = 0 THEN 25.0 ELSE 1.0 END AS v FROM obs GROUP BY interval_id) GROUP BY traj_id HAVING quantile_cont(v, 0.85) > 0),
s AS (SELECT count(*) AS n, 0.2 * stddev_samp(x) AS h FROM m),
d AS (SELECT i, ln(0.125) + i * (ln(48.0) - ln(0.125)) / 1199 AS g, sum(exp(-0.5 * pow((ln(0.125) + i * (ln(48.0) - ln(0.125)) / 1199 - x) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())) AS d FROM m, s, range(1200) AS r(i) WHERE n >= 20 AND h > 0 GROUP BY i),
k AS (SELECT *, lag(d) OVER o AS b, lead(d) OVER o AS a, max(d) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l, max(d) OVER (ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r, max(d) OVER () AS p FROM d WINDOW o AS (ORDER BY i)),
hump AS (SELECT i, g, d FROM k WHERE d > b AND d > a),
v AS (SELECT k.i, k.g, least(l, r) / k.d AS prom, p, (SELECT arg_max(hump.g, hump.d) FROM hump WHERE hump.i < k.i) AS hg, (SELECT max(hump.d) FROM hump WHERE hump.i < k.i) AS hd FROM k WHERE d < b AND d < a AND g BETWEEN ln(0.5) AND ln(6.0))
SELECT round(exp(arg_max(g, prom)) / {_MPH}, 6) AS threshold FROM v WHERE prom >= 1.5 AND exp(hg) BETWEEN 0.6 AND 2.5 AND hd >= 0.15 * p""",
    "network_roads": f"{_GRID}, xy AS (SELECT *, {_utm('lon0', 'lat0')[0]} AS x0, {_utm('lon0', 'lat0')[1]} AS y0, {_utm('lon1', 'lat1')[0]} AS x1, {_utm('lon1', 'lat1')[1]} AS y1 FROM ends) SELECT 2 * road_no + d AS edge_id, 2 * road_no + 1 - d AS reverse_id, 2 * road_no AS road_id, round({_LIMIT}, 6) AS maxspeed_mps, round(sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)), 3) AS length_m FROM xy, (VALUES (0), (1)) AS t(d)",
    "road_degrees": f"{_GRID}, t AS (SELECT round(lon0, 7) AS x, round(lat0, 7) AS y FROM ends UNION ALL SELECT round(lon1, 7), round(lat1, 7) FROM ends) SELECT degree, count(*) AS nodes FROM (SELECT count(*) AS degree FROM t GROUP BY x, y) GROUP BY degree",
    "fixes_projected": f"{adapters.with_tables('fixes')} SELECT point_id, round({_FX}, 4) AS x, round({_FY}, 4) AS y FROM fixes",
    "nearest_edges": _NEAREST,
    "nearest_edges_join": _NEAREST,
    "road_features": f"""{_USE}, s AS (SELECT edge_id, median(speed_mps) AS o FROM u GROUP BY edge_id)
SELECT 2 * r AS edge_id, (2 * r)::VARCHAR || ',' || (2 * r + 1)::VARCHAR AS edge_ids, avg(o) IS NOT NULL AS has_speed, round(avg(o) / {_MPH}, 6) AS speed FROM range(264) AS a(r) LEFT JOIN s ON s.edge_id // 2 = r GROUP BY r""",
    "parsed_maxspeed": f"""SELECT text, round(CASE WHEN v > 0 THEN v * CASE unit WHEN '' THEN {_KPH} WHEN 'km/h' THEN {_KPH} WHEN 'mph' THEN {_MPH} WHEN 'm/s' THEN 1 END END, 6) AS mps
FROM (SELECT text, TRY_CAST(regexp_extract(lower(trim(text)), '^([0-9]+(?:\\.[0-9]+)?)\\s*([a-z/_]*)$', 1) AS DOUBLE) AS v, regexp_extract(lower(trim(text)), '^([0-9]+(?:\\.[0-9]+)?)\\s*([a-z/_]*)$', 2) AS unit FROM (VALUES {_LIT(_TAGS)}) AS t(text))""",
    "parsed_times": f"""WITH t AS (SELECT text, TRY_CAST(regexp_extract(replace(text, 'T', ' '), '^[0-9-]+ [0-9:.]+') AS TIMESTAMP) AS ts, regexp_extract(text, '[T ][0-9:.]+([+-])', 1) AS sign, TRY_CAST(regexp_extract(text, '[T ][0-9:.]+[+-]([0-9][0-9]):?[0-9][0-9]$', 1) AS INT) AS h, TRY_CAST(regexp_extract(text, '[T ][0-9:.]+[+-][0-9][0-9]:?([0-9][0-9])$', 1) AS INT) AS m FROM (VALUES {_LIT(_TIMES)}) AS v(text))
SELECT text, (ts - coalesce(CASE sign WHEN '-' THEN -1 ELSE 1 END * (60 * h + m), 0) * INTERVAL 1 MINUTE - INTERVAL 4 HOUR)::VARCHAR AS local FROM t""",
    "parsed_oneway": f"SELECT text, CASE WHEN lower(trim(text)) IN ('yes','true','1','t') THEN 1 WHEN lower(trim(text)) IN ('-1','reverse') THEN -1 ELSE 0 END AS way FROM (VALUES {_LIT(_ONEWAYS)}) AS t(text)",
}
ORACLE_SQL |= network_queries.ORACLE_SQL
ORACLE_SQL["geojson_network"] = ORACLE_SQL["network_roads"]
