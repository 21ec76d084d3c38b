"""Traffic inputs from the generated ``events`` table, by arithmetic alone: the same SQL in two dialects.

``observations``: speeds on edges, several edges to an interval. ``fixes``: trajectories that walk up and down the rows of ``roads``, a grid of 12 x 12 nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadflow.operators.network import Network

#: The grid's metric system.
EPSG = 32618

_OBSERVATIONS = """
SELECT event_id AS interval_id, user_id AS traj_id, ts AS time, value/3.6 AS speed_mps,
       CAST(5 + event_id % 20 AS DOUBLE) AS dt_s, value/3.6 * (5 + event_id % 20) AS distance_m,
       CAST({half} * (1 + event_id % 10) AS DOUBLE) AS speed_var, event_id % 7 <> 0 AS quality, j,
       CASE WHEN event_id % 50 = 0 THEN -1 ELSE (event_id*7 + j) % 40 END AS edge_id
FROM {source} WHERE j <= event_id % 3
"""
_FIXES = """
SELECT event_id AS point_id, user_id AS traj_id, k, {time} AS time,
       -77.30 + 0.0002*(CASE WHEN k%110 < 55 THEN k%110 ELSE 110 - k%110 END) + ((event_id*7919)%1000/{thousand} - {half}) * 1.2e-4 AS lon,
       38.80 + 0.001*(user_id%12) + ((event_id*104729)%1000/{thousand} - {half}) * 1.2e-4 AS lat
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events)
"""
_ROADS = """
SELECT id AS road_no, CASE WHEN id < 132 THEN id {div} 11 ELSE (id-132) % 11 END AS r0, CASE WHEN id < 132 THEN id % 11 ELSE (id-132) {div} 11 END AS c0,
       CASE WHEN id < 132 THEN 0 ELSE 1 END AS vertical, CASE id % 4 WHEN 0 THEN '25 mph' WHEN 1 THEN '50' WHEN 2 THEN 'none' ELSE '35 mph' END AS maxspeed
FROM {range}
"""

DUCK = {
    "obs": _OBSERVATIONS.format(half="CAST(0.5 AS DOUBLE)", source="(SELECT *, unnest(range(0,3)) AS j FROM events)"),
    "fixes": _FIXES.format(half="CAST(0.5 AS DOUBLE)", thousand="CAST(1000 AS DOUBLE)", time="TIMESTAMP '2026-06-01 06:00:00' + (user_id*600+k*3) * INTERVAL 1 SECOND"),
    "roads": _ROADS.format(div="//", range="(SELECT unnest(range(0,264)) AS id)"),
}


def with_tables(*names: str) -> str:
    """The leading WITH of a DuckDB query on these inputs."""
    return "WITH " + ",\n".join(f"{n} AS ({DUCK[n]})" for n in names)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "value")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return spark.sql(_OBSERVATIONS.format(half="0.5D", source="{e}"), e=e)


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    time = "TIMESTAMP_NTZ'2026-06-01 06:00:00' + make_dt_interval(0,0,0,CAST(user_id*600+k*3 AS DECIMAL(18,6)))"
    return spark.sql(_FIXES.replace("FROM events", "FROM {e}").replace("{half}", "0.5D").replace("{thousand}", "1000.0D").replace("{time}", time), e=_events(spark, sf_dir))


def roads(spark: SparkSession) -> DataFrame:
    return spark.sql(_ROADS.format(div="DIV", range="range(0, 264)"))


def road_records(spark: SparkSession) -> DataFrame:
    r = roads(spark)
    # in decimals, as SQL has it: 0.001 * c0 in doubles is off in the last bit
    at = lambda c, r: F.struct(F.expr(f"CAST(-77.30 + 0.001 * ({c}) AS DOUBLE)").alias("lon"), F.expr(f"CAST(38.80 + 0.001 * ({r}) AS DOUBLE)").alias("lat"))
    start, end = at("c0", "r0"), at("c0 + 1 - vertical", "r0 + vertical")
    return r.select(F.col("road_no").alias("record_no"), F.array(start, end).alias("coords"), F.create_map(F.lit("maxspeed"), "maxspeed", F.lit("name"), F.concat(F.lit("road "), F.col("road_no").cast("string"))).alias("props"))


_networks: dict[str, Network] = {}


def network(spark: SparkSession) -> Network:
    """The network, built once a session; its tables and arrays serve all queries."""
    app = spark.sparkContext.applicationId
    if app not in _networks:
        _networks.clear()
        _networks[app] = Network.from_records(road_records(spark), metric_epsg=EPSG)
    return _networks[app]
