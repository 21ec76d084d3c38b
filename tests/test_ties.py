"""Trajectories with equally likely ways, on which the last bit of a coordinate decides, against SQL."""

from __future__ import annotations

import random

import duckdb
import pytest

from roadflow.plans import network_queries


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    """Two trajectories that come back the way they went, six times with keys shifted."""
    folder = tmp_path_factory.mktemp("tied")
    duckdb.sql(f"COPY (SELECT event_id + 100103 * r AS event_id, ts, user_id + 1501 * r AS user_id, value FROM '/root/testdata/sf0.1/events.parquet', range(6) t(r) WHERE user_id IN (304, 1132)) TO '{folder}/events.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ["hmm_edges", "derived_speeds", "derived_observations"])
def test_equally_likely_ways_are_settled_as_in_sql(spark, tied, name):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tied}/events.parquet'")
    want = c.sql(network_queries.ORACLE_SQL[name])
    columns = list(want.columns)
    assert sorted(map(repr, map(tuple, network_queries.QUERIES[name](spark, tied).select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("seed", [888598, 408744])
def test_windows_as_slow_as_each_other_are_settled_as_in_sql(spark, tmp_path, seed):
    """An observation an hour, of six speeds: several windows have the same mean but for the last bit."""
    rng = random.Random(seed)
    values = [rng.choice([34.0, 34.01, 34.02, 34.03, 34.04, 34.05]) for _ in range(24)]
    c = duckdb.connect()
    c.sql(f"COPY (SELECT i + 1 AS event_id, TIMESTAMP '2026-06-01 00:30:00' + i * INTERVAL 1 HOUR AS ts, i AS user_id, CAST({values}[i + 1] AS DOUBLE) AS value FROM range(24) t(i)) TO '{tmp_path}/events.parquet'")
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = c.sql(network_queries.ORACLE_SQL["peak_windows"]).fetchall()
    assert sorted(map(tuple, network_queries.QUERIES["peak_windows"](spark, str(tmp_path)).collect())) == sorted(want)
