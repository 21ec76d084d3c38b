"""Each registered traffic query against its DuckDB SQL, and what the driver's entry promises."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from roadflow.plans import queries

#: The dearest to plan; their operators have tests of their own.
SMALL = sorted(set(queries.QUERIES) - {"congestion_summary", "day_type_overall", "hourly_weekdays", "mad_network", "vehicles_only"})


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def test_every_query_has_sql():
    assert queries.QUERIES.keys() == queries.ORACLE_SQL.keys()


@pytest.mark.parametrize("name", SMALL)
def test_query_matches_sql(spark, sf_dir, duck, name):
    df, want = queries.QUERIES[name](spark, sf_dir), duck.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    order = [list(want.columns).index(c) for c in columns]
    rows = sorted(([plain(v) for v in r] for r in df.select(*columns).collect()), key=repr)
    assert rows == sorted(([plain(r[i]) for i in order] for r in want.fetchall()), key=repr)
