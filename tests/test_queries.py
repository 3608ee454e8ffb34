"""Registered queries against their SQL in DuckDB, on the smallest given tables."""

import datetime as dt

import duckdb
import pytest

from mandi import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
# One of each family; the others share their layers.
CHECKED = ["parse_failures", "key_duplicates", "province_conflicts", "quality_flags", "stale_runs", "city_day", "coverage_tiers", "monthly_monitor", "cross_city_spread", "landed_cost", "sensitivity"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def tidy(value):
    return round(value, 5) + 0.0 if isinstance(value, float) else value


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(tidy(r[c]) for c in columns) for r in df.collect()]
    cursor = duck.execute(SQL[name])
    at = [d[0] for d in cursor.description]
    assert sorted(at) == columns
    want = [tuple(tidy(r[at.index(c)]) for c in columns) for r in cursor.fetchall()]
    key = lambda r: tuple((x is not None, str(x) if isinstance(x, (bool, dt.date)) else x if x is not None else 0) for x in r)
    assert sorted(got, key=lambda r: str(key(r))) == sorted(want, key=lambda r: str(key(r)))
