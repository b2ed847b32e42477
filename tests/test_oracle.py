"""Every registered query against its DuckDB oracle (sf0.001, whole tables)."""

import math

import duckdb
import pytest

from aidsift.plans.registry import load_all
from aidsift.sources.tables import TABLES

from .conftest import SF_SMALL

QUERIES = load_all()


def _canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ("~",)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, (int, float)):
        return ("n", round(float(v), 6))
    if isinstance(v, (list, tuple)):
        return ("l", tuple(_canon(x) for x in v))
    return ("s", str(v))


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_canon(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    c.execute("SET TimeZone='UTC'")
    return c


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if sql))
def test_query_matches_oracle(spark, con, name):
    fn, sql = QUERIES[name]
    df = fn(spark, SF_SMALL)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    ocols = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert _rows(df.columns, got) == _rows(ocols, want)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if not sql))
def test_rows_only_queries_run(spark, name):
    fn, _ = QUERIES[name]
    assert fn(spark, SF_SMALL).count() > 0
