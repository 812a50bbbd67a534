"""Every registered query against its DuckDB oracle on the smallest tables."""

import math

import duckdb
import pytest

from tabsight.plans.registry import all_queries
from tabsight.plans.tables import TABLES

from conftest import SF_SMALL

QUERIES = all_queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, bool):
        return (4, int(v))
    if isinstance(v, (int, float)):
        return (1, round(float(v), 4))
    if hasattr(v, "isoformat"):
        return (2, v.isoformat())
    if isinstance(v, (list, tuple)):
        return (3, str([norm(x) for x in v]))
    return (5, str(v))


def rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in recs)


def test_names_unique_and_sql_present():
    names = [q.name for q in QUERIES]
    assert len(names) == len(set(names))
    assert sum(q.sql is not None for q in QUERIES) == len(QUERIES)


@pytest.mark.parametrize("q", QUERIES, ids=[q.name for q in QUERIES])
def test_query_matches_oracle(spark, duck, q):
    sdf = q.build(spark, SF_SMALL)
    scols = list(sdf.columns)
    srows = [tuple(r) for r in sdf.collect()]
    res = duck.execute(q.sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(scols) == sorted(dcols)
    assert len(srows) == len(drows)
    assert rows(scols, srows) == rows(dcols, drows)
