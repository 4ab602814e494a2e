"""Every archive query against its SQL on the smallest tables, and what plans must not hold."""

import datetime
import os

import duckdb
import pytest

from missive.plans import catalog_work as catalog
from missive.plans.model import SOURCES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in SOURCES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    found = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_plans(spark):
    plan = lambda n: catalog.QUERIES[n](spark, SF)._jdf.queryExecution().toString()
    suggestions = plan("merge_suggestions")
    assert "CartesianProduct" not in suggestions and "BroadcastNestedLoopJoin" not in suggestions
    assert "TakeOrderedAndProject" in plan("person_page")


def test_names_match():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
