"""What the review of round 1 found missing in the archive queries, on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from missive.operators import archive, vectors
from missive.plans import catalog
from missive.plans.model import SOURCES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in SOURCES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def plain(r):
    return tuple(round(x, 6) if isinstance(x, float) else x for x in r)


@pytest.mark.parametrize("name", ["message_context_all", "message_context", "vector_topk_all", "vector_topk", "hybrid_rrf_all", "hybrid_rrf"])
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    found = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted((plain(r[n] for n in names) for r in got.collect()), key=repr) == sorted(map(plain, found.fetchall()), key=repr)


def test_every_message_has_its_context(spark):
    message = spark.createDataFrame([(k, "t", k) for k in range(30)] + [(99, "u", 1)], "id long, thread_id string, sent_at_unix long")
    got = sorted(map(tuple, archive.message_context(message, message.select("id")).select("anchor_id", "id", "distance").collect()))
    assert got == sorted([(a, b, b - a) for a in range(30) for b in range(30) if abs(a - b) <= 8] + [(99, 99, 0)])


def test_top_k_answers_every_query_row(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8])], "vec_id long, embedding array<float>")
    asked = rows.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    got = vectors.top_k(rows, asked, limit=2, floor=0.7).select("query_id", "vec_id").collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 2), (2, 3)]
