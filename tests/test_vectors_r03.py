"""Searches by meaning for sets of queries: the same hits as one by one, without a row for each pair."""

import math

import numpy as np
from pyspark.sql import functions as F

from missive.operators import vectors

NAN, INF = math.nan, math.inf


def hits(found):
    return sorted((r.query_id, repr(r.vec_id), repr(r.score)) for r in found.select("query_id", "vec_id", "score").collect())


def test_many_queries_get_the_hits_of_single_ones(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK", 3000)
    made = np.random.default_rng(3)
    some = made.normal(size=(900, 8)).round(2)
    rows = [*some.tolist(), *[some[5].tolist()] * 90, *(some[:60] * 1e-3).tolist(), *(some[:30] * 1e9).tolist(), [0.0] * 8, [1.0], [2.0, 1.0], [-2.0, 1.0], [], None, [1.0, None]]
    for odd in ([], [[INF] + [1.0] * 7, [-INF] + [1.0] * 7, [NAN] * 8, [1e200] * 8]):
        for kind in ("double", "float"):
            table = spark.createDataFrame(list(enumerate(rows + odd * 2)), f"vec_id long, embedding array<{kind}>").repartition(3)
            asked = table.where("vec_id % 9 = 5 OR vec_id > 1080").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
            for limit, floor in ((20, 0.1), (3, 0.8)):
                assert hits(vectors.top_k_of_many(table, asked, limit, floor)) == hits(vectors.top_k(table, asked, limit, floor)), (kind, limit, bool(odd))


def test_ids_of_any_type_and_queries_without_names(spark):
    table = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.6, 0.8])], "vec_id string, embedding array<float>")
    found = vectors.top_k_of_many(table, spark.createDataFrame([([1.0, 0.0],)], "query array<double>"), limit=2)
    assert sorted(map(tuple, found.collect())) == [("a", 1.0, 1), ("b", 1.0, 2)]


def test_scores_round_as_sql_does():
    scores = np.array([0.0000005, 0.1234565, 2.5e-7, 1234.0000005, 123456789012.5, 0.3, NAN, INF])
    assert [repr(float(x)) for x in vectors._rounded(scores)] == ["1e-06", "0.123457", "0.0", "1234.000001", "123456789012.5", "0.3", "nan", "inf"]


def test_no_row_for_each_pair(spark):
    table = spark.range(400).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    asked = table.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    plan = vectors.top_k_of_many(table, asked)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
