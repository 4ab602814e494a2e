"""Hybrid search for sets of queries: one list of keyword hits for all of them, and texts that are cut once."""

import pytest
from pyspark.sql import functions as F

from missive.operators import search, vectors


@pytest.mark.parametrize("limit", [3, 7, 50])
def test_one_list_of_keyword_hits_serves_all_queries(spark, limit):
    words = [(k, k // 4 if k % 5 else k, 2 * k + k % 2) for k in range(1, 60)] + [(500, 3, 4), (400, 3, 4)]  # ranks with gaps and ties
    keyword = spark.createDataFrame(words, "id long, group long, rank int")
    asked = spark.createDataFrame([(q,) for q in range(6)], "query_id long")
    meant = [(q, (7 * q + 3 * r) % 40 + (100 if r % 7 == 0 else 0), r, 50 * q + r) for q in range(5) for r in range(1, 45)]
    semantic = spark.createDataFrame(meant, "query_id long, group long, rank int, representative long").dropDuplicates(["query_id", "group"])
    rows = lambda found: sorted(map(tuple, found.collect()))
    apart = vectors.reciprocal_rank_fusion(keyword.crossJoin(asked), semantic, limit, "query_id")
    shared = vectors.reciprocal_rank_fusion(keyword, semantic, limit, "query_id", asked)
    assert rows(shared) == rows(apart)
    assert {r.query_id for r in shared.collect()} == set(range(6))  # the last is found by words only


def test_statistics_hits_and_order_read_stored_counts(spark):
    docs = spark.createDataFrame([(k, "the fox " * (k % 5) + "on") for k in range(40)] + [(99, None)], "id long, body string")
    found = search.search(docs, '"the" on', limit=None)
    assert "regexp" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.id for r in search.ranked(found).collect()} == {k for k in range(40) if k % 5}
    assert found.orderBy(F.desc("score"), "id").first().id == 4
