"""The classifier's sample stays off the driver, and the model is that of the same rows in order."""

import os

import numpy as np

from missive.llm import quality


def _tables(spark, n=60):
    rows = [(k, f"{'the of and' if k % 2 else '### {{ ]]'} w{k % 7} x{k % 5}", k % 2) for k in range(n)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(5)
    return table.drop("quality"), table.drop("text")


def test_training_is_not_the_drivers_work(spark, monkeypatch):
    monkeypatch.setattr(quality, "train", lambda texts, classes: quality.Model(np.array([os.getpid()], np.float32), float(len(texts))))
    model = quality.fit(*_tables(spark), sample=20)
    assert model.bias == 20
    assert int(model.weight[0]) != os.getpid()


def test_model_is_that_of_the_rows_in_order(spark):
    docs, labels = _tables(spark)
    rows = docs.join(labels, "doc_id").where(quality.fold(docs["doc_id"]) != 0).orderBy("doc_id").collect()
    want = quality.train([r.text for r in rows], [r.quality for r in rows])
    got = quality.fit(docs, labels)
    assert got.weight.dtype == want.weight.dtype and len(got.weight) == quality.BUCKETS + 1
    assert np.allclose(got.weight, want.weight, rtol=1e-4, atol=1e-6) and np.isclose(got.bias, want.bias)


def test_a_sample_of_several_batches_gives_one_model(spark):
    docs, labels = _tables(spark)
    want = quality.fit(docs, labels)
    most = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(most)
    spark.conf.set(most, 7)
    try:
        got = quality.fit(docs, labels)
    finally:
        spark.conf.set(most, before)
    assert (got.weight == want.weight).all() and got.bias == want.bias
