"""The pipeline's stages on a small table: decisions take effect and columns stay."""

import corpus_pipeline


def test_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    total = docs.count()
    columns = docs.columns
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder).cache()
        kept[name] = docs.count()
        if k < 4:
            assert docs.columns == columns
    assert total > kept["quality"] >= kept["near_duplicates"] == kept["pii"] > 0
    lengths = docs.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0]
    assert lengths <= 1024


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "pii", "mixing", "packing"]
