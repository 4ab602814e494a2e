"""Added spans against planted ones and decoys; the pipeline's stages on odd tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from missive.llm import pii
from missive.llm.common import checkpoint

PLANTED = {
    "email": ["write to bob [at] host [dot] org now", "contact amy(at)mail.net please", "her mail is j.doe {at} firm.co.uk"],
    "ip": ["server 2001:0db8:85a3:0000:0000:8a2e:0370:7334 is up", "from host fe80:1:2:3:4:5:6:7 we saw"],
    "card": ["paid by amex card 3782 822463 10005 yesterday", "credit card 371449635398431 was charged"],
    "phone": ["call me at (555) 123-4567 today", "phone 555-123-4567 or", "his mobile: 212 555 0199 rings"],
}
DECOYS = ["order 555-123-4567 shipped", "see invoice (555) 123-4567 for", "version release 555.123.4567 is out", "article section 212 555 0199", "isbn 212-555-0199"]
STRICT = ["mail bob@mail.org now", "call +1 (555) 555-1234 now", "card 4111 1111 1111 1111 paid", "host 10.0.0.1 down"]


def test_added_spans_find_what_was_planted_and_few_decoys(spark):
    rng = random.Random(12)
    filler = [f"w{k}" for k in range(300)]
    prose = lambda: " ".join(rng.choices(filler, k=rng.randrange(5, 30)))
    rows, want = [], {}
    for k in range(1200):
        kind = rng.choice([*PLANTED, "decoy", "strict", "none"])
        said = {"decoy": DECOYS, "strict": STRICT, "none": ["nothing here"]}.get(kind) or PLANTED[kind]
        rows.append((k, f"{prose()}. {rng.choice(said)}. {prose()}"))
        want[k] = kind
    got = {r.doc_id: {s["kind"] for s in r.spans if not s["base"]} for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hits = sum(want[k] in found for k, found in got.items() if want[k] in PLANTED)
    wrong = sum(bool(found - {want[k]}) for k, found in got.items())
    planted = sum(v in PLANTED for v in want.values())
    assert hits >= 0.95 * planted and wrong <= 0.05 * planted, (hits, planted, wrong)
    assert not any(found for k, found in got.items() if want[k] in ("strict", "none"))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    text = "the quick brown fox jumps over the lazy dog and mails bob@mail.org now"
    rows = [
        (1, text, "en", "a", 1), (2, text, "en", "a", 1), (2, text, "en", "a", 1), (None, text, "en", None, None), (None, None, None, None, None), (3, None, "en", "b", 0), (4, "", None, "b", 0),
        (5, " \n", "en", "c", 2), ((1 << 53) + 1, "other words stand here, quite a few of them in fact", "de", "c", 9), (6, "long " * 40_000, "en", "a", 9), (6, "another text of the same id", "en", "a", 9),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("score", "component_id", "kept_id", "place", "copies", "mixed_id", "copy", "block", "spans", "target", "rep", "labelled"):
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    spark.createDataFrame([(1, 1), (2, 1), (None, 1), (7, None), (9, 0)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return docs, folder


@pytest.mark.parametrize("empty", [False, True])
def test_stages_take_odd_tables(spark, odd, empty):
    """Each stage keeps the columns as they are, with their values, whatever they are called."""
    docs, folder = odd
    docs = docs.where(F.lit(not empty))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = checkpoint(stage(spark, docs, folder))
        assert not empty or docs.count() == 0
        if name == "packing":
            assert docs.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            break
        assert docs.columns == columns and docs.schema.simpleString() == before.schema.simpleString()
        assert all(r[c] == f"own {c}" for r in docs.collect() for c in columns[5:])
        kept = {(r.doc_id, r.text) for r in docs.collect()}
        if not empty and name == "near_duplicates":
            assert (1, before.where("doc_id = 1").first().text) in kept and not any(k == 2 for k, _ in kept)
            assert sum(r.doc_id is None for r in docs.collect()) == before.where("doc_id IS NULL").count()
        if not empty and name == "pii":
            assert not any("bob@" in (t or "") for _, t in kept)
