"""Null ids beside large ones, very long white space, mixing at every number of parts, ties, and plain scores."""

import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm_operators import brute_components

from missive.llm import common, html_text, jaccard_join, metric_join, mixing, packing, quality

BIG = (1 << 53) + 1
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def library_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids


LONG = {
    "newlines": "\n" * 2_000_000,
    "tabs": "a" + "\t" * 2_000_000 + "b",
    "blanks": "x " + " " * 2_000_000 + "y",
    "mixed": "\n \t　\x85" * 400_000 + "end",
    "special": "\n " * 1_000_000 + "<|endoftext|>" + " " * 300 + "<|endoftext|> z",
    "two": " \n" * 40_000 + "a" + "\t" * 65_535 + "b" + " " * 65_536 + " c" + "\r\n" * 32_768,
    "many": "".join("w" + " \n"[k % 2] * (250 + k % 12) + "'s" * (k % 3 == 0) for k in range(4000)),
}


@pytest.mark.parametrize("name", LONG)
def test_packing_reads_long_white_space_as_the_library(name):
    import public_tokenizers

    ids = np.frombuffer(packing.text_ids(LONG[name], public_tokenizers.path("byte_bpe_50k.tiktoken")), "<u4")
    assert ids.tolist() == library_ids(LONG[name])


def test_packing_of_long_white_space_and_null_ids(spark):
    rows = [(1, LONG["newlines"]), (None, "no id"), (BIG, "a large id"), (None, "no id"), (BIG + 1, None), (None, None)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("x"))).collect()
    want = []
    for doc_id, text in rows:
        ids = np.array([*library_ids(text), 2], "<u4")
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids), 1024), len(ids)]
        want += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    ends = defaultdict(list)
    for r in got:
        ends[r.sequence_id].append((r.offset, r.length))
    for pieces in ends.values():
        pieces.sort()
        assert [p[0] for p in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= 1024


def test_joins_and_pages_with_null_ids(spark):
    same = "one two three four five six seven eight"
    rows = [(None, same, "c"), (BIG, same, "c"), (BIG + 2, same, "c"), (None, None, "c"), (7, "", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(map(tuple, jaccard_join.join_components(docs).collect()), key=repr)
    assert got == sorted([(None, 4, None), (BIG, 4, BIG), (BIG + 2, 4, BIG), (None, 0, None), (7, 0, 7)], key=repr)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in jaccard_join.keep_one(docs).collect()) == [(False, 7), (False, BIG), (True, 0), (True, 0)]

    vectors = [(None, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (BIG, [1.0, 0.0], 1), (BIG + 1, [2.0, 0.1], 1), (BIG + 2, [0.0, 1.0], 1), (None, [0.0, 1.0], None)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label long").withColumn("rep", F.lit("x")).withColumn("cell", F.lit(1))
    got = sorted(map(tuple, metric_join.near_duplicates(table).collect()), key=repr)
    assert got == sorted([(None, 0, None, True)] * 3 + [(BIG, 1, BIG, True), (BIG + 1, 1, BIG, False), (BIG + 2, 0, BIG + 2, True)], key=repr)
    assert metric_join.near_duplicates(table.where("false")).collect() == []

    page = "<p>shared line</p><p>own %s</p>"
    pages = [(None, "http://h/a", page % "n"), (BIG, "http://h/b", page % "b"), (BIG + 1, "http://h/c", page % "c"), (None, None, None)]
    got = {(r.page_id, r.url): r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {(None, "http://h/a"): "shared line\nown n", (BIG, "http://h/b"): "own b", (BIG + 1, "http://h/c"): "own c", (None, None): ""}


def test_keep_one_of_rows_with_one_id(spark):
    rows = [(3, "b text", 2), (3, "a text", 9), (3, None, 4), (3, None, 1), (4, "other", 1)]
    runs = {tuple(sorted(map(tuple, jaccard_join.keep_one(spark.createDataFrame(rows[::way], "doc_id long, text string, place int")).collect()))) for way in (1, -1)}
    assert len(runs) == 1
    kept = runs.pop()
    assert [(r[0], r[1]) for r in kept] == [(3, None), (4, "other")]


@pytest.fixture(scope="module")
def mixture(spark):
    rng = np.random.default_rng(5)
    rows = []
    for s, n in enumerate((1, 3, 40, 200, 500)):
        for _ in range(n):
            rows.append((len(rows), " ".join(["w"] * int(rng.geometric(0.01))), "en", f"s{s}" if s else None, 1))
    rows += [(len(rows), None, "en", "s9", 1), (None, "a b c", "en", "s3", 1), (5, "again again", "en", "s3", 1)]
    return rows


def test_mixing_is_the_same_at_every_number_of_parts(spark, mixture, monkeypatch):
    docs = spark.createDataFrame(mixture, DOCS)
    whole = sorted(map(tuple, mixing.mixed(docs).collect()), key=repr)
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 7)
    assert sorted(map(tuple, mixing.mixed(docs.repartition(9)).collect()), key=repr) == whole
    connection = duckdb.connect()
    connection.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    assert sorted(connection.execute(mixing.ORACLE_SQL).fetchall(), key=repr) == whole


def test_mixing_comes_near_its_targets(spark, mixture):
    """Systematic sampling in the order of sizes misses a target by less than the source's largest document."""
    docs = spark.createDataFrame(mixture, DOCS)
    by_source = mixing.mixed(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max("size").alias("largest"), F.count("*").alias("n")).collect()
    assert len(by_source) == 6
    for r in by_source:
        assert abs(r.taken - r.target) <= r.largest
        if r.n >= 200:
            assert abs(r.taken - r.target) <= 0.02 * r.target


def test_mix_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(k, "a b c", "s", "kept") for k in range(9)], "doc_id long, text string, source string, _copy string")
    docs = docs.withColumn("copy", F.lit(1)).withColumn("mixed_id", F.lit(2)).withColumn("copies", F.lit(3))
    got = mixing.mix(docs)
    assert got.columns == docs.columns and {r["_copy"] for r in got.collect()} == {"kept"}


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    class Frame:
        class sparkSession:  # noqa: N801
            class sparkContext:  # noqa: N801
                master = "spark://host:7077"
                getCheckpointDir = staticmethod(lambda: None)

            class conf:  # noqa: N801
                get = staticmethod(lambda name, default: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.checkpoint(Frame())


def plain_features(text):
    """Buckets of a text's words, character n-grams and repeated words, one after the other."""
    mask, out = (1 << 32) - 1, []
    codes = []
    for c in text:
        code = int.from_bytes(c.encode(), "little")
        codes.append(32 if 9 <= code <= 13 else code)
    for n in quality.GRAMS:
        for k in range(len(codes) - n + 1):
            code = sum((codes[k + j] + 1) * quality._GRAM_FACTORS[j] for j in range(n)) & mask
            code ^= code >> 15
            out.append(((code * 0x2C1B3C6D) & mask) >> 16)
    data = text.encode()
    words, _ = common.word_hashes(np.frombuffer(data, np.uint8), np.array([0, len(data)]), lower=False)
    out += [int(w) >> 48 for w in words]
    split = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    return out + [quality.REPEAT for a, b in zip(split, split[1:]) if a == b]


def test_scores_are_the_mean_of_whole_texts(spark):
    rng = np.random.default_rng(2)
    model = quality.Model(rng.normal(size=quality.BUCKETS + 1).astype(np.float32), 0.25)
    texts = [None, "", "a", "ab ab  ab\ncd", "день день 日本語 x", "é" * 5, "word " * 3000]
    got = {r.doc_id: r.score for r in quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for k, text in enumerate(texts):
        found = plain_features(text or "")
        mean = float(np.mean([model.weight[b] for b in found])) if found else 0.0
        logits = np.array([0.0, mean + model.bias])
        assert got[k] == pytest.approx(float(np.exp(logits[1]) / np.exp(logits).sum()), abs=1e-5)


def test_quality_learns_from_a_bounded_sample(spark):
    rows = [(k, f"good fine words {k}" if k % 2 else f"### $$ {k}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id long, quality int")
    model = quality.fit(docs, labels, sample_bytes=2000)  # about 120 texts
    got = quality.score(docs, model).collect()
    assert sum((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in got) >= 395
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels, sample=0)).collect()} == {0.5}


def test_jaccard_join_of_short_texts_that_share_a_passage(spark):
    """Three hundred short texts hold one passage, most of them little else; some link by way of others."""
    rng = np.random.default_rng(8)
    passage = "the same passage stands in every one of these".split()
    texts = {}
    for k in range(300):
        own = [f"w{int(x)}" for x in rng.integers(0, 9, int(rng.integers(0, 6)))]
        texts[k] = " ".join(passage[: int(rng.integers(5, 10))] + own if k % 2 else own + passage)
    want = brute_components(texts)
    rows = spark.createDataFrame([*texts.items(), (999, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_components(rows.repartition(7)).collect()}
    assert got == want | {999: (0, 999)}
    assert 5 < len({c for _, c in want.values()}) < 200


def test_lists_read_in_parts_give_the_same_stars(monkeypatch):
    """However many entries are read at once, every two sets that meet in blocks which may link are in one star."""
    rng = np.random.default_rng(4)
    rows = []
    for bucket in (0, 1):
        for block in range(jaccard_join.BLOCKS + 1):
            for part in range(3):
                n = int(rng.integers(1, 40))
                rows.append((bucket, block, part, 0, rng.integers(0, 30, n).astype(np.uint32).tobytes(), rng.integers(0, 25, n).tobytes()))
    names = ["bucket", "block", "part", "number", "lists", "nodes"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[k : k + 5]]) for k in range(0, len(rows), 5)]
    entries = [(b, x, int(name), int(node)) for b, x, _, _, lists, nodes in rows for name, node in zip(np.frombuffer(lists, np.uint32), np.frombuffer(nodes, np.int64))]
    for most in (2_000_000, 10):
        monkeypatch.setattr(jaccard_join, "SEND_ENTRIES", most)
        pairs = {(p, n) for batch in jaccard_join._star_pairs(iter(batches)) for p, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())}
        pivots = {}
        for b, x, name, node in entries:
            pivots.setdefault((b, name), (x, node))
        want = {(pivots[b, name][1], node) for b, x, name, node in entries if node != pivots[b, name][1] and x + pivots[b, name][0] <= jaccard_join.BLOCKS}
        assert pairs == want


def test_the_memo_holds_short_words_only():
    import public_tokenizers
    from tokenizers import Tokenizer

    from missive.llm import token_counts

    path = public_tokenizers.path("word_bpe_49k.json")
    counter, library = token_counts.WordBpeCounter(path), Tokenizer.from_file(path)
    texts = ["short words", "x" * 100_000 + " y", "ab" * 50 + " " + "c" * 64 + " short"]
    for _ in range(2):
        assert counter(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
        assert set(counter.memo) == {"short", "words", "y", "c" * 64}
