"""Each stage of the pipeline against a brute-force version, on a small table with planted copies, rejected documents and
personal data."""

import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from test_llm_operators import brute_components, brute_spans

import corpus_pipeline
from missive.llm import mixing
from missive.llm.common import checkpoint

PERSONAL = ["mail bob@mail.org now", "call +1 (555) 555-1234 now", "card 4111 1111 1111 1111 paid", "host 10.0.0.1 down, amy@mail.org knows"]


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(8)
    words = ["the", "of", "and", "reti", "ther", "on", *(f"w{c}{d}" for c in "abcdefghij" for d in "klmnop")]
    good, rows, bad = [], [], set()
    for k in range(240):
        text = rng.choices(words, k=rng.randrange(40, 90))
        if k % 4 == 0:
            bad.add(k)
            rows.append((k, "### ".join(text)))
            continue
        if k % 10 == 1 and good:
            text = list(rng.choice(good))
            if k % 20 == 1:
                text[rng.randrange(len(text))] = "other"
        elif k % 10 == 3:
            text[10:10] = rng.choice(PERSONAL).split()
        good.append(text)
        rows.append((k, " ".join(text) + "."))
    return [(k, t, "en", f"s{k % 7 % 3}", len(t)) for k, t in rows], bad


@pytest.fixture(scope="module")
def stages(spark, planted, tmp_path_factory):
    """Rows before the first stage and after each."""
    folder = str(tmp_path_factory.mktemp("pipeline"))
    rows, bad = planted
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(k, int(k not in bad)) for k, *_ in rows], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    out = {"documents": [tuple(r) for r in docs.collect()]}
    for name, stage in corpus_pipeline.STAGES:
        docs = checkpoint(stage(spark, docs, folder))
        out[name] = [tuple(r) for r in docs.collect()] if name != "packing" else docs.collect()
    return out


def test_quality_drops_the_rejected(planted, stages):
    assert sorted(stages["quality"]) == sorted(r for r in stages["documents"] if r[0] not in planted[1])


def test_near_duplicates_keep_the_first_of_each_group(stages):
    first = brute_components({r[0]: r[1] for r in stages["quality"]})
    want = [r for r in stages["quality"] if first[r[0]][1] == r[0]]
    assert len(want) <= len(stages["quality"]) - 10
    assert sorted(stages["near_duplicates"]) == sorted(want)


def test_personal_data_are_replaced(stages):
    def redacted(text):
        spans, parts, end = sorted((int(a), int(b), kind) for kind, a, b in (x.split(":") for x in brute_spans(text))), [], 0
        for a, b, kind in spans:
            if a >= end:
                parts += [text[end:a], f"[{kind}]"]
            end = max(end, b)
        return "".join([*parts, text[end:]])

    want = [(k, redacted(t), lang, source, len(redacted(t))) for k, t, lang, source, _ in stages["near_duplicates"]]
    assert sorted(stages["pii"]) == sorted(want)
    assert all(any(f"[{kind}]" in r[1] for r in want) for kind in ("email", "phone", "card", "ip"))


def test_mixing_takes_what_the_sql_says(spark, stages, tmp_path):
    folder = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(stages["pii"], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(folder)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/*.parquet'")
    found = connection.execute(f"SELECT doc_id, copies FROM ({mixing.ORACLE_SQL})").fetchall()
    copies = dict(found)
    assert Counter(stages["mixing"]) == Counter({r: copies[r[0]] for r in stages["pii"] if copies[r[0]]})


def test_packing_holds_every_piece_once(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in stages["mixing"]:
        ids = [*library.encode(r[1], add_special_tokens=False).ids, 2]
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids), 1024), len(ids)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(r[0], piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    rows = stages["packing"]
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    at = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= 1024
