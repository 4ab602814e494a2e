"""Each operator against a brute-force version or an exact round trip, on small tables with odd rows."""

import hashlib
import html
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from missive.llm import html_text, jaccard_join, licenses, metric_join, mixing, packing, pii, quality, token_counts, transport_stream

ODD = [None, "", " \n\t ", "a", "a", "It's  DON'T'll ²½Ⅷ 12 __x_ýé ΑΣ İ <|endoftext|> aaaa !!'s!?", "日本 語\x00 \x1c\x85z", "w " * 30000, "x@y.zz 1.2.3.4 and +1 (555) 555-1234, card 4111 1111 1111 1111"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", None if k % 5 == 0 else f"s{k % 3}", 1) for k, t in enumerate(ODD)] + [(3, "a", "en", "s0", 1), (None, "null id", None, "s1", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("target", F.lit("x")).withColumn("n", F.lit(0))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where(F.lit(False))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_token_counts_equal_the_library(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = Counter(map(tuple, token_counts.count_tokens(docs).collect()))
    want = Counter()
    for r in docs.collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        want[(r.doc_id, len((r.text or "").encode()), n, n > 2048)] += 1
    assert got == want
    assert token_counts.count_tokens(empty).count() == 0


def test_token_counts_of_rare_characters():
    """Characters that Python's Unicode tables class, compose or lower in another way than the library's."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, counter = Tokenizer.from_file(path), token_counts.WordBpeCounter(path)
    rng = random.Random(9)
    rare = [chr(c) for c in (0x898, 0x1C89, 0xA7CB, 0xA7DC, 0xC3C, 0x1715, 0x10D50, 0x1C5F0, 0x24F0, 0x1680, 0x1C, 0xE9, 0x323, 0x41, 0x20)]
    texts = ["".join(rng.choice(rare + [chr(rng.randrange(0xE000, 0x20000))]) for _ in range(rng.randrange(40))) for _ in range(2000)]
    assert counter(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_license_rules(spark, empty):
    mit = "The MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nThe software is provided \"as is\", without warranty of any kind, express or implied"
    rows = [(1, "x\nLicensed under CC BY-NC 4.0. Released under the MIT License.\ny"), (2, mit), (3, None), (4, ""), (5, "a license, but which?")]
    got = {r.doc_id: (r.licenses, r.n_rules) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("CC-BY-NC-4.0,MIT", 2), 2: ("MIT", 1), 3: ("", 0), 4: ("", 0), 5: ("", 0)}
    assert licenses.scan_licenses(empty).count() == 0
    assert all(re.search(licenses.HINT, form) for forms in licenses.SENTENCES.values() for form in forms)


def test_html(spark):
    article = "<article><header><h1>T &amp;\n x</h1></header><p>one<p><b>two</b><br>more<aside>no</aside><div class='comments'><p>no</div></article>"
    page = "<html><head><title>no</title><style>p{}</style><script>var t='<p>no</p>'</script></head><body><nav><ul><li>no</ul></nav><!-- no --><div class=ad>no</div>" + article + "<footer>no"
    plain = lambda own: f"<div>Site name</div><p>{own}</p><p>All the same here</p>"
    rows = [(1, "http://a.b/x/1", page), (2, "http://a.b/y/1", plain("first")), (3, "http://a.b/y/2", plain("second")), (4, None, None), (5, "http://c.d", ""), (5, "http://c.d", "")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))).collect()
    assert sorted((r.page_id, r.text) for r in got) == [(1, "T & x\none\ntwo more"), (2, "first"), (3, "second"), (4, ""), (5, ""), (5, "")]
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_common_lines_is_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert len(html_text.common_lines(a, b)) == table[-1][-1]


def brute_components(texts):
    sets = {}
    for k, t in texts.items():
        w = words(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k)) for k in sets}


@pytest.mark.parametrize(("chunk", "frequent", "entries"), [(400_000, 1 << 20, 2_000_000), (300, 2, 2_000_000), (300, 4, 50)])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, chunk, frequent, entries):
    """Also with stars of many chunks, lists of frequent elements as rows, and many buckets that are sent and read in parts."""
    monkeypatch.setattr(jaccard_join, "CHUNK_ELEMENTS", chunk)
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard_join, "TIMES_MEAN", 1)
    monkeypatch.setattr(jaccard_join, "SEND_ENTRIES", entries)
    monkeypatch.setattr(jaccard_join, "BUCKET_ENTRIES", entries)
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = rng.choices(vocabulary, k=40)
    texts, k = {}, 0
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.choice([3, 5, 7, 20, 60, 150])) + rng.choice([[], passage])
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary).upper()
            texts[k] = " ".join(copy) + rng.choice(["", "\n", "  "])
            k += 1
    texts |= {1000 + i: t for i, t in enumerate(ODD)}
    rows = spark.createDataFrame([*texts.items(), (0, texts[0])], "doc_id long, text string").withColumn("n", F.lit("clash"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_components(rows).collect()}
    assert got == brute_components(texts)


def test_jaccard_join_of_nothing(empty):
    assert jaccard_join.join_components(empty).count() == 0


def test_lists_hold_every_linked_pair_in_blocks_that_are_read():
    """A pair at the threshold meets in a list, in blocks that are not skipped for one another, whatever the counters say."""
    rng = np.random.default_rng(2)
    for n in [1, 2, 4, 5, 9, 10, 17, 40, 100, 333]:
        for _ in range(30):
            common = jaccard_join.mix64(rng.integers(1, 1 << 62, n).astype(np.uint64))
            own = int(0.25 * n)  # |x & y| / |x | y| = n / (n + own)
            split = int(rng.integers(0, own + 1))
            extra = jaccard_join.mix64(rng.integers(1, 1 << 62, own).astype(np.uint64))
            x, y = np.sort(np.append(common, extra[:split])), np.sort(np.append(common, extra[split:]))
            levels = jaccard_join.frequency_levels(rng.integers(0, 40, 1 << jaccard_join.COUNTER_BITS))
            name, of, block, _ = jaccard_join.list_entries(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), levels)
            mine = dict(zip(name[of == 0].tolist(), block[of == 0].tolist()))
            assert any(k in mine and mine[k] + b <= jaccard_join.BLOCKS for k, b in zip(name[of == 1].tolist(), block[of == 1].tolist())), n
            assert block.max() <= jaccard_join.BLOCKS


def test_lists_skip_blocks_that_are_too_late():
    lists = jaccard_join._Lists()
    assert lists.read(3, np.array([7, 7, 8], np.uint32), np.array([1, 2, 3])).tolist() == [[1, 2]]
    assert lists.read(5, np.array([7, 8], np.uint32), np.array([4, 5])).tolist() == [[1, 4], [3, 5]]
    assert lists.read(6, np.array([7, 9, 9], np.uint32), np.array([6, 7, 8])).tolist() == []


def test_counters_are_whole(spark, docs):
    from missive.llm.common import text_bytes

    found = jaccard_join.sketches(docs.select("doc_id", "text").repartition(3))
    levels, total = jaccard_join.total_levels(found.where("slice IS NOT NULL"))
    values, _ = jaccard_join.shingle_sets(*text_bytes(docs.select("text").toArrow().column("text").combine_chunks()))
    counts = np.bincount((values >> np.uint64(64 - jaccard_join.COUNTER_BITS)).astype(int), minlength=1 << jaccard_join.COUNTER_BITS)
    assert total == len(values) and levels.tolist() == jaccard_join.frequency_levels(counts).tolist()


def test_mixing(docs, empty):
    got = mixing.mixed(docs).collect()
    again = mixing.mixed(docs).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    assert len(got) == docs.count() and all(r.taken == r.copies * r.size <= 2 * r.size for r in got)
    assert {r.doc_id: r.size for r in got}[1] == 0
    assert mixing.mixed(empty).count() == 0
    assert Counter(r.doc_id for r in mixing.mix(docs.where("doc_id = 7")).collect())[7] in (1, 2)


def test_mixing_targets(spark):
    sizes = spark.createDataFrame([("0a", 100), ("0b", 1000), ("0c", 10), ("1", 0)], "key string, source_size long")
    got = {r.key: r.target for r in mixing.targets(sizes, (5, 2, 1), 1.5, 2.0).collect()}
    assert got == {"0a": 200.0, "0b": 1445.0, "0c": 20.0, "1": 0.0}


def brute_spans(t):
    def digits(s):
        return re.sub("[^0-9]", "", s)

    out = []
    for kind, pattern, good in (
        ("email", pii.EMAIL, lambda m: True),
        ("ip", pii.IP, lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", pii.CARD, lambda m: 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))),
        ("phone", pii.PHONE, lambda m: 8 <= len(digits(m)) <= 15),
    ):
        out += [f"{kind}:{m.start()}:{m.end()}" for m in pattern.finditer(t) if good(m.group())]
    return out


def test_base_spans_equal_plain_patterns():
    rng = random.Random(5)
    parts = ["a", "b.", "@", "@x.", ".c", "1", "22", "4111 1111 1111 1111", " ", "-", "+1", "(706)", "\n", "é", "%", "10.0.0.", "255", "4111-1111111111 11"]
    for _ in range(5000):
        t = "".join(rng.choices(parts, k=rng.randrange(1, 14)))
        assert [f"{k}:{a}:{b}" for k, a, b in pii.base_spans(t)] == brute_spans(t), t


def test_spans_of_long_runs_take_linear_time():
    n = 200_000
    for text in ("1" * n, "a" * n, "a" * n + "@", "1." * n, "a@" * n, "a [at] " * (n // 4), "0" * 5000 + ".1.1.1"):
        assert len(pii.candidates(text)) == (text.startswith("0") or (n // 4 if text.startswith("1.") else 0)), text[:10]
    assert len(pii.candidates("a@b.co " * 20_000 + "(555) 123-4567 " * 3000)) == 23_000


def test_spelled_addresses_equal_a_plain_pattern():
    plain = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:" + pii.SPELLED_AT.pattern + ")")
    rng = random.Random(3)
    parts = ["bob", " ", "[at]", "(at)", "{at}", "[dot]", " [dot] ", ".", "x.org", "-", "_", "é", "a [at] b.c"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert list(pii._spelled_emails(t)) == [m.span() for m in plain.finditer(t)], t


def test_pii(spark, docs, empty):
    got = {r.doc_id: r for r in pii.digest(pii.find_pii(docs)).collect()}
    row = got[8]
    base = brute_spans(ODD[8])
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 1, 1)
    assert row.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
    assert set(base) <= set(row.spans.split(","))
    assert got[1].spans == "" and got[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find_pii(empty).count() == 0
    texts = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert texts[8].startswith("[email] [ip] and [phone], card [card]") and texts[0] is None and texts[3] == "a"


def test_reliabilities_and_added_spans():
    votes = np.array([[2, 2, 2], [2, 2, 0], [1, 2, 2], [1, 1, 1], [1, 1, 0]])
    model = pii.estimate(votes, np.array([50, 60, 10, 80, 40]))
    p = model.posterior(votes)
    assert p[0] > 0.9 and p[2] > 0.5 and p[3] < 0.1


def test_transport_stream_round_trip_and_faults():
    rng = random.Random(1)
    for n in [0, 1, 170, 183, 184, 185, 575, 576, 577, 9215, 9216, 9217, 50_000]:
        data = transport_stream.padded(rng.randbytes(n))
        program = transport_stream.demux(transport_stream.mux(data))
        assert program.payload == data and len(data) % 576 == 0
        assert program.timestamps == [k * transport_stream.TICKS for k in range(-(-len(data) // transport_stream.ACCESS_UNIT))]
    stream = bytearray(transport_stream.mux(b"x" * 3000))
    with pytest.raises(transport_stream.BadStream):
        transport_stream.demux(bytes(stream[: 188 * 3] + stream[188 * 4 :]))
    stream[20] ^= 1
    with pytest.raises(transport_stream.BadStream):
        transport_stream.demux(bytes(stream))


def test_media_columns(docs, empty):
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in transport_stream.stream_digest(transport_stream.media_columns(docs)).collect():
        data = transport_stream.padded((texts[r.doc_id] or "").encode())
        assert (r.payload_bytes, r.payload_sha256) == (len(data), hashlib.sha256(data).hexdigest())
    assert transport_stream.stream_digest(transport_stream.media_columns(empty)).count() == 0


def test_quality(spark, docs, empty):
    rng = random.Random(3)
    good = lambda: " ".join(rng.choices(["the", "of", "and", "reti", "ther", "on"], k=60)) + "."
    bad = lambda: "### ".join(rng.choices(["the", "of", "and", "reti"], k=60))
    rows = [(k, bad() if k % 4 == 0 else good(), int(k % 4 != 0)) for k in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(table.drop("quality"), table.drop("text"))
    scored = quality.score(table, model).join(table, "doc_id").where("held_out").collect()
    assert len(scored) > 20 and all(r.predicted == r.quality for r in scored)
    assert quality.score(docs, model).count() == docs.count() and quality.score(empty, model).count() == 0
    nothing = quality.fit(empty, table.drop("text").where(F.lit(False)))
    assert {r.score for r in quality.score(docs, nothing).collect()} == {0.5}


@pytest.mark.parametrize("small", [False, True])
def test_metric_join_equals_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in {"PER_PIVOT": 10, "CHUNK_VECTORS": 7, "ASSIGN_ROWS": 9}.items():
            monkeypatch.setattr(metric_join, name, value)
    rng = np.random.default_rng(7)
    vectors = []
    for k in range(60):
        base = rng.normal(size=6)
        vectors += [(base + rng.normal(size=6) * 0.25).tolist() for _ in range(1 + k % 3)]
    rows = [(k, [float(np.float32(x)) for x in v], k % 2) for k, v in enumerate(vectors)]
    rows += [(900, rows[0][1], 0), (901, None, 0), (902, [0.0] * 6, 0), (903, [float("nan")] * 6, 1), (904, [1.0, None], 1), (905, rows[1][1], None), (906, [], 1), (907, [1.0], 0), (908, [2.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in metric_join.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    sound = {k: np.array(v, float) for k, v, label in rows if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    label = {k: x for k, _, x in rows}
    near = {k: {j for j, b in sound.items() if j != k and label[j] == label[k] and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93} for k, a in sound.items()}
    for k, _, _ in rows:
        seen, todo = {k}, [k]
        while todo:
            new = near.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        assert got[k] == (len(near.get(k, ())), min(seen), min(seen) == k), k


def test_packing(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    import zlib

    pieces = packing.pack_documents(docs).collect()
    want = Counter()
    for r in docs.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        starts = [0, *range(first, len(ids), 1024)]
        for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            want[(r.doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == want
    at = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 1024
    assert packing.pack_documents(empty).count() == 0


def test_sum_of_squares_is_close_to_the_bound():
    lengths = np.sort(np.random.default_rng(0).integers(1, 1024, 5000))[::-1]
    sequence, _ = packing.sum_of_squares(lengths, 1024)
    assert sequence.max() + 1 <= -(-lengths.sum() // 1024) * 1.02


def test_sql_of_native_operators(spark):
    folder = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    for got, sql in ((mixing.op5_source_mixing(spark, folder), mixing.ORACLE_SQL), (licenses.op2_license_scan(spark, folder), licenses.oracle_sql())):
        found = connection.execute(sql)
        names = [c[0] for c in found.description]
        near = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
        assert sorted(near(r[n] for n in names) for r in got.collect()) == sorted(map(near, found.fetchall()))


def test_page_text_on_the_tables(spark):
    folder = "/root/testdata/sf0.001"
    for r in html_text.op3_html_text(spark, folder).join(spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "html"), "page_id").limit(50).collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S).group(1)
        want = "\n".join(x for x in (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)) if x)
        assert r.text == want
