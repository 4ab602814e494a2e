import hashlib

import pytest
from pyspark.sql import functions as F

from missive.functions.text import similar, value_key, words
from missive.operators import archive, entity, facts, ingest, jobs, media, search, sessions


def messages(spark, rows):
    return spark.createDataFrame(rows, "id long, thread_id string, sent_at_unix long, plaintext string").withColumn("uid", F.concat(F.lit("u"), "id"))


def test_sessions_split_at_the_gap_itself(spark):
    rows = [(1, "a", 0, ""), (2, "a", 14_399, ""), (3, "a", 28_799, ""), (4, "a", 28_799, "")]
    got = sessions.sessions(messages(spark, rows)).orderBy("started_at_unix").collect()
    assert [(r.started_at_unix, r.message_count) for r in got] == [(0, 2), (28_799, 2)]


@pytest.mark.parametrize(
    ("texts", "verdict"),
    [(["on my way", "ok", "👍", "5 min", "here"], False), ([" ", ""], False), (["x" * 60], True), (["are we going to the lake at noon?", "yes we will"], True)],
)
def test_substance(spark, texts, verdict):
    rows = messages(spark, [(k, "a", k, t) for k, t in enumerate(texts)])
    assert sessions.substantive(rows, ["thread_id"]).first().is_substantive is verdict


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("Acme", "acme.", True), ("Acme", "Acme Corp", True), ("Berlin", "Berlin, Germany", True), ("the cinema", "cinema", True), ("Berlin", "Prague", False), ("two", "three", False)],
)
def test_similar(spark, a, b, same):
    rows = spark.createDataFrame([(a, b)], "a string, b string")
    assert rows.select(similar(value_key(F.col("a")), value_key(F.col("b"))).alias("s")).first().s is same


def test_pages_with_ties(spark):
    rows = messages(spark, [(k, "a", 100, "") for k in range(10)]).withColumn("sender_identity_id", F.lit("x")).withColumn("kind", F.lit("message"))
    first = archive.thread_page(rows, "a", 4).collect()
    second = archive.thread_page(rows, "a", 4, (first[-1].sent_at_unix, first[-1].id)).collect()
    assert [r.id for r in first + second] == [9, 8, 7, 6, 5, 4, 3, 2]


def test_query_grammar():
    terms = search.parse_query('foo-bar "two words" ... "open éa')
    assert [(t.words, t.prefix) for t in terms] == [(("foo", "bar"), True), (("two", "words"), False), (("open", "ea"), False)]


def test_search_counts_expansions_as_one_term_and_empty_queries_find_nothing(spark):
    docs = spark.createDataFrame([(1, "fox foxes box"), (2, "foxtrot"), (3, "x")], "id long, body string")
    assert {r.id for r in search.search(docs, "fox").collect()} == {1, 2}
    assert search.search(docs, "...").count() == 0
    assert search.capped_count(search.search(docs, "fox"), 1).first() == (1, False)


def test_snippet_runs():
    runs = search.cut_snippet("a b c d e f g h i j k l m Fox n", search.parse_query("fox"))
    assert ("Fox", True) in runs and runs[0][0].startswith("…")


def test_enqueue_twice_is_one_job_and_a_new_hash_revives_it(spark):
    queue = spark.createDataFrame([("k", "s", "done", 2, "h", 1)], "kind string, subject_id string, state string, attempts long, input_hash string, priority long")
    wanted = lambda h: spark.createDataFrame([("k", "s", h, 1)], "kind string, subject_id string, input_hash string, priority long")
    assert jobs.enqueue(queue, wanted("h")).first().state == "done"
    again = jobs.enqueue(queue, wanted("i")).first()
    assert (again.state, again.attempts, again.input_hash) == ("pending", 0, "i")


def test_commit_is_idempotent(spark):
    stored = spark.createDataFrame([("a", "1"), ("b", "2")], "uid string, content_hash string")
    batch = spark.createDataFrame([("b", "3"), ("c", "4")], "uid string, content_hash string")
    once = ingest.commit(batch, stored)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, ingest.commit(batch, once).collect())) == [("a", "1"), ("b", "3"), ("c", "4")]
    assert tuple(ingest.commit_stats(batch, stored).first()) == (1, 1, 0)


def test_fold_roots_follow_chains_and_drop_dangling_ones(spark):
    fact = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None), ("x", "gone")], "id string, merged_into string")
    assert sorted(map(tuple, facts.fold_roots(fact).collect())) == [("a", "c"), ("b", "c")]


def test_owner_needs_two_threads(spark):
    roster = spark.createDataFrame([("s", "1", "me"), ("s", "1", "x"), ("s", "2", "me"), ("t", "3", "me")], "source_id string, thread_id string, member string")
    assert [tuple(r) for r in entity.infer_owner(roster).collect()] == [("s", "me")]


def test_retired_sessions_lose_their_extracted_facts(spark):
    from missive.operators import facts

    session = spark.createDataFrame([("s1",), ("s2",)], "session_id string")
    artifact = spark.createDataFrame([("a1", "s1"), ("a2", "s2"), ("a3", None)], "id string, session_id string")
    rows = [("f1", "a1", "extracted", None, None), ("f2", "a1", "user_edited", None, None), ("f3", "a2", "extracted", None, "f1"), ("f4", None, "extracted", None, "f2"), ("f5", "a1", "extracted", 3, None)]
    fact = spark.createDataFrame(rows, "id string, artifact_id string, source string, retracted_at long, merged_into string")
    left, detached, after = facts.retire_sessions(session, artifact, fact, session.where("session_id = 's1'"), 9)
    assert [r[0] for r in left.collect()] == ["s2"] and sorted(map(tuple, detached.collect()), key=str) == [("a1", None), ("a2", "s2"), ("a3", None)]
    assert {r.id: (r.retracted_at, r.merged_into) for r in after.collect()} == {"f1": (9, None), "f2": (None, None), "f3": (None, None), "f4": (None, "f2"), "f5": (3, None)}


def test_unmerge_rename_dismiss(spark):
    import pytest

    from missive.operators import entity

    identity = spark.createDataFrame([("i1", "Ann"), ("i2", "Annie"), ("i0", "Me")], "id string, display_name string")
    bridge = spark.createDataFrame([("i1", "p1", "auto"), ("i2", "p1", "manual"), ("i0", "p0", "seed")], "identity_id string, person_id string, confidence string")
    person = spark.createDataFrame([("p1", "Ann", False), ("p0", "Me", True)], "id string, display_name string, is_owner boolean")
    links, people = entity.unmerge(identity, bridge, person, "i2")
    assert {r.identity_id: r.person_id for r in links.collect()} == {"i1": "p1", "i2": "p:i2:own", "i0": "p0"}
    assert {r.id: r.display_name for r in people.collect()} == {"p1": "Ann", "p0": "Me", "p:i2:own": "Annie"}
    for bad in ("i0", "i9"):
        with pytest.raises(ValueError):
            entity.unmerge(identity, bridge, person, bad)
    assert {r.display_name for r in entity.rename(person, "p1", "Zoe").collect()} == {"Zoe", "Me"}
    none = spark.createDataFrame([], "left_id string, right_id string")
    twice = entity.dismiss(entity.dismiss(none, "b", "a"), "a", "b")
    assert [tuple(r) for r in twice.collect()] == [("a", "b")] and entity.restore(twice, "b", "a").isEmpty()
    moved = entity.move_facts(spark.createDataFrame([("f", "p1"), ("g", "p2")], "id string, subject_person_id string"), "p1", "p2")
    assert {r.subject_person_id for r in moved.collect()} == {"p2"}


def test_edited_and_deleted_facts_take_what_was_folded_into_them_along(spark):
    rows = [("a", "old", 0.5, "extracted", None, None), ("b", "older", 0.4, "extracted", "a", 7), ("c", "else", 0.3, "extracted", None, None)]
    fact = spark.createDataFrame(rows, "id string, object_text string, confidence double, source string, merged_into string, retracted_at long")
    citation = spark.createDataFrame([("a", 1), ("c", 2)], "fact_id string, message_id long")
    edited, cited = facts.edit(fact, citation, "a", "new", "n")
    assert {r.id: (r.object_text, r.confidence, r.source, r.merged_into) for r in edited.collect()} == {
        "a": ("old", 0.5, "extracted", "n"), "b": ("older", 0.4, "extracted", "n"), "c": ("else", 0.3, "extracted", None), "n": ("new", 1.0, "user_edited", None)
    }
    assert sorted(map(tuple, cited.collect())) == [("a", 1), ("c", 2), ("n", 1)]
    assert facts.edit(fact, citation, "none", "new", "n")[0].count() == 3
    deleted = {r.id: (r.source, r.retracted_at) for r in facts.delete(fact, "a", 9).collect()}
    assert deleted == {"a": ("user_deleted", 9), "b": ("user_deleted", 7), "c": ("extracted", None)}


def test_lost_facts_read_the_latest_extract_only(spark):
    extract = spark.createDataFrame([("s", 1, 1, '{"facts": 9}'), ("s", 2, 2, '{"facts": 1}'), ("t", 1, 3, '{"facts": 2}'), ("u", 1, 4, "no json"), ("v", 1, 5, None)], "session_id string, created_unix long, id long, payload string")
    fact = spark.createDataFrame([("s", "extracted"), ("t", "extracted"), ("t", "user_edited")], "session_id string, source string")
    assert [tuple(r) for r in facts.lost(extract, fact).collect()] == [("t", 2, 1)]


def test_media_by_size_kind_and_newest_reading(spark):
    schema = "media_id long, message_id long, kind string, byte_size long, sent_at_unix long"
    rows = [(1, 10, "photo", 5 << 20, 50), (1, 11, "photo", 5 << 20, 40), (2, 12, "photo", (5 << 20) + 1, 40), (3, 13, "file", 1, 40), (4, 14, None, None, 40), (5, 15, "voice", 6 << 20, 40)]
    reference = spark.createDataFrame(rows, schema)
    readings = spark.createDataFrame([(5, "m", "p"), (1, "m", "other")], "media_id long, model string, prompt string")
    assert [tuple(r) for r in media.pending(reference, readings, "m", "p").collect()] == [(1, 50)]
    assert sorted(map(tuple, media.anchors(reference).collect())) == [(1, 11), (5, 15)]
    texts = spark.createDataFrame([(1, 1, "a"), (1, 2, " "), (2, 1, ""), (2, 2, "b"), (3, 1, None)], "media_id long, id long, text string")
    assert [tuple(r) for r in media.searchable(texts).collect()] == [(2, 2, "b")]


def test_backup_refuses_to_overwrite(spark, tmp_path):
    archive.backup({"t": spark.range(3)}, str(tmp_path / "copy"))
    assert spark.read.parquet(str(tmp_path / "copy/t")).count() == 3
    with pytest.raises(Exception, match="(?i)exists"):
        archive.backup({"t": spark.range(3)}, str(tmp_path / "copy"))


def test_a_revision_needs_more_than_other_white_space_in_its_entities(spark):
    schema = "uid string, content_hash string, text string, service_action string, entities string"
    stored = spark.createDataFrame([("a", "1", "x", None, '[{"b": 1, "a": 2}]'), ("b", "1", "x", None, None), ("c", "1", "x", "join", "[]"), ("d", "1", "x", None, '{"b":1,"a":2}'), ("e", "1", "x", None, "[")], schema)
    batch = spark.createDataFrame([("a", "2", "x", None, '[{"b":1,"a":2}]'), ("b", "2", "y", None, None), ("c", "1", "z", None, "[]"), ("d", "2", "x", None, '{"a":2,"b":1}'), ("e", "2", "x", None, "["), ("f", "2", "x", None, "[")], schema)
    assert sorted((r.uid, r.text, r.entities) for r in ingest.reconcile(batch, stored).collect()) == [("b", "x", None), ("d", "x", '{"b":1,"a":2}')]


def test_files_are_stored_once_by_their_content(spark, tmp_path):
    for name, content in (("a.JPG", b"one"), ("b.png", b"one"), ("d.txt", b"two")):
        (tmp_path / name).write_bytes(content)
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    # Spark's source leaves empty files out
    rows = media.stored_files(files.unionByName(spark.createDataFrame([("c", b"")], "path string, content binary"))).collect()
    found = {bytes(r.content): r for r in rows}
    assert sorted(found) == [b"", b"one", b"two"] and len(rows) == 3
    one = found[b"one"]
    assert one.hash == hashlib.sha256(b"one").hexdigest() and one.byte_size == 3
    assert one.stored_path == f"{one.hash[:2]}/{one.hash[2:4]}/{one.hash}.jpg"
    assert found[b""].stored_path.endswith(found[b""].hash)


def test_committed_facts_yield_to_the_user_and_end_what_they_supersede(spark):
    schema = "id string, session_id string, subject_person_id string, predicate string, object_text string, valid_from long, valid_to long, retracted_at long, source string"
    fact = spark.createDataFrame([("a", "s", "p", "likes", "Tea", 1, None, None, "extracted"), ("b", "s", "p", "owns", "Cat", 1, None, None, "user_deleted"), ("c", "t", "p", "lives", "X", 1, None, None, "extracted"), ("d", None, "p", "lives", "W", 1, 5, None, "extracted")], schema)
    rows = [("n1", "s", "p", "owns", "CAT", 9, None, None, "extracted", None), ("n2", "s", "p", "lives", "Y", 9, None, None, "extracted", "c"), ("n3", "s", "p", "lives", "Z", 8, None, None, "extracted", "c"), ("n4", "s", "p", "lives", "Z", 8, None, None, "extracted", "d")]
    proposed = spark.createDataFrame(rows, schema + ", supersedes string")
    read = spark.createDataFrame([("s",), ("s",)], "session_id string")
    got = {r.id: (r.retracted_at, r.valid_to) for r in facts.commit(fact, proposed, read, 7).collect()}
    assert got == {"a": (7, None), "b": (None, None), "c": (None, 8), "d": (None, 5), "n2": (None, None), "n3": (None, None), "n4": (None, None)}


def test_overlapping_phrases_count_each(spark):
    rows = spark.createDataFrame([("a a a b",), ("ab a",), ("",), (None,)], "text string")
    count = lambda query: [r[0] for r in rows.select(search.occurrences(search.parse_query(query)[0], words(F.col("text")))).collect()]
    assert count('"a a"') == [2, 0, 0, None]
    assert count("a") == [3, 2, 0, None]
    assert count('"a b"') == [1, 0, 0, None]
    assert count('"ab"') == [0, 1, 0, None]
