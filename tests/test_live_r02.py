"""Streams, pages, folders, made-up archives, the index and the rules of extraction that queries don't show."""

import json

import pytest
from pyspark.sql import functions as F

from missive.functions.text import compatible, fold, folded, value_key, words
from missive.operators import archive, entity, facts, index, ingest, jobs, planning, search, sessions, vectors
from missive.sources import synthetic
from missive.streaming import backfill, folders
from missive.streaming import ingest as live


def line(uid, thread, number, text, event="message"):
    return json.dumps({"uid": uid, "thread_id": thread, "id": number, "sent_at_unix": number, "plaintext": text, "event": event})


def test_the_last_body_of_a_batch_counts_and_chats_are_asked_anew(spark, tmp_path):
    folder, target, mark = (tmp_path / n for n in ("in", "out", "mark"))
    folder.mkdir()
    wanted = ["a"]
    included = lambda: spark.createDataFrame([(w,) for w in wanted], "thread_id string")
    (folder / "1.json").write_text("\n".join([line("a/1", "a", 1, "first"), line("a/1", "a", 1, "second"), line("b/1", "b", 1, "left out")]))
    live.follow(spark, str(folder), str(target), str(mark), included).awaitTermination()
    wanted.append("b")
    (folder / "2.json").write_text("\n".join([line("a/2", "a", 2, "x", "deletion"), line("a/2", "a", 2, "x"), line("b/2", "b", 2, "kept")]))
    live.follow(spark, str(folder), str(target), str(mark), included).awaitTermination()
    want = [("a/1", "second", False), ("a/2", "x", True), ("b/2", "kept", False)]
    got = lambda path: sorted((r.uid, r.plaintext, r.deleted) for r in live.stored(spark, str(path)).collect())
    assert got(target) == want
    live.compact(spark, str(target), str(tmp_path / "one"))
    assert got(tmp_path / "one") == want


def test_deletions_without_a_chat(spark):
    message = spark.createDataFrame([("c/5", "c", 5), ("u/5", "u", 5), ("s/5", "s", 5), ("u/6", "u", 6), ("x/7", "x", 7)], "uid string, thread_id string, id long")
    chats = spark.createDataFrame([("s", "channel", "include", 0), ("u", "user", "include", 2), ("c", "chat", "include", 1), ("x", "user", "ignore", 3)], "thread_id string, peer_kind string, decision string, place int")
    deletions = spark.createDataFrame([(None, 5), ("s", 5), (None, 6), (None, 7), ("u", 9)], "thread_id string, id long")
    assert sorted(r.uid for r in live.resolve_deletions(deletions, message, chats).collect()) == ["c/5", "s/5", "u/6"]


def page(seq, phase, *ids, chat="c"):
    return json.dumps({"source_id": "s", "chat_id": chat, "seq": seq, "phase": phase, "messages": [{"id": i, "sent_at_unix": i, "plaintext": f"{i} at {seq}"} for i in ids]})


def test_backfill_goes_on_where_it_ended(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    run = lambda: backfill.replay(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    state = lambda: {r.chat_id: (r.oldest, r.done, r.newest) for r in backfill.progress(spark, str(tmp_path / "out")).collect()}
    (folder / "1.json").write_text(page(1, "backfill", 9, 10) + "\n" + page(1, "backfill", chat="empty"))
    run()
    assert state() == {"c": (9, False, 10), "empty": (None, True, None)}
    (folder / "2.json").write_text("\n".join([page(2, "backfill", 7, 8, 9), page(3, "backfill"), page(4, "catchup", 11, 12)]))
    run()
    assert state()["c"] == (7, True, 10)  # catching up hasn't ended
    (folder / "3.json").write_text("\n".join([page(5, "catchup"), page(6, "catchup", 13), page(4, "catchup", 11, 12)]))
    run()
    assert state()["c"] == (7, True, 12)
    assert [(r.id, r.plaintext) for r in backfill.messages(spark, str(tmp_path / "out")).orderBy("id").collect()] == [(7, "7 at 2"), (8, "8 at 2"), (9, "9 at 2"), (10, "10 at 1"), (11, "11 at 4"), (12, "12 at 4"), (13, "13 at 6")]


def test_one_folder_that_fails_does_not_stop_the_others(spark, tmp_path):
    good, bad = tmp_path / "good", tmp_path / "bad"
    good.mkdir(), bad.mkdir()
    (good / "chat.txt").write_text("[20/02/24, 10:00:00] A: hi\n", encoding="utf-8")
    (bad / "what.bin").write_text("?")
    known, seen = {}, []
    check = lambda: [(o.state, o.rows) for o in folders.check(spark, [str(tmp_path / "none"), str(bad), str(good)], known, lambda f, rows: seen.append(rows.count()))]
    assert check() == [("missing", 0), ("failed", 0), ("imported", 1)]
    assert check() == [("missing", 0), ("failed", 0), ("unchanged", 0)] and seen == [1]
    (good / "chat.txt").write_text("[20/02/24, 10:00:00] A: hi\n[21/02/24, 10:00:00] A: again\n", encoding="utf-8")
    assert check()[2] == ("imported", 2)


def test_made_up_archives_depend_on_the_seed_alone(spark):
    one = synthetic.messages(spark, 3000, 20, seed=4).orderBy("uid").collect()
    assert one == synthetic.messages(spark, 3000, 20, seed=4).repartition(7).orderBy("uid").collect()
    assert one != synthetic.messages(spark, 3000, 20, seed=5).orderBy("uid").collect()
    assert len({r.uid for r in one}) == 3000 and {r.thread_kind for r in one} == {"dm", "group"}
    times = [(r.thread_id, r.sent_at_unix) for r in one]
    assert len(set(times)) < len(times) and 100 < sum(r.media is not None for r in one) < 300
    found = sessions.session_members(synthetic.messages(spark, 3000, 20, seed=4).withColumnRenamed("text", "plaintext").withColumn("id", F.split("uid", "/")[2].cast("long")))
    assert found.agg(F.max("number")).first()[0] >= 10


def test_marks_fold_alike_in_queries_and_documents(spark):
    texts = ["мой дом", "żółw ŁÓDŹ", "Ő ű ě ё Ё", "été", "İstanbul", "日本語 x²", "ａｂ", "ΑΣ ΟΔΟΣ", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", folded(F.col("t")).alias("f"), words(F.col("t")).alias("w")).collect()
    for r in rows:
        assert fold(r.t) == r.f
    assert {r.t: r.w for r in rows}["мой дом"] == ["мои", "дом"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    for query, ids in (("мой", {0}), ("żółw", {1}), ("ő", {2}), ("été", {3}), ("zołw", {1}), ("łodz", {1})):
        assert {r.id for r in search.search(docs, query).collect()} == ids, query


def test_the_index_follows_commits(spark, tmp_path):
    folder = str(tmp_path / "index")
    docs = lambda *rows: spark.createDataFrame(list(rows), "id long, body string")
    find = lambda query, at=folder: [r.id for r in index.search(spark, at, query).orderBy("id").collect()]
    index.commit(docs((1, "the red fox"), (2, "a fox, the fox"), (3, None), (4, "red the fox")), folder, 0)
    assert (find("fox"), find('"the fox"'), find('"the red" fo'), find("..."), find("zebra")) == ([1, 2, 4], [2, 4], [1], [], [])
    index.commit(docs((1, "a zebra"), (5, "the fox")), folder, 1, deleted=docs((4, None)))
    assert (find("fox"), find("zebra"), find("red")) == ([2, 5], [1], [])
    index.commit(docs((4, "red again")), folder, 2)
    assert find("red") == [4]
    index.compact(spark, folder, str(tmp_path / "one"))
    for query in ("fox", "zebra", "red", '"the fox"'):
        assert index.search(spark, folder, query).collect() == index.search(spark, str(tmp_path / "one"), query).collect()


def test_a_batch_may_bring_a_key_twice(spark):
    stored = spark.createDataFrame([("a", "1")], "uid string, content_hash string")
    batch = spark.createDataFrame([("a", "2", 0), ("a", "1", 1), ("b", "1", 2), ("b", "1", 3), ("b", "2", 4)], "uid string, content_hash string, place int")
    assert tuple(ingest.commit_stats(batch, stored, order=["place"]).first()) == (1, 3, 1)
    once = ingest.commit(batch, stored, order=["place"])
    assert sorted(map(tuple, once.collect())) == [("a", "1"), ("b", "2")]


def test_merging_into_the_owner_must_be_confirmed(spark):
    person = spark.createDataFrame([("o", "O", True), ("p", "P", False)], "id string, display_name string, is_owner boolean")
    bridge = spark.createDataFrame([("i", "p", "auto"), ("me", "o", "seed")], "identity_id string, person_id string, confidence string")
    with pytest.raises(ValueError, match="confirmed"):
        entity.merge_identity(bridge, person, "i", "o")
    with pytest.raises(ValueError, match="confirmed"):
        entity.merge_people(bridge, person, "p", "o")
    with pytest.raises(ValueError, match="no such person"):
        entity.merge_identity(bridge, person, "i", "nobody")
    with pytest.raises(ValueError, match="no such identity"):
        entity.merge_identity(bridge, person, "x", "p")
    merged, people, emptied = entity.merge_identity(bridge, person, "i", "o", confirm_owner=True)
    assert emptied == "p" and [r.id for r in people.collect()] == ["o"] and {r.person_id for r in merged.collect()} == {"o"}


def test_no_owner_yet(spark):
    identity = spark.createDataFrame([("i", "Ann", "x", None, True)], "id string, display_name string, platform string, handle string, is_synthetic boolean")
    nobody = spark.createDataFrame([], "id string, display_name string, is_owner boolean")
    none = spark.createDataFrame([], "identity_id string, person_id string, confidence string")
    found, people, bridge = entity.ensure_identities(identity, identity.where("false"), nobody, none)
    assert [tuple(r) for r in bridge.collect()] == [("i", "p:i", "auto")]
    people, bridge = entity.seed_owner(found, people, bridge, "i")
    assert [tuple(r) for r in people.collect()] == [("owner", "Ann", True)] and [tuple(r) for r in bridge.collect()] == [("i", "owner", "auto")]


def test_values_in_compatible_forms(spark):
    rows = spark.createDataFrame([("ﬁne ＡＣＭＥ²",), ("The Plain",), (None,)], "v string")
    assert [r.k for r in rows.select(value_key(compatible(F.col("v"))).alias("k")).collect()] == ["fine acme2", "plain", None]


def test_corrections_end(spark):
    calls = [["a", "b"], ["b"], ["b"], ["b"]]
    asked = []

    def ask(refused):
        asked.append(list(refused))
        return calls[len(asked) - 1]

    assert planning.converse(ask, lambda c: c == "a") == (True, 3) and asked == [[], ["b"], ["b"]]
    assert planning.converse(lambda r: [], lambda c: True) == (False, 1)
    assert planning.converse(lambda r: ["a"], lambda c: True) == (True, 1)
    assert planning.converse(lambda r: ["b"], lambda c: False, finished=lambda: True) == (True, 1)


def test_staging_somebody_elses_archive(spark):
    message = spark.createDataFrame([(1, 10, "p"), (1, 11, "q")], "session_id long, message_id long, sender_person_id string")
    people = spark.createDataFrame([(1, "p"), (1, "q")], "session_id long, person_id string")
    fields = "id string, session_id long, place int, subject_person_id string, other_person_id string, predicate string, object_text string, claim_text string, confidence double, message_ids array<long>, valid_from long, valid_from_message_id long, valid_to long, valid_to_message_id long"
    base = ("p", None, "works_at", "Acme", "works at Acme", 0.9, [10], None, None, None, None)
    rows = [("own", 1, 0, *base), ("again", 1, 1, "p", None, "works_at", " ACME ", *base[4:]), ("told", 1, 2, *base[:6], [11], *base[7:]), ("pair", 1, 3, "q", "p", *base[2:]), ("none", 1, 4, *base[:6], None, *base[7:])]
    proposed = spark.createDataFrame(rows, fields)
    got = {r.id: (r.accepted, r.reason, r.evidence, r.staged) for r in facts.stage(proposed, message, people, 0, own_archive=False).collect()}
    assert got == {
        "own": (True, None, "self_report", True), "again": (True, None, "self_report", False), "told": (False, "reflected", "reflected", False),
        "pair": (True, None, "self_report", True), "none": (False, "uncited", "reflected", False),
    }


def test_prefixes_and_provenance(spark):
    assert sessions.prefix_for("Nomic-embed") == "search_document: " and sessions.prefix_for("e5-large", query=True) == "query: " and sessions.prefix_for("bge") == ""
    keyword = spark.createDataFrame([(1, 1, 7)], "id long, rank int, session_id long")
    nearest = spark.createDataFrame([(7, 1), (8, 2)], "session_id long, rank int")
    members = spark.createDataFrame([(1, 7, "a fox"), (2, 8, "x"), (3, 8, "the fox")], "id long, session_id long, plaintext string")
    hits = lambda p: {(r.id, r.found_by) for r in vectors.hybrid(keyword, nearest, members, ["fox"], p).collect()}
    assert hits(None) == hits("message") == {(1, "both"), (3, "meaning")} and hits("ocr") == {(1, "keyword")}


def test_context_at_a_threads_ends(spark):
    message = spark.createDataFrame([(k, "t", 5 if k < 3 else k) for k in range(12)] + [(99, "u", 0)], "id long, thread_id string, sent_at_unix long")
    got = {(r.id, r.distance) for r in archive.message_context_of(message, 1, radius=3).collect()}
    assert got == {(3, -3), (4, -2), (0, -1), (1, 0), (2, 1), (5, 2), (6, 3)}  # by time, then id
    assert {(r.id, r.distance) for r in archive.message_context_of(message, 3, radius=1).collect()} == {(3, 0), (4, 1)}
    assert archive.message_context_of(message, 1000).count() == 0


def test_the_index_follows_what_a_commit_changes(spark, tmp_path):
    fields = "id long, content_hash string, body string, place int"
    stored = spark.createDataFrame([(1, "a", "red fox", 0), (2, "b", "blue fox", 0)], fields)
    batch = spark.createDataFrame([(1, "a", "red fox", 1), (2, "x", "green", 2), (2, "c", "grey hen", 3), (3, "d", "fox", 4), (4, "e", "short lived", 5), (4, "f", "fox hen", 6)], fields)
    folder = str(tmp_path / "index")
    index.follow(stored, stored.where("false"), folder, 0)
    index.follow(batch, stored, folder, 1, order=["place"])
    find = lambda query: [r.id for r in index.search(spark, folder, query).orderBy("id").collect()]
    assert (find("fox"), find("hen"), find("blue"), find("green"), find("lived")) == ([1, 3, 4], [2, 4], [], [], [])
    written = spark.read.parquet(f"{folder}/documents").where("segment = 1")
    assert sorted(r.id for r in written.collect()) == [2, 3, 4]


def test_sessions_are_those_of_whole_threads(spark):
    """Over ends of days, ties, times before 1970 and none at all, sessions are those of one order of each thread."""
    import random

    rng = random.Random(3)
    rows = [(k, rng.choice(["a", "b", None]), rng.choice([None, -90_000, -1, 0, 5, 86_399, 86_400, 100_799, 100_800, 400_000, rng.randrange(-200_000, 800_000)])) for k in range(300)]
    message = spark.createDataFrame(rows, "id long, thread_id string, sent_at_unix long").withColumn("number", F.lit("mine"))
    got = {r.id: r.number for r in sessions.session_members(message.drop("number")).collect()}
    want = {}
    for thread in ("a", "b", None):
        number, before = 0, None
        for k, _, at in sorted((r for r in rows if r[1] == thread), key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
            number += before is None or at is None or at - before >= sessions.GAP
            want[k], before = number, at
    assert got == want


def test_a_running_job_keeps_its_lease(spark):
    """Asked for again with the same input, a running job isn't reclaimed; with another input it begins anew."""
    queue = spark.createDataFrame([("k", "same", "running", 1, "h", 5, 900), ("k", "other", "running", 2, "h", 5, 900), ("k", "left", "done", 1, "h", 5, None)], "kind string, subject_id string, state string, attempts long, input_hash string, priority long, lease_unix long")
    wanted = spark.createDataFrame([("k", "same", "h", 6), ("k", "other", "x", 6), ("k", "new", "h", 6)], "kind string, subject_id string, input_hash string, priority long")
    got = {r.subject_id: (r.state, r.attempts, r.lease_unix) for r in jobs.enqueue(queue, wanted).collect()}
    assert got == {"same": ("running", 1, 900), "other": ("pending", 0, None), "new": ("pending", 0, None), "left": ("done", 1, None)}
