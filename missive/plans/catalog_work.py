"""More archive queries by name with their SQL: identities, replayed batches, moved knowledge, coverage, planners, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import archive, diary, entity, facts, index, ingest, jobs, media, planning, search, sessions, vectors
from .catalog import _CO, _MEMBERS, _MONTHS, _NORM, _REFERENCE, _SESSIONS, ORACLES, QUERIES, _edges, _index, _months, _pending, _reference, _search_sql, query
from .model import frame, with_tables

__all__ = ["QUERIES", "ORACLES"]


# --- ingestion ---------------------------------------------------------------

_TWICE = """h AS (SELECT doc_id AS uid, 0 AS place, concat(text, CASE WHEN doc_id % 5 = 0 THEN '!' ELSE '' END) AS text FROM documents WHERE doc_id % 3 <> 0
              UNION ALL SELECT doc_id, 1, concat(text, CASE WHEN doc_id % 5 = 0 THEN '!' ELSE '' END) FROM documents WHERE doc_id % 2 = 0
              UNION ALL SELECT doc_id, 2, concat(text, '?') FROM documents WHERE doc_id % 7 = 0),
       b AS (SELECT uid, place, sha256(coalesce(text, '')) AS h, coalesce(lag(sha256(coalesce(text, ''))) OVER (PARTITION BY uid ORDER BY place), s.h) AS old
             FROM h LEFT JOIN (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents WHERE doc_id % 4 <> 0) s ON s.doc_id = h.uid)"""


def _twice(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored rows, and a batch that brings many of its keys two or three times."""
    rows = documents.select(F.col("doc_id").alias("uid"), F.coalesce("text", F.lit("")).alias("text"))
    marked = rows.withColumn("text", F.concat("text", F.when(F.col("uid") % 5 == 0, "!").otherwise("")))
    batch = marked.where("uid % 3 <> 0").withColumn("place", F.lit(0))
    batch = batch.unionByName(marked.where("uid % 2 = 0").withColumn("place", F.lit(1)))
    batch = batch.unionByName(rows.where("uid % 7 = 0").withColumn("text", F.concat("text", F.lit("?"))).withColumn("place", F.lit(2)))
    hashed = lambda t: t.withColumn("content_hash", ingest.content_hash("text"))
    return hashed(rows.where("uid % 4 <> 0")), hashed(batch)


@query("", f"WITH {_TWICE} SELECT count(*) FILTER (old IS NULL) AS inserted, count(*) FILTER (old <> h) AS revised, count(*) FILTER (old = h) AS skipped FROM b")
def replay_stats(documents):
    stored, batch = _twice(documents)
    return ingest.commit_stats(batch, stored, order=["place"])


@query("", f"WITH {_TWICE} SELECT uid, old AS old_hash, h AS new_hash FROM b WHERE old <> h")
def replay_revisions(documents):
    stored, batch = _twice(documents)
    return ingest.revisions(batch, stored, order=["place"])


@query("", f"WITH {_TWICE} SELECT uid, arg_max(h, place) AS content_hash FROM b GROUP BY 1 UNION ALL SELECT doc_id, sha256(coalesce(text, '')) FROM documents WHERE doc_id % 4 <> 0 AND doc_id NOT IN (SELECT uid FROM b)")
def replay_commit(documents):
    stored, batch = _twice(documents)
    once = ingest.commit(batch, stored, order=["place"])
    return ingest.commit(batch, once, order=["place"]).select("uid", "content_hash")


_BODIES = """o AS (SELECT id AS uid, concat('h', id) AS content_hash, plaintext AS text, CASE WHEN kind = 'service' THEN event_type END AS service_action,
              CASE WHEN id % 4 <> 0 THEN concat('[{"type":"bold","length":', id % 9, '}]') END AS entities FROM message),
       n AS (SELECT uid, CASE WHEN uid % 3 = 0 THEN 'new' ELSE content_hash END AS content_hash, CASE WHEN uid % 5 = 0 THEN 'other' ELSE text END AS text,
              CASE WHEN uid % 7 = 0 THEN 'pin' ELSE service_action END AS service_action, CASE WHEN uid % 12 = 3 THEN '[]' ELSE entities END AS entities FROM o)"""


@query("message", f"""WITH {_BODIES} SELECT o.* FROM o JOIN n USING (uid) WHERE o.content_hash <> n.content_hash
       AND (o.text IS DISTINCT FROM n.text OR o.service_action IS DISTINCT FROM n.service_action OR o.entities IS DISTINCT FROM n.entities)""")  # fmt: skip
def reconciled_bodies(message):
    """What a re-export replaces: it writes its JSON with white space, which is no change."""
    entities = F.when(F.col("id") % 4 != 0, F.concat(F.lit('[{"type":"bold","length":'), (F.col("id") % 9).cast("string"), F.lit("}]")))
    stored = message.select(F.col("id").alias("uid"), F.concat(F.lit("h"), F.col("id").cast("string")).alias("content_hash"), F.col("plaintext").alias("text"), F.when(F.col("kind") == "service", F.col("event_type")).alias("service_action"), entities.alias("entities"))
    batch = stored.withColumn("content_hash", F.when(F.col("uid") % 3 == 0, "new").otherwise(F.col("content_hash"))).withColumn("text", F.when(F.col("uid") % 5 == 0, "other").otherwise(F.col("text")))
    batch = batch.withColumn("service_action", F.when(F.col("uid") % 7 == 0, "pin").otherwise(F.col("service_action")))
    batch = batch.withColumn("entities", F.when(F.col("uid") % 12 == 3, "[]").otherwise(F.replace("entities", F.lit(":"), F.lit(" :  "))))
    return ingest.reconcile(batch, stored)


@query("person", "SELECT id, CASE WHEN id = 'p:8' THEN 'Somebody' ELSE display_name END AS display_name FROM person")
def renamed_people(person):
    return entity.rename(person, "p:8", "Somebody").select("id", "display_name")


@query("identity", "SELECT least(id, 'i:2') AS left_id, greatest(id, 'i:2') AS right_id FROM identity WHERE id NOT IN ('i:2', 'i:3') UNION SELECT 'i:7', 'i:9'")
def dismissed_pairs(identity):
    """Everybody's pair with i:2 was dismissed; one is taken back, one more is dismissed, twice."""
    pairs = identity.where("id <> 'i:2'").select(F.least("id", F.lit("i:2")).alias("left_id"), F.greatest("id", F.lit("i:2")).alias("right_id"))
    pairs = entity.restore(pairs, "i:3", "i:2")
    return entity.dismiss(entity.dismiss(pairs, "i:9", "i:7"), "i:7", "i:9")


def _known(identity: DataFrame, person: DataFrame, identity_person: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A store that lacks a quarter of the identities."""
    have = identity.where("id = 'i:owner' OR cast(substr(id, 3) AS bigint) % 4 <> 1")
    return have, person, identity_person.join(have.select(F.col("id").alias("identity_id")), "identity_id", "left_semi")


_NEW = "nw AS (SELECT id, display_name FROM identity WHERE id <> 'i:owner' AND substr(id, 3)::BIGINT % 4 = 1)"


@query("identity identity_person", f"WITH {_NEW} SELECT identity_id, person_id, confidence FROM identity_person WHERE identity_id NOT IN (SELECT id FROM nw) UNION ALL SELECT id, concat('p:', id), 'auto' FROM nw")
def new_identities(identity, person, identity_person):
    have, people, bridge = _known(identity, person, identity_person)
    return entity.ensure_identities(identity.unionByName(identity), have, people, bridge)[2]


@query("identity person identity_person", f"WITH {_NEW} SELECT id, display_name, is_owner FROM person UNION ALL SELECT concat('p:', id), display_name, false FROM nw")
def new_identity_people(identity, person, identity_person):
    return entity.ensure_identities(identity, *_known(identity, person, identity_person))[1]


@query("identity identity_person person", "SELECT identity_id, CASE WHEN identity_id = 'i:11' THEN 'owner' ELSE person_id END AS person_id, CASE WHEN identity_id = 'i:11' THEN 'auto' ELSE confidence END AS confidence FROM identity_person")
def seeded_owner(identity, person, identity_person):
    """A guessed owner: the identity is synthetic."""
    return entity.seed_owner(identity, person, identity_person, "i:11")[1]


@query("identity identity_person person", "SELECT id, display_name, is_owner FROM person WHERE is_owner OR id IN (SELECT person_id FROM identity_person WHERE identity_id <> 'i:100')")
def seeded_owner_people(identity, person, identity_person):
    """The person whose only identity turns out to be the owner's goes."""
    return entity.seed_owner(identity, person, identity_person, "i:100")[0]


@query("message thread_participant", "SELECT thread_id, concat(identity_id, '/silent') AS identity_id, min(first_seen_unix) AS first_seen_unix FROM thread_participant GROUP BY ALL HAVING min(first_seen_unix) IS NOT NULL")
def roster_participants(thread_participant):
    silent = thread_participant.withColumn("identity_id", F.concat("identity_id", F.lit("/silent")))
    roster = thread_participant.unionByName(silent).unionByName(silent.withColumn("first_seen_unix", F.col("first_seen_unix") + 9))
    return entity.ensure_participants(roster, thread_participant)


@query("identity identity_person person", "SELECT DISTINCT p.id, p.display_name, p.is_owner, p.ai_excluded FROM person p JOIN identity_person ip ON ip.person_id = p.id JOIN identity i ON i.id = ip.identity_id WHERE i.is_synthetic")
def people_synthetic(identity, identity_person, person):
    return archive.people_with_synthetic(person, identity_person, identity)


@query(
    "identity identity_person person",
    """WITH v AS (SELECT i.*, ip.person_id FROM identity i JOIN identity_person ip ON ip.identity_id = i.id),
       m AS (SELECT a.person_id FROM v a JOIN v b ON a.id <> b.id AND a.person_id <> b.person_id AND ((a.handle <> '' AND a.handle = b.handle)
             OR (lower(a.display_name) = lower(b.display_name) AND (a.platform <> b.platform OR a.is_synthetic OR b.is_synthetic))))
       SELECT id, display_name, is_owner, ai_excluded FROM person WHERE id IN (SELECT person_id FROM m)""",
)
def people_suggested(identity, identity_person, person, message):
    none = identity.where(F.lit(False)).select(F.col("id").alias("left_id"), F.col("id").alias("right_id"))
    return archive.people_with_suggestions(person, identity_person, entity.merge_suggestions(identity, identity_person, message, none, limit=None))


@query("sync_chat", "SELECT chat_id, CASE WHEN chat_id = 't:7' THEN 'include' ELSE decision END AS decision FROM sync_chat")
def decide_chat(sync_chat):
    return archive.decide(sync_chat, "t:7", "include").select("chat_id", "decision")


def search_count_if_truncated(spark, sf_dir):
    return search.count_if_truncated(index.search(spark, _index(spark, sf_dir), "the", limit=None), 200, 300)


QUERIES["search_count_if_truncated"] = search_count_if_truncated
ORACLES["search_count_if_truncated"] = with_tables("search_document", _search_sql("the", tail="SELECT least(count(*), 200) AS shown, least(count(*), 300) AS hits, count(*) < 300 AS exact FROM hit"))


# --- moved knowledge ---------------------------------------------------------

_EDGE = f"{_CO}, edge AS (SELECT concat(pa, '|', pb) AS id, pa AS person_a_id, pb AS person_b_id FROM e)"


def _knowledge(thread_participant: DataFrame, identity_person: DataFrame, fact: DataFrame, ai_job: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges, facts about people and about edges, jobs about people and threads; what was known of p:8 moves to p:9."""
    edge = _edges(thread_participant, identity_person).select(F.concat_ws("|", "person_a_id", "person_b_id").alias("id"), "person_a_id", "person_b_id")
    about = fact.select("id", "subject_person_id", F.lit(None).cast("string").alias("subject_edge_id"))
    both = edge.select(F.concat(F.lit("e/"), "id").alias("id"), F.lit(None).cast("string").alias("subject_person_id"), F.col("id").alias("subject_edge_id"))
    person = F.when(F.col("id") % 2 == 0, F.concat(F.lit("p:"), F.substring("subject_id", 3, 9)))
    job = ai_job.select("id", F.when(person.isNull(), "thread").otherwise("person").alias("subject_kind"), F.coalesce(person, "subject_id").alias("subject_id"))
    return entity.move_knowledge(about.unionByName(both), edge, job, "p:8", "p:9")


@query(
    "thread_participant identity_person fact",
    f"""WITH {_EDGE}, m AS (SELECT id, CASE WHEN person_a_id = 'p:8' THEN person_b_id WHEN person_b_id = 'p:8' THEN person_a_id END AS other FROM edge),
       k AS (SELECT m.id, x.id AS kept FROM m LEFT JOIN edge x ON x.person_a_id = least(m.other, 'p:9') AND x.person_b_id = greatest(m.other, 'p:9') WHERE other IS NOT NULL)
       SELECT id, CASE WHEN subject_person_id = 'p:8' THEN 'p:9' ELSE subject_person_id END AS subject_person_id, NULL::VARCHAR AS subject_edge_id FROM fact
       UNION ALL SELECT concat('e/', edge.id), NULL, coalesce(k.kept, edge.id) FROM edge LEFT JOIN k ON k.id = edge.id WHERE NOT (person_a_id = 'p:8' AND person_b_id = 'p:9')""",
)
def moved_knowledge(thread_participant, identity_person, fact, ai_job):
    return _knowledge(thread_participant, identity_person, fact, ai_job)[0]


@query(
    "thread_participant identity_person",
    f"""WITH {_EDGE}, m AS (SELECT id, least(other, 'p:9') AS a, greatest(other, 'p:9') AS b FROM (SELECT id, CASE WHEN person_a_id = 'p:8' THEN person_b_id ELSE person_a_id END AS other FROM edge
             WHERE person_a_id = 'p:8' OR person_b_id = 'p:8') WHERE other <> 'p:9')
       SELECT * FROM edge WHERE person_a_id <> 'p:8' AND person_b_id <> 'p:8' UNION ALL SELECT * FROM m WHERE (a, b) NOT IN (SELECT (person_a_id, person_b_id) FROM edge)""",
)
def moved_edges(thread_participant, identity_person, fact, ai_job):
    return _knowledge(thread_participant, identity_person, fact, ai_job)[1]


@query("ai_job", "SELECT id, CASE WHEN id % 2 = 0 THEN 'person' ELSE 'thread' END AS subject_kind, CASE WHEN id % 2 = 0 THEN concat('p:', substr(subject_id, 3)) ELSE subject_id END AS subject_id FROM ai_job WHERE NOT (id % 2 = 0 AND subject_id = 't:8')")
def moved_jobs(thread_participant, identity_person, fact, ai_job):
    return _knowledge(thread_participant, identity_person, fact, ai_job)[2]


@query(
    "thread_participant identity_person person fact fact_citation",
    f"""WITH {_EDGE}, f AS (SELECT id, subject_person_id, NULL::VARCHAR AS subject_edge_id, predicate, object_text, confidence, source, merged_into, retracted_at FROM fact WHERE substr(id, length(id)) <> '1'
          UNION ALL SELECT f.id, NULL, x.id, predicate, object_text, confidence, source, merged_into, retracted_at FROM fact f LEFT JOIN edge x ON x.id = concat('p:7|', subject_person_id) WHERE substr(f.id, length(f.id)) = '1'),
       r AS (SELECT f.*, CASE WHEN person_a_id = 'p:7' THEN person_b_id ELSE person_a_id END AS other FROM f LEFT JOIN edge x ON x.id = subject_edge_id AND 'p:7' IN (person_a_id, person_b_id)
             WHERE merged_into IS NULL AND retracted_at IS NULL AND source <> 'user_deleted' AND (subject_person_id = 'p:7' OR x.id IS NOT NULL)),
       c AS (SELECT coalesce(f.merged_into, f.id) AS id, count(*) AS citations, min(message_id) FILTER (f.merged_into IS NULL AND role = 'asserts') AS first_message FROM fact_citation c JOIN fact f ON f.id = c.fact_id GROUP BY 1)
       SELECT r.id, subject_person_id, p.display_name AS other_name, predicate, object_text, round(confidence, 6) AS confidence, source, coalesce(citations, 0) AS citations, first_message
       FROM r LEFT JOIN person p ON p.id = r.other LEFT JOIN c ON c.id = r.id""",
)
def person_facts(thread_participant, identity_person, person, fact, fact_citation):
    """What is known of p:7: every fact with number 1 is about them and its subject, if they share an edge."""
    edge = _edges(thread_participant, identity_person).select(F.concat_ws("|", "person_a_id", "person_b_id").alias("id"), "person_a_id", "person_b_id")
    paired = F.col("id").endswith("1")
    known = edge.select(F.col("id").alias("edge_id"), F.lit("p:7").alias("with")).where("edge_id LIKE 'p:7|%'")
    rows = fact.withColumn("edge_id", F.when(paired, F.concat(F.lit("p:7|"), "subject_person_id"))).join(known, "edge_id", "left")
    rows = rows.withColumn("subject_edge_id", F.when(F.col("with").isNotNull(), F.col("edge_id"))).withColumn("subject_person_id", F.when(~paired, F.col("subject_person_id")))
    return facts.facts_of(rows, fact_citation, edge, person, "p:7")


# --- sessions and their vectors ------------------------------------------------


@query("message", f"WITH {_SESSIONS} SELECT n.id, concat('s_', substr(sha256(concat(n.thread_id, '|', g.member_hash)), 1, 24)) AS session_id FROM n JOIN g ON g.thread_id = n.thread_id AND g.number = n.number")
def assigned_sessions(message):
    return sessions.assigned(message)


def _read(message: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spoken messages with their sessions where their thread was segmented, sessions, and extracts at two prompt versions."""
    spoken = message.where("kind = 'message'")
    segmented = spoken.where("cast(substr(thread_id, 3) AS bigint) % 5 <> 0")
    found = sessions.sessions(segmented).withColumn("substantive", F.col("message_count") >= 2)
    in_session = sessions.assigned(segmented)
    extract = found.where("started_at_unix % 3 = 0").select("session_id", F.when(F.col("started_at_unix") % 2 == 0, "v2").otherwise("v1").alias("prompt"))
    return spoken.join(in_session, "id", "left").select("id", "thread_id", "session_id"), found, extract


_READ = f"""WITH spoken AS (SELECT * FROM message WHERE kind = 'message'), {_MEMBERS.replace("FROM message", "FROM spoken WHERE substr(thread_id, 3)::BIGINT % 5 <> 0")},
       ss AS (SELECT thread_id, number, count(*) >= 2 AS sub, min(sent_at_unix) % 6 = 0 AS done FROM n GROUP BY 1, 2)"""
_SHARES = "round(CASE WHEN threads > 0 THEN threads_segmented / threads ELSE 0 END, 6) AS segmented_share, round(CASE WHEN substantive > 0 THEN extracted / substantive ELSE 0 END, 6) AS extracted_share"


@query(
    "message",
    f"""{_READ}, x AS (SELECT (SELECT count(DISTINCT thread_id) FROM spoken) AS threads, (SELECT count(DISTINCT thread_id) FROM ss) AS threads_segmented, (SELECT count(*) FROM spoken) AS messages,
         (SELECT count(*) FROM n) AS messages_in_sessions, (SELECT count(*) FROM ss) AS sessions, (SELECT count(*) FILTER (sub) FROM ss) AS substantive, (SELECT count(*) FILTER (sub AND done) FROM ss) AS extracted)
       SELECT *, {_SHARES} FROM x""",
)
def coverage_summary(message):
    return sessions.coverage_summary(*_read(message), "v2")


@query(
    "message thread_participant identity_person",
    f"""{_READ}, mine AS (SELECT DISTINCT person_id, tp.thread_id FROM thread_participant tp JOIN identity_person ip ON ip.identity_id = tp.identity_id),
       a AS (SELECT thread_id, count(*) AS m FROM spoken GROUP BY 1), c AS (SELECT thread_id, count(*) AS mi FROM n GROUP BY 1),
       d AS (SELECT thread_id, count(*) AS s, count(*) FILTER (sub) AS u, count(*) FILTER (sub AND done) AS e FROM ss GROUP BY 1),
       x AS (SELECT person_id, count(*) AS threads, count(s) AS threads_segmented, coalesce(sum(m), 0)::BIGINT AS messages, coalesce(sum(mi), 0)::BIGINT AS messages_in_sessions, coalesce(sum(s), 0)::BIGINT AS sessions,
                    coalesce(sum(u), 0)::BIGINT AS substantive, coalesce(sum(e), 0)::BIGINT AS extracted FROM mine LEFT JOIN a USING (thread_id) LEFT JOIN c USING (thread_id) LEFT JOIN d USING (thread_id) GROUP BY 1)
       SELECT *, {_SHARES} FROM x""",
)
def coverage_by_person(message, thread_participant, identity_person):
    per = thread_participant.join(identity_person, "identity_id").select("person_id", "thread_id")
    return sessions.coverage_summary(*_read(message), "v2", per)


@query("chat", "WITH message AS (SELECT * FROM chat), " + _MEMBERS + """ SELECT thread_id, number, concat('passage: ', substr(string_agg(concat(sender_identity_id, ': ', plaintext, chr(10)), '' ORDER BY sent_at_unix, id), 1, 4000)) AS text FROM n GROUP BY 1, 2""")
def session_passages(chat):
    """Texts of sessions as a model of the E5 family expects them."""
    rows = sessions.session_text(sessions.session_members(chat), ["thread_id", "number"])
    return rows.withColumn("text", F.concat(F.lit(sessions.prefix_for("multilingual-e5-large")), "text"))


@query("", f"""SELECT vec_id AS session_id, concat('m', vec_id % 2) AS model, CASE WHEN vec_id % 6 = 0 THEN 'old' ELSE 'new' END AS input_hash,
       CASE WHEN vec_id % 6 = 0 THEN [0.0, 0.0] ELSE [round(x / {_NORM}, 6) for x in embedding::DOUBLE[]][1:2] END AS first FROM embeddings""")  # fmt: skip
def vectors_written(embeddings):
    """Vectors of two models over stored ones, which stay where no new one has their session and model."""
    rows = embeddings.select(F.col("vec_id").alias("session_id"), F.concat(F.lit("m"), (F.col("vec_id") % 2).cast("string")).alias("model"), F.lit("new").alias("input_hash"), "embedding")
    stored = rows.where("session_id % 3 = 0").select("session_id", "model", F.lit("old").alias("input_hash"), F.array(F.lit(0.0), F.lit(0.0)).alias("vector"))
    out = vectors.write(stored, rows.where("session_id % 6 <> 0"))
    return out.select("session_id", "model", "input_hash", F.transform(F.slice("vector", 1, 2), lambda x: F.round(x, 6)).alias("first"))


# --- the queue and its planners ------------------------------------------------


@query("ai_job", "SELECT id, CASE WHEN id % 8 = 1 THEN 'done' WHEN id % 8 = 5 THEN 'needs_review' ELSE state END AS state, CASE WHEN id % 8 NOT IN (1, 5) THEN lease_unix END AS lease_unix FROM ai_job")
def job_complete(ai_job):
    done = ai_job.where("id % 8 IN (1, 5)").select("id", (F.col("id") % 8 == 5).alias("needs_review"))
    return jobs.complete(ai_job, done).select("id", "state", "lease_unix")


@query("ai_job", "SELECT id, CASE WHEN state = 'failed' THEN 'pending' ELSE state END AS state, CASE WHEN state = 'failed' THEN 0 ELSE attempts END AS attempts, CASE WHEN state <> 'failed' THEN lease_unix END AS lease_unix FROM ai_job")
def job_retry(ai_job):
    return jobs.retry(ai_job).select("id", "state", "attempts", "lease_unix")


@query("ai_job", "SELECT count(*) FILTER (false) AS jobs FROM ai_job")
def job_clear(ai_job):
    return jobs.clear(ai_job).agg(F.count("*").alias("jobs"))


@query("message", "SELECT id, sent_at_unix // 86400 AS priority FROM message")
def job_priority(message):
    return message.select("id", jobs.priority("sent_at_unix").alias("priority"))


@query("thread person", "SELECT id, id = 't:8' OR ai_excluded AS ai_excluded FROM thread UNION ALL SELECT id, ai_excluded AND id <> 'p:3' FROM person")
def exclusions(thread, person):
    """One thread more is left out, one person no longer."""
    return jobs.exclude(thread, ["t:8"]).select("id", "ai_excluded").unionByName(jobs.exclude(person, ["p:3"], False).select("id", "ai_excluded"))


_BARRED = """thread_id NOT IN (SELECT id FROM thread WHERE ai_excluded) AND thread_id NOT IN (SELECT t.id FROM thread t JOIN thread_participant tp ON tp.thread_id = t.id
       JOIN identity_person ip ON ip.identity_id = tp.identity_id JOIN person p ON p.id = ip.person_id WHERE t.kind = 'dm' AND p.ai_excluded)"""


def _to_read(message, thread, thread_participant, identity_person, person, opted_out=False):
    found = sessions.sessions(message).withColumn("substantive", F.col("message_count") >= 2)
    extract = found.where("started_at_unix % 3 = 0").select("session_id", F.when(F.col("started_at_unix") % 2 == 0, "v2").otherwise("v1").alias("prompt"))
    return planning.to_read(found, extract, thread, thread_participant, identity_person, person, "v2", opted_out)


_EXTRACTION = f"SELECT 'extract' AS kind, 'session' AS subject_kind, session_id AS subject_id, concat(member_hash, '|v2') AS input_hash, ended_at_unix // 86400 AS priority FROM session WHERE message_count >= 2 AND started_at_unix % 6 <> 0 AND {_BARRED}"


@query("message thread thread_participant identity_person person", f"WITH {_SESSIONS} {_EXTRACTION}")
def plan_extraction(message, thread, thread_participant, identity_person, person):
    return planning.extraction(_to_read(message, thread, thread_participant, identity_person, person), "v2")


@query("message thread thread_participant identity_person person", f"WITH {_SESSIONS} SELECT session_id FROM session WHERE false")
def plan_opted_out(message, thread, thread_participant, identity_person, person):
    """A save that opted out has nothing to read."""
    return _to_read(message, thread, thread_participant, identity_person, person, opted_out=True).select("session_id")


def _plan_merging(fact: DataFrame, fact_citation: DataFrame) -> DataFrame:
    none = fact.where(F.lit(False)).select(F.col("id").alias("a_id"), F.col("id").alias("b_id"))
    return planning.merging(facts.merge_plan(fact, fact_citation, none), fact)


def plan_merging(spark, sf_dir):
    return _plan_merging(frame(spark, sf_dir, "fact"), frame(spark, sf_dir, "fact_citation"))


QUERIES["plan_merging"] = plan_merging
ORACLES["plan_merging"] = (
    ORACLES["merge_plan"].replace("SELECT a.id AS a_id, b.id AS b_id FROM z a", ", pairs AS (SELECT a.subject_person_id AS person, a.id AS a_id, b.id AS b_id FROM z a")
    + ") SELECT 'adjudicate' AS kind, 'person' AS subject_kind, person AS subject_id, sha256(string_agg(concat(a_id, '+', b_id), chr(10) ORDER BY concat(a_id, '+', b_id))) AS input_hash, 0::BIGINT AS priority FROM pairs GROUP BY person"
)


@query("message", f"""WITH {_SESSIONS} SELECT 'embed' AS kind, 'thread' AS subject_kind, thread_id AS subject_id, sha256(string_agg(concat(session_id, ':', member_hash), chr(10) ORDER BY session_id)) AS input_hash,
       max(ended_at_unix) // 86400 AS priority FROM session WHERE started_at_unix % 3 <> 1 GROUP BY thread_id""")  # fmt: skip
def plan_embeddings(message):
    return planning.embeddings(vectors.threads_pending(_pending(message)), "m1")


_MEDIA = "SELECT 'ocr' AS kind, 'media' AS subject_kind, media_id::VARCHAR AS subject_id, concat(media_id, '|m1|p1') AS input_hash, max(sent_at_unix) // 86400 AS priority FROM e WHERE kind = 'photo' AND media_id % 5 <> 0 GROUP BY media_id"


def _plan_media(message: DataFrame) -> DataFrame:
    reference = _reference(message).where("kind = 'photo'")
    readings = reference.select("media_id", F.lit("m1").alias("model"), F.lit("p1").alias("prompt")).where("media_id % 5 = 0")
    return planning.media(media.pending(reference, readings, "m1", "p1"), "ocr", "m1", "p1")


@query("message", f"WITH {_REFERENCE} {_MEDIA}")
def plan_media(message):
    return _plan_media(message)


_DIARY = f"""SELECT 'diary_month' AS kind, 'person' AS subject_kind, concat(person_id, '/', month) AS subject_id, sha256(concat('v1|', hash, '|', messages)) AS input_hash, 0::BIGINT AS priority FROM mo"""


@query(
    "message thread thread_participant identity_person person fact",
    f"WITH {_SESSIONS}, {_REFERENCE}, {_MONTHS}, every AS ({_EXTRACTION} UNION ALL {_DIARY} UNION ALL {_MEDIA}) SELECT kind, count(*) AS jobs, max(priority) AS highest FROM every GROUP BY 1",
)
def plan_all(message, thread, thread_participant, identity_person, person, fact):
    months = _months(fact)
    none = months.where(F.lit(False))
    work = planning.every([
        planning.extraction(_to_read(message, thread, thread_participant, identity_person, person), "v2"),
        planning.diary(diary.plan_months(months, none, none, "v1")),
        _plan_media(message),
        planning.embeddings(vectors.threads_pending(_pending(message)), " "),
    ])
    return work.groupBy("kind").agg(F.count("*").alias("jobs"), F.max("priority").alias("highest"))


# --- extraction ----------------------------------------------------------------


@query(
    "",
    """SELECT event_id AS session_id, CASE WHEN event_id % 11 = 0 THEN 'skipped' WHEN event_id % 5 = 0 THEN 'needs_review' WHEN event_id % 7 = 0 AND event_id % 4 = 0 THEN 'nothing_to_record'
              WHEN event_id % 4 = 0 AND event_id % 3 <> 1 AND event_id % 6 <> 2 THEN 'needs_review' ELSE 'written' END AS outcome,
              NOT (event_id % 11 = 0 OR event_id % 5 = 0) AND ((event_id % 7 = 0 AND event_id % 4 = 0) OR NOT (event_id % 4 = 0 AND event_id % 3 <> 1 AND event_id % 6 <> 2)) AS is_written FROM events""",
)
def extraction_outcomes(events):
    n = F.col("event_id")
    run = events.select(
        n.alias("session_id"), (n % 11 != 0).alias("readable"), (n % 5).alias("calls"), (n % 7 == 0).alias("nothing"), (n % 4).alias("facts"),
        F.when(n % 3 == 1, 1).otherwise(0).alias("corroborations"), F.when(n % 6 == 2, 1).otherwise(0).alias("contradictions"),
    )
    return facts.outcome(run)


_WINDOW = """w AS (SELECT DISTINCT l_orderkey AS session_id, l_orderkey * 10 + l_linenumber AS message_id, concat('p:', l_suppkey % 40) AS sender FROM line),
       o AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS session_id, l_linenumber AS place, CASE WHEN l_linenumber % 7 = 6 THEN 'p:none' ELSE concat('p:', l_suppkey % 40) END AS subject,
              CASE WHEN l_partkey % 9 = 0 THEN concat('p:', l_suppkey % 40) WHEN l_partkey % 9 = 1 THEN 'p:else' END AS other,
              CASE WHEN l_partkey % 13 = 0 THEN 'Works At' WHEN l_partkey % 13 < 6 THEN 'works_at' ELSE 'likes' END AS predicate,
              CASE WHEN l_partkey % 11 = 0 THEN 'works' WHEN l_partkey % 11 = 1 THEN ' ' WHEN l_partkey % 11 = 2 THEN repeat('x', 201) ELSE concat('Value ', l_orderkey % 2) END AS object_text,
              repeat('c', 380 + l_linenumber * 4) AS claim_text, l_discount * 12 AS confidence,
              CASE WHEN l_partkey % 17 = 0 THEN [] WHEN l_partkey % 17 = 1 THEN [l_orderkey * 10 + l_linenumber, 5] ELSE [l_orderkey * 10 + 1] END AS ids,
              CASE WHEN l_partkey % 5 = 0 THEN l_orderkey * 1000 END AS vf, CASE WHEN l_partkey % 10 = 0 THEN l_orderkey * 10 + 1 ELSE 5 END AS vfm,
              CASE WHEN l_partkey % 20 = 0 THEN l_orderkey * 1000 - 500 + l_suppkey % 1000 END AS vt FROM line)"""


@query(
    "line",
    f"""WITH {_WINDOW}, k AS (SELECT o.*, s.sender AS speaker, coalesce(s.sender = subject OR s.sender = other, false) AS spoke, subject IN (SELECT sender FROM w WHERE w.session_id = o.session_id) AS known,
              other IN (SELECT sender FROM w WHERE w.session_id = o.session_id) AS other_known, len([i for i in ids if NOT list_contains(ms, i)]) AS astray, list_contains(ms, vfm) AS vfm_there
              FROM o JOIN (SELECT session_id, list(message_id) AS ms FROM w GROUP BY 1) a ON a.session_id = o.session_id LEFT JOIN w s ON s.session_id = o.session_id AND s.message_id = ids[1]),
       j AS (SELECT *, CASE WHEN NOT known THEN 'subject' WHEN other IS NOT NULL AND NOT other_known THEN 'other' WHEN subject = other THEN 'same person'
                WHEN NOT regexp_full_match(predicate, '[a-z][a-z0-9_]*') THEN 'predicate' WHEN trim(object_text) = '' OR length(object_text) > 200 THEN 'object' WHEN length(claim_text) > 400 THEN 'claim'
                WHEN list_contains(string_split(predicate, '_'), lower(trim(object_text))) THEN 'restates' WHEN confidence > 1 THEN 'confidence' WHEN len(ids) = 0 THEN 'uncited' WHEN astray > 0 THEN 'citation'
                WHEN vf > 1000000 + 157680000 OR vt > 1000000 + 157680000 THEN 'future' WHEN (vf IS NOT NULL OR vt IS NOT NULL) AND NOT vfm_there THEN 'date citation' WHEN vf > vt THEN 'order' END AS reason FROM k)
       SELECT id, reason IS NULL AS accepted, reason, CASE WHEN spoke THEN 'self_report' ELSE 'reflected' END AS evidence,
              reason IS NULL AND row_number() OVER (PARTITION BY session_id, subject, other, predicate, lower(trim(object_text)), ids, reason IS NULL ORDER BY place, id) = 1 AS staged FROM j""",
)
def staged_facts(line):
    """Facts that order lines propose from their order: a line is a message, its supplier the sender."""
    n, part, at = F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.col("l_partkey"), F.col("l_orderkey") * 10 + 1
    sender = F.concat(F.lit("p:"), (F.col("l_suppkey") % 40).cast("string"))
    five = F.lit(5).cast("long")
    message = line.select(F.col("l_orderkey").alias("session_id"), n.cast("long").alias("message_id"), sender.alias("sender_person_id"))
    people = message.select("session_id", F.col("sender_person_id").alias("person_id"))
    cited = F.when(part % 10 == 0, at.cast("long")).otherwise(five)
    proposed = line.select(
        n.alias("id"), F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("place"), F.when(F.col("l_linenumber") % 7 == 6, "p:none").otherwise(sender).alias("subject_person_id"),
        F.when(part % 9 == 0, sender).when(part % 9 == 1, "p:else").alias("other_person_id"), F.when(part % 13 == 0, "Works At").when(part % 13 < 6, "works_at").otherwise("likes").alias("predicate"),
        F.when(part % 11 == 0, "works").when(part % 11 == 1, " ").when(part % 11 == 2, "x" * 201).otherwise(F.concat(F.lit("Value "), (F.col("l_orderkey") % 2).cast("string"))).alias("object_text"),
        F.expr("repeat('c', int(380 + l_linenumber * 4))").alias("claim_text"), (F.col("l_discount") * 12).alias("confidence"),
        F.when(part % 17 == 0, F.array().cast("array<bigint>")).when(part % 17 == 1, F.array(n.cast("long"), five)).otherwise(F.array(at.cast("long"))).alias("message_ids"),
        F.when(part % 5 == 0, F.col("l_orderkey") * 1000).alias("valid_from"), cited.alias("valid_from_message_id"),
        F.when(part % 20 == 0, F.col("l_orderkey") * 1000 - 500 + F.col("l_suppkey") % 1000).alias("valid_to"), cited.alias("valid_to_message_id"),
    )
    return facts.stage(proposed, message, people, 1_000_000)


@query(
    "fact fact_citation message",
    """WITH v AS (SELECT id AS older, lead(id) OVER (PARTITION BY subject_person_id, predicate ORDER BY valid_from, id) AS newer FROM fact),
       s AS (SELECT fact_id, min(sent_at_unix) AS said FROM fact_citation c JOIN message m ON m.id = c.message_id WHERE role IN ('asserts', 'corroborates') GROUP BY 1)
       SELECT o.id, coalesce(o.valid_to, CASE WHEN n.valid_from % 7 <> 0 THEN n.valid_from END, said) AS valid_to FROM v JOIN fact o ON o.id = v.older JOIN fact n ON n.id = v.newer LEFT JOIN s ON s.fact_id = v.newer
       WHERE o.merged_into IS NULL AND o.retracted_at IS NULL""",
)
def changed_facts(fact, fact_citation, message):
    """Verdicts that the next fact of a subject and predicate replaced one; a seventh of the beginnings is unknown."""
    from pyspark.sql import Window

    newer = F.lead("id").over(Window.partitionBy("subject_person_id", "predicate").orderBy("valid_from", "id"))
    verdict = fact.select(F.col("id").alias("older_id"), newer.alias("newer_id")).where("newer_id IS NOT NULL")
    begun = fact.withColumn("valid_from", F.when(F.col("valid_from") % 7 != 0, F.col("valid_from")))
    said_at = message.select(F.col("id").alias("message_id"), "sent_at_unix")
    return facts.expire(facts.changed(begun, fact_citation, said_at, verdict))
