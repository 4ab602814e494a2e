"""The bitemporal fact store: live facts, merging, expiry, validation, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.store import shared_folder
from ..functions.text import compatible, similar, value_key

ASSERTING = ("asserts", "corroborates")
CHASE = 16
PREDICATE, PREDICATE_SHAPE = r"^[a-z][a-z0-9_]{1,59}$", "^[a-z][a-z0-9_]*$"
#: Most characters of the parts of a fact, and how far ahead its dates may lie.
MOST_PREDICATE, MOST_OBJECT, MOST_CLAIM, FUTURE = 60, 200, 400, 5 * 365 * 86400


def is_live() -> Column:
    return F.col("merged_into").isNull() & F.col("retracted_at").isNull() & (F.col("source") != "user_deleted")


def folded_citations(fact: DataFrame, citation: DataFrame) -> DataFrame:
    """(fact_id, message_id): the asserting citations of facts and of those folded into them."""
    root = fact.select("id", F.coalesce("merged_into", "id").alias("fact_id"))
    said = citation.where(F.col("role").isin(*ASSERTING)).select(F.col("fact_id").alias("id"), "message_id")
    return said.join(root, "id").select("fact_id", "message_id").distinct()


def live_facts(fact: DataFrame, citation: DataFrame) -> DataFrame:
    """Live facts with their citations (their own and folded ones) and the first message that says them."""
    said = folded_citations(fact, citation).groupBy("fact_id").agg(F.count("*").alias("citations"), F.min("message_id").alias("first_message"))
    rows = fact.where(is_live()).join(said, F.col("id") == F.col("fact_id"), "left")
    return rows.select("id", "subject_person_id", "predicate", "object_text", F.round("confidence", 6).alias("confidence"), (F.col("source") == "user_edited").alias("by_user"), F.coalesce("citations", F.lit(0)).alias("citations"), "first_message")


def facts_of(fact: DataFrame, citation: DataFrame, edge: DataFrame, person: DataFrame, person_id: str) -> DataFrame:
    """What is known of a person: live facts about them, and about them and somebody else (then with the other's name).

    Citations count whatever their role, those of folded facts too; the first message is the first that asserts the fact
    itself. The user's own facts come first, then the certain ones, by predicate. Everything but the person's facts is
    pruned before it is joined.
    """
    there = edge.where((F.col("person_a_id") == person_id) | (F.col("person_b_id") == person_id))
    other = F.when(F.col("person_a_id") == person_id, F.col("person_b_id")).otherwise(F.col("person_a_id"))
    there = there.select(F.col("id").alias("subject_edge_id"), other.alias("other_id"))
    theirs = fact.where(is_live()).join(there, "subject_edge_id", "left")
    theirs = theirs.where((F.col("subject_person_id") == person_id) | F.col("other_id").isNotNull())
    theirs = theirs.join(person.select(F.col("id").alias("other_id"), F.col("display_name").alias("other_name")), "other_id", "left")
    folded = fact.select(F.col("id").alias("fact_id"), F.coalesce("merged_into", "id").alias("id")).join(theirs.select("id"), "id", "left_semi")
    own = F.when((F.col("fact_id") == F.col("id")) & (F.col("role") == "asserts"), F.col("message_id"))
    said = citation.join(folded, "fact_id").groupBy("id").agg(F.count("*").alias("citations"), F.min(own).alias("first_message"))
    rows = theirs.join(said, "id", "left").withColumn("confidence", F.round("confidence", 6))
    columns = ["id", "subject_person_id", "other_name", "predicate", "object_text", "confidence", "source", F.coalesce("citations", F.lit(0)).alias("citations"), "first_message"]
    return rows.orderBy(F.col("source") == "extracted", F.desc("confidence"), "predicate", "id").select(columns)


def merge_candidates(fact: DataFrame) -> DataFrame:
    """Subjects and predicates with two live facts or more."""
    return fact.where(is_live()).groupBy("subject_person_id", "predicate").agg(F.count("*").alias("n")).where("n >= 2")


def preferred(fact: DataFrame, citation: DataFrame) -> DataFrame:
    """For each subject, predicate and value key of live facts: the preferred one, and how many it stands for."""
    rows = live_facts(fact, citation).withColumn("key", value_key(compatible(F.col("object_text"))))
    group = Window.partitionBy("subject_person_id", "predicate", "key")
    order = group.orderBy(F.desc("by_user"), F.desc("citations"), F.desc("confidence"), F.asc_nulls_last("first_message"), "id")
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("n", F.count("*").over(group))
    return rows.where("place = 1").select("subject_person_id", "predicate", "key", "id", F.col("n").alias("stands_for"))


def merge_plan(fact: DataFrame, citation: DataFrame, judged: DataFrame, few: int = 6) -> DataFrame:
    """Pairs of preferred facts to be judged: of one subject and predicate, all where there are few, else similar ones.

    judged: a_id, b_id. Keys are made once, and facts with equal keys are one, before pairs are: only keys are compared.
    """
    best = preferred(fact, citation).join(fact.select("id", "source"), "id")
    size = Window.partitionBy("subject_person_id", "predicate")
    best = best.select("subject_person_id", "predicate", "id", "key", "source", F.count("*").over(size).alias("size"))
    a = best.select("subject_person_id", "predicate", "size", *[F.col(c).alias(f"a_{c}") for c in ("id", "key", "source")])
    b = best.select("subject_person_id", "predicate", *[F.col(c).alias(f"b_{c}") for c in ("id", "key", "source")])
    pairs = a.join(b, ["subject_person_id", "predicate"]).where(F.col("a_id") < F.col("b_id"))
    pairs = pairs.where((F.col("size") <= few) | similar(F.col("a_key"), F.col("b_key")))
    pairs = pairs.where(~((F.col("a_source") == "user_edited") & (F.col("b_source") == "user_edited")))
    return pairs.join(judged, ["a_id", "b_id"], "left_anti").select("a_id", "b_id")


def fold_roots(fact: DataFrame, chase: int = CHASE) -> DataFrame:
    """The fact that each folded fact ends in, following at most ``chase`` pointers; dangling ones are left out."""
    shared_folder(fact.sparkSession)
    pointer = fact.select("id", F.col("merged_into").alias("to"))
    rows = pointer.where("to IS NOT NULL").select("id", F.col("to").alias("root"))
    next_of = pointer.select(F.col("id").alias("root"), F.col("to").alias("further"))
    done = None
    for _ in range(chase):
        step = rows.join(next_of, "root")
        ended = step.where("further IS NULL").select("id", "root")
        done = ended if done is None else done.unionByName(ended)
        rows = step.where("further IS NOT NULL").select("id", F.col("further").alias("root")).checkpoint()  # or each hop would redo all before it
        if rows.isEmpty():
            break
    return done


def expire(older: DataFrame) -> DataFrame:
    """When a fact that another one replaced stopped holding: its own end, or the newer one's beginning, or its first mention."""
    return older.select("id", F.coalesce("valid_to", "newer_valid_from", "newer_first_said").alias("valid_to"))


def changed(fact: DataFrame, citation: DataFrame, said_at: DataFrame, verdict: DataFrame) -> DataFrame:
    """Facts that a verdict says a newer one replaced, ready for ``expire``: unless folded, retracted or replaced before.

    verdict: older_id, newer_id; said_at: message_id, sent_at_unix.
    """
    first = citation.where(F.col("role").isin(*ASSERTING)).join(said_at, "message_id").groupBy(F.col("fact_id").alias("newer_id")).agg(F.min("sent_at_unix").alias("newer_first_said"))
    newer = verdict.join(fact.select(F.col("id").alias("newer_id"), F.col("valid_from").alias("newer_valid_from")), "newer_id").join(first, "newer_id", "left")
    older = fact.where("merged_into IS NULL AND retracted_at IS NULL").select("id", "valid_to")
    return older.join(newer.withColumnRenamed("older_id", "id"), "id").select("id", "newer_id", "valid_to", "newer_valid_from", "newer_first_said")


def replaced(fact: DataFrame) -> DataFrame:
    """Live facts with the next one of their subject and predicate, ready for ``expire``."""
    order = Window.partitionBy("subject_person_id", "predicate").orderBy("valid_from", "id")
    rows = fact.where(is_live()).withColumn("newer_valid_from", F.lead("valid_from").over(order))
    return rows.where("newer_valid_from IS NOT NULL").select("id", "valid_to", "newer_valid_from", F.lit(None).cast("long").alias("newer_first_said"))


def facts_in_window(fact: DataFrame, citation: DataFrame, said_at: DataFrame, start: int, end: int, limit: int = 40) -> DataFrame:
    """Visible facts first said in [start, end). said_at: message_id, sent_at_unix."""
    said = folded_citations(fact, citation).join(said_at, "message_id").where((F.col("sent_at_unix") >= start) & (F.col("sent_at_unix") < end))
    first = said.groupBy("fact_id").agg(F.min("message_id").alias("first_message"), F.min("sent_at_unix").alias("first_unix"))
    rows = fact.where(is_live()).join(first, F.col("id") == F.col("fact_id"))
    return rows.select("id", "subject_person_id", "first_message", "first_unix").orderBy("first_unix", "id").limit(limit)


def validate(proposed: DataFrame, now: int) -> DataFrame:
    """Whether a proposed fact can be written, and if not, the first reason: by its own fields alone."""
    reason = (
        F.when(~F.col("predicate").rlike(PREDICATE), "predicate")
        .when(F.length(F.trim("object_text")) == 0, "empty")
        .when(F.length("object_text") > MOST_OBJECT, "too long")
        .when(restates(F.col("predicate"), F.col("object_text")), "restates")
        .when((F.col("confidence") < 0) | (F.col("confidence") > 1), "confidence")
        .when(F.col("valid_to") < F.col("valid_from"), "order")
        .when(F.col("valid_from") > now + FUTURE, "future")
    )
    return proposed.select("id", reason.isNull().alias("accepted"), reason.alias("reason"))


def restates(predicate: Column, value: Column) -> Column:
    """Whether a value is the predicate or one of its words."""
    key = F.replace(F.lower(F.trim(value)), F.lit(" "), F.lit("_"))
    return (key != "") & ((key == predicate) | F.array_contains(F.split(predicate, "_"), key))


def stage(proposed: DataFrame, message: DataFrame, people: DataFrame, now: int, own_archive: bool = True) -> DataFrame:
    """Proposed facts against the windows of their sessions: id, accepted, reason (the first), evidence, staged.

    proposed: id, session_id, place (order of the calls), subject_person_id, other_person_id (null: about one person),
    predicate, object_text, claim_text, confidence, message_ids, valid_from, valid_from_message_id, valid_to,
    valid_to_message_id; message: session_id, message_id, sender_person_id, those that may be cited; people: session_id,
    person_id.

    Evidence is a self-report if the first cited message is the subject's own, else reflected, which somebody else's
    archive refuses. A fact that was accepted before with the same value, whatever its case, and the same citations is
    accepted again, but not staged.
    """
    here = people.select("session_id", "person_id").distinct()
    known = lambda c: here.select("session_id", F.col("person_id").alias(c), F.lit(True).alias(f"{c}_known"))
    rows = proposed.join(known("subject_person_id"), ["session_id", "subject_person_id"], "left").join(known("other_person_id"), ["session_id", "other_person_id"], "left")
    window = message.select("session_id", "message_id", "sender_person_id").dropDuplicates(["session_id", "message_id"])
    cited = proposed.select("id", "session_id", F.posexplode("message_ids").alias("at", "message_id"))
    cited = cited.join(window.withColumn("there", F.lit(True)), ["session_id", "message_id"], "left")
    checks = cited.groupBy("id").agg(F.count_if(F.col("there").isNull()).alias("astray"), F.max(F.when(F.col("at") == 0, F.col("sender_person_id"))).alias("speaker"))
    rows = rows.join(checks, "id", "left")
    for end in ("valid_from", "valid_to"):
        at = window.select("session_id", F.col("message_id").alias(f"{end}_message_id"), F.lit(True).alias(f"{end}_there"))
        rows = rows.join(at, ["session_id", f"{end}_message_id"], "left")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    long = lambda c, most: F.length(F.trim(c)) > most
    a, b = F.col("subject_person_id"), F.col("other_person_id")
    spoke = F.coalesce((F.col("speaker") == a) | (F.col("speaker") == b), F.lit(False))
    evidence = F.when(spoke, "self_report").otherwise("reflected")
    reason = (
        F.when(blank("subject_person_id") | F.col("subject_person_id_known").isNull(), "subject")
        .when(b.isNotNull() & F.col("other_person_id_known").isNull(), "other")
        .when(a == b, "same person")
        .when(blank("predicate") | long("predicate", MOST_PREDICATE) | ~F.trim("predicate").rlike(PREDICATE_SHAPE), "predicate")
        .when(blank("object_text") | long("object_text", MOST_OBJECT), "object")
        .when(blank("claim_text") | long("claim_text", MOST_CLAIM), "claim")
        .when(restates(F.trim("predicate"), F.col("object_text")), "restates")
        .when(F.col("confidence").isNull() | ~F.col("confidence").between(0, 1), "confidence")
        .when(F.coalesce(F.size("message_ids"), F.lit(-1)) <= 0, "uncited")
        .when(F.col("astray") > 0, "citation")
        .when((F.col("valid_from") > now + FUTURE) | (F.col("valid_to") > now + FUTURE), "future")
        .when((F.col("valid_from").isNotNull() & F.col("valid_from_there").isNull()) | (F.col("valid_to").isNotNull() & F.col("valid_to_there").isNull()), "date citation")
        .when(F.col("valid_from") > F.col("valid_to"), "order")
    )
    if not own_archive:
        reason = reason.when(~spoke, "reflected")
    rows = rows.withColumn("reason", reason)
    same = ["session_id", F.coalesce(F.least(a, b), a), F.coalesce(F.greatest(a, b), F.lit("")), F.trim("predicate"), F.lower(F.trim("object_text")), "message_ids", F.col("reason").isNull()]
    first = F.row_number().over(Window.partitionBy(*same).orderBy("place", "id")) == 1
    return rows.select("id", F.col("reason").isNull().alias("accepted"), "reason", evidence.alias("evidence"), (F.col("reason").isNull() & first).alias("staged"))


def outcome(run: DataFrame) -> DataFrame:
    """How the extraction of a session ended. run: session_id, readable (it has a window), calls, nothing (the model said
    that there is nothing), facts, corroborations, contradictions (staged).

    A run that found nothing is written all the same, so that it isn't read again.
    """
    nothing_staged = (F.col("facts") == 0) & (F.col("corroborations") == 0) & (F.col("contradictions") == 0)
    ended = (
        F.when(~F.col("readable"), "skipped")
        .when(F.col("calls") == 0, "needs_review")
        .when(F.col("nothing") & (F.col("facts") == 0), "nothing_to_record")
        .when(nothing_staged, "needs_review")
        .otherwise("written")
    )
    return run.select("session_id", ended.alias("outcome"), ended.isin("nothing_to_record", "written").alias("is_written"))


def release_from_retracted(fact: DataFrame) -> DataFrame:
    """Facts that were folded into one that is retracted now stand for themselves again."""
    gone = fact.where("retracted_at IS NOT NULL").select(F.col("id").alias("merged_into"), F.lit(True).alias("gone"))
    rows = fact.join(gone, "merged_into", "left")
    return rows.withColumn("merged_into", F.when(F.col("gone").isNull(), F.col("merged_into"))).select(fact.columns)


def retire_sessions(session: DataFrame, artifact: DataFrame, fact: DataFrame, retired: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sessions, artifacts, facts) without retired sessions (session_id).

    Facts extracted from a retired session are retracted at ``now`` unless they are already; what the user wrote stays.
    Artifacts stay, without a session. artifact: id, session_id; fact: artifact_id beside its own columns.
    """
    ids = retired.select("session_id").distinct().withColumn("retired", F.lit(True))
    marked = artifact.join(ids, "session_id", "left")
    read = marked.where("retired").select(F.col("id").alias("artifact_id")).distinct().withColumn("lost", F.lit(True))
    detached = marked.withColumn("session_id", F.when(F.col("retired").isNull(), F.col("session_id"))).select(artifact.columns)
    rows = fact.join(read, "artifact_id", "left")
    lost = F.col("lost") & F.col("retracted_at").isNull() & (F.col("source") == "extracted")
    rows = rows.withColumn("retracted_at", F.when(lost, F.lit(now).cast("long")).otherwise(F.col("retracted_at"))).select(fact.columns)
    return session.join(ids, "session_id", "left_anti"), detached, release_from_retracted(rows)


def edit(fact: DataFrame, citation: DataFrame, fact_id: str, text: str, new_id: str) -> tuple[DataFrame, DataFrame]:
    """A user's wording as a fact of its own, certain, with copies of the citations; the old fact and what was folded into
    it are folded into the new one. Without such a fact there is no new one."""
    is_old = F.col("id") == fact_id
    new = fact.where(is_old).select([
        {"id": F.lit(new_id), "object_text": F.lit(text), "confidence": F.lit(1.0), "source": F.lit("user_edited"), "merged_into": F.lit(None)}.get(c, F.col(c)).cast(fact.schema[c].dataType).alias(c)
        for c in fact.columns
    ])
    pointed = F.when(is_old | F.coalesce(F.col("merged_into") == fact_id, F.lit(False)), F.lit(new_id)).otherwise(F.col("merged_into"))
    there = fact.where(is_old).select(F.col("id").alias("old_id"))
    copies = citation.join(there, citation["fact_id"] == F.col("old_id"), "left_semi").withColumn("fact_id", F.lit(new_id))
    kept = fact.withColumn("merged_into", pointed)
    return kept.unionByName(new), citation.unionByName(copies)


def delete(fact: DataFrame, fact_id: str, now: int) -> DataFrame:
    """Buries a fact and all that is folded into it; an earlier retraction keeps its time."""
    gone = (F.col("id") == fact_id) | F.coalesce(F.col("merged_into") == fact_id, F.lit(False))
    retracted = F.when(gone, F.coalesce("retracted_at", F.lit(now).cast("long"))).otherwise(F.col("retracted_at"))
    return fact.withColumn("retracted_at", retracted).withColumn("source", F.when(gone, F.lit("user_deleted")).otherwise(F.col("source")))


def lost(extract: DataFrame, fact: DataFrame) -> DataFrame:
    """Sessions whose latest extract names more facts than are stored, the user's own aside.

    extract: session_id, created_unix, id, payload (JSON with a number ``facts``); fact: session_id, source.
    """
    latest = extract.groupBy("session_id").agg(F.max_by("payload", F.struct("created_unix", "id")).alias("payload"))
    named = F.coalesce(F.get_json_object("payload", "$.facts").try_cast("long"), F.lit(0))
    stored = fact.where("source <> 'user_edited'").groupBy("session_id").agg(F.count("*").alias("stored"))
    rows = latest.select("session_id", named.alias("named")).join(stored, "session_id", "left")
    rows = rows.select("session_id", "named", F.coalesce("stored", F.lit(0)).alias("stored"))
    return rows.where("named > stored")


def known_facts(live: DataFrame, people: DataFrame, limit: int = 40) -> DataFrame:
    """What is known of some people (person_id), the most certain first."""
    rows = live.join(people.select(F.col("person_id").alias("subject_person_id")).distinct(), "subject_person_id", "left_semi")
    return rows.orderBy(F.desc("confidence"), "id").limit(limit)


def window_people(participant: DataFrame, identity_person: DataFrame, person: DataFrame, thread_id: str) -> DataFrame:
    """The people of a thread and the owner, each once."""
    there = participant.where(F.col("thread_id") == thread_id).join(identity_person, "identity_id").select("person_id")
    return there.unionByName(person.where("is_owner").select(F.col("id").alias("person_id"))).distinct()


def commit(fact: DataFrame, proposed: DataFrame, sessions: DataFrame, now: int) -> DataFrame:
    """The facts after the extraction of ``sessions`` (session_id) proposed new ones.

    Extracted facts of earlier runs over these sessions are retracted. A proposal gives way to what the user said: it is
    left out where an edited or deleted fact has its subject, predicate and value, whatever its case. A fact that a
    proposal supersedes ends when that begins (the earliest of several), unless it has ended already.
    Both tables: id, session_id, subject_person_id, predicate, object_text, valid_from, valid_to, retracted_at, source;
    proposed also: supersedes.
    """
    key = ["subject_person_id", "predicate", "value"]
    verdict = fact.where(F.col("source").isin("user_edited", "user_deleted")).withColumn("value", F.lower("object_text")).select(key).distinct()
    new = proposed.withColumn("value", F.lower("object_text")).join(verdict, key, "left_anti").select(proposed.columns)
    ends = new.where(F.col("supersedes").isNotNull()).groupBy(F.col("supersedes").alias("id")).agg(F.min("valid_from").alias("ends"))
    read = sessions.select("session_id", F.lit(True).alias("again")).distinct()
    rows = fact.join(read, "session_id", "left").join(ends, "id", "left")
    gone = F.coalesce("again", F.lit(False)) & (F.col("source") == "extracted")
    rows = rows.withColumn("retracted_at", F.when(gone, F.coalesce("retracted_at", F.lit(now).cast("long"))).otherwise(F.col("retracted_at")))
    return rows.withColumn("valid_to", F.coalesce("valid_to", "ends")).select(fact.columns).unionByName(new.select(fact.columns))
