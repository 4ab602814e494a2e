"""Sessions by gaps of silence, their substance, and what has been read of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import gaps, with_days

#: A gap of this many seconds or more begins a session: 4 hours.
GAP = 4 * 3600
#: Thresholds of substance.
LONG_TEXT, MANY_WORDS, VARIETY, QUESTION_WORDS = 60, 20, 1.5, 8


def session_members(message: DataFrame, gap: int = GAP) -> DataFrame:
    """Each message with its session's number in the thread, by (sent_at_unix, id). No task holds a thread, only a day of it."""
    rows, days = gaps(message, F.col("gap_") >= gap)
    rows = with_days(rows, days)
    opens = F.coalesce((F.col("day_gap_") >= gap).cast("int"), F.lit(1))
    return rows.withColumn("number", F.col("ahead_") + opens + F.col("marks_")).select(*message.columns, "number")


def numbered(message: DataFrame, gap: int = GAP) -> DataFrame:
    """``sessions`` with their numbers in the thread."""
    members = session_members(message, gap)
    ordered = F.array_sort(F.collect_list(F.struct("sent_at_unix", "id", "uid")))
    rows = members.groupBy("thread_id", "number").agg(
        F.min("sent_at_unix").alias("started_at_unix"), F.max("sent_at_unix").alias("ended_at_unix"), F.count("*").alias("message_count"), ordered.alias("all")
    )
    digest = F.sha2(F.array_join(F.transform("all", lambda x: x["uid"]), "\n"), 256)
    rows = rows.withColumn("member_hash", digest)
    name = F.concat(F.lit("s_"), F.substring(F.sha2(F.concat_ws("|", "thread_id", "member_hash"), 256), 1, 24))
    return rows.select(name.alias("session_id"), "thread_id", "number", "started_at_unix", "ended_at_unix", "message_count", "member_hash")


def sessions(message: DataFrame, gap: int = GAP) -> DataFrame:
    """Sessions with start, end, count, the hash of their members and an id made of thread and hash."""
    return numbered(message, gap).drop("number")


def assigned(message: DataFrame, gap: int = GAP) -> DataFrame:
    """Each message (id) with the id of its session."""
    members = session_members(message, gap).select("id", "thread_id", "number")
    return members.join(numbered(message, gap).select("thread_id", "number", "session_id"), ["thread_id", "number"]).select("id", "session_id")


def session_diff(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """What a new segmentation adds and what it retires."""
    add = wanted.select("session_id").join(existing.select("session_id"), "session_id", "left_anti")
    retire = existing.select("session_id").join(wanted.select("session_id"), "session_id", "left_anti")
    return add.withColumn("action", F.lit("add")).unionByName(retire.withColumn("action", F.lit("retire")))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{Nd}]+)"), F.lit(1))


def utf16_length(text: Column) -> Column:
    """UTF-16 code units, so that a character outside the basic plane counts as two."""
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("long")


def substantive(members: DataFrame, keys: list[str]) -> DataFrame:
    """Whether a session says something: a long text, many different words, or a question with some."""
    spoken = members.where(F.length(F.trim("plaintext")) > 0)
    rows = spoken.groupBy(keys).agg(
        F.max(utf16_length(F.col("plaintext"))).alias("longest"),
        F.count("*").alias("spoken"),
        F.coalesce(F.bool_or(F.col("plaintext").contains("?") | F.col("plaintext").contains("？")), F.lit(False)).alias("asks"),
    )
    # pairs of session and word are made distinct where they are before they travel; no task holds a session's words
    pairs = spoken.select(*keys, F.explode(F.array_distinct(words(F.col("plaintext")))).alias("word")).distinct()
    rows = rows.join(pairs.groupBy(keys).agg(F.count("*").alias("distinct_words")), keys, "left").fillna(0, ["distinct_words"])
    verdict = (
        (F.col("longest") >= LONG_TEXT)
        | ((F.col("distinct_words") >= MANY_WORDS) & (F.col("distinct_words") >= VARIETY * F.col("spoken")))
        | (F.col("asks") & (F.col("distinct_words") >= QUESTION_WORDS))
    )
    silent = members.select(keys).distinct().join(rows, keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return silent.select(*keys, zero("longest"), zero("spoken"), zero("distinct_words"), F.coalesce("asks", F.lit(False)).alias("asks"), F.coalesce(verdict, F.lit(False)).alias("is_substantive"))


def threads_by_recency(message: DataFrame) -> DataFrame:
    return message.where("kind = 'message'").groupBy("thread_id").agg(F.max("sent_at_unix").alias("last_unix"), F.count("*").alias("message_count"))


def unread(session: DataFrame, extract: DataFrame, thread: DataFrame) -> DataFrame:
    """Sessions without an extract, of threads that aren't excluded."""
    allowed = thread.where(~F.col("ai_excluded")).select(F.col("id").alias("thread_id"))
    return session.join(extract, "session_id", "left_anti").join(allowed, "thread_id", "left_semi").select("session_id", "thread_id", "message_count")


def coverage_summary(message: DataFrame, session: DataFrame, extract: DataFrame, prompt: str, per: DataFrame | None = None) -> DataFrame:
    """Seven counts and two shares (0 where there is nothing): threads with spoken messages, those with sessions, spoken
    messages, those in sessions, sessions, substantive ones, and substantive ones that were read at a prompt version.

    message: thread_id, session_id (null outside of sessions), spoken ones that are not deleted; session: session_id,
    thread_id, substantive; extract: session_id, prompt. ``per`` (person_id, thread_id) gives a row for each person, over
    the threads they are in, instead of one for all; the threads are then those they are in, spoken in or not.
    """
    read = extract.where(F.col("prompt") == prompt).select("session_id", F.lit(True).alias("read")).distinct()
    of_sessions = session.join(read, "session_id", "left").groupBy("thread_id").agg(
        F.count("*").alias("sessions"), F.count_if("substantive").alias("substantive"), F.count_if(F.col("substantive") & F.col("read")).alias("extracted")
    )
    of_messages = message.groupBy("thread_id").agg(F.count("*").alias("messages"), F.count("session_id").alias("messages_in_sessions"))
    threads = of_messages.join(of_sessions, "thread_id", "full")
    keys = []
    if per is not None:
        keys, threads = ["person_id"], per.select("person_id", "thread_id").distinct().join(threads, "thread_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    count = F.count("*") if per is not None else F.count("messages")
    rows = threads.groupBy(keys).agg(
        count.alias("threads"), F.count("sessions").alias("threads_segmented"), *[total(c) for c in ("messages", "messages_in_sessions", "sessions", "substantive", "extracted")]
    )
    share = lambda part, whole: F.when(F.col(whole) > 0, F.round(F.col(part) / F.col(whole), 6)).otherwise(0.0)
    return rows.withColumn("segmented_share", share("threads_segmented", "threads")).withColumn("extracted_share", share("extracted", "substantive"))


def coverage(session: DataFrame, extract: DataFrame) -> DataFrame:
    """Sessions, how many were read, and the share; 0 where there are none."""
    read = session.join(extract.select("session_id").distinct().withColumn("read", F.lit(1)), "session_id", "left")
    out = read.agg(F.count("*").alias("sessions"), F.count("read").alias("read_sessions"), F.coalesce(F.sum("message_count"), F.lit(0)).alias("messages"), F.coalesce(F.sum(F.when(F.col("read") == 1, F.col("message_count"))), F.lit(0)).alias("read_messages"))
    return out.withColumn("share", F.when(F.col("sessions") > 0, F.round(F.col("read_sessions") / F.col("sessions"), 6)).otherwise(0.0))


def coverage_by_thread(session: DataFrame, extract: DataFrame) -> DataFrame:
    read = session.join(extract.select("session_id").distinct().withColumn("read", F.lit(1)), "session_id", "left")
    return read.groupBy("thread_id").agg(F.count("*").alias("sessions"), F.count("read").alias("read_sessions"), F.max("ended_at_unix").alias("last_unix"))


def session_text(members: DataFrame, keys: list[str], most: int = 4000) -> DataFrame:
    """``sender: text`` lines of a session in order, cut at ``most`` characters."""
    line = F.concat(F.col("sender_identity_id"), F.lit(": "), F.col("plaintext"), F.lit("\n"))
    ordered = F.array_sort(F.collect_list(F.struct("sent_at_unix", "id", line.alias("line"))))
    rows = members.groupBy(keys).agg(ordered.alias("all"))
    return rows.select(*keys, F.substring(F.array_join(F.transform("all", lambda x: x["line"]), ""), 1, most).alias("text"))


# What families of embedding models expect before a document and before a query.
PREFIXES = (("nomic", "search_document: ", "search_query: "), ("e5", "passage: ", "query: "))


def prefix_for(model: str, query: bool = False) -> str:
    """The prefix of a text for an embedding model, by its name; none for most."""
    return next((of_query if query else of_document for family, of_document, of_query in PREFIXES if family in model.lower()), "")


def eligible(session: DataFrame, thread: DataFrame, participant: DataFrame, identity_person: DataFrame, person: DataFrame) -> DataFrame:
    """Substantive sessions (``substantive``) of threads that are not excluded, nor direct ones with an excluded person."""
    excluded = person.where("ai_excluded").select(F.col("id").alias("person_id"))
    theirs = participant.join(identity_person, "identity_id").join(excluded, "person_id", "left_semi").select("thread_id")
    barred = thread.where("kind = 'dm'").select(F.col("id").alias("thread_id")).join(theirs, "thread_id", "left_semi")
    barred = barred.unionByName(thread.where("ai_excluded").select(F.col("id").alias("thread_id")))
    return session.where("substantive").join(barred, "thread_id", "left_anti")
