"""What the queue should hold: work for sessions, people, threads and media, as jobs (kind, subject_kind, subject_id,
input_hash, priority) ready for ``jobs.enqueue``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import priority
from .sessions import eligible

COLUMNS = ("kind", "subject_kind", "subject_id", "input_hash", "priority")


def _jobs(rows: DataFrame, kind: str, subject_kind: str) -> DataFrame:
    return rows.select(F.lit(kind).alias("kind"), F.lit(subject_kind).alias("subject_kind"), "subject_id", "input_hash", "priority")


def to_read(session: DataFrame, extract: DataFrame, thread: DataFrame, participant: DataFrame, identity_person: DataFrame, person: DataFrame, prompt: str, opted_out: bool = False) -> DataFrame:
    """Substantive sessions that no extract at a prompt version has read, without excluded threads, direct threads with
    excluded people, and saves that opted out. extract: session_id, prompt."""
    wanted = eligible(session, thread, participant, identity_person, person)
    read = extract.where(F.col("prompt") == prompt)
    return wanted.join(read, "session_id", "left_anti").where(F.lit(not opted_out))


def extraction(unread: DataFrame, prompt: str) -> DataFrame:
    """Sessions to read (session_id, member_hash, ended_at_unix), the newest days first."""
    made_of = F.concat_ws("|", "member_hash", F.lit(prompt))
    return _jobs(unread.select(F.col("session_id").alias("subject_id"), made_of.alias("input_hash"), priority("ended_at_unix").alias("priority")), "extract", "session")


def merging(pairs: DataFrame, fact: DataFrame) -> DataFrame:
    """People with facts that may be one (a_id, b_id), with the hash of those pairs, after everything else."""
    of = pairs.join(fact.select(F.col("id").alias("a_id"), F.col("subject_person_id").alias("subject_id")), "a_id")
    named = F.sort_array(F.collect_list(F.concat_ws("+", "a_id", "b_id")))
    rows = of.groupBy("subject_id").agg(F.sha2(F.array_join(named, "\n"), 256).alias("input_hash"))
    return _jobs(rows.withColumn("priority", F.lit(0).cast("long")), "adjudicate", "person")


def embeddings(threads: DataFrame, model: str | None) -> DataFrame:
    """Threads with sessions to embed (``vectors.threads_pending``); none without a model."""
    rows = threads.where(F.lit(bool(model and model.strip())))
    return _jobs(rows.select(F.col("thread_id").alias("subject_id"), "input_hash", priority("last_unix").alias("priority")), "embed", "thread")


def media(pending: DataFrame, kind: str, model: str | None, prompt: str) -> DataFrame:
    """Files to read or to hear (media_id, last_unix) with a model; none without one."""
    rows = pending.where(F.lit(bool(model and model.strip())))
    made_of = F.concat_ws("|", F.col("media_id").cast("string"), F.lit(model or ""), F.lit(prompt))
    return _jobs(rows.select(F.col("media_id").cast("string").alias("subject_id"), made_of.alias("input_hash"), priority("last_unix").alias("priority")), kind, "media")


def diary(months: DataFrame) -> DataFrame:
    """Months to write (``diary.plan_months``)."""
    rows = months.select(F.concat_ws("/", "person_id", "month").alias("subject_id"), "input_hash", F.lit(0).cast("long").alias("priority"))
    return _jobs(rows, "diary_month", "person")


def every(plans: list[DataFrame]) -> DataFrame:
    """All planned work, in the order in which it depends on itself."""
    out = plans[0]
    for plan in plans[1:]:
        out = out.unionByName(plan)
    return out


def converse(ask: Callable[[list], list], dispatch: Callable[[object], bool], finished: Callable[[], bool] = lambda: False, corrections: int = 2) -> tuple[bool, int]:
    """A conversation with a model at the driver: asks, hands each call over, and asks again while some were refused.

    ``ask`` gets the refused calls of the round before (none at first) and returns calls; ``dispatch`` says whether one was
    accepted. It ends when there are no calls, none is refused, it is finished, or after so many corrections. Returns
    whether anything was called, and the rounds.
    """
    called, refused = False, []
    for turn in range(1 + corrections):
        calls = ask(refused)
        if not calls:
            return called, turn + 1
        called, refused = True, [c for c in calls if not dispatch(c)]
        if not refused or finished():
            return called, turn + 1
    return called, 1 + corrections
