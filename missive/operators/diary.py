"""Monthly activity and the planning of diaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARE_LEAST, SHARE_TOTAL = 600, 9000


def month_of(unix: str) -> Column:
    return F.date_format(F.timestamp_seconds(unix), "yyyy-MM")


def month_activity(message: DataFrame, thread: DataFrame, participant: DataFrame, identity_person: DataFrame) -> DataFrame:
    """Messages and active days of each person and UTC month: of their dm threads, and those they sent elsewhere."""
    dm = thread.where("kind = 'dm'").select(F.col("id").alias("thread_id"))
    of = participant.join(dm, "thread_id", "left_semi").join(identity_person, "identity_id").select("thread_id", "person_id").distinct()
    columns = ["person_id", "sent_at_unix"]
    shared = message.join(of, "thread_id").select(columns)
    sent = message.join(identity_person, F.col("sender_identity_id") == F.col("identity_id")).select("thread_id", *columns)
    rows = shared.unionByName(sent.join(of, ["thread_id", "person_id"], "left_anti").select(columns))
    day = F.floor(F.col("sent_at_unix") / 86400)
    days = rows.groupBy("person_id", month_of("sent_at_unix").alias("month"), day.alias("day")).agg(F.count("*").alias("n"))
    return days.groupBy("person_id", "month").agg(F.sum("n").alias("messages"), F.count("*").alias("days"))


def quiet_months(activity: DataFrame) -> DataFrame:
    """Months without messages before each active one; null for a person's first."""
    index = F.substring("month", 1, 4).cast("int") * 12 + F.substring("month", 6, 2).cast("int")
    before = F.lag(index).over(Window.partitionBy("person_id").orderBy("month"))
    return activity.select("person_id", "month", (index - before - 1).cast("long").alias("quiet"))


def month_hashes(fact: DataFrame) -> DataFrame:
    """Live facts of each subject and month, and the hash of their ids."""
    ids = F.array_join(F.sort_array(F.collect_list("id")), "\n")
    rows = fact.groupBy("subject_person_id", month_of("valid_from").alias("month"))
    return rows.agg(F.count("*").alias("facts"), F.sha2(ids, 256).alias("hash"))


def latest_versions(artifact: DataFrame) -> DataFrame:
    """The newest version of each (scope, start), the one before it, and how many there are. artifact: scope, start, id, created_unix."""
    order = Window.partitionBy("scope", "start").orderBy(F.desc("created_unix"), F.desc("id"))
    rows = artifact.select("scope", "start", "id", F.row_number().over(order).alias("place"), F.lead("id").over(order).alias("previous_id"), F.count("*").over(Window.partitionBy("scope", "start")).alias("revisions"))
    return rows.where("place = 1").select("scope", "start", "id", "previous_id", "revisions")


def _budgeted(total: int):
    """Rows in order of person, session and place, as a stream: of each session the lines up to its limit, together up to
    the total. Only sums are held, whatever a person's or a session's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        person = session = None
        spent = mine = 0
        open_ = True
        for batch in batches:
            kept = np.zeros(batch.num_rows, bool)
            columns = [batch.column(c).to_pylist() for c in ("person_id", "session_id", "length", "share")]
            for k, (who, which, length, share) in enumerate(zip(*columns, strict=True)):
                if who != person:
                    person, session, spent = who, None, 0
                if which != session:
                    session, mine, open_ = which, 0, True
                open_ = open_ and mine + length <= share and spent + length <= total
                if open_:
                    mine += length
                    spent += length
                    kept[k] = True
            yield batch.select(["person_id", "session_id", "id"]).filter(pa.array(kept))

    return run


def excerpts(lines: DataFrame, least: int = SHARE_LEAST, total: int = SHARE_TOTAL) -> DataFrame:
    """For each person and session the first lines up to the session's share, all of a person's up to the total; the line
    that exceeds one ends its session. lines: person_id, session_id, id, sent_at_unix, length.

    A line beyond its session's share is dropped before the person's lines are put in order, and only numbers travel.
    """
    sessions = lines.groupBy("person_id").agg(F.count_distinct("session_id").alias("sessions"))
    share = F.greatest(F.lit(least), F.expr(f"{total} div sessions"))
    inside = Window.partitionBy("person_id", "session_id").orderBy("sent_at_unix", "id").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("length", F.coalesce("length", F.lit(0)).cast("long"))
    rows = lines.withColumn("upto", F.sum("length").over(inside)).join(sessions.select("person_id", share.alias("share")), "person_id")
    order = ["person_id", "session_id", "sent_at_unix", "id"]
    rows = rows.where("upto <= share").select(*order, "length", "share").repartition("person_id").sortWithinPartitions(*order)
    return rows.mapInArrow(_budgeted(total), "person_id string, session_id string, id long")


def plan_months(months: DataFrame, busy: DataFrame, unread: DataFrame, prompt: str) -> DataFrame:
    """Months to write, with the hash of what they are written from; people at work and months with unread sessions wait.

    months: person_id, month, messages, hash (of the month's facts); busy: person_id; unread: person_id, month.
    """
    rows = months.join(busy.select("person_id").distinct(), "person_id", "left_anti")
    rows = rows.join(unread.select("person_id", "month").distinct(), ["person_id", "month"], "left_anti")
    made_of = F.concat_ws("|", F.lit(prompt), F.coalesce("hash", F.lit("")), F.col("messages").cast("string"))
    return rows.select("person_id", "month", F.sha2(made_of, 256).alias("input_hash"))


def plan_years(written: DataFrame, least: int = 2) -> DataFrame:
    """Years with enough written months. written: person_id, month."""
    rows = written.select("person_id", F.substring("month", 1, 4).alias("year"), "month").distinct()
    return rows.groupBy("person_id", "year").agg(F.count("*").alias("months")).where(F.col("months") >= least)


def plan_profiles(fact: DataFrame, busy_years: DataFrame, least: int = 3) -> DataFrame:
    """People with enough live facts and no year at work. fact: live ones, subject_person_id; busy_years: person_id."""
    rows = fact.groupBy(F.col("subject_person_id").alias("person_id")).agg(F.count("*").alias("facts")).where(F.col("facts") >= least)
    return rows.join(busy_years.select("person_id").distinct(), "person_id", "left_anti")


def valid_sentences(sentence: DataFrame, citation: DataFrame, window: DataFrame, most: int = 500) -> DataFrame:
    """Sentences that aren't too long and cite only messages of their window.

    sentence: sentence_id, text; citation: sentence_id, message_id; window: message_id.
    """
    astray = citation.join(window.select("message_id").distinct(), "message_id", "left_anti").select("sentence_id")
    return sentence.where(F.length("text") <= most).join(astray, "sentence_id", "left_anti").select("sentence_id")
