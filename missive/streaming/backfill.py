"""Resumable backfill: pages of chats' messages, dropped as files, committed with the cursor that they move.

A chat is read downwards from its newest message until an empty page ends it, then upwards from there: catch-up pages hold
what is newer than the cursor, and what they reached counts only once an empty page ends them. A page is committed even
if it is empty, and a page that is read twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .ingest import latest

#: A file's line: a page of a chat. ``seq`` orders a chat's pages, ``phase`` is backfill or catchup.
PAGE = (
    "source_id string, chat_id string, seq long, phase string, "
    "messages array<struct<id: long, sent_at_unix: long, plaintext: string>>"
)


def cursors(pages: DataFrame) -> DataFrame:
    """source_id, chat_id, oldest, done, newest of the chats that pages (source_id, chat_id, seq, phase, low, high, size) are
    of: how far down a chat was read, whether that was to its end, and up to where nothing is missing."""
    empty = F.col("size") == 0
    up = F.col("phase") == "catchup"
    key = ["source_id", "chat_id"]
    pages = pages.dropDuplicates([*key, "seq", "phase"])
    ended = pages.where(up & empty).groupBy(key).agg(F.max("seq").alias("ended"))
    rows = pages.join(ended, key, "left")
    reached = F.max(F.when(~up | (F.col("seq") < F.col("ended")), F.col("high")))
    return rows.groupBy(key).agg(F.min(F.when(~up, F.col("low"))).alias("oldest"), F.max(~up & empty).alias("done"), reached.alias("newest"))


def commit_pages(target: str, included: Callable[[], DataFrame] | None = None):
    """A sink for pages: messages, then the pages' bounds, each into the batch's own folder; a batch that is run again
    replaces both. ``included`` (chat_id) names the chats to keep."""

    def write(rows: DataFrame, batch: int) -> None:
        if included is not None:
            rows = rows.join(included(), "chat_id", "left_semi")
        each = rows.select("source_id", "chat_id", "seq", F.explode("messages").alias("m")).select("source_id", "chat_id", "seq", "m.*")
        uid = F.concat_ws("/", "source_id", "chat_id", F.col("id").cast("string"))
        bodies = each.select(uid.alias("uid"), F.col("chat_id").alias("thread_id"), "id", "sent_at_unix", "plaintext", F.lit("message").alias("event"), F.col("seq").alias("position"))
        bodies.write.mode("overwrite").parquet(f"{target}/messages/batch={batch}")
        ids = F.transform(F.coalesce("messages", F.array().cast("array<struct<id: long, sent_at_unix: long, plaintext: string>>")), lambda m: m["id"])
        bounds = rows.select("source_id", "chat_id", "seq", "phase", F.array_min(ids).alias("low"), F.array_max(ids).alias("high"), F.size(ids).alias("size"))
        bounds.write.mode("overwrite").parquet(f"{target}/pages/batch={batch}")

    return write


def replay(spark: SparkSession, folder: str, target: str, checkpoint: str, included: Callable[[], DataFrame] | None = None, per_trigger: int = 100) -> StreamingQuery:
    """Commits the pages that lie in a folder (JSON lines of PAGE) and ends; a further call goes on where it ended."""
    stream = spark.readStream.schema(PAGE).option("maxFilesPerTrigger", per_trigger).json(folder)
    return stream.writeStream.foreachBatch(commit_pages(target, included)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def messages(spark: SparkSession, target: str) -> DataFrame:
    """What was read, each message once."""
    return latest(spark.read.parquet(f"{target}/messages"))


def progress(spark: SparkSession, target: str) -> DataFrame:
    """``cursors`` of all committed pages."""
    return cursors(spark.read.parquet(f"{target}/pages"))
