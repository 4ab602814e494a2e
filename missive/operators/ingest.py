"""Idempotent ingestion: what a batch adds to, revises in and leaves of a stored table."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def content_hash(*columns: str):
    """The hash of fields joined by the unit separator, nulls as empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def first_of(batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """A batch's first row for each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return batch.withColumn("_place", place).where("_place = 1").drop("_place")


def new_rows(batch: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return batch.join(stored.select(key), key, "left_anti")


def replayed(batch: DataFrame, stored: DataFrame, key: str = "uid", order: list[str] | None = None) -> DataFrame:
    """A batch's rows with the content hash that each finds: that of the row before it with its key, or else the stored
    one (old_hash, null if there is none), and whether it is its key's last (newest). ``order`` gives the batch's order;
    without it rows of one key follow by their hashes.
    """
    place = order or ["content_hash"]
    own = Window.partitionBy(key).orderBy(*place)
    rows = batch.join(stored.select(key, F.col("content_hash").alias("stored_hash")), key, "left")
    rows = rows.withColumn("old_hash", F.coalesce(F.lag("content_hash").over(own), "stored_hash"))
    return rows.withColumn("newest", F.lead(F.lit(True), 1, False).over(own) == F.lit(False)).drop("stored_hash")


def revisions(batch: DataFrame, stored: DataFrame, key: str = "uid", order: list[str] | None = None) -> DataFrame:
    """Bodies that a batch replaces, in the store or earlier in the batch: same key, another content hash."""
    rows = replayed(batch, stored, key, order).where(F.col("old_hash").isNotNull() & (F.col("old_hash") != F.col("content_hash")))
    return rows.select(key, "old_hash", F.col("content_hash").alias("new_hash"))


def commit(batch: DataFrame, stored: DataFrame, key: str = "uid", order: list[str] | None = None) -> DataFrame:
    """The stored rows after a batch: new ones added, changed ones replaced, of several with one key the last; a second
    time nothing changes."""
    kept = stored.join(batch.select(key), key, "left_anti")
    newest = replayed(batch, stored, key, order).where("newest")
    return kept.unionByName(newest.select(stored.columns))


def commit_stats(batch: DataFrame, stored: DataFrame, key: str = "uid", order: list[str] | None = None) -> DataFrame:
    """One row: inserted, revised and skipped rows of a batch, read in its order."""
    rows = replayed(batch, stored, key, order)
    new, same = F.col("old_hash").isNull(), F.col("old_hash") == F.col("content_hash")
    return rows.agg(F.count_if(new).alias("inserted"), F.count_if(~new & ~same).alias("revised"), F.count_if(~new & same).alias("skipped"))


def store_media(media: DataFrame) -> DataFrame:
    """Content by hash, each once, with the path it is stored under and the number of references."""
    rows = media.select(F.sha2(F.col("content").cast("binary"), 256).alias("hash"), "byte_size")
    rows = rows.groupBy("hash").agg(F.count("*").alias("references"), F.min("byte_size").alias("byte_size"))
    path = F.concat(F.substring("hash", 1, 2), F.lit("/"), F.substring("hash", 3, 2), F.lit("/"), "hash", F.lit(".html"))
    return rows.select("hash", path.alias("path"), "references", "byte_size")


def mark_deleted(observed: DataFrame, message: DataFrame, marked: DataFrame) -> DataFrame:
    """New deletion marks: of known messages only, the first observation wins. observed: uid, observed_unix."""
    first = observed.groupBy("uid").agg(F.min("observed_unix").alias("observed_unix"))
    known = message.select("uid", F.col("id").alias("message_id"))
    return first.join(known, "uid").join(marked.select("message_id"), "message_id", "left_anti").select("message_id", "observed_unix")


def reactions(named: DataFrame, totals: DataFrame) -> DataFrame:
    """Named reactions, each once, and for the rest of a total one row without an actor.

    named: message_id, emoji, actor; totals: message_id, emoji, count.
    """
    once = named.dropDuplicates(["message_id", "emoji", "actor"]).select("message_id", "emoji", "actor", F.lit(1).cast("long").alias("count"))
    known = once.groupBy("message_id", "emoji").agg(F.count("*").alias("known"))
    rest = totals.join(known, ["message_id", "emoji"], "left")
    rest = rest.select("message_id", "emoji", F.lit(None).cast("string").alias("actor"), (F.col("count") - F.coalesce("known", F.lit(0))).cast("long").alias("count")).where("count > 0")
    return once.unionByName(rest)


def participants(message: DataFrame, stored: DataFrame) -> DataFrame:
    """New participants of threads with when they were first seen."""
    rows = message.groupBy("thread_id", F.col("sender_identity_id").alias("identity_id")).agg(F.min("sent_at_unix").alias("first_seen_unix"))
    return rows.join(stored.select("thread_id", "identity_id"), ["thread_id", "identity_id"], "left_anti")


def known_uids(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    return wanted.select("uid").distinct().join(stored.select("uid"), "uid", "left_semi")


def source_of(chat: DataFrame, platform: str) -> DataFrame:
    """The source that has most chats of a platform, the first by name of equals. chat: platform, source_id, chat_id."""
    rows = chat.where(F.col("platform") == platform).groupBy("source_id").agg(F.count_distinct("chat_id").alias("chats"))
    return rows.orderBy(F.desc("chats"), "source_id").limit(1)


@F.pandas_udf(StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """JSON without its white space, keys in the order given; what is no JSON stays as it is."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return json.dumps(json.loads(text), separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return text

    return texts.map(one)


def reconcile(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored bodies that a batch replaces, as revisions: uid, content_hash, text, service_action, entities as they were.

    A body whose hash differs is the same if its text, service action and entities (as canonical JSON) are. Only rows
    whose hash differs reach Python.
    """
    fields = ["text", "service_action", "entities"]
    new = batch.select("uid", *[F.col(c).alias(f"new_{c}") for c in ["content_hash", *fields]])
    both = stored.join(new, "uid").where(~F.col("content_hash").eqNullSafe(F.col("new_content_hash")))
    plain = F.col("text").eqNullSafe(F.col("new_text")) & F.col("service_action").eqNullSafe(F.col("new_service_action"))
    same = canonical_json("entities").eqNullSafe(canonical_json("new_entities"))
    both = both.withColumn("_plain", plain).withColumn("_same", same)
    return both.where(~(F.col("_plain") & F.col("_same"))).select("uid", "content_hash", *fields)
