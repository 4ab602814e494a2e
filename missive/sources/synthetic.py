"""A made-up archive of any size from a seed: chats with bursts of messages, ties in the same second, groups, a sticker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .canonical import canonical

#: Words of the made-up texts.
WORDS = ("harbour", "letter", "morning", "window", "river", "paper", "garden", "winter", "bridge", "lamp", "музыка", "вечер", "city", "train", "bread", "song")
BURST, GAP, START = 12, 6 * 3600, 1_500_000_000


def _draw(seed: int, name: str, *keys: str) -> Column:
    """A number from 0 to 2^31 that depends on the seed, a name and the row's keys."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), *keys), F.lit(1 << 31))


def messages(spark: SparkSession, count: int, chats: int = 120, seed: int = 1) -> DataFrame:
    """``count`` messages of ``chats`` chats in the canonical schema, the same for the same numbers, however it is split.

    Messages come in bursts of BURST with hours between; one in ten has the second of the one before it; a quarter of the
    chats are groups of up to nine; one message in sixteen is one sticker; one in twenty answers the message before it.
    """
    rows = spark.range(count).select(F.pmod("id", F.lit(chats)).alias("chat"), F.floor(F.col("id") / chats).cast("long").alias("number"))
    keys = ("chat", "number")
    burst, inside = F.floor(F.col("number") / BURST).cast("long"), F.pmod("number", F.lit(BURST))
    rows = rows.withColumn("burst", burst)
    begins = START + F.col("burst") * (BURST * 60 + GAP) + _draw(seed, "gap", "chat", "burst") % GAP
    tie = (inside > 0) & (_draw(seed, "tie", *keys) % 10 == 0)
    group = _draw(seed, "group", "chat") % 4 == 0
    people = F.when(group, 3 + _draw(seed, "people", "chat") % 7).otherwise(2)
    words = F.array(*map(F.lit, WORDS))
    said = F.transform(F.sequence(F.lit(1), (1 + _draw(seed, "length", *keys) % 14).cast("int")), lambda k: F.element_at(words, (F.pmod(F.xxhash64(F.lit(seed), "chat", "number", k), F.lit(len(WORDS))) + 1).cast("int")))
    sticker = _draw(seed, "sticker", *keys) % 16 == 0
    thread = F.concat(F.lit("chat"), F.col("chat").cast("string"))
    uid = lambda n: F.concat_ws("/", F.lit("syn"), thread, n.cast("string"))
    sender = F.concat(F.lit("person"), F.when(_draw(seed, "sender", *keys) % people == 0, "0").otherwise(F.concat_ws("-", "chat", _draw(seed, "sender", *keys) % people)))
    return canonical(
        rows, platform=F.lit("synthetic"), thread_id=thread, thread_kind=F.when(group, "group").otherwise("dm"), title=F.concat(F.lit("Chat "), F.col("chat").cast("string")),
        uid=uid(F.col("number")), sender_id=sender, sender_name=sender, kind=F.lit("message"), text=F.when(sticker, "").otherwise(F.array_join(said, " ")),
        sent_at_unix=begins + (inside - tie.cast("int")) * 60, reply_to_uid=F.when((F.col("number") > 0) & (_draw(seed, "reply", *keys) % 20 == 0), uid(F.col("number") - 1)),
        media=F.when(sticker, F.array(F.lit("sticker.webp"))),
    )
