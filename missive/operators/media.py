"""Reading of media: what still needs a reading, where a medium belongs, and which reading can be searched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds that are read, and the bytes of the largest medium of each.
BYTE_CAPS = {"photo": 5 << 20, "voice": 25 << 20, "video_message": 25 << 20}


def is_eligible(caps: dict[str, int] | None = None) -> Column:
    """A row's kind is read and its medium isn't too large; never null."""
    fits = [(F.col("kind") == kind) & (F.col("byte_size") <= most) for kind, most in (caps or BYTE_CAPS).items()]
    either = fits[0]
    for other in fits[1:]:
        either = either | other
    return F.coalesce(either, F.lit(False))


def pending(reference: DataFrame, reading: DataFrame, model: str, prompt: str) -> DataFrame:
    """Eligible media without a reading by ``model`` and ``prompt``, and when each was last sent.

    reference: media_id, kind, byte_size, sent_at_unix; reading: media_id, model, prompt.
    """
    done = reading.where((F.col("model") == model) & (F.col("prompt") == prompt)).select("media_id")
    rows = reference.where(is_eligible()).groupBy("media_id").agg(F.max("sent_at_unix").alias("last_unix"))
    return rows.join(done, "media_id", "left_anti")


def anchors(reference: DataFrame) -> DataFrame:
    """The earliest message that holds each eligible medium. reference: also message_id."""
    first = F.min(F.struct("sent_at_unix", "message_id")).alias("first")
    return reference.where(is_eligible()).groupBy("media_id").agg(first).select("media_id", F.col("first.message_id").alias("message_id"))


def searchable(reading: DataFrame) -> DataFrame:
    """The newest reading of each medium; one without text takes the medium out of the search. reading: media_id, id, text."""
    order = Window.partitionBy("media_id").orderBy(F.desc("id"))
    newest = reading.withColumn("place", F.row_number().over(order)).where("place = 1")
    return newest.where(F.length(F.trim("text")) > 0).select("media_id", "id", "text")


def stored_files(files: DataFrame) -> DataFrame:
    """Files (path, content) by the hash of their content, each content once: hash, stored_path, byte_size, content.

    ``files`` is what Spark's binaryFile source reads (it leaves empty files out). The first file by path gives the ending; the content of the others
    is not sent on.
    """
    ending = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]{1,10})$", 1))
    rows = files.select("path", F.sha2("content", 256).alias("hash"), ending.alias("ending"), F.octet_length("content").cast("long").alias("byte_size"))
    first = rows.groupBy("hash").agg(F.min(F.struct("path", "ending", "byte_size")).alias("f"))
    address = F.concat_ws("/", F.substring("hash", 1, 2), F.substring("hash", 3, 2), F.concat("hash", "f.ending"))
    first = first.select("hash", address.alias("stored_path"), "f.byte_size", F.col("f.path").alias("path"))
    return first.join(files.select("path", "content"), "path").select("hash", "stored_path", "byte_size", "content")
