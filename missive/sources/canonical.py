"""The one schema that all readers give, and expressions that they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANONICAL = (
    "platform string, thread_id string, thread_kind string, title string, uid string, sender_id string, sender_name string, kind string, "
    "service_action string, text string, sent_at_unix long, edited_at_unix long, reply_to_uid string, "
    "reactions array<struct<emoji: string, actor: string, count: long>>, media array<string>, entities string, tz_offset_minutes long"
)
NAMES = [c.split()[0] for c in CANONICAL.replace("array<struct<emoji: string, actor: string, count: long>>", "x").split(", ")]
_TYPES = dict(zip(NAMES, [c.split(" ", 1)[1] for c in CANONICAL.replace(": string, actor: string, count: long", "").split(", ")], strict=True))
_TYPES["reactions"] = "array<struct<emoji: string, actor: string, count: long>>"


def canonical(rows: DataFrame, **columns: Column) -> DataFrame:
    """Rows in the canonical schema; what isn't given is null."""
    return rows.select(*[columns.get(n, F.lit(None)).cast(_TYPES[n]).alias(n) for n in NAMES])


def with_occurrence(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``occurrence``: which of the rows with an equal key a row is, from 0."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1
    return rows.withColumn("occurrence", place)


def derived_uid(prefix: str, *parts: str) -> Column:
    """A uid from the fields of a message and which of equal ones it is."""
    digest = F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]), 256), 1, 24)
    return F.concat(F.lit(prefix + "/"), "thread_id", F.lit("/"), digest, F.when(F.col("occurrence") > 0, F.concat(F.lit("-"), "occurrence")).otherwise(F.lit("")))


def file_part(path: Column, back: int) -> Column:
    """A part of a path, counted from its end (1: the file's name)."""
    return F.url_decode(F.replace(F.element_at(F.split(path, "/"), -back), F.lit("+"), F.lit("%2B")))
