"""Exports in binary files: QIP's histories, the Messages database."""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .canonical import canonical, file_part
from .text_exports import phone

_QIP = "uin string, nickname string, id int, sent int, outgoing boolean, type int, said binary"
#: Types of QIP messages that aren't chat.
QIP_SERVICE = {5: "authorization_request", 14: "authorization_accepted"}


def qip_history(data: bytes) -> Iterator[tuple]:
    """Messages of a .qhf file. All sizes, field marks and the count of messages are checked; a file that differs raises."""
    if data[:3] != b"QHF":
        raise ValueError("no QHF signature")
    try:
        size, wanted, length = struct.unpack_from(">i", data, 4)[0], struct.unpack_from(">i", data, 0x22)[0], struct.unpack_from(">h", data, 0x2C)[0]
        uin = data[0x2E : 0x2E + length].decode("ascii")
        at = 0x2E + length
        length = struct.unpack_from(">h", data, at)[0]
        nickname, at = data[at + 2 : at + 2 + length].decode("utf-8", "replace"), at + 2 + length
        if size != len(data) - 8:
            raise ValueError(f"QHF header says {size} bytes, {len(data) - 8} follow")
        found = 0
        while at < len(data):
            # block mark and size; fields 1 (id), 2 (time), 3 (direction, 0, type), 4 (text) with mark and length each
            mark, block, f1, n1, number, f2, n2, sent, f3, n3, way, _, kind, f4, n4 = struct.unpack_from(">hi hhi hhi hh3B hi", data, at)
            begin, end = at + 35, at + 6 + block
            if (mark, f1, n1, f2, n2, f3, n3, f4) != (1, 1, 4, 2, 4, 3, 3, 4) or end > len(data) or n4 < 0 or begin + n4 > end:
                raise ValueError(f"not a QHF message block at byte {at}")
            yield uin, nickname, number, sent, way != 0, kind, bytes((254 - b - i) & 255 for i, b in enumerate(data[begin : begin + n4]))
            found, at = found + 1, end
    except struct.error as e:
        raise ValueError("a QHF file that ends early") from e
    if found != wanted:
        raise ValueError(f"QHF header says {wanted} messages, {found} found")


def _qip_files(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["owner", *[c.split()[0] for c in _QIP.split(", ")]]
    for frame in frames:
        for owner, data in zip(frame["owner"], frame["content"], strict=True):
            yield pd.DataFrame([(owner, *row) for row in qip_history(bytes(data))], columns=names)


def qip(spark: SparkSession, path: str) -> DataFrame:
    """.qhf files, one for each contact. The folder above theirs names the owner if it is a number; his own file is saved messages.

    Times before 1996 or more than a day ahead raise, as bytes read from the wrong place give such times.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.qhf").load(path)
    rows = files.select(file_part(F.col("path"), 3).alias("owner"), "content").mapInPandas(_qip_files, f"owner string, {_QIP}")
    own = F.col("owner").rlike("^[0-9]+$") & (F.col("uin") == F.col("owner"))
    contact = F.when(F.trim("nickname") == "", F.col("uin")).otherwise(F.col("nickname"))
    mine = F.col("outgoing") | own
    action = F.coalesce(*[F.when(F.col("type") == k, v) for k, v in QIP_SERVICE.items()])
    sent = F.col("sent").cast("long")
    plausible = (sent >= 820_454_400) & (sent <= F.unix_timestamp() + 86_400)
    return canonical(
        rows, platform=F.lit("qip"), thread_id=F.col("uin"), thread_kind=F.when(own, "saved").otherwise("dm"), title=F.when(own, "Saved messages").otherwise(contact),
        uid=F.concat(F.lit("qip/"), "uin", F.lit("/"), F.col("id").cast("string")), sender_id=F.when(mine, "self").otherwise(F.col("uin")), sender_name=F.when(~mine, contact),
        kind=F.when(action.isNull(), "message").otherwise("service"), service_action=action, text=F.make_valid_utf8(F.col("said").cast("string")),
        sent_at_unix=F.when(plausible, sent).otherwise(F.raise_error(F.lit("not a time of QIP")).cast("long")),
    )


def _sqlite(query: str, names: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for data in frame["content"]:
                db = sqlite3.connect(":memory:")
                db.deserialize(bytes(data[:18]) + b"\x01\x01" + bytes(data[20:]))  # as if it had no write-ahead log
                rows = db.execute(query)
                while batch := rows.fetchmany(10_000):
                    yield pd.DataFrame(batch, columns=names, dtype=object)
                db.close()

    return read


def sqlite_query(spark: SparkSession, path: str, query: str, schema: str) -> DataFrame:
    """Rows of a query on a SQLite file, in batches. The file is read through Spark, so it can lie in any store.

    A file is held in memory by the task that reads it, and must be under 2 GB.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(_sqlite(query, names), schema)


#: What comes between the class name and the length of a string in an archived attributed text, as Latin-1.
TYPEDSTREAM = "\x01\x94\x84\x01+"
#: Tapbacks by type; 1,000 more takes one back.
TAPBACKS = {2000: "❤️", 2001: "👍", 2002: "👎", 2003: "😂", 2004: "‼️", 2005: "❓"}
#: What the types of items but 0 mean.
ITEMS = {1: "participants_changed", 2: "group_name_changed", 3: "left_group", 4: "shared_location", 5: "shared_screen", 6: "group_photo_changed"}
APPLE_EPOCH = 978_307_200


def attributed_text(blob: Column) -> Column:
    """The string of an archived attributed text: null if it holds none; another layout raises."""
    raw = F.decode(blob, "ISO-8859-1")  # a character for each byte
    at = F.instr(raw, "NSString")
    rest = F.substr(raw, at + 8, F.lit(2_147_483_647))
    byte = lambda k: F.ascii(F.substr(rest, F.lit(6 + k), F.lit(1)))
    mark = byte(0)
    length = F.when(mark == 0x81, byte(1) + byte(2) * 256).when(mark == 0x82, byte(1) + byte(2) * 256 + byte(3) * 65_536 + byte(4) * 16_777_216).otherwise(mark)
    said = F.substr(rest, F.when(mark == 0x81, 9).when(mark == 0x82, 11).otherwise(7), length)
    good = rest.startswith(TYPEDSTREAM) & (mark <= 0x82) & (mark != 0x80) & (F.length(said) == length)
    text = F.make_valid_utf8(F.encode(said, "ISO-8859-1").cast("string"))
    return F.when(at > 0, F.when(good, text).otherwise(F.raise_error(F.lit("an attributed text of unknown layout"))))


def _account(value: Column) -> Column:
    bare = F.regexp_replace(F.trim(value), "^[pe]:", "")
    return phone(F.when(bare.startswith(";"), bare).otherwise(F.substring_index(bare, ";", 1)))


def apple_seconds(date: Column) -> Column:
    """Seconds since 1970 of seconds or nanoseconds since 2001, told apart by size; what is neither raises."""
    seconds = F.when(F.abs(date) > 1_000_000_000_000, 1_000_000_000).otherwise(1).cast("long")
    seconds = F.signum(date).cast("long") * F.floor(F.abs(date) / seconds).cast("long")
    return F.when(seconds.between(-1_000_000_000, 4_000_000_000), seconds + APPLE_EPOCH).otherwise(F.raise_error(F.lit("not a time of iMessage")).cast("long"))


def imessage(spark: SparkSession, path: str) -> DataFrame:
    """chat.db. Tapbacks become reactions of their message: the last of a person, target and kind counts, unless it takes one back.

    What the database's write-ahead log holds and the file doesn't isn't read. A chat of style 45 or none is direct.
    Text comes from ``text``, else from the archived attributed text.
    """
    table = lambda query, schema: sqlite_query(spark, path, query, schema)
    message = table(
        "SELECT m.ROWID, m.guid, m.text, m.attributedBody, m.date, m.is_from_me, m.handle_id, m.item_type, m.associated_message_type, m.associated_message_guid FROM message m",
        "id long, guid string, plain string, body binary, date long, mine long, handle_id long, item long, tap long, tapped string",
    )
    handle = table("SELECT ROWID, id FROM handle", "handle_id long, name string").select("handle_id", _account(F.col("name")).alias("person"))
    chat = table("SELECT ROWID, guid, style, display_name, chat_identifier FROM chat", "chat_id long, chat string, style long, name string, identifier string")
    within = table("SELECT chat_id, message_id FROM chat_message_join", "chat_id long, id long")
    files = table("SELECT j.message_id, a.ROWID, a.filename FROM attachment a JOIN message_attachment_join j ON j.attachment_id = a.ROWID WHERE a.filename IS NOT NULL", "id long, place long, file string")
    stored = F.regexp_extract(F.replace("file", F.lit("\\"), F.lit("/")), "(?i)(Attachments/.*)$", 1)
    files = files.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", F.when(stored == "", F.col("file")).otherwise(stored).alias("file")))).alias("files"))
    message = message.join(handle, "handle_id", "left").withColumn("actor", F.when(F.col("mine") == 1, "self").otherwise(F.col("person")))

    tap = F.coalesce("tap", F.lit(0))
    back = tap.between(3000, 3005)
    emoji = F.coalesce(*[F.when(tap % 1000 == kind - 2000, shown) for kind, shown in TAPBACKS.items()])
    taps = message.where(tap.between(2000, 3005) & F.col("tapped").isNotNull() & F.col("actor").isNotNull())
    taps = taps.select(F.substring_index(F.substring_index("tapped", "/", -1), ":", -1).alias("guid"), "actor", emoji.alias("emoji"), back.alias("back"), "date", "id").where("emoji IS NOT NULL")
    taps = taps.groupBy("guid", "actor", "emoji").agg(F.max_by("back", F.struct("date", "id")).alias("back")).where("NOT back")
    taps = taps.groupBy("guid").agg(F.array_sort(F.collect_list(F.struct("emoji", "actor", F.lit(1).cast("long").alias("count")))).alias("reactions"))

    rows = message.where(~tap.between(2000, 3005)).join(within, "id").join(chat, "chat_id").join(files, "id", "left").join(taps, "guid", "left")
    item = F.coalesce("item", F.lit(0))
    action = F.when(item != 0, F.coalesce(*[F.when(item == k, v) for k, v in ITEMS.items()], F.concat(F.lit("item_type_"), item.cast("string"))))
    return canonical(
        rows, platform=F.lit("imessage"), thread_id=F.col("chat"), thread_kind=F.when(F.coalesce("style", F.lit(45)) == 45, "dm").otherwise("group"),
        title=F.coalesce(F.when(F.col("name") != "", F.col("name")), "identifier"), uid=F.concat(F.lit("im/"), "chat", F.lit("/"), "guid"), sender_id=F.col("actor"), sender_name=F.col("person"),
        kind=F.when(action.isNull(), "message").otherwise("service"), service_action=action,
        text=F.coalesce(F.when(F.col("plain") != "", F.col("plain")), attributed_text(F.col("body")), F.lit("")), sent_at_unix=apple_seconds(F.col("date")), reactions=F.col("reactions"),
        media=F.transform("files", lambda f: f["file"]),
    )
