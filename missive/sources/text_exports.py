"""Exports in text and XML: WhatsApp, SMS Backup & Restore."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .canonical import canonical, derived_uid, file_part, with_occurrence

#: Heads of messages, with brackets (iOS) or a dash (Android).
HEAD = "^‎?\\[?([0-9]{1,4})([./-])([0-9]{1,2})[./-]([0-9]{1,4}),? ([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?[  ]?([AaPp][Mm])?(?:\\] | - )(.*)$"


def _stamp(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    year = F.when(year < 100, year + 2000).otherwise(year)
    return F.unix_seconds(F.try_make_timestamp(year, month, day, hour, minute, second))


def whatsapp(spark: SparkSession, path: str) -> DataFrame:
    """Chat files as text. Lines without a head continue a message.

    A chat's dates are year first where the year has four digits there, day first with dots; else by which reading of
    all of them is possible, or goes back by more than a day less often. A chat that leaves both open is read as the
    chats of its shape (separator and digits of the year) are, where these agree; else it raises.
    """
    files = spark.read.text(path, wholetext=True).withColumn("chat", file_part(F.input_file_name(), 1))
    lines = files.select("chat", F.posexplode(F.split(F.regexp_replace("value", r"\r?\n\z", ""), "\r?\n")).alias("pos", "line"))
    part = lambda k: F.regexp_extract("line", HEAD, k)
    lines = lines.withColumn("head", part(1) != "")
    order = Window.partitionBy("chat").orderBy("pos")
    lines = lines.withColumn("number", F.sum(F.col("head").cast("int")).over(order)).where("number > 0")
    body = F.when(F.col("head"), part(9)).otherwise(F.col("line"))
    number = lambda k: F.when(F.col("head"), F.when(part(k) == "", 0).otherwise(part(k).cast("int")))
    half = F.upper(part(8))
    hour = F.when(half == "PM", number(5) % 12 + 12).when(half == "AM", number(5) % 12).otherwise(number(5))
    a, b, c = number(1), number(3), number(4)
    first = lambda x: F.first(x, ignorenulls=True)
    lines = lines.select("chat", "number", "pos", body.alias("body"), part(2).alias("sep"), F.length(part(1)).alias("digits"), F.length(part(4)).alias("last_digits"), *[
        _stamp(y, m, d, hour, number(6), number(7)).alias(n) for n, (y, m, d) in {"ymd": (a, b, c), "dmy": (c, b, a), "mdy": (c, a, b)}.items()
    ])
    rows = lines.groupBy("chat", "number").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda x: x["body"]), "\n").alias("body"),
        F.max("sep").alias("sep"), F.max("digits").alias("digits"), F.max("last_digits").alias("last_digits"), *[first(n).alias(n) for n in ("ymd", "dmy", "mdy")],
    )
    turn = Window.partitionBy("chat").orderBy("number")
    for n in ("dmy", "mdy"):
        rows = rows.withColumn(f"{n}_back", (F.col(n) < F.lag(n).over(turn) - 86400).cast("int"))
    back = lambda n: F.coalesce(F.sum(f"{n}_back"), F.lit(0)).alias(f"{n}_back")
    never = lambda n: F.bool_or(F.col(n).isNull()).alias(f"no_{n}")
    shape = F.concat_ws("/", F.min_by("sep", "number"), F.min_by("last_digits", "number")).alias("shape")
    chats = rows.groupBy("chat").agg(F.max("digits").alias("digits"), F.min("sep").alias("least_sep"), F.max("sep").alias("sep"), never("dmy"), never("mdy"), back("dmy"), back("mdy"), shape)
    own = (
        F.when(F.col("digits") == 4, "ymd")
        .when(((F.col("sep") == ".") & (F.col("least_sep") == ".")) | (F.col("no_mdy") & ~F.col("no_dmy")), "dmy")
        .when(F.col("no_dmy") & ~F.col("no_mdy"), "mdy")
        .when(F.col("dmy_back") < F.col("mdy_back"), "dmy")
        .when(F.col("mdy_back") < F.col("dmy_back"), "mdy")
    )
    chats = chats.select("chat", "shape", own.alias("own"))
    peers = chats.where("own IS NOT NULL").groupBy("shape").agg(F.when(F.count_distinct("own") == 1, F.min("own")).alias("theirs"))
    chats = chats.join(peers, "shape", "left").select("chat", F.coalesce("own", "theirs", F.raise_error(F.concat(F.lit("day or month first? "), "chat"))).alias("order"))
    rows = rows.join(chats, "chat")
    chosen = F.when(F.col("order") == "ymd", F.col("ymd")).when(F.col("order") == "dmy", F.col("dmy")).otherwise(F.col("mdy"))
    whole = Window.partitionBy("chat")
    rows = rows.withColumn("at", chosen)
    sender = F.regexp_extract("body", r"(?s)^([^:\n]{1,80}): (.*)$", 1)
    rows = rows.withColumn("sender", F.when(sender != "", sender)).withColumn("said", F.when(sender != "", F.regexp_extract("body", r"(?s)^([^:\n]{1,80}): (.*)$", 2)).otherwise(F.col("body")))
    rows = rows.withColumn("thread_id", F.regexp_replace("chat", r"\.txt$", "")).withColumn("senders", F.size(F.collect_set("sender").over(whole)))
    rows = with_occurrence(rows, ["thread_id", "at", "sender", "said"], ["number"])
    return canonical(
        rows, platform=F.lit("whatsapp"), thread_id=F.col("thread_id"), thread_kind=F.when(F.col("senders") > 2, "group").otherwise("dm"), title=F.col("thread_id"),
        uid=derived_uid("wa", "at", "sender", "said"), sender_id=F.col("sender"), sender_name=F.col("sender"), kind=F.when(F.col("sender").isNull(), "service").otherwise("message"),
        text=F.col("said"), sent_at_unix=F.col("at"),
    )


def phone(address: Column) -> Column:
    """Digits with a leading plus where there is one; addresses with letters in lower case."""
    bare = F.regexp_replace(address, r"[^0-9+]", "")
    return F.when(address.rlike("[A-Za-z]"), F.lower(F.trim(address))).when(bare == "", F.trim(address)).otherwise(bare)


SMS = "_address string, _date long, _type int, _body string, _contact_name string"


def sms(spark: SparkSession, path: str) -> DataFrame:
    """<sms> records: type 1 came in, 2 and 4 to 6 went out, 3 is a draft and is left out; the text "null" is none."""
    rows = spark.read.format("xml").option("rowTag", "sms").schema(SMS).load(path).where("_type <> 3")
    rows = rows.withColumn("thread_id", F.concat(F.lit("dm/"), phone(F.col("_address")))).withColumn("out", F.col("_type").isin(2, 4, 5, 6))
    rows = with_occurrence(rows, ["thread_id", "_date", "_type", "_body"], ["_date"])
    null = lambda c: F.when(F.col(c) != "null", F.col(c))
    return canonical(
        rows, platform=F.lit("sms"), thread_id=F.col("thread_id"), thread_kind=F.lit("dm"), title=null("_contact_name"), uid=derived_uid("sms", "_date", "_type", "_body"),
        sender_id=F.when(F.col("out"), "self").otherwise(phone(F.col("_address"))), sender_name=F.when(~F.col("out"), null("_contact_name")), kind=F.lit("message"),
        text=F.coalesce(null("_body"), F.lit("")), sent_at_unix=F.floor(F.col("_date") / 1000).cast("long"),
    )


_PART = "struct<_ct: string, _text: string, _name: string, _cl: string, _fn: string, _data: string>"
MMS = (
    "_date long, _msg_box int, _m_id string, _address string, _contact_name string, _sub string, addrs struct<addr: array<struct<_address: string, _type: int>>>, "
    f"parts struct<part: array<{_PART}>>"
)
#: Types of addresses.
FROM, TO = 137, 151


def mms(spark: SparkSession, path: str, own: str | None = None) -> DataFrame:
    """<mms> records: box 1 came in, 2 and 4 went out, 3 is a draft and is left out; another box raises.

    Everybody but the owner is in the thread; without ``own`` (the owner's number), the sender of what went out is the
    owner. Text is the subject and all plain parts by lines; other parts but layouts are media, named with the hash of
    their bytes where the backup has them.
    """
    rows = spark.read.format("xml").option("rowTag", "mms").schema(MMS).load(path).where("_msg_box IS NULL OR _msg_box <> 3")
    null = lambda c: F.when((c != "null") & (c != ""), c)
    box = F.when(F.col("_msg_box").isin(1, 2, 4), F.col("_msg_box") != 1).otherwise(F.raise_error(F.lit("an mms of unknown box")).cast("boolean"))
    joined = F.filter(F.split(F.coalesce(null(F.col("_address")), F.lit("")), "~"), lambda a: a != "")
    listed = F.filter(F.coalesce("addrs.addr", F.array().cast("array<struct<_address: string, _type: int>>")), lambda a: null(a["_address"]).isNotNull() & a["_type"].isNotNull())
    known = F.when(F.size(listed) > 0, F.transform(listed, lambda a: F.struct(phone(a["_address"]).alias("number"), a["_type"].alias("type")))).otherwise(
        F.transform(joined, lambda a: F.struct(phone(a).alias("number"), F.lit(TO).alias("type")))
    )
    rows = rows.withColumn("out", box).withColumn("known", known)
    mine = phone(F.lit(own)) if own else F.lit(None).cast("string")
    others = F.array_distinct(F.transform(F.filter("known", lambda a: ~a["number"].eqNullSafe(mine) & ~(F.col("out") & (a["type"] == FROM))), lambda a: a["number"]))
    sender = F.get(F.filter("known", lambda a: a["type"] == FROM), 0)["number"]
    names = F.split(null(F.col("_contact_name")), ", ")
    paired = F.when(F.size(names) == F.size(joined), F.arrays_zip(F.transform(joined, phone).alias("number"), names.alias("name")))
    rows = rows.withColumns({"others": others, "paired": paired, "sender": F.when(F.col("out") | sender.isNull() | sender.eqNullSafe(mine), "self").otherwise(sender)})
    rows = rows.withColumn("others", F.when(F.size("others") > 0, F.col("others")).otherwise(F.raise_error(F.lit("an mms that names nobody but its sender"))))
    alone = F.when((F.size("others") == 1) & F.col("paired").isNull(), null(F.col("_contact_name")))
    name = lambda number: F.coalesce(F.get(F.filter("paired", lambda p: p["number"] == number), 0)["name"], alone, number)
    part = F.coalesce("parts.part", F.array().cast(f"array<{_PART}>"))
    kind = lambda p: F.lower(F.coalesce(p["_ct"], F.lit("application/octet-stream")))
    said = F.concat(F.array(null(F.col("_sub"))), F.transform(F.filter(part, lambda p: kind(p) == "text/plain"), lambda p: null(p["_text"])))
    label = lambda p: F.coalesce(null(p["_name"]), null(p["_cl"]), null(p["_fn"]), F.lit("attachment"))
    content = lambda p: F.coalesce(F.sha2(F.unbase64(null(p["_data"])), 256), F.lit("missing"))
    files = F.transform(F.filter(part, lambda p: ~kind(p).isin("text/plain", "application/smil")), lambda p: F.concat(F.lit("mms/"), label(p), F.lit("#"), content(p)))
    single = F.size("others") == 1
    rows = rows.withColumns({
        "thread_id": F.when(single, F.concat(F.lit("dm/"), F.get("others", 0))).otherwise(F.concat(F.lit("group/"), F.array_join(F.array_sort("others"), ","))),
        "text": F.array_join(F.filter(said, lambda t: t.isNotNull()), "\n"), "files": files, "single": single,
    }).withColumn("held", F.array_join("files", "\x1f"))
    rows = with_occurrence(rows, ["thread_id", "_date", "out", "text", "held"], ["_date"])
    return canonical(
        rows, platform=F.lit("sms"), thread_id=F.col("thread_id"), thread_kind=F.when(F.col("single"), "dm").otherwise("group"), title=F.array_join(F.transform("others", name), ", "),
        uid=F.coalesce(F.concat(F.lit("mms/"), null(F.col("_m_id"))), derived_uid("mms", "_date", "out", "text", "held")), sender_id=F.col("sender"),
        sender_name=F.when(F.col("sender") != "self", name(F.col("sender"))), kind=F.lit("message"), text=F.col("text"), sent_at_unix=F.floor(F.col("_date") / 1000).cast("long"), media=F.col("files"),
    )


def backup(spark: SparkSession, path: str, own: str | None = None) -> DataFrame:
    """All records of a backup, sms and mms."""
    return sms(spark, path).unionByName(mms(spark, path, own))
