"""Exports in JSON: Telegram, Hangouts, Google Chat, Messenger and Instagram, Skype, Slack, Discord."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .canonical import canonical, derived_uid, file_part, with_occurrence

_REACTION = "array<struct<emoji: string, actor: string, count: long>>"

TELEGRAM_MESSAGE = (
    "struct<id: long, type: string, date: string, date_unixtime: string, edited_unixtime: string, `from`: string, from_id: string, actor: string, actor_id: string, "
    "action: string, text_entities: array<struct<type: string, text: string, href: string, document_id: string, user_id: long, language: string>>, reply_to_message_id: long, "
    "photo: string, file: string, contact_vcard: string, "
    "reactions: array<struct<type: string, count: long, emoji: string, document_id: string, recent: array<struct<`from`: string, from_id: string>>>>>"
)
TELEGRAM_CHAT = f"struct<name: string, type: string, id: long, messages: array<{TELEGRAM_MESSAGE}>>"
TELEGRAM = f"chats struct<list: array<{TELEGRAM_CHAT}>>, left_chats struct<list: array<{TELEGRAM_CHAT}>>, name string, type string, id long, messages array<{TELEGRAM_MESSAGE}>"
#: Kinds of threads by the export's chat types; any other is a group.
TELEGRAM_KINDS = {
    "saved_messages": "saved", "personal_chat": "dm", "bot_chat": "dm", "private_group": "group", "private_supergroup": "group",
    "public_supergroup": "group", "channel": "channel", "private_channel": "channel", "public_channel": "channel",
}
MISSING_MEDIA = "(File not included. Change data exporting settings to download.)"


def _telegram_id(ref: Column) -> Column:
    plain = F.regexp_extract(ref, r"^(?:user|channel|chat)([0-9]+)$", 1)
    return F.when(ref.isNull(), F.lit(None)).when(plain != "", plain).otherwise(F.raise_error(F.concat(F.lit("unknown identity prefix: "), ref)))


def telegram(spark: SparkSession, path: str) -> DataFrame:
    """result.json of all chats or of one. Text is that of text_entities, never ``text``; service messages name an actor.

    A chat without an id goes by its name. The zone's offset is what local time differs from the stamp by, in whole minutes;
    a message with local time only is taken for UTC, its offset unknown. One without either raises, and so does a chat
    without id and name.
    """
    root = spark.read.schema(TELEGRAM).option("multiLine", True).json(path)
    one = F.when(F.col("messages").isNotNull(), F.array(F.struct("name", "type", "id", "messages")))
    none = F.array().cast(f"array<{TELEGRAM_CHAT}>")
    chats = F.concat(*[F.coalesce(c, none) for c in (F.col("chats.list"), F.col("left_chats.list"), one)])
    rows = root.select(F.explode(chats).alias("chat")).select("chat.*").select("name", "type", F.col("id").alias("chat_id"), F.explode("messages").alias("m"))
    kinds = F.create_map(*[F.lit(x) for pair in TELEGRAM_KINDS.items() for x in pair])
    kind = F.coalesce(F.try_element_at(kinds, F.col("type")), F.lit("group"))
    service = F.col("m.type") == "service"
    named_chat = F.when(F.trim("name") != "", F.concat(F.lit("name:"), "name"))
    thread = F.coalesce(F.col("chat_id").cast("string"), named_chat, F.raise_error(F.lit("a chat without an id or a name")))
    local = F.unix_seconds(F.try_to_timestamp(F.concat("m.date", F.lit("Z"))))
    stamp = F.col("m.date_unixtime").try_cast("long")
    sent = F.coalesce(stamp, local, F.raise_error(F.lit("a message without a time")).cast("long"))
    marked = F.filter(F.coalesce("m.text_entities", F.array()), lambda e: e["type"] != "plain")
    uid = lambda n: F.concat(F.lit("tg/"), thread, F.lit("/"), n.cast("string"))
    shown = lambda r: F.coalesce(r["emoji"], r["document_id"])  # noqa: E731 (custom emoji have an id only)
    named = F.flatten(F.transform("m.reactions", lambda r: F.transform(F.coalesce(r["recent"], F.array()), lambda a: F.struct(shown(r).alias("emoji"), a["from_id"].alias("actor"), F.lit(1).cast("long").alias("count")))))
    rest = F.filter(
        F.transform("m.reactions", lambda r: F.struct(shown(r).alias("emoji"), F.lit(None).cast("string").alias("actor"), (r["count"] - F.size(F.coalesce(r["recent"], F.array()))).cast("long").alias("count"))),
        lambda r: r["count"] > 0,
    )
    media = F.filter(F.array("m.photo", "m.file", "m.contact_vcard"), lambda f: f.isNotNull())
    return canonical(
        rows, platform=F.lit("telegram"), thread_id=thread, thread_kind=kind, title=F.col("name"), uid=uid(F.col("m.id")),
        sender_id=_telegram_id(F.when(service, F.col("m.actor_id")).otherwise(F.col("m.from_id"))), sender_name=F.when(service, F.col("m.actor")).otherwise(F.col("m.from")),
        kind=F.when(service, "service").otherwise("message"), service_action=F.col("m.action"),
        text=F.array_join(F.transform(F.coalesce("m.text_entities", F.array()), lambda e: e["text"]), ""),
        sent_at_unix=sent, edited_at_unix=F.col("m.edited_unixtime").cast("long"), tz_offset_minutes=F.round((local - stamp) / 60).cast("long"),
        entities=F.when(F.size(marked) > 0, F.to_json(marked)),
        reply_to_uid=uid(F.col("m.reply_to_message_id")), reactions=F.concat(named, rest).cast(_REACTION),
        media=F.transform(media, lambda f: F.when(f == MISSING_MEDIA, F.lit("missing")).otherwise(f)),
    )


HANGOUTS = (
    "conversations array<struct<conversation: struct<conversation_id: struct<id: string>, conversation: struct<type: string, name: string, "
    "participant_data: array<struct<id: struct<gaia_id: string>, fallback_name: string>>>>, events: array<struct<event_id: string, sender_id: struct<gaia_id: string>, "
    "timestamp: string, event_type: string, chat_message: struct<message_content: struct<segment: array<struct<type: string, text: string>>>>>>>>"
)


def hangouts(spark: SparkSession, path: str) -> DataFrame:
    """Hangouts.json: one-to-one conversations are direct; calls, membership and names are service messages."""
    root = spark.read.schema(HANGOUTS).option("multiLine", True).json(path)
    rows = root.select(F.explode("conversations").alias("c")).select("c.conversation", F.explode("c.events").alias("e"))
    about = F.col("conversation.conversation")
    roster = F.size(F.coalesce(about["participant_data"], F.array()))
    kind = F.when(about["type"] == "STICKY_ONE_TO_ONE", "dm").when(about["type"] == "GROUP", "group").when(roster <= 2, "dm").otherwise("group")
    thread = F.col("conversation.conversation_id.id")
    segments = F.coalesce("e.chat_message.message_content.segment", F.array())
    text = F.array_join(F.transform(segments, lambda s: F.when(s["type"] == "LINE_BREAK", "\n").otherwise(F.coalesce(s["text"], F.lit("")))), "")
    sender = F.col("e.sender_id.gaia_id")
    name = F.element_at(F.transform(F.filter(about["participant_data"], lambda p: p["id"]["gaia_id"] == sender), lambda p: p["fallback_name"]), 1)
    message = F.col("e.event_type") == "REGULAR_CHAT_MESSAGE"
    return canonical(
        rows, platform=F.lit("hangouts"), thread_id=thread, thread_kind=kind, title=about["name"], uid=F.concat(F.lit("gh/"), thread, F.lit("/"), "e.event_id"),
        sender_id=sender, sender_name=F.when(F.size(F.filter(about["participant_data"], lambda p: p["id"]["gaia_id"] == sender)) > 0, name), kind=F.when(message, "message").otherwise("service"),
        service_action=F.when(~message, F.lower("e.event_type")), text=text, sent_at_unix=F.floor(F.col("e.timestamp").cast("long") / 1_000_000).cast("long"),
    )


_CHAT_PERSON = "struct<name: string, email: string>"
GOOGLE_CHAT = (
    f"name string, members array<{_CHAT_PERSON}>, user {_CHAT_PERSON}, messages array<struct<creator: {_CHAT_PERSON}, created_date: string, updated_date: string, text: string, "
    "message_id: string, quoted_message_metadata: struct<message_id: string>, attached_files: array<struct<original_name: string, export_name: string>>, "
    "reactions: array<struct<emoji: struct<unicode: string, custom_emoji: struct<short_code: string>>, reactor_emails: array<string>>>>>"
)
#: Forms of its dates without weekday and zone.
_CHAT_DATES = [f"{day} 'at' {time}XXX" for day in ("MMMM d, yyyy", "d MMMM yyyy", "MMM d, yyyy", "d MMM yyyy") for time in ("h:mm:ss a", "H:mm:ss", "h:mm a", "H:mm")]


def chat_date(text: Column) -> Column:
    """Seconds of an English date of Google Chat, in UTC or GMT, or of an ISO time; another text raises."""
    plain = F.trim(F.regexp_replace(text, "[\u202f\u00a0]", " "))
    bare = F.regexp_replace(F.regexp_extract(plain, r"^(?:[A-Za-z]+,\s+)?(.*\S)\s+(?i:UTC|GMT)$", 1), r"\s+", " ")
    bare = F.concat(F.regexp_replace(F.regexp_replace(bare, r"(?i)\s*\bam$", " AM"), r"(?i)\s*\bpm$", " PM"), F.lit("Z"))
    read = [F.try_to_timestamp(bare, F.lit(form)) for form in _CHAT_DATES]
    iso = F.when(plain.rlike(r"^[0-9-]+T"), F.try_to_timestamp(F.when(plain.rlike(r"(Z|[+-][0-9:]+)$"), plain).otherwise(F.concat(plain, F.lit("Z")))))
    return F.coalesce(*[F.unix_seconds(t) for t in (*read, iso)], F.raise_error(F.concat(F.lit("not an English date of Google Chat: "), F.coalesce(text, F.lit("none")))).cast("long"))


def google_chat(spark: SparkSession, root: str) -> DataFrame:
    """Groups/<kind> <id>/messages.json with group_info.json beside it, and the account in Users.

    Folders named DM are direct, Space groups; others go by their members. A message without an id goes by time,
    sender and text, and which of equal ones it is. No creator, no messages, another date or two accounts raise.
    """
    files = spark.read.schema(GOOGLE_CHAT).option("multiLine", True).json(f"{root}/{{Groups,Users}}/*/*.json")
    files = files.withColumns({"file": file_part(F.input_file_name(), 1), "folder": file_part(F.input_file_name(), 2)})
    account = files.where("file = 'user_info.json'").agg(
        F.when(F.count("*") < 2, F.lower(F.max("user.email"))).otherwise(F.raise_error(F.lit("more than one account"))).alias("owner")
    )  # one row
    info = files.where("file = 'group_info.json'").select("folder", F.col("name").alias("space"), "members")
    listed = F.coalesce("messages", F.raise_error(F.concat(F.lit("no messages in "), "folder")))
    rows = files.where("file = 'messages.json'").select("folder", F.posexplode(listed).alias("pos", "m"))
    rows = rows.join(info, "folder", "left").crossJoin(F.broadcast(account)).withColumn("members", F.coalesce("members", F.array().cast(f"array<{_CHAT_PERSON}>")))
    spaced = F.instr("folder", " ") > 1
    prefix = F.when(spaced, F.substring_index("folder", " ", 1)).otherwise("Group")
    group = F.when(spaced, F.regexp_replace("folder", "^[^ ]+ ", "")).otherwise(F.col("folder"))
    kind = F.when(prefix == "DM", "dm").when(prefix == "Space", "group").when(F.size("members") <= 2, "dm").otherwise("group")
    filled = lambda c: F.when(F.trim(c) != "", c)
    called = lambda p: F.coalesce(filled(p["name"]), p["email"])
    other = F.get(F.filter("members", lambda p: ~F.lower(p["email"]).eqNullSafe(F.col("owner")) | F.col("owner").isNull()), 0)
    sender = F.lower(filled(F.col("m.creator.email")))
    listed_as = F.get(F.filter("members", lambda p: F.lower(p["email"]) == sender), 0)
    name = F.coalesce(called(listed_as), called(F.col("m.creator")), F.raise_error(F.lit("a message without a creator")))
    emoji = lambda r: F.coalesce(r["emoji"]["unicode"], r["emoji"]["custom_emoji"]["short_code"], F.when(r["emoji"]["custom_emoji"].isNotNull(), "custom"))
    actors = lambda r: F.when(F.size(r["reactor_emails"]) > 0, F.transform(r["reactor_emails"], F.lower)).otherwise(F.array(F.lit(None).cast("string")))
    reactions = F.flatten(F.transform("m.reactions", lambda r: F.transform(actors(r), lambda a: F.struct(emoji(r).alias("emoji"), a.alias("actor"), F.lit(1).cast("long").alias("count")))))
    rows = rows.withColumns({
        "thread_id": F.concat(F.lower(prefix), F.lit("/"), group), "kind": kind, "title": F.when(kind == "dm", F.coalesce(called(other), "space")).otherwise(F.col("space")),
        "sender": sender, "name": name, "text": F.coalesce("m.text", F.lit("")), "at": chat_date(F.col("m.created_date")),
    })
    rows = with_occurrence(rows, ["thread_id", "at", "sender", "name", "text", "m.message_id"], ["pos"])
    return canonical(
        rows, platform=F.lit("googlechat"), thread_id=F.col("thread_id"), thread_kind=F.col("kind"), title=F.col("title"),
        uid=F.coalesce(F.concat(F.lit("gc/"), "m.message_id"), derived_uid("gc", "at", "sender", "name", "text")), sender_id=F.col("sender"), sender_name=F.col("name"), kind=F.lit("message"),
        text=F.col("text"), sent_at_unix=F.col("at"), edited_at_unix=F.when(F.col("m.updated_date").isNotNull(), chat_date(F.col("m.updated_date"))),
        reply_to_uid=F.concat(F.lit("gc/"), "m.quoted_message_metadata.message_id"), reactions=F.filter(reactions, lambda r: r["emoji"].isNotNull()),
        media=F.transform("m.attached_files", lambda f: F.coalesce(f["export_name"], f["original_name"])),
    )


META = (
    "participants array<struct<name: string>>, title string, thread_path string, messages array<struct<sender_name: string, timestamp_ms: long, content: string, "
    "type: string, is_unsent: boolean, photos: array<struct<uri: string>>, videos: array<struct<uri: string>>, gifs: array<struct<uri: string>>, audio_files: array<struct<uri: string>>, "
    "files: array<struct<uri: string>>, sticker: struct<uri: string>, reactions: array<struct<reaction: string, actor: string>>>>"
)


def repaired(text: Column) -> Column:
    """UTF-8 that was written as Latin-1, read as UTF-8 again; text that is no such thing stays."""
    narrow = ~text.rlike(r"[^\x00-\xff]")
    raw = F.encode(F.when(narrow, text), "ISO-8859-1")
    return F.when(narrow & F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8")).otherwise(text)


def meta(spark: SparkSession, path: str, platform: str = "messenger") -> DataFrame:
    """message_*.json files of Messenger or Instagram; a thread's parts come together by their folder."""
    files = spark.read.schema(META).option("multiLine", True).json(path).withColumn("path", F.input_file_name())
    rows = files.select("participants", "title", "path", F.coalesce("thread_path", file_part(F.col("path"), 2)).alias("thread_id"), F.posexplode("messages").alias("place", "m"))
    rows = rows.withColumn("sender", repaired(F.col("m.sender_name"))).withColumn("content", F.when(F.coalesce("m.is_unsent", F.lit(False)), "").otherwise(repaired(F.col("m.content"))))
    rows = rows.withColumn("at", F.col("m.timestamp_ms"))
    rows = with_occurrence(rows, ["thread_id", "at", "sender", "content"], ["path", "place"])
    none = F.array().cast("array<struct<uri: string>>")
    media = F.concat(*[F.coalesce(f"m.{c}", none) for c in ("photos", "videos", "gifs", "audio_files", "files")], F.when(F.col("m.sticker").isNotNull(), F.array("m.sticker")).otherwise(none))
    reactions = F.transform("m.reactions", lambda r: F.struct(repaired(r["reaction"]).alias("emoji"), repaired(r["actor"]).alias("actor"), F.lit(1).cast("long").alias("count")))
    service = F.col("m.type").isin("Call", "Subscribe", "Unsubscribe")
    return canonical(
        rows, platform=F.lit(platform), thread_id=F.col("thread_id"), thread_kind=F.when(F.size("participants") <= 2, "dm").otherwise("group"), title=repaired(F.col("title")),
        uid=derived_uid(platform[:2], "at", "sender", "content"), sender_id=F.col("sender"), sender_name=F.col("sender"), kind=F.when(service, "service").otherwise("message"),
        service_action=F.when(service, F.lower("m.type")), text=F.coalesce("content", F.lit("")), sent_at_unix=F.floor(F.col("at") / 1000).cast("long"), reactions=reactions,
        media=F.transform(media, lambda p: p["uri"]),
    )


SKYPE = "userId string, conversations array<struct<id: string, displayName: string, MessageList: array<struct<id: string, originalarrivaltime: string, messagetype: string, content: string, `from`: string, displayName: string, properties: struct<edittime: string, deletetime: string>>>>>"


#: Skype's types of messages, and what service messages do.
SKYPE_TEXT = "Text"
SKYPE_RICH = (
    "RichText", "RichText/Html", "RichText/Location", "RichText/Contacts", "RichText/Media_Card", "RichText/Sms",
    "RichText/UriObject", "RichText/Media_Video", "RichText/Media_AudioMsg", "RichText/Media_GenericFile", "RichText/Media_FlikMsg",
)
SKYPE_SERVICE = {
    "Event/Call": "phone_call", "ThreadActivity/AddMember": "invite_members", "ThreadActivity/DeleteMember": "remove_members",
    "ThreadActivity/TopicUpdate": "edit_group_title", "ThreadActivity/PictureUpdate": "edit_group_photo",
}


@F.pandas_udf(StringType())
def unescaped(texts: pd.Series) -> pd.Series:
    """Text with its character references decoded."""
    return texts.map(html.unescape, na_action="ignore")


def skype(spark: SparkSession, path: str) -> DataFrame:
    """messages.json: conversations of kinds 8, 28, 4 and 2 are direct, 19 groups, 48 aren't chats.

    Rich text loses its markup, plain text stays; service messages have none, and neither have deleted ones. An unknown kind
    or type raises; other thread activities go by their names.
    """
    root = spark.read.schema(SKYPE).option("multiLine", True).json(path)
    rows = root.select(F.explode("conversations").alias("c")).select(F.col("c.id").alias("conversation"), F.col("c.displayName").alias("title"), F.explode("c.MessageList").alias("m"))
    prefix = F.substring_index("conversation", ":", 1)
    kind = F.when(prefix.isin("8", "28", "4", "2"), "dm").when(prefix == "19", "group").otherwise(F.raise_error(F.concat(F.lit("unknown conversation: "), "conversation")))
    rows = rows.where(prefix != "48")
    named = F.col("m.messagetype")
    known = F.create_map(*[F.lit(x) for pair in SKYPE_SERVICE.items() for x in pair])
    activity = F.when(named.startswith("ThreadActivity/"), F.lower(F.substring_index(named, "/", -1)))
    unknown = F.raise_error(F.concat(F.lit("unknown message type: "), F.coalesce(named, F.lit("none"))))
    rows = rows.withColumn("action", F.when(~(F.coalesce(named, F.lit("")).isin(SKYPE_TEXT, *SKYPE_RICH)), F.coalesce(F.try_element_at(known, named), activity, unknown)))
    # references are decoded in Python, only where there are any
    rich = F.regexp_replace(F.coalesce("m.content", F.lit("")), "<[^>]*>", "")
    rows = rows.withColumn("rich", rich).withColumn("rich", F.coalesce(unescaped(F.when(F.contains("rich", F.lit("&")), F.col("rich"))), "rich"))
    gone = F.col("action").isNotNull() | F.col("m.properties.deletetime").isNotNull()
    text = F.when(gone, "").when(named == SKYPE_TEXT, F.coalesce("m.content", F.lit(""))).otherwise(F.col("rich"))
    return canonical(
        rows, platform=F.lit("skype"), thread_id=F.col("conversation"), thread_kind=kind, title=F.col("title"), uid=F.concat(F.lit("sk/"), "conversation", F.lit("/"), "m.id"),
        sender_id=F.col("m.from"), sender_name=F.col("m.displayName"), kind=F.when(F.col("action").isNull(), "message").otherwise("service"), service_action=F.col("action"),
        text=text, sent_at_unix=F.unix_seconds(F.to_timestamp("m.originalarrivaltime")),
        edited_at_unix=F.floor(F.col("m.properties.edittime").cast("long") / 1000).cast("long"),
    )


SLACK_MESSAGE = "type string, subtype string, user string, text string, ts string, thread_ts string, bot_id string, username string, reactions array<struct<name: string, users: array<string>, count: long>>"
SLACK_USERS = "id string, name string, real_name string"
SLACK_CHATS = "id string, name string, members array<string>"
#: The platform's subtypes of messages that somebody writes; all others but tombstones are service messages.
SLACK_SPOKEN = ("bot_message", "file_comment", "file_share", "me_message", "reply_broadcast", "slackbot_response", "thread_broadcast")
#: Its subtypes of service messages by what they do; the rest go by their names.
SLACK_SERVICE = {
    "bot_add": "invite_members", "bot_remove": "remove_members", "channel_archive": "archive", "channel_join": "invite_members", "channel_leave": "remove_members",
    "channel_name": "edit_group_title", "channel_purpose": "edit_group_title", "channel_topic": "edit_group_title", "channel_unarchive": "unarchive", "group_archive": "archive",
    "group_join": "invite_members", "group_leave": "remove_members", "group_name": "edit_group_title", "group_purpose": "edit_group_title", "group_topic": "edit_group_title",
    "group_unarchive": "unarchive", "huddle_thread": "phone_call", "pinned_item": "pin_message", "reminder_add": "reminder", "unpinned_item": "unpin_message",
}


def slack(spark: SparkSession, folder: str) -> DataFrame:
    """An export folder: users.json, lists of conversations, and <conversation>/<day>.json. Mentions and links are written out.

    Channels, private groups and group messages are groups, filed by name; direct messages are filed by id. A folder that no
    list names is a group of its own.
    """
    users = spark.read.schema(SLACK_USERS).option("multiLine", True).json(f"{folder}/users.json")
    names = users.select(F.col("id").alias("user"), F.coalesce("real_name", "name").alias("sender_name"))
    lists = spark.read.schema(SLACK_CHATS).option("multiLine", True).json(f"{folder}/{{channels,groups,dms,mpims}}.json").withColumn("list", file_part(F.input_file_name(), 1))
    chats = lists.where("id IS NOT NULL AND list IN ('channels.json', 'groups.json', 'dms.json', 'mpims.json')")
    direct = F.col("list") == "dms.json"
    chats = chats.select(F.when(direct, F.col("id")).otherwise(F.coalesce("name", "id")).alias("channel"), F.col("id").alias("chat_id"), F.when(direct, "dm").otherwise("group").alias("chat_kind"), F.when(F.col("list").isin("channels.json", "groups.json"), F.concat(F.lit("#"), "name")).alias("chat_title"))
    days = spark.read.schema(SLACK_MESSAGE).option("multiLine", True).json(f"{folder}/*/*.json").withColumn("channel", file_part(F.input_file_name(), 2))
    rows = days.where("subtype IS NULL OR subtype <> 'tombstone'").join(names, "user", "left").join(chats.dropDuplicates(["channel"]), "channel", "left")
    # the names that a message mentions, looked up by a join: the whole book of users goes nowhere
    asked = rows.where(F.contains("text", F.lit("<@"))).select("channel", "ts", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("<@([A-Za-z0-9]+)"), F.lit(1)))).alias("user"))
    book = asked.distinct().join(names, "user").groupBy("channel", "ts").agg(F.map_from_entries(F.collect_list(F.struct("user", "sender_name"))).alias("book"))
    rows = rows.join(book, ["channel", "ts"], "left").withColumn("book", F.coalesce("book", F.create_map().cast("map<string, string>")))
    thread = F.coalesce("chat_id", "channel")
    uid = lambda ts: F.concat(F.lit("sl/"), thread, F.lit("/"), ts)

    def shown(part: Column) -> Column:
        inner = F.substring_index(F.regexp_replace(part, "^<|>$", ""), "|", 1)
        label = F.when(F.contains(part, F.lit("|")), F.regexp_replace(F.substring_index(part, "|", -1), ">$", ""))
        return (
            F.when(~part.rlike("^<.*>$"), part)
            .when(part.startswith("<@"), F.concat(F.lit("@"), F.coalesce(label, F.try_element_at("book", F.substring(inner, 2, 99)), F.substring(inner, 2, 99))))
            .when(part.startswith("<#"), F.concat(F.lit("#"), F.coalesce(label, F.substring(inner, 2, 99))))
            .when(part.startswith("<!"), F.concat(F.lit("@"), F.coalesce(label, F.substring(inner, 2, 99))))
            .otherwise(F.coalesce(label, inner))
        )

    text = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "(?=<)|(?<=>)"), shown), "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    spoken = F.col("subtype").isNull() | F.col("subtype").isin(*SLACK_SPOKEN)
    action = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in SLACK_SERVICE.items() for x in pair]), F.col("subtype")), "subtype")
    reactions = F.flatten(F.transform("reactions", lambda r: F.transform(r["users"], lambda u: F.struct(r["name"].alias("emoji"), u.alias("actor"), F.lit(1).cast("long").alias("count")))))
    return canonical(
        rows, platform=F.lit("slack"), thread_id=thread, thread_kind=F.coalesce("chat_kind", F.lit("group")), title=F.when(F.col("chat_id").isNull(), F.col("channel")).otherwise(F.col("chat_title")),
        uid=uid(F.col("ts")), sender_id=F.coalesce("user", "bot_id"), sender_name=F.coalesce("sender_name", "username"), kind=F.when(spoken, "message").otherwise("service"),
        service_action=F.when(~spoken, action), text=text, sent_at_unix=F.floor(F.col("ts").cast("double")).cast("long"),
        reply_to_uid=F.when(F.col("thread_ts") != F.col("ts"), uid(F.col("thread_ts"))), reactions=reactions,
    )


#: Kinds of threads by the platform's channel types.
DISCORD_TYPES = {1: "dm", 3: "group", 0: "channel", 2: "channel", 4: "channel", 5: "channel", 10: "channel", 11: "channel", 12: "channel", 13: "channel", 15: "channel", 16: "channel"}


def discord_package(spark: SparkSession, path: str) -> DataFrame:
    """messages.csv files of a data package (ID, Timestamp, Contents, Attachments) with channel.json beside each, which has
    the channel's id and type; without one the folder is the channel. An unknown type raises."""
    rows = spark.read.schema("ID string, Timestamp string, Contents string, Attachments string").csv(path, header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST", enforceSchema=False)
    rows = rows.withColumn("folder", file_part(F.input_file_name(), 2))
    about = spark.read.schema("id string, type int, name string").option("multiLine", True).option("pathGlobFilter", "channel.json").option("recursiveFileLookup", True)
    about = about.json(path.split("*")[0].rstrip("/") if "*" in path else path.rpartition("/")[0]).withColumn("folder", file_part(F.input_file_name(), 2)).withColumnRenamed("id", "channel_id")
    types = F.create_map(*[F.lit(x) for pair in DISCORD_TYPES.items() for x in pair])
    rows = rows.join(about.dropDuplicates(["folder"]), "folder", "left").withColumn("channel", F.coalesce("channel_id", "folder"))
    unknown = F.raise_error(F.concat(F.lit("unknown channel type: "), F.col("type").cast("string")))
    kind = F.when(F.col("type").isNull(), "channel").otherwise(F.coalesce(F.try_element_at(types, F.col("type")), unknown))
    sent = F.unix_seconds(F.to_timestamp(F.col("Timestamp")))
    return canonical(
        rows, platform=F.lit("discord"), thread_id=F.col("channel"), thread_kind=kind, title=F.col("name"), uid=F.concat(F.lit("dc/"), "channel", F.lit("/"), "ID"), sender_id=F.lit("self"),
        kind=F.lit("message"), text=F.coalesce("Contents", F.lit("")), sent_at_unix=sent, media=F.filter(F.split(F.coalesce("Attachments", F.lit("")), " "), lambda a: a != ""),
    )


_DISCORD_PERSON = "struct<id: string, name: string, nickname: string>"
DISCORD_EXPORT = (
    "guild struct<name: string>, channel struct<id: string, type: string, name: string>, messages array<struct<id: string, type: string, timestamp: string, timestampEdited: string, "
    f"content: string, author: {_DISCORD_PERSON}, attachments: array<struct<url: string>>, stickers: array<struct<name: string, sourceUrl: string>>, "
    f"reference: struct<messageId: string, channelId: string>, reactions: array<struct<emoji: struct<id: string, name: string>, count: long, users: array<{_DISCORD_PERSON}>>>>>"
)
#: Kinds of threads by the exporter's channel types.
DISCORD_KINDS = {
    "DirectTextChat": "dm", "DirectGroupTextChat": "group", "GuildTextChat": "channel", "GuildNewsChat": "channel", "GuildAnnouncement": "channel", "GuildVoiceChat": "channel",
    "GuildStageVoice": "channel", "GuildPublicThread": "channel", "GuildPrivateThread": "channel", "GuildNewsThread": "channel", "GuildForum": "channel", "GuildCategory": "channel",
}
#: Its types of messages that people write, and the service messages.
DISCORD_SPOKEN = ("Default", "Reply", "ChatInputCommand", "ContextMenuCommand", "ThreadStarterMessage")
DISCORD_SERVICE = {
    "Call": "phone_call", "RecipientAdd": "invite_members", "RecipientRemove": "remove_members", "ChannelNameChange": "edit_group_title", "ChannelIconChange": "edit_group_photo",
    "ChannelPinnedMessage": "pin_message", "GuildMemberJoin": "join_group_by_link", "ThreadCreated": "thread_created",
}


def discord_export(spark: SparkSession, path: str) -> DataFrame:
    """The exporter's JSON, a file for each channel. Unknown types of channels or messages, and times that aren't, raise."""
    files = spark.read.schema(DISCORD_EXPORT).option("multiLine", True).json(path)
    rows = files.select("guild", "channel", F.explode(F.coalesce("messages", F.raise_error(F.lit("no messages array")))).alias("m"))
    named = lambda book, key: F.try_element_at(F.create_map(*[F.lit(x) for pair in book.items() for x in pair]), key)
    kind = F.coalesce(named(DISCORD_KINDS, F.col("channel.type")), F.raise_error(F.concat(F.lit("unknown channel type: "), F.coalesce("channel.type", F.lit("none")))))
    spoken = F.coalesce("m.type", F.lit("Default")).isin(*DISCORD_SPOKEN)
    action = F.when(~spoken, F.coalesce(named(DISCORD_SERVICE, F.col("m.type")), F.raise_error(F.concat(F.lit("unknown message type: "), "m.type"))))
    seconds = lambda c: F.coalesce(F.unix_seconds(F.try_to_timestamp(c)), F.raise_error(F.concat(F.lit("not a time: "), F.coalesce(c, F.lit("none")))).cast("long"))
    who = lambda r: F.filter(F.coalesce(r["users"], F.array().cast(f"array<{_DISCORD_PERSON}>")), lambda u: u["id"].isNotNull())
    one = lambda r, actor, count: F.struct(r["emoji"]["name"].alias("emoji"), actor.cast("string").alias("actor"), count.cast("long").alias("count"))
    some = F.flatten(F.transform("m.reactions", lambda r: F.transform(who(r), lambda u: one(r, u["id"], F.lit(1)))))
    rest = F.transform("m.reactions", lambda r: one(r, F.lit(None), F.coalesce(r["count"], F.lit(1)) - F.size(who(r))))
    reactions = F.filter(F.concat(some, F.filter(rest, lambda r: r["count"] > 0)), lambda r: r["emoji"].isNotNull())
    stickers = F.transform(F.coalesce("m.stickers", F.array().cast("array<struct<name: string, sourceUrl: string>>")), lambda x: F.coalesce(x["sourceUrl"], x["name"], F.lit("sticker")))
    files_of = F.transform(F.coalesce("m.attachments", F.array().cast("array<struct<url: string>>")), lambda a: a["url"])
    uid = lambda channel, mid: F.concat(F.lit("dc/"), channel, F.lit("/"), mid)
    title = F.when((kind == "channel") & F.col("guild.name").isNotNull(), F.concat("guild.name", F.lit(" #"), F.coalesce("channel.name", F.lit("")))).otherwise(F.col("channel.name"))
    return canonical(
        rows, platform=F.lit("discord"), thread_id=F.col("channel.id"), thread_kind=kind, title=title,
        uid=F.coalesce(uid(F.col("channel.id"), F.col("m.id")), F.raise_error(F.lit("a channel or message without an id"))), sender_id=F.col("m.author.id"),
        sender_name=F.coalesce("m.author.nickname", "m.author.name"), kind=F.when(spoken, "message").otherwise("service"), service_action=action, text=F.coalesce("m.content", F.lit("")),
        sent_at_unix=seconds(F.col("m.timestamp")), edited_at_unix=F.when(F.col("m.timestampEdited").isNotNull(), seconds(F.col("m.timestampEdited"))),
        reply_to_uid=uid(F.coalesce("m.reference.channelId", "channel.id"), F.col("m.reference.messageId")), reactions=reactions, media=F.concat(files_of, stickers),
    )
