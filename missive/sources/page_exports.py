"""Exports in web pages: Google Voice, VK. Pages are parsed in Python; who is who is decided over all pages, in the plan."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .canonical import canonical, derived_uid, file_part, with_occurrence
from .markup import Node, tree
from .text_exports import phone

#: The time that ends file names of Google Voice.
VOICE_TIME = r"\d{4}-\d\d-\d\dT\d\d_\d\d_\d\dZ\.html"
#: The kinds of its files.
VOICE_KINDS = ("Text", "Received", "Placed", "Missed", "Voicemail", "Recorded")
GROUP = "Group Conversation"

_PERSON = "struct<number: string, name: string>"
_VOICE = f"file string, who string, call string, pos int, people array<{_PERSON}>, sender {_PERSON}, at string, text string, media array<string>"


def _pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(file_part(F.col("path"), 2).alias("folder"), file_part(F.col("path"), 1).alias("file"), "content")


def _person(scope: Node | None) -> tuple[str, str] | None:
    link = scope and scope.first("a", "tel")
    if not link or not link.attrs.get("href", "").startswith("tel:"):
        return None
    name = link.first(cls="fn")
    return link.attrs["href"][4:], name.text().strip() if name else ""


def _media(scope: Node) -> list[str]:
    linked = [n.attrs.get("src") or n.attrs.get("href") for n in scope.all() if n.tag in ("img", "audio") or n.tag == "a" and n.classes & {"video", "vcard"}]
    return [ref for ref in linked if ref and not ref.startswith("tel:")]


def voice_name(file: str) -> tuple[str, str] | None:
    """Who and kind of a file's name, which ends in a kind and a time, or only in a time for groups; None for other files."""
    front, _, time = file.rpartition(" - ")
    if not re.fullmatch(VOICE_TIME, time):
        return None
    who, _, kind = front.rpartition(" - ")
    if front == GROUP:
        return GROUP, "Text"
    return (who, kind) if who and re.fullmatch("[A-Za-z]+", kind) else None


def _voice_file(file: str, page: bytes) -> Iterator[tuple]:
    name = voice_name(file)
    if name is None:
        return
    who, kind = name
    if kind not in VOICE_KINDS:
        raise ValueError(f"a Google Voice file of unknown kind {kind}")
    root = tree(page)
    if kind == "Text":
        people = [p for block in root.all("div", "participants") for cite in block.all("cite") if (p := _person(cite))]
        for pos, message in enumerate(root.all("div", "message")):
            sender, at, said = _person(message.first("cite", "sender")), message.first("abbr", "dt"), message.first("q")
            if sender is None:
                raise ValueError(f"a message without a sender in a Google Voice file of kind {kind}")
            yield file, who, kind, pos, people, sender, at and at.attrs.get("title"), said.text(breaks="\n").strip() if said else "", _media(message)
        return
    call = root.first("div", "haudio")
    if call is None:
        raise ValueError(f"a Google Voice file of kind {kind} without a call")
    other, at, said = _person(call), call.first("abbr", "published"), call.first(cls="full-text")
    voicemail = kind == "Voicemail"
    yield file, who, kind, 0, [other] if other else [], ("", "Me") if kind == "Placed" else other, at and at.attrs.get("title"), said.text().strip() if voicemail and said else "", _media(call) if voicemail else []


def _voice_pages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["file", "who", "call", "pos", "people", "sender", "at", "text", "media"]
    as_dict = lambda p: p and {"number": p[0], "name": p[1]}
    for frame in frames:
        for file, page in zip(frame["file"], frame["content"], strict=True):
            rows = [(*r[:4], [as_dict(p) for p in r[4]], as_dict(r[5]), *r[6:]) for r in _voice_file(file, page)]
            yield pd.DataFrame(rows, columns=names)


def google_voice(spark: SparkSession, path: str) -> DataFrame:
    """The pages of a Calls folder: texts, voicemail (messages with their transcript) and calls (service messages).

    The owner's number is the one that most links named Me bear (of equally many the least); what it says is ``self``'s.
    A message has no id: it goes by time, sender and text, and which of equal ones in its file it is. Files whose names
    aren't of this export are passed over; an unknown kind, a message without a sender or without a time raise.
    """
    pages = _pages(spark, path).where(F.col("file").rlike(f" - {VOICE_TIME}$"))
    rows = pages.select("file", "content").mapInPandas(_voice_pages, _VOICE)
    known = lambda p: F.struct(phone(p["number"]).alias("number"), p["name"].alias("name"))
    rows = rows.withColumns({"people": F.transform("people", known), "sender": F.when(F.col("sender").isNotNull(), known(F.col("sender")))})
    mine = rows.where("sender.name = 'Me' AND sender.number <> '' AND call = 'Text'").groupBy("sender.number").count()
    own = mine.agg(F.min_by("number", F.struct(-F.col("count"), F.col("number"))).alias("own"))  # one row
    rows = rows.crossJoin(F.broadcast(own))
    is_own = lambda p: (p["name"] == "Me") | F.coalesce(p["number"] == F.col("own"), F.lit(False))
    others = F.filter("people", lambda p: ~is_own(p))
    rows = rows.withColumn("self", F.coalesce(is_own(F.col("sender")), F.lit(True)))
    spoke = rows.where("NOT self").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("pos", "sender"))).alias("spoke"))
    rows = rows.join(spoke, "file", "left").withColumn("others", others)
    rows = rows.withColumn("spoke", F.transform(F.coalesce("spoke", F.array().cast(f"array<struct<pos: int, sender: {_PERSON}>>")), lambda x: x["sender"]))
    shown = lambda p: F.when(F.trim(p["name"]) == "", p["number"]).otherwise(p["name"])
    once = lambda people: F.filter(people, lambda p, k: F.array_position(F.transform(people, lambda q: q["number"]), p["number"]) == k + 1)
    rows = rows.withColumn("everybody", once(F.concat("others", "spoke")))
    group = (F.size(once(F.col("others"))) > 1) | (F.col("who") == GROUP)
    other = F.get("everybody", 0)
    numbers = F.array_join(F.array_sort(F.transform("everybody", lambda p: p["number"])), ",")
    rows = rows.withColumns({
        "group": group, "thread_id": F.when(group, F.concat(F.lit("group/"), numbers)).when(other.isNotNull(), F.concat(F.lit("text/"), other["number"])).otherwise(F.concat(F.lit("text/name:"), "who")),
        "title": F.when(group, F.array_join(F.transform("everybody", shown), ", ")).when(other.isNotNull(), shown(other)).otherwise(F.col("who")),
        "sender_id": F.when(F.col("self"), "self").otherwise(F.col("sender.number")),
        "service_action": F.when(F.col("call") == "Missed", "missed_call").when(~F.col("call").isin("Text", "Voicemail"), "phone_call"),
        "zone": F.when(F.col("at").rlike("Z$"), 0).otherwise(F.concat(F.regexp_extract("at", "([+-])[0-9]{2}:?[0-9]{2}$", 1), F.lit("1")).try_cast("long") * (
            F.regexp_extract("at", "[+-]([0-9]{2}):?[0-9]{2}$", 1).try_cast("long") * 60 + F.regexp_extract("at", "[+-][0-9]{2}:?([0-9]{2})$", 1).try_cast("long"))),
        "sent": F.coalesce(F.unix_seconds(F.try_to_timestamp("at")), F.raise_error(F.lit("a Google Voice message without a time")).cast("long")),
    })
    rows = with_occurrence(rows, ["file", "sent", "sender_id", "service_action", "text"], ["pos"])
    return canonical(
        rows, platform=F.lit("googlevoice"), thread_id=F.col("thread_id"), thread_kind=F.when(F.col("group"), "group").otherwise("dm"), title=F.col("title"),
        uid=derived_uid("gv", "sent", "sender_id", "service_action", "text"), sender_id=F.col("sender_id"), sender_name=F.when(~F.col("self"), shown(F.col("sender"))),
        kind=F.when(F.col("service_action").isNull(), "message").otherwise("service"), service_action=F.col("service_action"), text=F.col("text"), sent_at_unix=F.col("sent"), tz_offset_minutes=F.col("zone"),
        media=F.transform("media", lambda m: F.url_decode(F.replace(m, F.lit("+"), F.lit("%2B")))),
    )


#: The months as VK writes them.
VK_MONTHS = ("янв", "фев", "мар", "апр", "май", "июн", "июл", "авг", "сен", "окт", "ноя", "дек")
VK_MAY = "мая"
VK_DATE = r"([0-9]{1,2})\s+([^\s\d]+)\s+([0-9]{4})\s+в\s+([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?"
_VK = "peer string, title string, id string, sender_id string, sender_name string, date string, text string, media array<string>"


def _vk_pages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in _VK.split(", ")]
    for frame in frames:
        for peer, page in zip(frame["folder"], frame["content"], strict=True):
            root = tree(page)
            crumbs = [c.text().strip() for c in root.all(cls="ui_crumb")]
            rows = []
            for message in root.all(cls="message"):
                header, mid = message.first(cls="message__header"), message.attrs.get("data-id", "").strip()
                if not mid or header is None:
                    raise ValueError("a VK message without data-id or header")
                link, sender = header.first("a"), ("self", None)
                if link:
                    profile = re.search(r"(id|public|club)([0-9]+)", link.attrs.get("href", ""))
                    number = profile and ("" if profile[1] == "id" else "-") + profile[2]
                    sender = number, link.text().strip() or number
                media = []
                for item in (a for k in message.all(cls="kludges") for a in k.all(cls="attachment")):
                    to, about = item.first("a"), item.first(cls="attachment__description")
                    media.append(to and to.attrs.get("href") or about and about.text().strip() or "attachment")
                rows.append((peer, crumbs[-1] if crumbs else None, mid, *sender, header.text("message-edited").strip(), message.text("message__header", "kludges").strip(), media))
            yield pd.DataFrame(rows, columns=names)


def vk(spark: SparkSession, path: str) -> DataFrame:
    """messages*.html in folders by peer. Negative peers are groups; a message without a link to its sender is ``self``'s.

    Dates are Russian; another month, a message without data-id or without a header raises. Attachments aren't in the
    archive, only their links or descriptions.
    """
    rows = _pages(spark, path).select("folder", "content").mapInPandas(_vk_pages, _VK)
    part = lambda k: F.regexp_extract("date", VK_DATE, k)
    name = F.regexp_replace(F.lower(part(2)), r"\.+$", "")
    month = F.when(name == VK_MAY, 5).otherwise(F.array_position(F.array(*map(F.lit, VK_MONTHS)), name).cast("int"))
    number = lambda k: F.when(part(k) == "", 0).otherwise(part(k).try_cast("int"))
    day = F.try_make_timestamp(number(3), month, number(1), number(4), number(5), number(6), F.lit("UTC"))
    sent = F.coalesce(F.unix_seconds(day), F.raise_error(F.concat(F.lit("not a date of VK: "), part(2))).cast("long"))
    return canonical(
        rows, platform=F.lit("vk"), thread_id=F.col("peer"), thread_kind=F.when(F.col("peer").startswith("-"), "group").otherwise("dm"), title=F.col("title"),
        uid=F.concat(F.lit("vk/"), "peer", F.lit("/"), "id"), sender_id=F.col("sender_id"), sender_name=F.col("sender_name"), kind=F.lit("message"), text=F.col("text"),
        sent_at_unix=sent, media=F.col("media"),
    )
