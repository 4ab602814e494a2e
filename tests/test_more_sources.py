import json
import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from missive.sources import binary_exports, json_exports, registry, text_exports


def in_order(rows):
    return rows.orderBy("sent_at_unix", "uid").collect()


def test_google_chat(spark, tmp_path):
    for folder in ("Groups/DM abc", "Groups/Space xyz", "Users/User 1"):
        (tmp_path / "Google Chat" / folder).mkdir(parents=True)
    me, ann = {"name": "Me", "email": "Me@x.org"}, {"name": "Ann", "email": "ann@x.org"}
    root = tmp_path / "Google Chat"
    (root / "Users/User 1/user_info.json").write_text(json.dumps({"user": me}))
    (root / "Groups/DM abc/group_info.json").write_text(json.dumps({"members": [me, ann]}))
    said = [
        {"creator": {"name": "x", "email": "ANN@x.org"}, "created_date": "Sunday, March 14, 2021 at 10:41:03 PM UTC", "text": "hi", "message_id": "a/b/c",
         "reactions": [{"emoji": {"unicode": "+"}, "reactor_emails": ["ME@x.org"]}, {"emoji": {"custom_emoji": {"uid": "1"}}}]},
        {"creator": me, "created_date": "14 March 2021 at 22:41:04 UTC", "text": "yo", "quoted_message_metadata": {"message_id": "a/b/c"}},
        {"creator": me, "created_date": "14 March 2021 at 22:41:04 UTC", "text": "yo"},
    ]
    (root / "Groups/DM abc/messages.json").write_text(json.dumps({"messages": said}))
    (root / "Groups/Space xyz/messages.json").write_text(json.dumps({"messages": [{"creator": ann, "created_date": "March 1, 2022 at 12:05 AM GMT", "text": "s"}]}))
    assert registry.detect(str(tmp_path)) == [("googlechat", registry.CERTAIN)]
    a, b, c, d = in_order(registry.read(spark, str(tmp_path)))
    assert (a.uid, a.thread_id, a.thread_kind, a.title, a.sender_id, a.sender_name, a.sent_at_unix) == ("gc/a/b/c", "dm/abc", "dm", "Ann", "ann@x.org", "Ann", 1615761663)
    assert [tuple(r) for r in a.reactions] == [("+", "me@x.org", 1), ("custom", None, 1)]
    assert b.uid != c.uid and {b.reply_to_uid, c.reply_to_uid} == {"gc/a/b/c", None} and b.sent_at_unix == 1615761664
    assert (d.thread_id, d.thread_kind, d.sent_at_unix) == ("space/xyz", "group", 1646093100)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_chat_dates_do_not_depend_on_the_session(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = spark.createDataFrame([("14 March 2021 at 22:41:04 UTC",), ("2021-03-14T22:41:04Z",), ("Mar 14, 2021 at 10:41:04 pm GMT",)], "t string")
        assert {r[0] for r in rows.select(json_exports.chat_date(F.col("t"))).collect()} == {1615761664}
        with pytest.raises(Exception, match="not an English date"):
            spark.createDataFrame([("14 mars 2021 22:41",)], "t string").select(json_exports.chat_date(F.col("t"))).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_discord_export(spark, tmp_path):
    ann = {"id": "7", "name": "ann", "nickname": "Ann"}
    said = [
        {"id": "1", "type": "Default", "timestamp": "2024-01-01T02:00:00+02:00", "content": "hi", "author": ann, "attachments": [{"url": "a.png"}],
         "reactions": [{"emoji": {"id": "", "name": "x"}, "count": 3, "users": [ann]}]},
        {"id": "2", "type": "Call", "timestamp": "2024-01-01T00:00:01+00:00", "timestampEdited": "2024-01-01T00:00:09Z", "content": "", "author": ann, "reference": {"messageId": "1"}},
    ]
    (tmp_path / "c.json").write_text(json.dumps({"guild": {"name": "G"}, "channel": {"id": "5", "type": "GuildTextChat", "name": "talk"}, "messages": said}))
    a, b = in_order(registry.read(spark, str(tmp_path)))
    assert (a.uid, a.title, a.thread_kind, a.sent_at_unix, a.sender_name, a.media) == ("dc/5/1", "G #talk", "channel", 1704067200, "Ann", ["a.png"])
    assert [tuple(r) for r in a.reactions] == [("x", "7", 1), ("x", None, 2)]
    assert (b.kind, b.service_action, b.reply_to_uid, b.edited_at_unix) == ("service", "phone_call", "dc/5/1", 1704067209)
    said[0]["type"] = "Hologram"
    (tmp_path / "c.json").write_text(json.dumps({"channel": {"id": "5", "type": "DirectTextChat"}, "messages": said}))
    with pytest.raises(Exception, match="unknown message type: Hologram"):
        registry.read(spark, str(tmp_path)).collect()


def voice_message(number, name, at, text):
    return f'<div class="message"><abbr class="dt" title="{at}">x</abbr><cite class="sender vcard"><a class="tel" href="tel:{number}"><abbr class="fn">{name}</abbr></a></cite><q>{text}</q></div>'


def test_google_voice(spark, tmp_path):
    calls = tmp_path / "Voice" / "Calls"
    calls.mkdir(parents=True)
    page = voice_message("+15", "Ann", "2020-01-01T00:00:00.000Z", "a &amp; b<br>c") + voice_message("+1 99", "Me", "2020-01-01T00:00:01.000-01:00", "yes")
    (calls / "Ann - Text - 2020-01-01T00_00_00Z.html").write_text(page)
    cites = "".join(f'<cite><a class="tel" href="tel:{n}"><span class="fn">{w}</span></a></cite>' for n, w in (("+15", "Ann"), ("+16", ""), ("+199", "old me")))
    (calls / "Group Conversation - 2020-01-02T00_00_00Z.html").write_text(f'<div class="participants">{cites}</div>' + voice_message("+16", "", "2020-01-02T00:00:00Z", "g"))
    (calls / "Ann - Missed - 2020-01-03T00_00_00Z.html").write_text('<div class="haudio"><a class="tel" href="tel:+15"><span class="fn">Ann</span></a><abbr class="published" title="2020-01-03T00:00:00Z"></abbr></div>')
    a, b, c, d = in_order(registry.read(spark, str(tmp_path)))
    assert (a.thread_id, a.title, a.sender_id, a.text, a.sent_at_unix) == ("text/+15", "Ann", "+15", "a & b\nc", 1577836800)
    assert (b.sender_id, b.thread_id, b.sent_at_unix) == ("self", "text/+15", 1577840401)
    assert (c.thread_id, c.thread_kind, c.title, c.sender_name) == ("group/+15,+16", "group", "Ann, +16", "+16")
    assert (d.kind, d.service_action, d.thread_id, d.sender_id) == ("service", "missed_call", "text/+15", "+15")
    (calls / "Ann - Hummed - 2020-01-03T00_00_00Z.html").write_text("x")
    with pytest.raises(Exception, match="unknown kind Hummed"):
        registry.read(spark, str(tmp_path)).collect()


def test_vk(spark, tmp_path):
    for peer, sender in (("12", '<a href="https://vk.com/id12">Аня</a>, '), ("-3", '<a href="https://vk.com/club3">Клуб</a>, ')):
        folder = tmp_path / "messages" / peer
        folder.mkdir(parents=True)
        page = (
            '<meta charset="windows-1251"><div class="ui_crumb">Все</div><div class="ui_crumb">Имя</div>'
            f'<div class="message" data-id="1"><div class="message__header">{sender}5 мая 2020 в 7:08:09 <span class="message-edited">(ред. 6 июн 2021 в 1:00)</span></div><div>привет<div class="kludges">'
            '<div class="attachment"><div class="attachment__description">Фото</div></div></div></div></div><div class="message" data-id="2"><div class="message__header">Вы, 6 дек. 2020 в 17:08</div><div>да</div></div>'
        )
        (folder / "messages0.html").write_bytes(page.encode("cp1251"))
    rows = {r.uid: r for r in registry.read(spark, str(tmp_path)).collect()}
    a, b, c = rows["vk/12/1"], rows["vk/12/2"], rows["vk/-3/1"]
    assert (a.text, a.title, a.sender_id, a.sender_name, a.sent_at_unix, a.media) == ("привет", "Имя", "12", "Аня", 1588662489, ["Фото"])
    assert (b.sender_id, b.sent_at_unix, b.thread_kind) == ("self", 1607274480, "dm") and (c.sender_id, c.thread_kind) == ("-3", "group")


def qhf(uin, nickname, messages):
    body = b""
    for number, sent, way, kind, text in messages:
        said = bytes((254 - b - i) & 255 for i, b in enumerate(text.encode()))
        block = struct.pack(">hhi hhi hh3B hi", 1, 4, number, 2, 4, sent, 3, 3, way, 0, kind, 4, len(said)) + said
        body += struct.pack(">hi", 1, len(block)) + block
    head = bytearray(0x2C)
    head[:4] = b"QHF\x03"
    data = head + struct.pack(">h", len(uin)) + uin.encode() + struct.pack(">h", len(nickname.encode())) + nickname.encode() + body
    struct.pack_into(">i", data, 4, len(data) - 8)
    struct.pack_into(">i", data, 0x22, len(messages))
    return bytes(data)


def test_qip(spark, tmp_path):
    folder = tmp_path / "111" / "History"
    folder.mkdir(parents=True)
    (folder / "a.qhf").write_bytes(qhf("222", "Зоя", [(1, 1_200_000_000, 0, 1, "привет"), (2, 1_200_000_001, 1, 1, "x" * 300), (3, 1_200_000_002, 0, 5, "")]))
    (folder / "b.qhf").write_bytes(qhf("111", "me", [(1, 1_200_000_003, 0, 1, "note")]))
    a, b, c, d = in_order(registry.read(spark, str(tmp_path / "111")))
    assert (a.uid, a.text, a.sender_id, a.title) == ("qip/222/1", "привет", "222", "Зоя") and (b.sender_id, b.text) == ("self", "x" * 300)
    assert (c.kind, c.service_action) == ("service", "authorization_request") and (d.thread_kind, d.sender_id) == ("saved", "self")
    good = qhf("222", "z", [(1, 1_200_000_000, 0, 1, "abc")])
    for bad in (good[:-1], good + b"\0", b"X" + good[1:], good[:40]):
        with pytest.raises(ValueError):
            list(binary_exports.qip_history(bad))


def typed(text):
    raw = text.encode()
    n = bytes([len(raw)]) if len(raw) < 128 else b"\x81" + struct.pack("<H", len(raw))
    return b"\x04\x0bstreamtyped\x84\x84NSString\x01\x94\x84\x01+" + n + raw + b"\x86\x84"


def test_imessage(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "chat.db")
    db.executescript(
        "CREATE TABLE message (guid, text, attributedBody, date, is_from_me, handle_id, item_type, associated_message_type, associated_message_guid);"
        "CREATE TABLE handle (id); CREATE TABLE chat (guid, style, display_name, chat_identifier); CREATE TABLE chat_message_join (chat_id, message_id);"
        "CREATE TABLE attachment (filename); CREATE TABLE message_attachment_join (message_id, attachment_id);"
        "INSERT INTO handle VALUES ('Ann@X.org'); INSERT INTO chat VALUES ('c1', 45, '', 'ann'); INSERT INTO attachment VALUES ('~/Library/Messages/Attachments/aa/p.jpg'); INSERT INTO message_attachment_join VALUES (1, 1);"
    )
    rows = [
        ("g1", "hi", None, 600_000_000, 0, 1, 0, 0, None), ("g2", None, typed("é" * 100), 600_000_001 * 10**9, 1, None, 0, 0, None), ("g3", None, typed("short"), 600_000_002, 0, 1, 2, 0, None),
        ("t1", "", None, 600_000_003, 1, None, 0, 2000, "p:0/g1"), ("t2", "", None, 600_000_004, 0, 1, 0, 2001, "bp:g1"), ("t3", "", None, 600_000_005, 0, 1, 0, 3001, "p:0/g1"),
    ]
    db.executemany("INSERT INTO message VALUES (?,?,?,?,?,?,?,?,?)", rows)
    db.execute("INSERT INTO chat_message_join SELECT 1, rowid FROM message")
    db.commit()
    db.close()
    a, b, c = in_order(registry.read(spark, str(tmp_path)))
    assert (a.uid, a.text, a.sender_id, a.title, a.sent_at_unix, a.media) == ("im/c1/g1", "hi", "ann@x.org", "ann", 1_578_307_200, ["Attachments/aa/p.jpg"])
    assert [tuple(r) for r in a.reactions] == [("❤️", "self", 1)]
    assert (b.text, b.sender_id, b.sent_at_unix) == ("é" * 100, "self", 1_578_307_201) and (c.text, c.service_action) == ("short", "group_name_changed")
    bad = spark.createDataFrame([(bytearray(b"NSString\x01\x94\x84\x02+\x01a"),)], "b binary")
    with pytest.raises(Exception, match="unknown layout"):
        bad.select(binary_exports.attributed_text(F.col("b"))).collect()


def test_mms(spark, tmp_path):
    part = '<part ct="application/smil" text="x"/><part ct="text/plain" text="hello"/><part ct="image/png" name="p.png" data="AAEC"/><part ct="image/png" cl="q.png"/>'
    addrs = '<addrs><addr address="+1 5" type="137"/><addr address="+16" type="151"/><addr address="+19" type="151"/></addrs>'
    (tmp_path / "s.xml").write_text(
        '<?xml version="1.0"?><smses><sms address="+15" date="5000" type="1" body="yo" contact_name="null"/>'
        f'<mms date="6000" msg_box="1" m_id="m1" address="+15~+16" contact_name="Ann, Bob" sub="null"><parts>{part}</parts>{addrs}</mms>'
        '<mms date="7000" msg_box="2" m_id="null" address="+16" contact_name="Bob" sub="re"><parts><part ct="text/plain" text="x"/></parts></mms><mms date="8000" msg_box="3" address="+16"/></smses>'
    )
    _, a, b = in_order(registry.read(spark, str(tmp_path)))
    assert (a.uid, a.thread_id, a.title, a.sender_id, a.sender_name, a.text) == ("mms/m1", "group/+15,+16,+19", "Ann, Bob, +19", "+15", "Ann", "hello")
    assert a.media[0].startswith("mms/p.png#ae4b") and a.media[1] == "mms/q.png#missing"
    assert (b.thread_id, b.sender_id, b.text, b.title) == ("dm/+16", "self", "re\nx", "Bob") and b.uid.startswith("mms/dm/+16/")
    owned = text_exports.mms(spark, str(tmp_path), "+19").where("uid = 'mms/m1'").first()
    assert owned.thread_id == "group/+15,+16"
