import json

import pytest

from missive.sources import registry
from missive.streaming import ingest


def by_uid(rows):
    return {r.uid: r for r in rows.collect()}


def test_telegram(spark, tmp_path):
    chat = {
        "name": "Sam", "type": "personal_chat", "id": 5,
        "messages": [
            {"id": 1, "type": "message", "date_unixtime": "100", "from": "Sam", "from_id": "user5", "text": "no", "text_entities": [{"type": "plain", "text": "he"}, {"type": "bold", "text": "y"}],
             "reactions": [{"type": "emoji", "count": 3, "emoji": "x", "recent": [{"from": "A", "from_id": "user7"}]}]},
            {"id": 2, "type": "service", "date_unixtime": "200", "actor": "Sam", "actor_id": "user5", "action": "phone_call", "text_entities": [], "reply_to_message_id": 1},
        ],
    }
    (tmp_path / "result.json").write_text(json.dumps({"chats": {"list": [chat]}}))
    assert registry.detect(str(tmp_path))[0] == ("telegram", registry.CERTAIN)
    rows = by_uid(registry.read(spark, str(tmp_path)))
    first, second = rows["tg/5/1"], rows["tg/5/2"]
    assert (first.text, first.sender_id, first.thread_kind, first.sent_at_unix) == ("hey", "5", "dm", 100)
    assert [tuple(r) for r in first.reactions] == [("x", "user7", 1), ("x", None, 2)]
    assert (second.kind, second.service_action, second.reply_to_uid) == ("service", "phone_call", "tg/5/1")


def test_telegram_unknown_prefix_raises(spark, tmp_path):
    (tmp_path / "result.json").write_text(json.dumps({"name": "x", "type": "personal_chat", "id": 1, "messages": [{"id": 1, "type": "message", "from_id": "robot9", "date_unixtime": "1"}]}))
    with pytest.raises(Exception, match="unknown identity prefix"):
        registry.read(spark, str(tmp_path)).collect()


def test_whatsapp_date_order(spark, tmp_path):
    (tmp_path / "chat.txt").write_text("1/2/24, 10:00 - Ann: one\nmore\n2/2/24, 11:00 - Bob: two\n13/2/24, 12:00 - Ann: three\n14/2/24, 12:01 - Ann left\n", encoding="utf-8")
    rows = registry.read(spark, str(tmp_path)).orderBy("sent_at_unix").collect()
    assert [r.text for r in rows] == ["one\nmore", "two", "three", "Ann left"]
    assert rows[0].sent_at_unix == 1706781600 and rows[3].kind == "service" and rows[0].thread_kind == "dm"


def test_whatsapp_ambiguous_dates_raise(spark, tmp_path):
    (tmp_path / "chat.txt").write_text("1/2/24, 10:00 - Ann: one\n", encoding="utf-8")
    with pytest.raises(Exception, match="day or month first"):
        registry.read(spark, str(tmp_path)).collect()


def test_messenger_repairs_and_counts_occurrences(spark, tmp_path):
    folder = tmp_path / "x_1"
    folder.mkdir()
    m = {"sender_name": "ZoÃ«", "timestamp_ms": 5000, "content": "hÃ©", "type": "Generic"}
    (folder / "message_1.json").write_text(json.dumps({"participants": [{"name": "a"}, {"name": "b"}], "title": "t", "messages": [m, m]}))
    rows = registry.read(spark, str(tmp_path)).collect()
    assert {r.text for r in rows} == {"hé"} and {r.sender_name for r in rows} == {"Zoë"} and len({r.uid for r in rows}) == 2


def test_discord_csv(spark, tmp_path):
    folder = tmp_path / "c1"
    folder.mkdir()
    (folder / "messages.csv").write_text('ID,Timestamp,Contents,Attachments\n1,2024-01-01 00:00:00,"a ""b""\nc",http://x/y\n')
    row = registry.read(spark, str(tmp_path)).first()
    assert (row.text, row.uid, row.media, row.sent_at_unix) == ('a "b"\nc', "dc/c1/1", ["http://x/y"], 1704067200)


def test_slack(spark, tmp_path):
    (tmp_path / "general").mkdir()
    (tmp_path / "channels.json").write_text("[]")
    (tmp_path / "users.json").write_text(json.dumps([{"id": "U1", "name": "ann", "real_name": "Ann"}]))
    said = [{"type": "message", "user": "U1", "text": "hi <@U1> <http://x|site> &amp;", "ts": "10.5"}, {"type": "message", "subtype": "channel_join", "user": "U1", "text": "", "ts": "11.0", "thread_ts": "10.5"}]
    (tmp_path / "general" / "2024-01-01.json").write_text(json.dumps(said))
    rows = by_uid(registry.read(spark, str(tmp_path)))
    assert rows["sl/general/10.5"].text == "hi @Ann site &" and rows["sl/general/11.0"].kind == "service" and rows["sl/general/11.0"].reply_to_uid == "sl/general/10.5"


def test_sms_skype_hangouts(spark, tmp_path):
    (tmp_path / "s.xml").write_text('<?xml version="1.0"?><smses><sms address="+1 (5)" date="5000" type="1" body="yo" contact_name="null"/><sms address="+15" date="6000" type="3" body="d" contact_name="x"/></smses>')
    row = registry.read(spark, str(tmp_path)).collect()
    assert [(r.thread_id, r.text, r.sender_id, r.title) for r in row] == [("dm/+15", "yo", "+15", None)]
    skype = tmp_path / "sk"
    skype.mkdir()
    (skype / "messages.json").write_text(json.dumps({"userId": "8:me", "conversations": [{"id": "8:a", "displayName": "A", "MessageList": [{"id": "1", "originalarrivaltime": "2024-01-01T00:00:00Z", "messagetype": "RichText", "content": "<b>x</b> &lt;", "from": "8:a"}]}]}))
    assert registry.read(spark, str(skype)).first().text == "x <"
    hangouts = tmp_path / "h"
    hangouts.mkdir()
    event = {"event_id": "e", "sender_id": {"gaia_id": "1"}, "timestamp": "5000000", "event_type": "REGULAR_CHAT_MESSAGE", "chat_message": {"message_content": {"segment": [{"type": "TEXT", "text": "a"}, {"type": "LINE_BREAK"}, {"type": "LINK", "text": "b"}]}}}
    about = {"conversation_id": {"id": "c"}, "conversation": {"type": "GROUP", "participant_data": [{"id": {"gaia_id": "1"}, "fallback_name": "Ann"}]}}
    (hangouts / "Hangouts.json").write_text(json.dumps({"conversations": [{"conversation": about, "events": [event]}]}))
    row = registry.read(spark, str(hangouts)).first()
    assert (row.text, row.sent_at_unix, row.sender_name, row.uid) == ("a\nb", 5, "Ann", "gh/c/e")


def test_stream_ingest_is_idempotent_and_keeps_deleted(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    line = lambda uid, text, event="message": json.dumps({"uid": uid, "thread_id": "t", "id": 1, "sent_at_unix": 1, "plaintext": text, "event": event})
    (source / "1.json").write_text("\n".join([line("a", "x"), line("a", "x"), line("b", "y")]))
    run = lambda: ingest.follow(spark, str(source), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    (source / "2.json").write_text("\n".join([line("a", "z"), line("b", "", "deletion")]))
    run()
    run()
    got = {r.uid: (r.plaintext, r.deleted) for r in ingest.stored(spark, str(tmp_path / "out")).collect()}
    assert got == {"a": ("z", False), "b": ("y", True)}


def test_stream_sessions_equal_the_batch_ones(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 14_399), ("a", 28_799)], "thread_id string, sent_at_unix long")
    got = ingest.stream_sessions(rows).orderBy("started_at_unix").collect()
    assert [(r.started_at_unix, r.ended_at_unix, r.message_count) for r in got] == [(0, 14_399, 2), (28_799, 28_799, 1)]
