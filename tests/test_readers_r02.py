"""Chats' kinds and names, dates by peers, zones, media and mentions that exports hold, and detection by pieces."""

import json

import pytest

from missive.sources import files, json_exports, page_exports, registry, text_exports


def by_uid(rows):
    return {r.uid: r for r in rows.collect()}


def test_telegram_kinds_names_zones_and_entities(spark, tmp_path):
    message = {"id": 1, "type": "message", "date": "2024-01-01T03:00:00", "date_unixtime": "1704067200", "from": "A", "from_id": "user1", "text_entities": [{"type": "plain", "text": "a "}, {"type": "custom_emoji", "text": "😀", "document_id": "77"}]}
    chats = [
        {"name": "c", "type": "channel", "id": 5, "messages": [message]},
        {"name": "n", "type": "something_new", "messages": [message | {"id": 2, "reactions": [{"type": "custom_emoji", "count": 3, "document_id": "88", "recent": [{"from": "B", "from_id": "user2"}]}]}]},
        {"name": "old", "type": "personal_chat", "id": 6, "messages": [{"id": 3, "type": "message", "date": "2024-01-01T00:00:00", "from": "A", "from_id": "user1", "text_entities": []}]},
    ]
    (tmp_path / "result.json").write_text(json.dumps({"chats": {"list": chats}}))
    assert registry.detect(str(tmp_path)) == registry.detect(str(tmp_path), spark) == [("telegram", registry.CERTAIN)]
    rows = by_uid(registry.read(spark, str(tmp_path)))
    a, b, c = rows["tg/5/1"], rows["tg/name:n/2"], rows["tg/6/3"]
    assert (a.thread_kind, a.tz_offset_minutes, a.text) == ("channel", 180, "a 😀") and json.loads(a.entities)[0]["document_id"] == "77"
    assert (b.thread_kind, b.thread_id) == ("group", "name:n") and [(r.emoji, r.actor, r["count"]) for r in b.reactions] == [("88", "user2", 1), ("88", None, 2)]
    assert (c.thread_kind, c.sent_at_unix, c.tz_offset_minutes, c.entities) == ("dm", 1704067200, None, None)


def test_slack_kinds_names_and_mentions(spark, tmp_path):
    (tmp_path / "users.json").write_text(json.dumps([{"id": "U1", "name": "a", "real_name": "Ann"}, {"id": "U2", "name": "bob"}]))
    (tmp_path / "channels.json").write_text(json.dumps([{"id": "C1", "name": "general", "members": ["U1"]}]))
    (tmp_path / "dms.json").write_text(json.dumps([{"id": "D1", "members": ["U1", "U2"]}]))
    (tmp_path / "mpims.json").write_text(json.dumps([{"id": "G1", "name": "mpdm-a--b", "members": ["U1", "U2"]}]))
    lines = {
        "general": [{"type": "message", "user": "U1", "text": "hi <@U2> and <@U9> <@U1|me>", "ts": "1.0"}, {"type": "message", "subtype": "slackbot_response", "user": "U1", "text": "x", "ts": "2.0"}, {"type": "message", "subtype": "channel_join", "user": "U2", "text": "", "ts": "3.0"}],
        "D1": [{"type": "message", "user": "U2", "text": "direct", "ts": "4.0"}],
        "mpdm-a--b": [{"type": "message", "user": "U2", "text": "group", "ts": "5.0"}],
        "unlisted": [{"type": "message", "user": "U2", "text": "z", "ts": "6.0"}],
    }
    for name, rows in lines.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "2024-01-01.json").write_text(json.dumps(rows))
    rows = by_uid(registry.read(spark, str(tmp_path)))
    assert rows["sl/C1/1.0"].text == "hi @bob and @U9 @me" and (rows["sl/C1/1.0"].thread_kind, rows["sl/C1/1.0"].title) == ("group", "#general")
    assert (rows["sl/C1/2.0"].kind, rows["sl/C1/3.0"].kind, rows["sl/C1/3.0"].service_action) == ("message", "service", "invite_members")
    assert (rows["sl/D1/4.0"].thread_kind, rows["sl/G1/5.0"].thread_kind, rows["sl/unlisted/6.0"].title) == ("dm", "group", "unlisted")


def chat(*dates):
    return "\n".join(f"[{d}, 10:0{k}:00] A: line {k}" for k, d in enumerate(dates)) + "\n"


def test_whatsapp_dates_by_chats_of_one_shape(spark, tmp_path):
    (tmp_path / "open.txt").write_text(chat("01/02/24", "01/02/24"), encoding="utf-8")
    (tmp_path / "sure.txt").write_text(chat("20/02/24", "21/02/24"), encoding="utf-8")
    rows = {(r.thread_id, r.text): r.sent_at_unix for r in text_exports.whatsapp(spark, str(tmp_path)).collect()}
    assert rows["open", "line 0"] == 1706781600  # 1 February
    (tmp_path / "other.txt").write_text(chat("02/20/24", "02/21/24"), encoding="utf-8")
    with pytest.raises(Exception, match="day or month first"):
        text_exports.whatsapp(spark, str(tmp_path)).collect()


def test_meta_media_order_and_instagram(spark, tmp_path):
    at = {"sender_name": "a", "timestamp_ms": 1700000000000}
    folder = tmp_path / "your_instagram_activity" / "messages" / "inbox" / "x_1"
    folder.mkdir(parents=True)
    first = [at | {"content": "same", "videos": [{"uri": "v"}]}, at | {"content": "same", "sticker": {"uri": "s"}}]
    (folder / "message_1.json").write_text(json.dumps({"participants": [{"name": "a"}, {"name": "b"}], "title": "t", "messages": first}))
    (folder / "message_2.json").write_text(json.dumps({"participants": [{"name": "a"}, {"name": "b"}], "title": "t", "messages": [at | {"content": "same", "audio_files": [{"uri": "w"}], "files": [{"uri": "f"}]}]}))
    assert registry.detect(str(tmp_path), spark) == [("instagram", registry.CERTAIN)]
    rows = sorted(registry.read(spark, str(tmp_path)).collect(), key=lambda r: (len(r.uid), r.uid))
    assert [(r.uid[:3], r.media) for r in rows] == [("in/", ["v"]), ("in/", ["s"]), ("in/", ["w", "f"])] and len({r.uid for r in rows}) == 3


def test_skype_types_and_references(spark, tmp_path):
    def line(k, kind, content, **more):
        return {"id": str(k), "originalarrivaltime": "2024-01-01T00:00:00Z", "messagetype": kind, "content": content, "from": "8:a"} | more

    messages = [line(1, "RichText", "<b>a</b> &amp; &eacute;&#8364;"), line(2, "Text", "1 < 2 &amp;"), line(3, "ThreadActivity/AddMember", "<x/>"), line(4, "ThreadActivity/E2EEHandshake", ""), line(5, "RichText", "gone", properties={"deletetime": "1"})]
    path = tmp_path / "messages.json"
    path.write_text(json.dumps({"conversations": [{"id": "8:b", "displayName": "B", "MessageList": messages}]}))
    rows = by_uid(json_exports.skype(spark, str(path)))
    got = [(rows[f"sk/8:b/{k}"].text, rows[f"sk/8:b/{k}"].service_action) for k in range(1, 6)]
    assert got == [("a & é€", None), ("1 < 2 &amp;", None), ("", "invite_members"), ("", "e2eehandshake"), ("", None)]
    path.write_text(json.dumps({"conversations": [{"id": "8:b", "MessageList": [line(1, "Novel", "")]}]}))
    with pytest.raises(Exception, match="unknown message type"):
        json_exports.skype(spark, str(path)).collect()


def test_discord_channel_types(spark, tmp_path):
    for name, about in (("c10", {"id": "10", "type": 1}), ("c11", {"id": "11", "type": 0, "name": "hall"}), ("c12", None)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "messages.csv").write_text("ID,Timestamp,Contents,Attachments\n1,2024-01-01 00:00:00,hi,\n")
        if about:
            (tmp_path / name / "channel.json").write_text(json.dumps(about))
    rows = by_uid(registry.read(spark, str(tmp_path)))
    assert {u: (r.thread_kind, r.title) for u, r in rows.items()} == {"dc/10/1": ("dm", None), "dc/11/1": ("channel", "hall"), "dc/c12/1": ("channel", None)}


@pytest.mark.parametrize(
    ("file", "name"),
    [
        ("Ann - Lee - Text - 2024-01-01T00_00_00Z.html", ("Ann - Lee", "Text")), ("Group Conversation - 2024-01-01T00_00_00Z.html", ("Group Conversation", "Text")),
        ("+1555 - Missed - 2024-01-01T00_00_00Z.html", ("+1555", "Missed")), ("Text - 2024-01-01T00_00_00Z.html", None), ("notes.html", None), ("A - Text - 2024.html", None),
    ],
)
def test_names_of_voice_files(file, name):
    assert page_exports.voice_name(file) == name


def test_json_keys_by_pieces(tmp_path, monkeypatch):
    path = tmp_path / "a.json"
    whole = {"first": {"inner": ["}{", 'quote " and \\', {"deep": 1}]}, "long": "x{[" * 50, "last": [1]}
    path.write_text(" \n" + json.dumps(whole))
    for size in (1, 2, 3, 7, 64, 1 << 20):
        monkeypatch.setattr(files, "PIECE", size)
        assert files.json_keys(files.LocalFiles(), str(path), {"first", "last", "inner", "deep", "none"}) == {"first", "last"}
    path.write_text("[" + json.dumps(whole) + "]")
    assert files.json_keys(files.LocalFiles(), str(path), {"first"}) == set()
