"""Which reader reads a folder or file. Files are looked at where Spark reads them, a piece at a time."""

from __future__ import annotations

import re
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from . import binary_exports, json_exports, page_exports, text_exports
from .files import LocalFiles, SparkFiles, head, json_keys

NONE, POSSIBLE, CERTAIN = 0, 1, 2
Files = LocalFiles | SparkFiles


def _name(path: str) -> str:
    return path.rstrip("/").rpartition("/")[2]


def _in(files: Files, path: str, name: str) -> str | None:
    """A file of a folder by its name, or the path itself if it is that file."""
    at = f"{path}/{name}" if files.is_dir(path) else path
    return at if _name(at) == name and files.is_file(at) else None


def _telegram(files: Files, p: str) -> int:
    at = _in(files, p, "result.json") or (p if p.endswith(".json") and files.is_file(p) else None)
    if at is None:
        return NONE
    keys = json_keys(files, at, {"chats", "messages", "type", "id"})
    return CERTAIN if "chats" in keys or {"messages", "type", "id"} <= keys else NONE


def _file(name: str, key: str) -> Callable[[Files, str], int]:
    def sure(files: Files, p: str) -> int:
        at = _in(files, p, name)
        return CERTAIN if at and json_keys(files, at, {key}) else NONE

    return sure


def _slack(files: Files, p: str) -> int:
    return CERTAIN if files.is_file(f"{p}/users.json") and files.is_file(f"{p}/channels.json") else NONE


def _inbox(files: Files, p: str) -> str | None:
    """The folder whose folders hold parts of threads."""
    below = ("", "/inbox", "/messages/inbox", "/your_facebook_activity/messages/inbox", "/your_instagram_activity/messages/inbox", "/your_activity_across_facebook/messages/inbox")
    return next((p + f for f in below if files.is_dir(p) and files.glob(p + f, "*/message_*.json")), None)


def _meta(instagram: bool) -> Callable[[Files, str], int]:
    def sure(files: Files, p: str) -> int:
        root = _inbox(files, p)
        if root is None or ("instagram" in root.lower()) != instagram:
            return NONE
        wanted = {"participants", "messages"}
        return CERTAIN if json_keys(files, files.glob(root, "*/message_*.json")[0], wanted) == wanted else NONE

    return sure


def _discord(files: Files, p: str) -> int:
    return CERTAIN if files.is_dir(p) and files.glob(p, "*/messages.csv") else NONE


def _some(files: Files, p: str, suffix: str) -> str | None:
    """The path itself or a folder's first file, if it ends so."""
    found = files.glob(p, f"*{suffix}") if files.is_dir(p) else [p] if files.is_file(p) else []
    return found[0] if found and found[0].endswith(suffix) else None


def _whatsapp(files: Files, p: str) -> int:
    at = _some(files, p, ".txt")
    return POSSIBLE if at and re.search(text_exports.HEAD, head(files, at), re.M) else NONE


def _sms(files: Files, p: str) -> int:
    at = _some(files, p, ".xml")
    return CERTAIN if at and "<smses" in head(files, at)[:2000] else NONE


def _below(files: Files, p: str, *names: str) -> str | None:
    """The folder itself or one of those that an export can be unpacked to, if it has what is looked for."""
    *folders, wanted = names
    return next((f"{p}/{f}".rstrip("/") for f in ("", *folders) if files.is_dir(p) and files.glob(f"{p}/{f}".rstrip("/"), wanted)), None)


def _chat_root(files: Files, p: str) -> str | None:
    return _below(files, p, "Google Chat", "Takeout/Google Chat", "Groups/*/messages.json")


def _calls(files: Files, p: str) -> str | None:
    return _below(files, p, "Calls", "Voice/Calls", "Takeout/Voice/Calls", "* - [0-9][0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9]T*Z.html")


def _vk_root(files: Files, p: str) -> str | None:
    return _below(files, p, "*/messages*.html") if _name(p).lower() == "messages" else _below(files, p, "messages/*/messages*.html")


def _qip_root(files: Files, p: str) -> str | None:
    return _below(files, p, "History", "*.qhf") or _below(files, p, "*/History/*.qhf")


def _imessage(files: Files, p: str) -> int:
    at = _in(files, p, "chat.db")
    return CERTAIN if at and next(files.pieces(at), b"")[:15] == b"SQLite format 3" else NONE


def _discord_export(files: Files, p: str) -> int:
    at, wanted = _some(files, p, ".json"), {"channel", "messages"}
    return CERTAIN if at and json_keys(files, at, wanted) == wanted else NONE


def _at(find: Callable[[Files, str], str | None]) -> Callable[[Files, str], int]:
    return lambda files, p: CERTAIN if find(files, p) else NONE


def _qip_files(files: Files, path: str) -> str:
    root = _qip_root(files, path)
    return f"{root}/*.qhf" if files.glob(root, "*.qhf") else f"{root}/*/History/*.qhf"


def _or(name: str) -> Callable[[Files, str], str]:
    """A folder's file of a name, or the path itself."""
    return lambda files, p: f"{p}/{name}" if files.is_dir(p) else p


#: In fixed order; of equally sure ones the first is taken.
READERS: list[tuple[str, Callable[[Files, str], int], Callable[[SparkSession, Files, str], DataFrame]]] = [
    ("telegram", _telegram, lambda s, f, p: json_exports.telegram(s, _or("result.json")(f, p))),
    ("hangouts", _file("Hangouts.json", "conversations"), lambda s, f, p: json_exports.hangouts(s, _or("Hangouts.json")(f, p))),
    ("googlechat", _at(_chat_root), lambda s, f, p: json_exports.google_chat(s, _chat_root(f, p))),
    ("googlevoice", _at(_calls), lambda s, f, p: page_exports.google_voice(s, f"{_calls(f, p)}/*.html")),
    ("messenger", _meta(False), lambda s, f, p: json_exports.meta(s, f"{_inbox(f, p)}/*/message_*.json")),
    ("instagram", _meta(True), lambda s, f, p: json_exports.meta(s, f"{_inbox(f, p)}/*/message_*.json", "instagram")),
    ("sms", _sms, lambda s, f, p: text_exports.backup(s, p)),
    ("whatsapp", _whatsapp, lambda s, f, p: text_exports.whatsapp(s, p)),
    ("skype", _file("messages.json", "conversations"), lambda s, f, p: json_exports.skype(s, _or("messages.json")(f, p))),
    ("imessage", _imessage, lambda s, f, p: binary_exports.imessage(s, _or("chat.db")(f, p))),
    ("discord", _discord, lambda s, f, p: json_exports.discord_package(s, f"{p}/*/messages.csv")),
    ("discord", _discord_export, lambda s, f, p: json_exports.discord_export(s, _or("*.json")(f, p))),
    ("slack", _slack, lambda s, f, p: json_exports.slack(s, p)),
    ("vk", _at(_vk_root), lambda s, f, p: page_exports.vk(s, f"{_vk_root(f, p)}/{'*' if _name(p).lower() == 'messages' else 'messages/*'}/messages*.html")),
    ("qip", _at(_qip_root), lambda s, f, p: binary_exports.qip(s, _qip_files(f, p))),
]


def detect(path: str, spark: SparkSession | None = None) -> list[tuple[str, int]]:
    """Readers that may read a path, the surest first; one that can't look at it is passed over. Without a session, only
    files of this machine are seen."""
    files = SparkFiles(spark) if spark else LocalFiles()
    found = []
    for name, sure, _ in READERS:
        try:
            if level := sure(files, path.rstrip("/")):
                found.append((name, level))
        except (OSError, Py4JJavaError):
            continue
    return sorted(found, key=lambda x: -x[1])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Canonical messages of an export."""
    files, path = SparkFiles(spark), path.rstrip("/")
    found = detect(path, spark)
    if not found:
        raise ValueError(f"no reader knows {path}")
    return next(r for n, sure, r in READERS if n == found[0][0] and sure(files, path))(spark, files, path)
