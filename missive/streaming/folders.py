"""Watched folders: each is imported when its files changed, and one that fails doesn't stop the others."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.store import fingerprint
from ..sources import registry
from ..sources.files import SparkFiles


@dataclass(frozen=True)
class Outcome:
    """What became of a folder: missing, unchanged, imported (with its rows) or failed (with its error's kind)."""

    folder: str
    state: str
    fingerprint: str | None = None
    rows: int = 0
    error: str | None = None


def check(spark: SparkSession, folders: list[str], known: dict[str, str], commit: Callable[[str, DataFrame], None], read: Callable[[SparkSession, str], DataFrame] = registry.read) -> list[Outcome]:
    """The outcome of each folder. ``known`` has the fingerprint of each folder's last import, and gets new ones;
    ``commit`` takes a folder and its messages. A folder that failed is tried again next time."""
    files, out = SparkFiles(spark), []
    for folder in folders:
        try:
            if not files.is_dir(folder):
                out.append(Outcome(folder, "missing", known.get(folder)))
                continue
            now = fingerprint(spark, folder)
            if known.get(folder) == now:
                out.append(Outcome(folder, "unchanged", now))
                continue
            rows = read(spark, folder)
            commit(folder, rows)
            known[folder] = now
            out.append(Outcome(folder, "imported", now, rows.count()))
        except Exception as e:  # whatever a reader raises is that folder's outcome
            out.append(Outcome(folder, "failed", known.get(folder), error=type(e).__name__))
    return out
