"""Looking at files where Spark reads them: on any file system, a piece at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession

PIECE = 1 << 20
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*("|\\?\Z)|[{}\[\]:]', re.S)  # a string may go on in the next piece


class LocalFiles:
    """Files of this machine."""

    def is_dir(self, path: str) -> bool:
        return Path(path).is_dir()

    def is_file(self, path: str) -> bool:
        return Path(path).is_file()

    def glob(self, folder: str, pattern: str) -> list[str]:
        """Paths below a folder that match, in order."""
        return sorted(map(str, Path(folder).glob(pattern))) if Path(folder).is_dir() else []

    def pieces(self, path: str) -> Iterator[bytes]:
        with open(path, "rb") as f:
            while piece := f.read(PIECE):
                yield piece


class SparkFiles:
    """Files of whatever file system Spark reads a path from."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self._conf), at

    def _status(self, path: str):
        system, at = self._at(path)
        return system.getFileStatus(at) if system.exists(at) else None

    def is_dir(self, path: str) -> bool:
        found = self._status(path)
        return found is not None and found.isDirectory()

    def is_file(self, path: str) -> bool:
        found = self._status(path)
        return found is not None and found.isFile()

    def glob(self, folder: str, pattern: str) -> list[str]:
        system, at = self._at(f"{folder}/{pattern}")
        return sorted(f.getPath().toString() for f in system.globStatus(at) or [])

    def pieces(self, path: str) -> Iterator[bytes]:
        system, at = self._at(path)
        stream = system.open(at)
        try:
            while len(piece := bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(self._jvm.org.apache.commons.io.input.BoundedInputStream(stream, PIECE)))):
                yield piece
        finally:
            stream.close()


def head(files: LocalFiles | SparkFiles, path: str) -> str:
    """The first piece of a file as text."""
    return next(files.pieces(path), b"").decode("utf-8", "replace")


def json_keys(files: LocalFiles | SparkFiles, path: str, wanted: set[str]) -> set[str]:
    """Keys of a JSON file's outermost object: those of ``wanted`` that it has, read until all are found or it ends.

    Only a piece of the file is held; a file that is no object has none.
    """
    found: set[str] = set()
    depth, rest, begun = 0, "", False
    last: str | None = None
    for piece in files.pieces(path):
        text = rest + piece.decode("utf-8", "replace")
        if not begun:
            if not text.lstrip("\ufeff \t\r\n"):
                continue
            if not text.lstrip("\ufeff \t\r\n").startswith("{"):
                return set()
            begun = True
        rest = ""
        for m in _TOKEN.finditer(text):
            token = m.group()
            if token[0] == '"' and m.group(1) != '"':
                rest = token
                break
            if token in "{[":
                depth += 1
            elif token in "}]":
                depth -= 1
            elif token == ":":
                if depth == 1 and last is not None:
                    found.add(last[1:-1])
            last = token if token[0] == '"' else None
            if wanted <= found:
                return found & wanted
    return found & wanted
