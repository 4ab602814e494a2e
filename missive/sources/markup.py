"""A small tree of HTML, for exports that come as web pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Node:
    """An element with its attributes, classes and children (elements and strings)."""

    def __init__(self, tag: str, attrs: list[tuple[str, str | None]] = ()) -> None:
        self.tag, self.attrs = tag, {k: v or "" for k, v in attrs}
        self.classes = set(self.attrs.get("class", "").split())
        self.children: list[Node | str] = []

    def all(self, tag: str = "", cls: str = "") -> Iterator[Node]:
        """Elements below in page order, of a tag or class if given."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            if (not tag or node.tag == tag) and (not cls or cls in node.classes):
                yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def first(self, tag: str = "", cls: str = "") -> Node | None:
        return next(self.all(tag, cls), None)

    def text(self, *without: str, breaks: str = "") -> str:
        """Text below, without elements of some classes; a line break counts as ``breaks``."""
        out, stack = [], list(reversed(self.children))
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag == "br":
                out.append(breaks)
            elif not node.classes & set(without):
                stack += reversed(node.children)
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = [Node("")]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[-1].children.append(Node(tag, attrs))

    def handle_endtag(self, tag: str) -> None:
        depth = next((k for k in range(len(self.open) - 1, 0, -1) if self.open[k].tag == tag), 0)
        if depth:
            del self.open[depth:]

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def tree(page: bytes) -> Node:
    """The root of a page, read in the charset that it names, else as UTF-8."""
    named = re.search(rb"charset=[\"']?([A-Za-z0-9_-]+)", page[:2048])
    builder = _Builder()
    builder.feed(page.decode(named[1].decode() if named else "utf-8", "replace"))
    builder.close()
    return builder.open[0]
