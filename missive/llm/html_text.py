"""HTML extraction by nearest-URL page differencing (operator 3).

Pages of a host are paired with the page of other lines whose URL path is nearest. Both pages' text lines (blocks) are
aligned by their longest common subsequence, and lines that both share are template, not content, and deleted. That
decides wherever a page's markup leaves doubt: on pages without an article or main element, and for blocks inside an
article that only a word of their class marks (``DOUBTFUL``). What the markup says plainly (navigation, forms, adverts,
comments, what is outside of an article) goes without it, and other lines inside an article stay even where the nearest
page shares them, because pages of one site also share whole sentences of their articles (README has the figures of
differencing alone).

A page is parsed once. Pages in doubt get the hashes of their partner's lines, others are done where they are. Pairs come
from sorted keys without any task holding a host: keys are range-partitioned by host and path, neighbours are looked up
inside a partition, and across its borders by way of its first and last row.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, table, text_chunks

# Element names by what they do.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "object", "select", "xmp")
TEMPLATE = frozenset("nav footer aside form head menu dialog button fieldset".split())
MAIN = frozenset("article main".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Words of class, id and role that mark template parts.
MARKS = frozenset(
    "ad ads advert advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "header masthead footer cookie cookies consent notice notices gdpr popup modal overlay comment comments respond reply replies disqus share sharing "
    "social related recommended newsletter subscribe signup login search form widget toolbar pagination pager contentinfo complementary".split()
)
#: Those of them that inside an article may as well mark its own parts.
DOUBTFUL = frozenset("banner contentinfo form header login masthead menu modal notice notices overlay popup promo promotion related reply replies respond search signup toolbar widget".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{'|'.join(RAW)})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'){{0,1000}}+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'){0,1000}+)>"
    r"|</?[a-zA-Z!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_MARK_VALUES = re.compile(r"(?:\b(?:class|id|role))\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_MAYBE_HIDDEN = re.compile(r"hidden|display", re.I)
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)


#: Matches for each line of two pages up to which they are chained one by one.
FEW_MATCHES = 16


@dataclass
class Line:
    text: str
    #: Inside the page's article, or what it marks as template (0 not, 1 perhaps, 2 surely).
    main: bool
    template: int


def _is_hidden(rest: str) -> bool:
    """Whether attributes hide their element: hidden by its name, display:none in style, true in aria-hidden."""
    if not _MAYBE_HIDDEN.search(rest):
        return False
    for m in _ATTRIBUTE.finditer(rest):
        name, value = m.group(1).lower(), (m.group(2) or m.group(3) or m.group(4) or "").strip().lower()
        if name == "hidden" and not value.startswith(("until", "false")):
            return True
        if (name == "aria-hidden" and value == "true") or (name == "style" and _NO_DISPLAY.search(value)):
            return True
    return False


def _is_template(name: str, rest: str, in_main: bool) -> int:
    """Whether an element's own markup makes it template: 0 not, 1 perhaps, 2 surely."""
    if name in TEMPLATE or (name == "header" and not in_main):
        return 2
    if not rest:
        return 0
    if _is_hidden(rest):
        return 2
    if name in MAIN or name in ("body", "html"):
        return 0
    found: set[str] = set()
    for values in _MARK_VALUES.findall(rest):
        found.update(MARKS.intersection(re.split(r"[^a-z]+", "".join(values).lower())))
    return 0 if not found else 1 if in_main and found <= DOUBTFUL else 2


def lines_of(page: str) -> list[Line]:
    """The text blocks of a page in order, white space one blank, character references decoded; none is empty."""
    out: list[Line] = []
    words: list[str] = []
    stack: list[tuple[str, bool, int]] = []
    standing: dict[str, int] = {}  # how often a name is in the stack
    main, template = False, 0

    def leave(k: int) -> None:
        """Goes back to before the stack's element k."""
        nonlocal main, template
        _, main, template = stack[k]
        for name, *_ in stack[k:]:
            standing[name] -= 1
        del stack[k:]

    def flush() -> None:
        if words:
            text = " ".join(html.unescape("".join(words)).split())
            words.clear()
            if text:
                out.append(Line(text, main, template))

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            words.append(page[at : m.start()])
        at = m.end()
        name = m.group("name")
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            words.append(" ")
            continue
        if name in BLOCKS:
            flush()
        if m.group("close"):
            if standing.get(name):
                leave(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
            continue
        rest = m.group("rest")
        if name in VOID or rest.endswith("/"):
            continue
        if name in ("p", "li") and standing.get(name):  # an open one ends here
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    leave(k)
                    break
                if stack[k][0] in BLOCKS:
                    break
        if name in BLOCKS or rest:
            marked = template if template == 2 else max(template, _is_template(name, rest, main))
            if name in BLOCKS or marked != template:
                stack.append((name, main, template))
                standing[name] = standing.get(name, 0) + 1
                if marked > template:
                    flush()
                main, template = main or name in MAIN, marked
    if at < len(page):
        words.append(page[at:])
    flush()
    return out


def common_lines(mine: list[int], theirs: list[int]) -> set[int]:
    """Places in ``mine`` of a longest common subsequence.

    Common beginnings and ends are part of one. Between them, few matches are chained (Hunt and Szymanski, 1977); many are
    counted in bit vectors, by halves (Hirschberg, 1975; Hyyrö, 2004), which takes little memory however long the pages.
    """
    begin = 0
    while begin < min(len(mine), len(theirs)) and mine[begin] == theirs[begin]:
        begin += 1
    end = 0
    while end < min(len(mine), len(theirs)) - begin and mine[-1 - end] == theirs[-1 - end]:
        end += 1
    found = {*range(begin), *range(len(mine) - end, len(mine))}
    inner, other = mine[begin : len(mine) - end], theirs[begin : len(theirs) - end]
    counts = Counter(other)
    matches = sum(counts[x] for x in inner)
    places = _chained(inner, other) if matches <= FEW_MATCHES * (len(inner) + len(other) + 1) else _halved(inner, other)
    return found | {begin + i for i in places}


def _chained(mine: list[int], theirs: list[int]) -> list[int]:
    where: dict[int, list[int]] = {}
    for j, line in enumerate(theirs):
        where.setdefault(line, []).append(j)
    ends: list[int] = []
    chains: list[tuple] = []
    for i, line in enumerate(mine):
        for j in reversed(where.get(line, ())):
            k = bisect_left(ends, j)
            chain = (i, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(chain)
            else:
                ends[k] = j
                chains[k] = chain
    found: list[int] = []
    chain = chains[-1] if chains else None
    while chain:
        found.append(chain[0])
        chain = chain[1]
    return found


def _prefix_lengths(mine: list[int], theirs: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of ``mine`` and each beginning of ``theirs``."""
    masks: dict[int, int] = {}
    for j, line in enumerate(theirs):
        masks[line] = masks.get(line, 0) | 1 << j
    whole = (1 << len(theirs)) - 1
    row = whole
    for line in mine:
        hit = row & masks.get(line, 0)
        row = ((row + hit) | (row - hit)) & whole
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(theirs) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(theirs)]
    return np.append(0, np.cumsum(bits == 0))


def _halved(mine: list[int], theirs: list[int]) -> list[int]:
    found: list[int] = []
    open_ = [(0, mine, theirs)]
    while open_:
        at, a, b = open_.pop()
        if not a or not b:
            continue
        if len(a) == 1:
            if a[0] in b:
                found.append(at)
            continue
        half = len(a) // 2
        cut = int(np.argmax(_prefix_lengths(a[:half], b) + _prefix_lengths(a[half:][::-1], b[::-1])[::-1]))
        open_ += [(at, a[:half], b[:cut]), (at + half, a[half:], b[cut:])]
    return found


def line_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8"), digest_size=8).digest(), "little", signed=True)


def in_doubt(lines: list[Line]) -> bool:
    """Whether the markup leaves open what of a page is its own."""
    has_main = any(x.main and not x.template for x in lines)
    return any(not x.template if not has_main else x.main and x.template == 1 for x in lines)


def main_text(lines: list[Line], nearest: list[int] | None) -> str:
    """The page's own lines: inside its article those that nothing marks, and of those that only a doubtful word marks what
    the nearest page doesn't share; without an article all unmarked lines that the nearest page doesn't share."""
    shared = common_lines([line_hash(x.text) for x in lines], nearest) if nearest else set()
    has_main = any(x.main and not x.template for x in lines)

    def own(k: int, x: Line) -> bool:
        if has_main:
            return x.main and (not x.template or (x.template == 1 and k not in shared))
        return not x.template and k not in shared

    return "\n".join(x.text for k, x in enumerate(lines) if own(k, x))


def pack_lines(lines: list[Line]) -> bytes:
    """Lines for the way to their page's pair: a sign and the text of each, compressed. No text holds a line end."""
    return zlib.compress("\n".join("nNtmMT"[x.template + 3 * x.main] + x.text for x in lines).encode("utf-8"), 1)


def unpack_lines(packed: bytes) -> list[Line]:
    rows = zlib.decompress(packed).decode("utf-8")
    return [Line(r[1:], r[0] in "mMT", "nNtmMT".index(r[0]) % 3) for r in rows.split("\n")] if rows else []


PARSED = "page_id long, url string, lines array<long>, text string, packed binary"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with the hashes of their lines, and their text, or in doubt their lines instead."""
    for batch in batches:
        for begin, end in text_chunks(batch, "html"):
            part = batch.slice(begin, end - begin)
            pages = [lines_of(page or "") for page in part.column("html").to_pylist()]
            doubt = [in_doubt(lines) for lines in pages]
            hashes = pa.array([[line_hash(x.text) for x in lines] for lines in pages], pa.list_(pa.int64()))
            texts = pa.array([None if open_ else main_text(lines, None) for lines, open_ in zip(pages, doubt, strict=True)], pa.string())
            packed = pa.array([pack_lines(lines) if open_ else None for lines, open_ in zip(pages, doubt, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), hashes, texts, packed], names=["page_id", "url", "lines", "text", "packed"])


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, end in text_chunks(batch, "packed"):
            part = batch.slice(begin, end - begin)
            texts = [main_text(unpack_lines(page), near) for page, near in zip(part.column("packed").to_pylist(), part.column("lines").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def nearest_pages(pages: DataFrame) -> DataFrame:
    """page_id and nearest_id of each row of ``pages`` (page_id, url, same), page_id being a key: the page of the same
    host and of another ``same`` whose URL path is nearest in order and has the longer common beginning (the earlier one
    of equals); null where a host has no such page. Pages of one ``same`` have equal lines.

    Pages of one ``same`` that follow each other are a run; the partners of all its pages are the pages beside the run.
    """
    url = F.regexp_replace(F.coalesce("url", F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    keys = pages.select(
        "page_id",
        "same",
        F.lower(F.substring_index(F.regexp_replace(url, "[?#].*$", ""), "/", 1)).alias("host"),
        F.regexp_extract(F.regexp_replace(url, "[?#].*$", ""), "^[^/]*(.*)$", 1).alias("path"),
    )
    order = ["host", "path", "same", "page_id"]
    parts = max(1, pages.sparkSession.sparkContext.defaultParallelism)
    keys = checkpoint(keys.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    near = F.struct(*order)
    inside = Window.partitionBy("part").orderBy(order)
    rows = keys.select("*", F.lag(near).over(inside).alias("lag"), F.lead(near).over(inside).alias("lead"))

    def beside(other):
        # the row ahead or behind, where a run begins or ends
        return F.when((other["host"] != F.col("host")) | (other["same"] != F.col("same")), other)

    back = [F.desc(c) for c in order]  # a frame that runs on to the end would be read anew at every row
    before, after = F.last(F.col("begins"), True), F.last(F.col("ends"), True)
    so_far = (Window.unboundedPreceding, 0)
    rows = rows.withColumn("begins", beside(F.col("lag"))).withColumn("ends", beside(F.col("lead")))
    rows = rows.select("*", before.over(inside.rowsBetween(*so_far)).alias("before"), after.over(inside.orderBy(*back).rowsBetween(*so_far)).alias("after"))
    # a partition's first and last run may go on in others: of these, their ends in the partition are enough, four rows at most
    first_run, last_run = F.col("before").isNull(), F.col("after").isNull()
    edge = F.col("lag").isNull() | F.col("lead").isNull() | (first_run & F.col("ends").isNotNull()) | (last_run & F.col("begins").isNotNull())
    across = Window.orderBy(order)
    edges = rows.where(edge).select(
        "part", *order, "lag", "lead",
        F.when(F.col("lag").isNull(), beside(F.lag(near).over(across))).otherwise(F.col("begins")).alias("begins"),
        F.when(F.col("lead").isNull(), beside(F.lead(near).over(across))).otherwise(F.col("ends")).alias("ends"),
    )
    edges = edges.select("part", "lag", "lead", before.over(across.rowsBetween(*so_far)).alias("before"), after.over(Window.orderBy(*back).rowsBetween(*so_far)).alias("after"))
    sides = edges.groupBy("part").agg(
        F.max(F.when(F.col("lag").isNull(), F.col("before"))).alias("part_before"), F.max(F.when(F.col("lead").isNull(), F.col("after"))).alias("part_after")
    )
    both = rows.select("part", *order, "before", "after").join(F.broadcast(sides), "part")
    both = both.select(*order, F.coalesce("before", "part_before").alias("before"), F.coalesce("after", "part_after").alias("after"))

    def common(other: str):
        # characters that both paths begin with: found by halves, so that long paths are compared a few times only
        longest = F.least(F.length("path"), F.length(F.col(other)["path"]))
        steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
        begins = lambda n: F.substring(F.col("path"), F.lit(1), n) == F.substring(F.col(other)["path"], F.lit(1), n)
        return F.aggregate(steps, F.lit(0), lambda n, step: F.when((step <= longest - n) & begins(n + step), n + step).otherwise(n))

    same = {c: F.col(c)["host"] == F.col("host") for c in ("before", "after")}
    nearest = F.when(same["before"] & ~(F.coalesce(same["after"], F.lit(False)) & (common("after") > common("before"))), F.col("before")["page_id"])
    return both.select("page_id", F.coalesce(nearest, F.when(same["after"], F.col("after")["page_id"])).alias("nearest_id"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages`` (page_id, url, html).

    A null or empty page, or one without lines of its own, has the text "" and no characters. A null URL is a page of
    the empty host; a page without a page_id is no page's partner and has none. Repeated rows give repeated rows; other
    columns are left out; an empty table gives no rows.
    """
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    parsed = checkpoint(pages.mapInArrow(_parsed, PARSED))
    plain, doubtful = parsed.where("packed IS NULL").select("page_id", "url", "text"), parsed.where("packed IS NOT NULL")
    if not doubtful.isEmpty():
        lines = parsed.where("page_id IS NOT NULL").select("page_id", "lines", F.struct(F.xxhash64("lines").alias("same"), "url").alias("row"))
        keys = lines.groupBy("page_id").agg(F.min("row").alias("row")).select("page_id", "row.*")
        asked = nearest_pages(keys).join(doubtful.select("page_id"), "page_id", "left_semi")
        lines = lines.join(asked.select(F.col("nearest_id").alias("page_id")), "page_id", "left_semi").groupBy("page_id").agg(F.min_by("lines", "row").alias("lines"))
        other = asked.join(lines.withColumnRenamed("page_id", "nearest_id"), "nearest_id").select(F.col("page_id").alias("paired"), "lines")
        rows = doubtful.drop("lines").join(other, F.col("page_id") == F.col("paired"), "left").select("page_id", "url", "packed", "lines")
        plain = plain.unionByName(rows.mapInArrow(_decided, "page_id long, url string, text string"))
    return plain.withColumn("n_chars", F.length("text").cast("long"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
