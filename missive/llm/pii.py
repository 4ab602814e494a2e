"""Personal data by weak supervision (operator 6).

Candidate spans of four kinds come from wide patterns. Three labelers vote on each: the strict pattern (regex), lists
of known endings, issuers and dialling codes (gazetteer), and the words around it (context). Expectation-maximisation
estimates from the votes of all candidates of the corpus how reliable each labeler is (Dawid and Skene, 1979, without
any true labels), and a logistic span classifier is trained on the resulting probabilities, with the votes and the
span's shape as features. Votes enter as counts of equal patterns, of which there is a fixed number, so the corpus is
aggregated before anything reaches the driver. What the strict patterns find stays in any case; the classifier adds.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_bytes, text_chunks

KINDS = ("email", "ip", "card", "phone")

# The strict patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# The same matches in time linear in the text: e-mail addresses are sought from their @, and a run of digits is tried
# for an address of the internet at its first digit only.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP_RUN = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")

# Wider patterns of candidates; that of e-mail addresses begins where the local part ends.
SPELLED_AT = re.compile(r"(?:\[at\]|\(at\)|\{at\}) ?[A-Za-z0-9-]+(?:(?: ?(?:\[dot\]|\(dot\)|\{dot\}) ?|\.)[A-Za-z0-9-]+)+")
WIDE = {
    "ip": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9A-Za-z])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9A-Za-z])"),
    "phone": re.compile(r"(?<![0-9A-Za-z+])(?:\([0-9]{2,4}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9A-Za-z])"),
}

# Gazetteers.
ENDINGS = frozenset("com org net edu gov mil int info biz io co dev app ai uk de fr es it nl eu us ca au jp cn br in ru ch se no example test".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "6011", "65", "35", "36", "38", "62")
DIALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "64", "81", "82", "86", "90", "91")
# Words before a span that speak for a kind, and against any.
FOR = {
    "email": frozenset("email e-mail mail contact write reply address courriel correo".split()),
    "ip": frozenset("ip host server address from client login logged".split()),
    "card": frozenset("card visa mastercard amex credit debit payment carte tarjeta karte".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax sms whatsapp telefon teléfono téléphone".split()),
}
AGAINST = frozenset("version isbn issn order invoice build release chapter section ticket article".split())

_WORD = re.compile(r"[\w-]+")
#: Characters before a span in which the context labeler looks for its last words, and how many of them it reads.
CONTEXT_CHARS, CONTEXT_WORDS = 60, 4
ABSTAIN, NO, YES = 0, 1, 2
LABELERS = ("regex", "gazetteer", "context")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _local_start(text: str, begin: int, end: int) -> int:
    """Where the run of characters of local parts that ends at ``end`` starts, ``begin`` at the earliest."""
    while end > begin and text[end - 1] in LOCAL:
        end -= 1
    return end


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """All matches of EMAIL. No local part holds an @, so the leftmost match before one starts its run of characters."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = _local_start(text, end, at)
        if start < at and (m := AT_DOMAIN.match(text, at)):
            end = m.end()
            yield start, end
        else:
            end = at + 1  # a later match can't reach over this @
        at = text.find("@", end)


def _spelled_emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses whose @ is written out, with at most one blank before it."""
    end = 0
    for m in SPELLED_AT.finditer(text):
        last = m.start() - (text[m.start() - 1 : m.start()] == " ")
        if (start := _local_start(text, end, max(last, end))) < last:
            end = m.end()
            yield start, end


def _wide(kind: str, text: str) -> Iterator[tuple[int, int]]:
    if kind == "email":
        yield from _spelled_emails(text)
    else:
        yield from (m.span() for m in WIDE[kind].finditer(text))


def _part(digits: str) -> int:
    """The value of a part of an internet address, as far as it matters whether that is at most 255."""
    digits = digits.lstrip("0")
    return int(digits or "0") if len(digits) <= 3 else 256


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """What the strict patterns find, by kind and then by start; leftmost, not overlapping inside a kind."""
    found = [("email", a, b) for a, b in _emails(text)]
    found += [("ip", *m.span()) for m in IP_RUN.finditer(text) if all(_part(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if 16 <= len(digits := _digits(m.group())) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return found


@dataclass
class Candidate:
    kind: str
    start: int
    end: int
    base: bool
    votes: tuple[int, int, int]
    shape: int


def _gazetteer(kind: str, span: str) -> int:
    if kind == "email":
        return YES if re.split(r"[^A-Za-z0-9-]+", span.rstrip("])}"))[-1].lower() in ENDINGS else NO
    digits = _digits(span)
    if kind == "card":
        return YES if digits.startswith(ISSUERS) else NO
    if kind == "phone":
        return (YES if digits.startswith(DIALLING) else NO) if span.startswith("+") else ABSTAIN
    return NO if span.startswith(("0.", "127.", "255.")) else ABSTAIN


def _context(kind: str, before: str) -> int:
    words = [w.lower() for w in _WORD.findall(before)[-CONTEXT_WORDS:]]
    if any(w in FOR[kind] for w in words):
        return YES
    return NO if any(w in AGAINST for w in words) else ABSTAIN


def candidates(text: str) -> list[Candidate]:
    """Strict and wide spans with their votes; wide ones that touch a strict one are left out."""
    base = base_spans(text)
    spans = [(k, a, b, True) for k, a, b in base]
    for kind in KINDS:
        starts = sorted(a for _, a, _, _ in spans)
        reach = list(accumulate((b for _, _, b, _ in sorted(spans, key=lambda s: s[1])), max))  # the furthest end so far
        for a, b in _wide(kind, text):
            if kind == "card" and not luhn(_digits(text[a:b])):
                continue
            before = bisect_left(starts, b)
            if not before or reach[before - 1] <= a:
                spans.append((kind, a, b, False))
    out = []
    for kind, a, b, strict in spans:
        span = text[a:b]
        votes = (YES if strict else NO, _gazetteer(kind, span), _context(kind, text[max(0, a - CONTEXT_CHARS) : a]))
        out.append(Candidate(kind, a, b, strict, votes, min(len(span) // 8, 3)))
    return out


@dataclass
class Reliability:
    """prior: how often a candidate is personal data; vote[l][y][v]: how often labeler l, where it votes, votes v and the
    truth is y. A labeler that abstains says nothing: how often it does depends on the kind, not on the truth."""

    prior: float = 0.5
    vote: np.ndarray = field(default_factory=lambda: np.array([[[1.0, 0.7, 0.3], [1.0, 0.3, 0.7]]] * len(LABELERS)))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        log = np.tile(np.log([1 - self.prior, self.prior]), (len(votes), 1))
        for labeler in range(votes.shape[1]):
            log += np.log(self.vote[labeler][:, votes[:, labeler]]).T
        log -= log.max(axis=1, keepdims=True)
        p = np.exp(log)
        return p[:, 1] / p.sum(axis=1)


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> Reliability:
    """Expectation-maximisation over vote patterns and their counts, with one pseudo-count for each cell."""
    model = Reliability()
    for _ in range(rounds if len(votes) else 0):
        p = model.posterior(votes)
        weight = np.stack([counts * (1 - p), counts * p])
        vote = np.ones((votes.shape[1], 2, 3))
        for labeler in range(votes.shape[1]):
            for v in (NO, YES):
                vote[labeler, :, v] += weight[:, votes[:, labeler] == v].sum(axis=1)
        vote[:, :, NO:] /= vote[:, :, NO:].sum(axis=2, keepdims=True)
        prior = (weight[1].sum() + 1) / (counts.sum() + 2)
        model = Reliability(float(prior), vote)
    return model


def _features(kinds: np.ndarray, votes: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    parts = [np.ones((len(kinds), 1)), np.eye(len(KINDS))[kinds], np.eye(4)[shapes]]
    parts += [np.eye(3)[votes[:, labeler]] for labeler in range(votes.shape[1])]
    return np.concatenate(parts, axis=1)


@dataclass
class SpanClassifier:
    weights: np.ndarray

    def probability(self, kinds: np.ndarray, votes: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-_features(kinds, votes, shapes) @ self.weights))


def train(kinds: np.ndarray, votes: np.ndarray, shapes: np.ndarray, counts: np.ndarray, rounds: int = 300) -> tuple[Reliability, SpanClassifier]:
    """Reliabilities of the labelers, and a logistic classifier that learns from the probabilities they give."""
    reliability = estimate(votes, counts)
    x, y = _features(kinds, votes, shapes), reliability.posterior(votes)
    weights = np.zeros(x.shape[1])
    share = counts / max(1, counts.sum())
    for _ in range(rounds if len(counts) else 0):
        p = 1 / (1 + np.exp(-x @ weights))
        weights -= 2.0 * (x.T @ (share * (p - y)) + 1e-3 * weights)
    return reliability, SpanClassifier(weights)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of a chunk; texts without a digit, a colon or an @ can hold no candidate and are passed as empty."""
    for batch in batches:
        for begin, end in text_chunks(batch):
            part = batch.slice(begin, end - begin)
            data, at = text_bytes(part.column("text"))
            hint = np.append(0, np.cumsum(((data >= 48) & (data <= 58)) | (data == 64)))
            wide = np.append(0, np.cumsum((data == 91) | (data == 40) | (data == 123)))
            some = (hint[at[1:]] > hint[at[:-1]]) | (wide[at[1:]] > wide[at[:-1]])
            whole, at = data.tobytes(), at.tolist()
            yield part.column("doc_id").to_pylist(), [whole[a:b].decode("utf-8") if s else "" for a, b, s in zip(at, at[1:], some.tolist(), strict=False)]


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple, int] = {}
    for _, texts in _texts(batches):
        for text in texts:
            for c in candidates(text) if text else ():
                key = (KINDS.index(c.kind), *c.votes, c.shape)
                counts[key] = counts.get(key, 0) + 1
    if counts:
        columns = [pa.array(c, pa.int64()) for c in zip(*(k + (n,) for k, n in counts.items()), strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=["kind", *LABELERS, "shape", "n"])


def fit(docs: DataFrame) -> SpanClassifier:
    """Trains on the votes on all candidates of ``docs`` (doc_id, text)."""
    rows = docs.select("doc_id", "text").mapInArrow(_patterns, "kind long, regex long, gazetteer long, context long, shape long, n long")
    keys = ["kind", *LABELERS, "shape"]
    patterns = rows.groupBy(keys).agg(F.sum("n").alias("n")).orderBy(keys).collect()  # at most 4 * 27 * 4 rows
    values = np.array([tuple(r) for r in patterns], np.int64).reshape(-1, 6)
    return train(values[:, 0], values[:, 1:4], values[:, 4], values[:, 5])[1]


SPANS = "doc_id long, spans array<struct<kind: string, start: long, end: long, base: boolean>>"


def find_pii(docs: DataFrame, threshold: float = 0.5, classifier: SpanClassifier | None = None) -> DataFrame:
    """SPANS of each row of ``docs`` (doc_id, text): code points, end exclusive, by kind as in KINDS, then by start.

    A null or empty text, or one without candidates, has no spans. Repeated rows give repeated rows; other columns are
    left out; an empty table gives no rows. ``base`` marks what the strict patterns find.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    classifier = classifier or fit(docs)
    struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _texts(batches):
            rows = []
            for text in texts:
                found = candidates(text) if text else []
                if found and not all(c.base for c in found):
                    p = classifier.probability(*(np.array(x) for x in ([KINDS.index(c.kind) for c in found], [c.votes for c in found], [c.shape for c in found])))
                    found = [c for c, q in zip(found, p.tolist(), strict=True) if c.base or q >= threshold]
                found.sort(key=lambda c: (KINDS.index(c.kind), c.start))
                rows.append([{"kind": c.kind, "start": c.start, "end": c.end, "base": c.base} for c in found])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.list_(struct))], names=["doc_id", "spans"])

    return docs.mapInArrow(run, SPANS)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the strict spans by kind, the hash of them all, and all spans as one string."""
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(base) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with each span in ``text`` replaced by its kind in brackets; other columns stay as they are."""
    classifier = fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            for k, text in enumerate(texts):
                found = candidates(text) if text else []
                if found:
                    p = classifier.probability(*(np.array(x) for x in ([KINDS.index(c.kind) for c in found], [c.votes for c in found], [c.shape for c in found])))
                    chosen = sorted((c.start, c.end, c.kind) for c, q in zip(found, p.tolist(), strict=True) if c.base or q >= 0.5)
                    parts, end = [], 0
                    for a, b, kind in chosen:
                        if a >= end:
                            parts += [text[end:a], f"[{kind}]"]
                        end = max(end, b)
                    texts[k] = "".join([*parts, text[end:]])
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field(at).type) if j == at else c for j, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op6_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_pii(table(spark, sf_dir, "documents")))
