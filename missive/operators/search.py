"""Full-text search: query grammar, terms, ranked hits, snippets, capped counts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.store import shared_folder
from ..functions.text import fold, plain_words, words

#: Okapi BM25, as published.
K1, B = 1.2, 0.75
CAP = 1000

@dataclass(frozen=True)
class Term:
    """Words that must stand next to each other; the last one may be a beginning."""

    words: tuple[str, ...]
    prefix: bool


def parse_query(query: str) -> list[Term]:
    """Bare words are prefixes, quoted ones phrases; an open quote runs to the end; terms without letters or digits go."""
    terms = []
    for m in re.finditer(r'"([^"]*)(?:"|$)|([^\s"]+)', query):
        quoted = m.group(2) is None
        found = tuple(plain_words(m.group(1) if quoted else m.group(2)))
        if found:
            terms.append(Term(found, not quoted))
    return terms


def occurrences(term: Term, words: Column) -> Column:
    """How often a term stands in an array of words; overlapping places count each.

    The words are read once, as one string: an expression over each of them would cut the text again for each, where a
    filter on its result is pushed below the words.
    """
    first, *rest = term.words
    ahead = "".join(f" {w}" for w in rest) + ("" if term.prefix else " ")
    line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    return F.regexp_count(line, F.lit(f" {first}(?={ahead})" if ahead else f" {first}"))


def filtered(hits: DataFrame, thread_id=None, person_id=None, provenance=None, since=None, until=None) -> DataFrame:
    """Hits of a thread, a person, a provenance, and a time (inclusive at both ends)."""
    for column, value in (("thread_id", thread_id), ("person_id", person_id), ("provenance", provenance)):
        if value is not None:
            hits = hits.where(F.col(column) == value)
    if since is not None:
        hits = hits.where(F.col("sent_at_unix") >= since)
    return hits if until is None else hits.where(F.col("sent_at_unix") <= until)


def scored(counted: DataFrame, stats: DataFrame, n_terms: int, limit: int | None = 200, **filters) -> DataFrame:
    """id and BM25 score of the rows with all terms (id, length, tf0, tf1, ...); stats: one row of n, mean, df0, df1, ..."""
    hit = counted
    for k in range(n_terms):
        hit = hit.where(F.col(f"tf{k}") > 0)
    hit = filtered(hit, **filters).crossJoin(F.broadcast(stats))  # one row of counts
    score = F.lit(0.0)
    for k in range(n_terms):
        tf, df = F.col(f"tf{k}"), F.col(f"df{k}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score += idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    found = hit.select("id", F.round(score, 6).alias("score"))
    return found if limit is None else found.orderBy(F.desc("score"), "id").limit(limit)


def frequencies(n_terms: int) -> list[Column]:
    return [F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(n_terms)]


def search(documents: DataFrame, query: str, limit: int | None = 200, **filters) -> DataFrame:
    """Documents (id, body, ...) that hold all terms, best first by BM25; each term's expansions count as one term.

    Reads all texts; ``index.search`` answers from stored postings. filters: those of ``filtered``.
    """
    terms = parse_query(query)
    if not terms:
        return documents.select("id", F.lit(0.0).alias("score")).where(F.lit(False))
    rows = documents.withColumn("words", words(F.col("body")))
    rows = rows.withColumn("length", F.size("words"))
    for k, term in enumerate(terms):
        rows = rows.withColumn(f"tf{k}", occurrences(term, F.col("words")))
    # counts are stored: statistics, hits and their order would each cut all texts again, filters on counts once more for each term
    shared_folder(documents.sparkSession)
    counted = rows.drop("words", "body").checkpoint()
    stats = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *frequencies(len(terms)))
    return scored(counted, stats, len(terms), limit, **filters)


def ranked(found: DataFrame) -> DataFrame:
    """id and rank of all hits, best first; no task holds them all: a rank is a hit's place in its partition of the ordered
    hits, behind what the partitions before hold."""
    shared_folder(found.sparkSession)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = found.orderBy(F.desc("score"), "id").select("id", F.spark_partition_id().alias("part"), place.alias("place")).checkpoint()
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = rows.groupBy("part").agg(F.count("*").alias("n")).select("part", ahead.alias("ahead"))  # a row a partition
    return rows.join(F.broadcast(parts), "part").select("id", (F.col("ahead") + F.col("place") + 1).alias("rank"))


def capped_count(found: DataFrame, cap: int = CAP) -> DataFrame:
    """Hits up to a cap, and whether that is all of them."""
    return found.limit(cap).agg(F.count("*").alias("hits")).withColumn("exact", F.col("hits") < cap)


def count_if_truncated(found: DataFrame, limit: int, cap: int = CAP) -> DataFrame:
    """Hits shown, and hits in all up to a cap: counted only where a page is full, as others show all there are."""
    shown = found.limit(limit).count()
    total = capped_count(found, cap) if shown == limit else found.sparkSession.range(1).select(F.lit(shown).cast("long").alias("hits"), F.lit(True).alias("exact"))
    return total.select(F.lit(shown).cast("long").alias("shown"), "hits", "exact")


def cut_snippet(text: str, terms: list[Term], around: int = 12) -> list[tuple[str, bool]]:
    """Up to ``around`` words about the first match, as runs of matched and other text."""
    spans = [m.span() for m in re.finditer(r"[^\W_]+", text)]
    folded = [fold(text[a:b]) for a, b in spans]
    matched = set()
    for term in terms:
        n = len(term.words)
        for k in range(len(folded) - n + 1):
            body, last = folded[k : k + n - 1], folded[k + n - 1]
            if tuple(body) == term.words[:-1] and (last.startswith(term.words[-1]) if term.prefix else last == term.words[-1]):
                matched.update(range(k, k + n))
    if not spans:
        return [(text, False)] if text else []
    first = min(matched, default=0)
    begin = max(0, min(first - around // 3, len(spans) - around))
    end = min(len(spans), begin + around)
    runs: list[tuple[str, bool]] = [("…", False)] if begin else []
    at = spans[begin][0] if begin else 0
    for k in range(begin, end):
        a, b = spans[k]
        if k in matched:
            runs += [(text[at:a], False), (text[a:b], True)]
            at = b
    tail = text[at : spans[end - 1][1]] if end < len(spans) else text[at:]
    runs.append((tail + ("…" if end < len(spans) else ""), False))
    merged: list[tuple[str, bool]] = []
    for part, hit in runs:
        if part and merged and merged[-1][1] == hit:
            merged[-1] = (merged[-1][0] + part, hit)
        elif part:
            merged.append((part, hit))
    return merged


def snippets(documents: DataFrame, query: str) -> DataFrame:
    """id and runs (text, is_match) of each document."""
    terms = parse_query(query)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            runs = [[{"text": t, "is_match": m} for t, m in cut_snippet(b or "", terms)] for b in rows["body"]]
            yield pd.DataFrame({"id": rows["id"], "runs": runs})

    return documents.select("id", "body").mapInPandas(run, "id long, runs array<struct<text: string, is_match: boolean>>")


def hydrate(hits: DataFrame, message: DataFrame, most: int = 200) -> DataFrame:
    """Hits (message_id) with their message's thread, sender, time and the beginning of its text."""
    text = F.col("plaintext")
    snippet = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)
    rows = message.select(F.col("id").alias("message_id"), "thread_id", "sender_identity_id", "sent_at_unix", snippet.alias("snippet"))
    return hits.join(rows, "message_id", "left")
