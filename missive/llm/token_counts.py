"""Token counts by rank-synchronous array merging (operator 1).

Texts are normalised and cut into pre-tokens as the tokenizer file says. The distinct pre-tokens of a batch that
the worker's bounded memo does not hold lie end to end in one numpy array of symbols. In each round every sequence's
lowest-rank pair is found and merged wherever it stands in that sequence, all sequences at once, until no sequence
holds a pair with a rank; the symbols that survive are its tokens.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pretokens
from .common import table, text_chunks

#: Words whose counts a worker remembers, of so many characters at most; beyond that it forgets all and starts anew (a memo,
#: not a limit: other words are counted anew in each batch).
MEMO, MEMO_LENGTH = 400_000, 64
#: Characters outside the blocks where Python's Unicode tables and the tokenizer's give the same NFC, case and classes.
OTHER = re.compile("[^\x00-\u06ff\u1e00-\u2bff\u3000-\u9fff\uac00-\ud7a3\uff00-\uffef\U0001f000-\U0001f64f]")
NO_RANK = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in names):
        names[b] = chr(256 + n)
    return [names[b] for b in range(256)]


class ArrayMerger:
    """Counts the tokens of pre-tokens with the merges of a tokenizer file (format of the tokenizers library)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        suffix = spec["model"].get("end_of_word_suffix") or ""
        names = byte_symbols()
        self.inner = np.array([vocab[c] for c in names], np.int64)
        self.last = np.array([vocab[c + suffix] for c in names], np.int64)
        self.base = len(vocab) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.special = sorted((t["content"] for t in spec["added_tokens"] if t["special"]), key=len, reverse=True)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Surviving symbols of each word; no word is empty."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        result = np.ones(len(words), np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[data[ends]]
        word = np.repeat(np.arange(len(words)), lengths)
        near = word[1:] == word[:-1]
        rank = np.full(len(symbols), NO_RANK, np.int64)
        rank[:-1][near] = self.rank(symbols[:-1][near], symbols[1:][near])
        while len(symbols):
            heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lowest = np.minimum.reduceat(rank, heads)
            sizes = np.diff(np.append(heads, len(symbols)))
            done = lowest == NO_RANK
            result[word[heads[done]]] = sizes[done]
            if done.all():
                break
            hit = (rank == np.repeat(lowest, sizes)) & (rank != NO_RANK)
            if (run := hit[1:] & hit[:-1]).any():  # overlapping pairs of one symbol: each second one stays out
                place = np.arange(len(hit))
                begin = np.maximum.accumulate(np.where(hit & ~np.append(False, run), place, -1))
                hit &= (place - begin) % 2 == 0
            symbols[hit] = self.made[rank[hit]]
            keep = np.repeat(~done, sizes)
            keep[1:] &= ~hit[:-1]
            symbols, word, rank, hit = symbols[keep], word[keep], rank[keep], hit[keep]
            # only pairs that a merged symbol is in have a new rank
            new = hit.copy()
            new[:-1] |= hit[1:]
            at = np.flatnonzero(new)
            inner = at[at < len(word) - 1]
            inner = inner[word[inner] == word[inner + 1]]
            rank[at] = NO_RANK
            rank[inner] = self.rank(symbols[inner], symbols[inner + 1])
        return result


@functools.cache
def library_normalizer():
    """NFC and lower case by the tables of the tokenizers library, some of which are older and some newer."""
    from tokenizers import normalizers

    return normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])


@functools.cache
def library_splitter():
    """The pre-token pattern by the classes of the tokenizers library."""
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(pretokens.WORD_BPE.pattern), behavior="removed", invert=True)


def pre_tokens(lowered: str) -> list[str]:
    if OTHER.search(lowered):
        return [piece for piece, _ in library_splitter().pre_tokenize_str(lowered)]
    return pretokens.WORD_BPE.findall(lowered)


class WordBpeCounter:
    """Tokens of whole texts for word_bpe_49k: NFC, one blank for white space, lower case, merges with word ends.

    No pre-token spans white space, so the memo holds the counts of whole words between it.
    """

    def __init__(self, path: str):
        self.merger = ArrayMerger(path)
        self.memo: dict[str, int] = {}
        self.special = re.compile("|".join(map(re.escape, self.merger.special))) if self.merger.special else None

    @staticmethod
    def lowered(text: str) -> str:
        if text.isascii():
            return text.lower()
        if OTHER.search(text):
            return library_normalizer().normalize_str(text)
        text = unicodedata.normalize("NFC", text)
        # lower() looks at the neighbours of a capital sigma, the tokenizer doesn't
        return text.replace("Σ", "σ").lower()

    def words(self, text: str) -> list[str]:
        text = self.lowered(text)
        if not pretokens.SEPARATORS.search(text):
            return text.split()
        return pre_tokens(text)

    def pieces(self, text: str) -> tuple[int, list[str]]:
        if self.special is None or "<|" not in text:
            return 0, self.words(text)
        parts = self.special.split(text)
        return len(parts) - 1, [w for part in parts for w in self.words(part)]

    def learn(self, words: list[str]) -> None:
        cut = [pre_tokens(w) for w in words]
        parts = list({p for c in cut for p in c})
        counts = dict(zip(parts, self.merger.counts([p.encode("utf-8") for p in parts]).tolist(), strict=True))
        self.memo.update((w, sum(map(counts.__getitem__, c))) for w, c in zip(words, cut, strict=True))

    def __call__(self, texts: list[str]) -> list[int]:
        cut = [self.pieces(t) for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        if new := {w for _, words in cut for w in words}.difference(self.memo):
            self.learn(list(new))
        known = self.memo.__getitem__
        counts = [n + sum(map(known, words)) for n, words in cut]
        for w in new:
            if len(w) > MEMO_LENGTH:
                del self.memo[w]
        return counts


@functools.cache
def word_counter(path: str) -> WordBpeCounter:
    """One for each Python worker, kept from task to task."""
    return WordBpeCounter(path)


def count_tokens(docs: DataFrame, path: str | None = None, over: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of ``docs`` (doc_id, text).

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows give repeated results; other columns are left out,
    whatever their names; an empty table gives no rows. ``path`` names the tokenizer file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        counter = word_counter(path or public_tokenizers.path("word_bpe_49k.json"))
        for batch in batches:
            for begin, end in text_chunks(batch):
                part = batch.slice(begin, end - begin)
                text = part.column("text").fill_null("")
                n = counter(text.to_pylist())
                columns = [part.column("doc_id"), pc.binary_length(text).cast(pa.int64()), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counted = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > over)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
