"""Quality classifier with supervised subword embeddings (operator 8).

A document is the mean of the learned vectors of its words, of its character n-grams and of the word pairs that repeat
a word, all hashed into buckets; a softmax layer gives the classes (Joulin et al., "Bag of tricks for efficient text
classification", 2016). It is trained by stochastic gradient descent in numpy on a bounded sample of the labelled
documents, whole texts. As both layers are linear, a trained bucket is one number, and scoring a document is a sum over
its characters and words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_bytes, text_chunks, word_hashes

#: The first buckets are of n-grams and words; REPEAT is the bucket of a word that follows itself.
BUCKETS = 1 << 16
REPEAT = BUCKETS
GRAMS = (2, 3, 4)
#: Labelled documents that the model learns from at most, and bytes of their texts (beyond which no further one is taken);
#: they are chosen by a hash of doc_id.
SAMPLE, SAMPLE_BYTES = 4000, 64 << 20
FOLDS = 5

_GRAM_FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each character (its bytes, the first lowest; white space as one kind) and the text that it is in."""
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    first = (data & 0xC0) != 0x80
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    begins = np.flatnonzero(first)
    plain = np.where((data >= 9) & (data <= 13), np.uint8(32), data).astype(np.uint32)
    place = np.arange(len(data)) - begins[np.cumsum(first) - 1]
    code = np.add.reduceat(plain << (8 * np.minimum(place, 3)).astype(np.uint32), begins).astype(np.uint32)
    return code, np.searchsorted(offsets, begins, side="right") - 1


def _grams(plain: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Buckets of the n-grams that begin at each character."""
    code = np.zeros(len(plain), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if len(plain) < n:
            return
        code = code[: len(plain) - n + 1] + (plain[n - 1 :] + np.uint32(1)) * np.uint32(_GRAM_FACTORS[n - 1])
        if n in GRAMS:
            mixed = code ^ (code >> np.uint32(15))
            yield n, (mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(16)


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Kinds of features of texts given as bytes: the buckets, and the text of each, in order."""
    plain, text = characters(data, offsets)
    for n, bucket in _grams(plain):
        inside = text[n - 1 :] == text[: len(text) - n + 1]
        yield bucket[inside], text[: len(text) - n + 1][inside]
    words, of = word_hashes(data, offsets, lower=False)
    yield (words >> np.uint64(48)).astype(np.uint32), of
    again = np.flatnonzero((words[1:] == words[:-1]) & (of[1:] == of[:-1])) + 1
    yield np.full(len(again), REPEAT, np.uint32), of[again]


@dataclass
class Model:
    """weight[b] is what bucket b adds to the log odds of class 1, before the mean; bias is added after it."""

    weight: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        total, count = np.zeros(n), np.zeros(n)
        for bucket, text in features(data, offsets):
            if len(bucket):
                ids, begins = np.unique(text, return_index=True)
                total[ids] += np.add.reduceat(self.weight[bucket], begins)
                count[ids] += np.diff(np.append(begins, len(text)))
        return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + self.bias)))


def train(texts: list[str], classes: list[int], dims: int = 8, epochs: int = 6, rate: float = 1.0, seed: int = 3) -> Model:
    """Learns from whole texts. Without examples, or with those of one class only, every score is that of the bias."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dims, 1 / dims, (BUCKETS + 1, dims))
    output = np.zeros((dims, 2))
    bias = np.zeros(2)
    bags = []
    for text in texts:
        data = np.frombuffer(text.encode("utf-8"), np.uint8)
        found = [b for b, _ in features(data, np.array([0, len(data)]))]
        ids, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, int), np.zeros(0))
        bags.append((ids.astype(np.uint32), (counts / max(1, counts.sum())).astype(np.float32)))
    wanted = np.asarray(classes, np.int64)
    steps, step = max(1, epochs * len(bags)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(bags)):
            ids, share = bags[k]
            now = rate * (1 - step / steps)
            step += 1
            hidden = share @ vectors[ids] if len(ids) else np.zeros(dims)
            logits = hidden @ output + bias
            p = np.exp(logits - logits.max())
            error = p / p.sum()
            error[wanted[k]] -= 1
            back = output @ error
            output -= now * np.outer(hidden, error)
            bias -= 0.1 * now * error
            # the mean's gradient is a small share for each bucket; scaled so that frequent ones move
            vectors[ids] -= now * 20 * share[:, None] * back
    return Model((vectors @ (output[:, 1] - output[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Trains on labelled rows outside fold 0; of more than ``sample`` labels, those least by a hash of doc_id, and of these
    documents, in that order, as many as begin within ``sample_bytes``.

    The task that holds the sample trains, so that the driver gets the weights of the buckets and no texts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("labelled"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("quality").isin(0, 1) & (fold(F.col("labelled")) != 0))
    known = known.orderBy(F.xxhash64("labelled"), "labelled", "quality").limit(sample)  # this many rows are broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("labelled"))
    rows = rows.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "quality")
    # a window over the sample, of ``sample`` labels at most
    ahead = Window.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "text").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.octet_length("text")).over(ahead), F.lit(0))
    rows = rows.withColumn("before", before).where(F.col("before") < sample_bytes).drop("before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := list(batches):
            known = pa.Table.from_batches(held).sort_by([("doc_id", "ascending"), ("quality", "ascending"), ("text", "ascending")])
            model = train(known.column("text").to_pylist(), known.column("quality").to_pylist())
            columns = [pa.array([model.weight.tobytes()], pa.binary()), pa.array([model.bias])]
            yield pa.RecordBatch.from_arrays(columns, names=["weight", "bias"])

    # the window leaves one partition, and so one model, or none where there are no rows
    models = rows.mapInArrow(run, "weight binary, bias double").collect()
    return Model(np.frombuffer(models[0]["weight"], np.float32), models[0]["bias"]) if models else train([], [])


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs`` (doc_id, text).

    A null or empty text gets the score of the bias alone. Repeated rows give repeated rows; a null doc_id is not held
    out; other columns are left out; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in text_chunks(batch):
                part = batch.slice(begin, end - begin)
                scores = model.scores(*text_bytes(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in text_chunks(batch):
                part = batch.slice(begin, end - begin)
                scores = model.scores(*text_bytes(part.column(part.schema.get_field_index("text"))))
                yield part.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
