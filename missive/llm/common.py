"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker turns into arrays at once; a single longer text makes a chunk of its own.
CHUNK_BYTES = 2 << 20

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder that the session names.

    Only where ``spark.checkpoint.dir`` is unset and the session runs on one machine (tests) a temporary folder is used;
    on a cluster that would lose data, so there it is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="missive-checkpoint-"))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of frames that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_chunks(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts together hold about CHUNK_BYTES."""
    at = np.frombuffer(batch.column(column).cast(pa.large_binary()).buffers()[1], dtype=np.int64)
    offset = batch.column(column).offset
    ends = at[offset : offset + batch.num_rows + 1]
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(ends, ends[begin] + CHUNK_BYTES, side="right")) - 1
        end = min(max(end, begin + 1), batch.num_rows)
        yield begin, end
        begin = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a column and the offsets where each begins; a null is an empty text."""
    filled = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(filled.buffers()[1], dtype=np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = filled.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection on 64-bit numbers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: One random 64-bit number for each byte value at each of 64 places in a word (tabulation hashing).
_PLACES = mix64(np.arange(1, 64 * 256 + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of texts given as bytes, and the text that each word is in."""
    if not len(data):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    starts_text = np.zeros(len(data), bool)
    starts_text[offsets[:-1][offsets[:-1] < len(data)]] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | starts_text[1:]
    begins = np.flatnonzero(first)
    if not len(begins):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    kept = np.flatnonzero(inside)
    word = np.cumsum(first[kept]) - 1
    place = kept - begins[word]
    value = _PLACES[((place & 63) << 8) | data[kept]]
    value = value * ((place >> 6).astype(U64) * U64(2) + U64(1))
    heads = np.searchsorted(kept, begins)
    length = np.diff(np.append(heads, len(kept))).astype(U64)
    hashed = mix64(np.add.reduceat(value, heads) + length * U64(0xD6E8FEB86659FD93))
    return hashed, np.searchsorted(offsets, begins, side="right") - 1


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) of every node of the edges, component being the smallest node it reaches.

    Alternates large-star and small-star steps (Kiveris et al., "Connected components in MapReduce and
    beyond", 2014); each step only takes minima, which are pre-aggregated before they are shuffled. A node
    of huge degree costs one row for each of its edges and no task has to hold its neighbours.
    """
    pairs = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u > v").distinct()
    pairs = checkpoint(pairs)
    state = None
    while True:
        both = pairs.select("u", "v").union(pairs.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.greatest("v", "m").alias("a"), "u", "m")
        after = small.select("u", F.col("m").alias("v")).union(small.select(F.col("a").alias("u"), F.col("m").alias("v")))
        pairs = checkpoint(after.where("u > v").distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    stars = pairs.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    centres = pairs.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return stars.unionByName(centres.join(stars.select("node"), "node", "left_anti"))
