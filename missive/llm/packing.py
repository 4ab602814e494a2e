"""Sum-of-squares packing of documents into sequences (operator 10).

Documents become ids, end in one closing id and are cut into pieces of at most ``size`` ids. Pieces are dealt into
blocks of a fixed expected size; in each block they go, longest first, to the open sequence whose choice makes the sum
over all gaps g of (open sequences with g ids left) squared smallest (Csirik et al., "On the sum-of-squares algorithm
for bin packing", 2006); a new sequence opens only where none has room. A full piece is a sequence of its own. A block
wastes at most a few part-filled sequences, so the loss doesn't grow with the number of blocks relative to the input.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_chunks

#: Documents, and pieces, that a block of the packing holds on average at most.
BLOCK_DOCS, BLOCK_PIECES = 40_000, 400_000
#: Characters of the runs of white space that are cut out (White_Space of Unicode, which Python's \s is not).
LONG = 1 << 16
LONG_SPACE = regex.compile(rf"\p{{White_Space}}{{{LONG},}}+")
END_OF_TEXT = "<|endoftext|>"

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


@functools.cache
def encoding(ranks_path: str, end_of_text: int = 50256):
    """byte_bpe_50k, its special string read as its id: one for each Python worker, kept from task to task.

    The ranks file holds the vocabulary and merges of the .json file; the ids are those the tokenizers library gives
    (tests compare them), at several times its speed.
    """
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    special = {END_OF_TEXT: end_of_text}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def text_ids(text: str, ranks_path: str) -> bytes:
    """Little-endian 32-bit ids of a text.

    The library's pattern reads a run of white space but for its last character as one piece, or all of it where the text
    or its part before a special string ends, and its matcher gives up on runs of a million. So long runs are cut out
    here, by the same rule, and merged without the pattern.
    """
    encoder = encoding(ranks_path)
    parts, at = [], 0
    for m in LONG_SPACE.finditer(text) if len(text) >= LONG else ():
        whole = m.end() == len(text) or text.startswith(END_OF_TEXT, m.end())
        end = m.end() if whole else m.end() - 1
        if m.start() > at:
            parts.append(encoder.encode_to_numpy(text[at : m.start()], allowed_special="all"))
        parts.append(np.array(encoder._encode_single_piece(text[m.start() : end]), np.uint32))
        at = end
    if at < len(text):
        parts.append(encoder.encode_to_numpy(text[at:], allowed_special="all"))
    return b"".join(p.astype("<u4", copy=False).tobytes() for p in parts)


def cut_pieces(docs: DataFrame, size: int = 1024, closing_id: int = 2, ranks_path: str | None = None) -> DataFrame:
    """The pieces of each row of ``docs`` (doc_id, text): PIECE_SCHEMA.

    A null text counts as empty and gives one piece, the closing id. Only the first piece of a document can be
    shorter than ``size``. Repeated rows give repeated pieces; a null doc_id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        closing = np.array([closing_id], "<u4").tobytes()
        for batch in batches:
            for begin, end in text_chunks(batch):
                part = batch.slice(begin, end - begin)
                rows: list[tuple[int | None, int, int, int, int]] = []
                texts = part.column("text").fill_null("").to_pylist()
                for doc_id, text in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                    ids = text_ids(text, path) + closing
                    total = len(ids) // 4
                    first = (total - 1) % size + 1
                    starts = [0, *range(first, total, size)]
                    for piece, (a, b) in enumerate(zip(starts, [*starts[1:], total], strict=True)):
                        rows.append((doc_id, piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECE_SCHEMA)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence of each length, in the order given, and the place in it; lengths are from 1 to ``size``."""
    open_with: list[list[int]] = [[] for _ in range(size + 1)]
    count = np.zeros(size + 1, np.int64)
    sequence, offset, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k, length in enumerate(lengths.tolist()):
        gaps = np.flatnonzero(count[length:]) + length
        gap = size
        if len(gaps):  # by how much the sum changes; a sequence without a gap is closed and not counted
            change = np.where(gaps == length, 1, 2 * count[gaps - length] + 2) - 2 * count[gaps]
            gap = int(gaps[np.argmin(change)])
        if gap < size:
            bin_id = open_with[gap].pop()
            count[gap] -= 1
        else:
            bin_id, made = made, made + 1
        left = gap - length
        sequence[k], offset[k] = bin_id, size - gap
        if left:
            open_with[left].append(bin_id)
            count[left] += 1
    return sequence, offset


def pack(pieces: DataFrame, blocks: int, size: int = 1024) -> DataFrame:
    """``pieces`` with sequence_id and offset. Reruns give the same sequences.

    Pieces without a doc_id are dealt by their place in the table, so that they don't all come into one block.
    """

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.drop_columns("block").sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = rows.column("length").to_numpy()
        full = int((lengths == size).sum())
        sequence, offset = sum_of_squares(lengths[full:], size)
        ids = (key[0].as_py() << 40) + np.concatenate([np.arange(full), sequence + full])
        return rows.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(np.concatenate([np.zeros(full, np.int64), offset])))

    place = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", place), F.lit(blocks)))
    return dealt.groupBy("block").applyInArrow(run, f"{PIECE_SCHEMA}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, size: int = 1024, closing_id: int = 2, ranks_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of the pieces of ``docs``.

    Null or empty texts give one piece of one id; repeated rows are packed as often as they stand there; rows without a
    doc_id are packed as others; an empty table gives no rows; columns other than doc_id and text are left out.
    """
    sizes = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0)).alias("bytes")).first()
    # an id stands for one byte at least
    blocks = max(1, -(-sizes["n"] // BLOCK_DOCS), -(-(sizes["n"] + sizes["bytes"] // size) // BLOCK_PIECES))
    return pack(cut_pieces(docs, size, closing_id, ranks_path), blocks, size)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
