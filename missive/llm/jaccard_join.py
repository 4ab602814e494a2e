"""N-gram Jaccard join with set-relation skipping (operator 4).

Exact: two sets link when 100 |x & y| >= 80 |x | y|. The two kinds of skipping are those of Wang, Qin, Lin, Zhang and
Chang, "Leveraging set relations in exact set similarity join" (2017), laid out for a cluster:

* Index level. A set's elements are ordered by how often they occur, rare ones first (counted in a table of fixed size, by
  hash; any order that all sets share gives right results). Sets of sizes n and m that link differ in at most (n + m) / 9
  elements, so the places i and j of their first common element add up to (n + m) / 9 at most. So only a set's first
  elements have entries, one for each size class in which it may link, and an element's list in a class falls into blocks
  of places: blocks that are too late to link with the list's first block are skipped. A passage that many sets share
  stands last in their orders and fills no list.
* Answer level. Each list has a pivot, the first set of its first block, and a star is a pivot with the members of its
  lists; all pairs of a list are never written out. In a star, a set that agrees with the pivot is answered by it: it joins
  the pivot's component. Only for the others answers are sought among the star's other members. That happens twice: first
  on block vectors, a byte for every two or so elements (sets that differ in more blocks than two linked sets can have
  elements apart do not link), which leaves groups that hold all links and little else; then on the sets themselves,
  where |y & b| <= min(|y & p|, |b & p|) + min(|y - p|, |b - p|) decides pairs from what is known about the pivot p
  and only what that leaves open is counted.

Equal sets count once from the lists on. Lists of very frequent elements are not read by one task: their entries are
rows, whose pivots come from an aggregation. A star larger than a task's share is split into chunks that hold the pivot
each; members that do not agree with the pivot then also visit the star's other chunks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from .common import U64, checkpoint, connected_components, mix64, release, table, text_bytes, text_chunks, word_hashes

WORDS = 5
#: A link needs TOP * intersection >= BOTTOM * union.
TOP, BOTTOM = 100, 80
#: Entries that a bucket of the index holds on average, and that a task gathers before it sends or reads them.
BUCKET_ENTRIES, SEND_ENTRIES = 500_000, 2_000_000
#: Set elements that a chunk of a star holds on average.
CHUNK_ELEMENTS = 400_000
#: Blocks of places that a list has, from the first place to the last at which the first common element can be.
BLOCKS = 8
#: Bits of an element's hash that name its counter, and slices in which the counters travel.
COUNTER_BITS, SLICES = 20, 64
#: An element is very frequent if its counter says at least this, and as many times the mean counter.
FREQUENT, TIMES_MEAN = 1 << 20, 64

_FACTORS = mix64(np.arange(1, WORDS + 1, dtype=U64)) | U64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles as 64-bit hashes in order, end to end, and where each text's begin."""
    words, text = word_hashes(data, offsets)
    n = len(offsets) - 1
    counts = np.bincount(text, minlength=n)
    place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    run = np.minimum(np.repeat(counts, counts) - place, WORDS)
    keep = np.flatnonzero((run == WORDS) | (place == 0))
    value = run[keep].astype(U64) * U64(0xC2B2AE3D27D4EB4F)
    padded = np.append(words, np.zeros(WORDS, U64))
    for j in range(WORDS):
        value += np.where(run[keep] > j, padded[keep + j], U64(0)) * _FACTORS[j]
    value, text = mix64(value), text[keep]
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return value[new], np.append(0, np.cumsum(np.bincount(text[new], minlength=n)))


def _sums(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sums of the runs of ``values`` that begin there; an empty run has the sum 0."""
    total = np.append(np.zeros(1, U64), np.cumsum(values, dtype=U64))
    return total[begins[1:]] - total[begins[:-1]]


def set_hashes(values: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set."""
    return mix64(_sums(mix64(values ^ U64(0x5851F42D4C957F2D)), begins)), mix64(_sums(mix64(values ^ U64(0x14057B7EF767814F)), begins))


def frequency_levels(counts: np.ndarray) -> np.ndarray:
    """For each counter the level that orders its elements, in 6 bits: twice its binary logarithm."""
    return np.minimum(2 * np.log2(counts + 1.0), 63).astype(np.uint8)


def frequent_level(total: int) -> int:
    """The level from which on elements are very frequent, where all counters together say ``total``."""
    return int(frequency_levels(np.array([max(FREQUENT, TIMES_MEAN * total >> COUNTER_BITS)]))[0])


def list_entries(values: np.ndarray, begins: np.ndarray, levels: np.ndarray, frequent_from: int = 64) -> tuple[np.ndarray, ...]:
    """The lists (64-bit hashes of element and size class) in which the sets have entries, the set of each entry, its block,
    and whether its element's level is that of very frequent ones.

    A set is in the lists of its own size class, and in those of the next one if sets there may link to it.
    """
    sizes = np.diff(begins)
    some = np.flatnonzero(sizes)
    own = np.zeros(len(sizes), np.int64)
    own[some] = np.floor(np.log2(sizes[some])).astype(np.int64)
    largest = sizes * TOP // BOTTOM
    sets = np.repeat(np.arange(len(sizes)), sizes)
    level = levels[values >> U64(64 - COUNTER_BITS)]
    # by set, level and value; a set's values are in order already, so a stable sort of what fits into 64 bits is exact
    bits = len(sizes).bit_length()
    key = (sets.astype(U64) << U64(64 - bits)) | (level.astype(U64) << U64(58 - bits)) | (values >> U64(6 + bits))
    order = np.argsort(key, kind="stable")
    ordered, frequent = values[order], level[order] >= frequent_from
    place = np.arange(len(values)) - begins[sets]
    out: list[tuple[np.ndarray, ...]] = []

    def add(chosen: np.ndarray, size_class: np.ndarray) -> None:
        most = 2 ** (size_class + 1) - 1  # elements of a set of the class
        upto = np.where(chosen, (sizes + np.minimum(largest, most)) // 9, -1)
        at = np.flatnonzero(place <= upto[sets])
        s = sets[at]
        salt = mix64(size_class[s].astype(U64) + U64(1))
        # floor(BLOCKS * i / (2 * most / 9)): the blocks of two places that may both be first add up to BLOCKS at most
        block = place[at] * (9 * BLOCKS) // (2 * most[s])
        out.append((mix64(ordered[at] ^ salt), s, block.astype(np.uint8), frequent[at]))

    add(sizes > 0, own)
    add((sizes > 0) & (largest >= 2 ** (own + 1)), own + 1)
    return tuple(np.concatenate(column) for column in zip(*out, strict=True))


def vector_blocks(sizes: np.ndarray) -> np.ndarray:
    """Blocks of a set's vector: a power of two, from 0.4 to 0.8 of its size, 32 at least."""
    return (2 ** np.ceil(np.log2(np.maximum(sizes * 2 / 5, 32)))).astype(np.int64)


def block_vectors(values: np.ndarray, begins: np.ndarray) -> list[bytes]:
    """For each set a byte for each block of positions: the sum of its elements' second hashes. Neighbours add up to
    the block of half as fine a vector."""
    sizes = np.diff(begins)
    blocks = vector_blocks(sizes)
    sets = np.repeat(np.arange(len(sizes)), sizes)
    at = np.append(0, np.cumsum(blocks))
    place = at[sets] + ((values >> U64(32)) * blocks[sets].astype(U64) >> U64(32)).astype(np.int64)
    flat = np.zeros(at[-1], np.uint8)
    if len(values):
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        flat[place[first]] = np.add.reduceat(mix64(values ^ U64(0x2545F4914F6CDD1D)) & U64(255), first).astype(np.uint8)
    whole = flat.tobytes()
    return [whole[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n (size of its set), h1 and h2 (hashes of its set), vector (its block vector) of each document; and, in rows
    whose slice is not null, a task's counters of elements, each slice's packed in vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << COUNTER_BITS, np.uint32)
        for batch in batches:
            for begin, end in text_chunks(batch):
                part = batch.slice(begin, end - begin)
                values, begins = shingle_sets(*text_bytes(part.column("text")))
                np.add.at(counters, (values >> U64(64 - COUNTER_BITS)).astype(np.int64), np.uint32(1))
                h1, h2 = set_hashes(values, begins)
                columns = [part.column("doc_id"), pa.array(np.diff(begins)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))]
                columns += [pa.array(block_vectors(values, begins), pa.binary()), pa.nulls(part.num_rows, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "h1", "h2", "vector", "slice"])
        if counters.any():
            none = pa.nulls(SLICES, pa.int64())
            packed = pa.array([pack_counters(c) for c in np.split(counters, SLICES)], pa.binary())
            yield pa.RecordBatch.from_arrays([none, none, none, none, packed, pa.array(range(SLICES), pa.int32())], names=["doc_id", "n", "h1", "h2", "vector", "slice"])

    return docs.mapInArrow(run, "doc_id long, n long, h1 long, h2 long, vector binary, slice int")


def pack_counters(counts: np.ndarray) -> bytes:
    """Counters in planes of one byte each, compressed: most of the upper planes are zeros."""
    return zlib.compress(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack_counters(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def total_levels(found: DataFrame) -> tuple[np.ndarray, int]:
    """The levels of the sum of all tasks' counters, and that sum over all elements: a table of fixed size (a byte for each
    counter), whatever the input's."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, packed in zip(batch.column("slice").to_pylist(), batch.column("vector").to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + unpack_counters(packed)
        columns = [pa.array(list(sums), pa.int32()), pa.array([int(c.sum()) for c in sums.values()], pa.int64())]
        columns.append(pa.array([frequency_levels(c).tobytes() for c in sums.values()], pa.binary()))
        yield pa.RecordBatch.from_arrays(columns, names=["slice", "total", "levels"])

    levels = np.zeros((SLICES, (1 << COUNTER_BITS) // SLICES), np.uint8)
    total = 0
    for row in found.select("slice", "vector").repartition("slice").mapInArrow(add, "slice int, total long, levels binary").collect():
        levels[row["slice"]] = np.frombuffer(row["levels"], np.uint8)
        total += row["total"]
    return levels.ravel(), total


def _index(docs: DataFrame, buckets: int, levels: np.ndarray, frequent_from: int) -> DataFrame:
    """The lists' entries, in bulk: rows of (bucket, block, part, number, lists, nodes), the lists being the low halves of
    their hashes; and, in buckets below 0, entries of very frequent elements with whole hashes and a block each."""

    sent = zlib.compress(levels.tobytes(), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(zlib.decompress(sent), np.uint8)
        part_id, number = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, ...]] = []
        gathered = 0

        def send() -> Iterator[pa.RecordBatch]:
            nonlocal number, gathered
            if not gathered:
                return
            name, node, block, frequent = (np.concatenate(column) for column in zip(*held, strict=True))
            held.clear()
            gathered = 0
            bucket = (((name >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.int64)
            bucket[frequent] = -1 - (part_id + number) % buckets
            cell = bucket * (BLOCKS + 1) + block
            order = np.argsort(cell, kind="stable")
            name, node, block, bucket = name[order], node[order], block[order], bucket[order]
            _, begins = np.unique(cell[order], return_index=True)
            rows = []
            for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(cell)], strict=True):
                lists = name[a:b] if bucket[a] < 0 else name[a:b].astype(np.uint32)
                rows.append((int(bucket[a]), int(block[a]), part_id, number, lists.tobytes(), node[a:b].tobytes()))
            number += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "block", "part", "number", "lists", "nodes"])

        for batch in batches:
            for begin, end in text_chunks(batch):
                values, begins = shingle_sets(*text_bytes(batch.slice(begin, end - begin).column("text")))
                hashes = set_hashes(values, begins)[0]
                name, of, block, frequent = list_entries(values, begins, levels, frequent_from)
                _, once = np.unique(hashes, return_index=True)  # of equal sets the first
                first = np.zeros(len(hashes), bool)
                first[once] = True
                keep = first[of]
                held.append((name[keep], hashes[of[keep]].view(np.int64), block[keep], frequent[keep]))
                gathered += int(keep.sum())
                if gathered >= SEND_ENTRIES:
                    yield from send()
        yield from send()

    entries = docs.select("doc_id", "text").mapInArrow(run, "bucket long, block int, part long, number long, lists binary, nodes binary")
    # partitions of about a bucket each, so that what a task reads doesn't grow with the input; few buckets are left to Spark
    usual = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = entries.repartition(buckets, "bucket") if buckets > usual else entries.repartition("bucket")
    return dealt.sortWithinPartitions("bucket", "block", "part", "number")


class _Lists:
    """The lists of a bucket, read block by block: of each its pivot and its first block, not its members."""

    def __init__(self) -> None:
        self.names, self.pivots, self.blocks = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def read(self, block: int, names: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """(pivot, node) of the next entries, all of one block, without those that are skipped."""
        mine, first = np.unique(names, return_index=True)
        at = np.minimum(np.searchsorted(self.names, mine), max(0, len(self.names) - 1))
        new = self.names[at] != mine if len(self.names) else np.ones(len(mine), bool)
        all_names = np.concatenate([self.names, mine[new]])
        order = np.argsort(all_names, kind="stable")
        self.names = all_names[order]
        self.pivots = np.concatenate([self.pivots, nodes[first[new]]])[order]
        self.blocks = np.concatenate([self.blocks, np.full(int(new.sum()), block)])[order]
        at = np.searchsorted(self.names, names)
        pivots = self.pivots[at]
        linked = (pivots != nodes) & (self.blocks[at] + block <= BLOCKS)
        return np.unique(np.stack([pivots[linked], nodes[linked]], axis=1), axis=0)


def _star_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pivot, node) of the lists; and (node, list, block) of the entries of very frequent elements as they are."""
    names = ["pivot", "node", "list", "block"]
    found: list[np.ndarray] = []
    waiting = 0

    def send() -> Iterator[pa.RecordBatch]:
        nonlocal waiting
        if waiting:
            pairs = np.unique(np.concatenate(found), axis=0)
            found.clear()
            waiting = 0
            none = pa.nulls(len(pairs), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), none, none.cast(pa.int32())], names=names)

    lists, place, held, gathered = _Lists(), (None, None), [], 0

    def read() -> None:
        nonlocal gathered, waiting
        if gathered:
            pairs = lists.read(place[1], *(np.concatenate(c) for c in zip(*held, strict=True)))
            held.clear()
            gathered = 0
            if len(pairs):
                found.append(pairs)
                waiting += len(pairs)

    for batch in batches:
        for bucket, block, name, node in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "lists", "nodes")), strict=True):
            node = np.frombuffer(node, np.int64)
            if bucket < 0:
                columns = [pa.nulls(len(node), pa.int64()), pa.array(node), pa.array(np.frombuffer(name, np.int64)), pa.array(np.full(len(node), block, np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                continue
            if (bucket, block) != place or gathered >= SEND_ENTRIES:
                read()
                if bucket != place[0]:
                    lists = _Lists()
                place = bucket, block
                if waiting >= SEND_ENTRIES:
                    yield from send()
            held.append((np.frombuffer(name, np.uint32), node))
            gathered += len(node)
    read()
    yield from send()


def star_pairs(docs: DataFrame, levels: np.ndarray, total: int) -> DataFrame:
    """(pivot, node) of all stars: each list's pivot and each other set of it that may link to one of it. ``levels`` are those
    of the elements, ``total`` is how many there are."""
    buckets, frequent_from = max(1, -(-total // 3 // BUCKET_ENTRIES)), frequent_level(total)
    found = _index(docs, buckets, levels, frequent_from).mapInArrow(_star_pairs, "pivot long, node long, list long, block int")
    if not (levels >= frequent_from).any():
        return found.select("pivot", "node").distinct()
    found = checkpoint(found)
    entries = found.where("list IS NOT NULL").select("list", "block", "node")
    firsts = entries.groupBy("list").agg(F.min(F.struct("block", "node")).alias("first"))
    frequent = entries.join(firsts, "list").where((F.col("node") != F.col("first.node")) & (F.col("block") + F.col("first.block") <= BLOCKS))
    frequent = frequent.select(F.col("first.node").alias("pivot"), "node")
    return found.where("list IS NULL").select("pivot", "node").unionByName(frequent).distinct()


class _Union:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)


def overlaps(values: np.ndarray, begins: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Elements that each set shares with one set (in order)."""
    if not len(one):
        return np.zeros(len(begins) - 1, np.int64)
    at = np.minimum(np.searchsorted(one, values), len(one) - 1)
    hits = np.append(0, np.cumsum(one[at] == values))
    return hits[begins[1:]] - hits[begins[:-1]]


def links(common: np.ndarray, n: np.ndarray, m: int | np.ndarray) -> np.ndarray:
    return (common > 0) & (TOP * common >= BOTTOM * (n + m - common))


def close_star(values: np.ndarray, begins: np.ndarray, askers: np.ndarray | None = None) -> tuple[list[int], np.ndarray]:
    """The component of each set of a star whose pivot is set 0, and which sets do not link to the pivot.

    ``askers`` (default: the sets that do not link to the pivot) are compared with every other set.
    """
    sizes = np.diff(begins)
    n = len(sizes)
    with_pivot = overlaps(values, begins, values[begins[0] : begins[1]])
    near = links(with_pivot, sizes, int(sizes[0]))
    near[0] = True
    union = _Union(n)
    for k in np.flatnonzero(near).tolist():
        union.join(0, k)
    for y in np.flatnonzero(~near if askers is None else askers).tolist():
        bound = np.minimum(with_pivot, with_pivot[y]) + np.minimum(sizes - with_pivot, sizes[y] - with_pivot[y])
        maybe = np.flatnonzero(links(np.minimum(bound, np.minimum(sizes, sizes[y])), sizes, int(sizes[y])))
        mine = values[begins[y] : begins[y + 1]]
        for b in maybe.tolist():
            if union.root(b) != union.root(y):
                other = values[begins[b] : begins[b + 1]]
                common = int(overlaps(other, np.array([0, len(other)]), mine)[0])
                if links(np.int64(common), sizes[b], int(sizes[y])):
                    union.join(b, y)
    return [union.root(k) for k in range(n)], ~near


def close_vectors(sizes: np.ndarray, vectors: list[np.ndarray], askers: np.ndarray | None = None) -> tuple[list[int], np.ndarray]:
    """As close_star, on block vectors: sets that may link are in one component, those that may not link to the pivot are far."""
    n = len(sizes)
    blocks = np.array([len(v) for v in vectors])
    levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    folded = dict(enumerate(vectors))
    for level in sorted(set(blocks.tolist()), reverse=True):
        rows = np.flatnonzero(blocks >= level)
        for k in rows.tolist():
            while len(folded[k]) > level:
                folded[k] = folded[k][::2] + folded[k][1::2]
        levels[level] = rows, np.stack([folded[k] for k in rows.tolist()])

    def maybe(y: int) -> np.ndarray:
        found, mine = [], vectors[y]
        for level in sorted((x for x in levels if x <= blocks[y]), reverse=True):
            while len(mine) > level:
                mine = mine[::2] + mine[1::2]
            rows, matrix = levels[level]
            if level < blocks[y]:
                own = blocks[rows] == level
                rows, matrix = rows[own], matrix[own]
            differ = (matrix != mine).sum(axis=1)
            both = sizes[rows] + sizes[y]
            # differ elements at least are in one of the two only
            most = (both - differ) // 2
            found.append(rows[links(np.minimum(most, np.minimum(sizes[rows], sizes[y])), sizes[rows], int(sizes[y]))])
        return np.concatenate(found)

    union = _Union(n)
    near = np.zeros(n, bool)
    near[0] = True
    near[maybe(0)] = True
    for k in np.flatnonzero(near).tolist():
        union.join(0, k)
    for y in np.flatnonzero(~near if askers is None else askers).tolist():
        for b in maybe(y).tolist():
            union.join(b, y)
    return [union.root(k) for k in range(n)], ~near


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows that are sorted by star, as tables, and where in them each group begins."""
    held: list[pa.RecordBatch] = []
    size = 0

    def cut(rows: pa.Table) -> np.ndarray:
        keys = [rows.column(c).to_numpy() for c in ("pivot", "chunk", "guests")]
        new = np.zeros(rows.num_rows, bool)
        new[:1] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        for begin, end in text_chunks(batch, "payload"):
            held.append(batch.slice(begin, end - begin))
            size += held[-1].nbytes
            if size >= 4 << 20:
                rows = pa.Table.from_batches(held)
                begins = cut(rows)
                if len(begins) > 1:
                    yield rows.slice(0, begins[-1]), begins[:-1]
                    rows = rows.slice(begins[-1])
                held, size = rows.combine_chunks().to_batches(), rows.nbytes
    if held:
        rows = pa.Table.from_batches(held)
        yield rows, cut(rows)


def _closing(on_vectors: bool):
    """Closes stars of sorted rows: links as (u, v), and members far from the pivot of a split star as (u, null, pivot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begins in _grouped(batches):
            rows = rows.combine_chunks()
            rep, pivot, chunks, role, n = (rows.column(c).to_numpy() for c in ("rep", "pivot", "chunks", "role", "n"))
            payload = rows.column("payload").chunk(0)
            if on_vectors:
                vectors = [np.frombuffer(v, np.uint8) for v in payload.to_pylist()]
            else:
                values, at = shingle_sets(*text_bytes(payload))
            u: list[int] = []
            v: list[int | None] = []
            far_of: list[int | None] = []
            for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(rep)], strict=True):
                guests = role[a:b] == 2
                askers = guests if guests.any() else None
                if on_vectors:
                    roots, far = close_vectors(n[a:b], vectors[a:b], askers)
                else:
                    inside = at[a : b + 1]
                    roots, far = close_star(values[inside[0] : inside[-1]], inside - inside[0], askers)
                for k, r in enumerate(roots):
                    if r != k:
                        u.append(int(rep[a + k]))
                        v.append(int(rep[a + r]))
                        far_of.append(None)
                if chunks[a] > 1 and askers is None:
                    for k in np.flatnonzero(far).tolist():
                        u.append(int(rep[a + k]))
                        v.append(None)
                        far_of.append(int(pivot[a]))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(far_of, pa.int64())], names=["u", "v", "far_of"])

    return run


def _closed(members: DataFrame, payload: DataFrame, on_vectors: bool) -> DataFrame:
    """members: pivot, chunk, chunks, guests, role (0 pivot, 1 member, 2 visitor from another chunk), rep, n."""
    rows = members.join(payload, "rep").select("pivot", "chunk", "guests", "chunks", "role", "rep", "n", "payload")
    rows = rows.repartition("pivot", "chunk", "guests").sortWithinPartitions("pivot", "chunk", "guests", "role", "rep")
    return checkpoint(rows.mapInArrow(_closing(on_vectors), "u long, v long, far_of long"))


def _links(members: DataFrame, heads: DataFrame, payload: DataFrame, on_vectors: bool) -> DataFrame:
    """(u, v) of sets that link (on vectors: may link), enough to connect what a star connects.

    members and heads: pivot, rep, n of a star's other sets and of its pivot; payload: rep and payload, which is the
    set's vector or the text.
    """
    none = F.lit(0).cast("long")
    each = lambda upto: F.explode(F.sequence(none, F.col(upto) - 1))
    sized = checkpoint(members.groupBy("pivot").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / CHUNK_ELEMENTS)).alias("chunks")))
    placed = members.join(sized, "pivot").select("pivot", F.pmod(F.xxhash64("rep"), F.col("chunks")).alias("chunk"), "chunks", F.lit(1).alias("role"), "rep", "n")
    in_each = heads.join(sized, "pivot").select("pivot", each("chunks").alias("chunk"), "chunks", F.lit(0).alias("role"), "rep", "n")
    hosts = placed.unionByName(in_each)
    found = _closed(hosts.withColumn("guests", none), payload, on_vectors)
    edges = found.where("v is not null").select("u", "v")
    far = found.where("v is null").select(F.col("far_of").alias("pivot"), F.col("u").alias("rep")).distinct()
    if far.isEmpty():
        return edges
    # members far from the pivot of a split star visit all its chunks, so many at a time
    far = far.join(members, ["pivot", "rep"])
    split = far.groupBy("pivot").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / CHUNK_ELEMENTS)).alias("parties")).join(sized, "pivot")
    party = F.pmod(F.xxhash64("rep"), F.col("parties")) + 1
    visits = far.join(split, "pivot").select("pivot", each("chunks").alias("chunk"), "chunks", party.alias("guests"), F.lit(2).alias("role"), "rep", "n")
    visited = hosts.join(split.select("pivot", "parties"), "pivot")
    visited = visited.select("pivot", "chunk", "chunks", F.explode(F.sequence(none + 1, F.col("parties"))).alias("guests"), "role", "rep", "n")
    again = _closed(visited.unionByName(visits), payload, on_vectors)
    return edges.unionByName(again.where("v is not null").select("u", "v"))


def join_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs`` (doc_id, text).

    A null or empty text, or one without words, has no shingles, links with nothing and is its own component; so is a
    text with fewer than five words a set of one shingle. Equal texts, and repeated rows, are one component; a row without
    a doc_id links with nothing and has no component; an empty table gives no rows; other columns are left out.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = checkpoint(sketches(docs))
    levels, total = total_levels(found.where("slice IS NOT NULL"))
    sets = found.where("slice IS NULL").drop("slice")
    docs = docs.where("doc_id IS NOT NULL")
    same = sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"))
    same = checkpoint(same)
    vectors = sets.join(same.select("rep"), F.col("doc_id") == F.col("rep"), "left_semi").dropDuplicates(["doc_id"])
    vectors = vectors.select(F.col("doc_id").alias("rep"), F.col("vector").alias("payload"))
    reps = same.select(F.col("h1").alias("node"), "rep", "n")
    pairs = star_pairs(docs, levels, total)
    star = checkpoint(pairs.join(reps, "node").select("pivot", "rep", "n"))
    del pairs
    release(docs.sparkSession)
    heads = star.select("pivot").distinct().join(reps, F.col("pivot") == F.col("node")).select("pivot", "rep", "n")

    # groups that hold all links: each a star around its smallest set
    groups = connected_components(_links(star, heads, vectors, on_vectors=True))
    group = groups.join(same, F.col("node") == F.col("rep")).select(F.col("component").alias("pivot"), "rep", "n")
    group = checkpoint(group)
    release(docs.sparkSession)
    texts = docs.select(F.col("doc_id").alias("rep"), F.coalesce("text", F.lit("")).alias("payload"))
    component = connected_components(_links(group.where("rep <> pivot"), group.where("rep = pivot"), texts, on_vectors=False))

    classes = same.join(component, same["rep"] == component["node"], "left")
    classes = classes.select("h1", "h2", "n", F.coalesce("component", "rep").alias("component_id"))
    own = F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return sets.drop("vector").join(classes, ["h1", "h2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without all but the smallest doc_id of each component, each doc_id once.

    Of rows with one doc_id the one with the least text (null first) stays, of those the one that is least by a hash of
    its other columns. Rows without a doc_id can't be told apart and stay.
    """
    classes = join_components(docs)
    first = classes.where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    named = docs.join(first, docs["doc_id"] == first["kept_id"], "left_semi")
    place, known = "place", {c.lower() for c in docs.columns}
    while place in known:
        place += "_"
    hashed = F.xxhash64(*[docs[f.name] for f in docs.schema.fields if not isinstance(f.dataType, (MapType, VariantType))])
    one = Window.partitionBy("doc_id").orderBy("text", hashed)
    named = named.withColumn(place, F.row_number().over(one)).where(F.col(place) == 1).drop(place)
    return named.unionByName(docs.where(docs["doc_id"].isNull()))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"))


#: All pairs of documents that share a shingle, as SQL: right for every table, affordable for small ones.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END)) AS shingle FROM d),
n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
linked AS (
  SELECT u, v FROM shared JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
links AS (
  SELECT u, v FROM linked UNION ALL SELECT v, u FROM linked),
reach(u, v) AS (
  SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
least_of AS (
  SELECT u, min(v) AS least FROM reach GROUP BY u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least_of m ON m.u = d.doc_id
"""
