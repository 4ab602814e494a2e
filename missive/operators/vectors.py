"""Vector and hybrid search."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

#: Hits must score at least this share of the best.
RELATIVE_FLOOR = 0.8
RRF_K = 60
SEMANTIC_DEPTH = 40
#: Components of a chunk of vectors (about), queries and vectors of a block of products, and candidates scored at once.
CHUNK, QUERIES, BLOCK, SCORED = 1 << 24, 256, 4096, 1 << 15
#: Lengths beyond which products are taken in double precision.
LONG = 1e15


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def normalized(vectors: DataFrame) -> DataFrame:
    """Vectors of length 1; a zero vector stays as it is."""
    n = norm(F.col("embedding"))
    return vectors.select("vec_id", F.when(n > 0, F.transform("embedding", lambda x: x / n)).otherwise(F.col("embedding").cast("array<double>")).alias("vector"))


def write(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored vectors (session_id, model, input_hash, vector) with new ones (embedding instead of vector), of length 1, in
    the place of those of the same session and model."""
    unit = normalized(new.withColumn("vec_id", F.struct("session_id", "model", "input_hash")))
    unit = unit.select("vec_id.*", "vector")
    kept = stored.join(new.select("session_id", "model"), ["session_id", "model"], "left_anti")
    return kept.select(unit.columns).unionByName(unit)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def top_k(vectors: DataFrame, query: DataFrame, limit: int = 20, floor: float = RELATIVE_FLOOR) -> DataFrame:
    """For each query row (column query, and others that name it) the vectors by their product with it, positive and near
    the best. The other columns of ``query`` come first. For one or a few queries; ``top_k_of_many`` is for sets of them."""
    keys = [c for c in query.columns if c != "query"]
    asked = query.withColumn("asked", F.monotonically_increasing_id())
    # all of a stated set of queries against all vectors: a few queries are broadcast by their size, many are joined in blocks
    scored = vectors.crossJoin(asked).where(F.size("embedding") == F.size("query"))
    scored = scored.select("asked", *keys, "vec_id", F.round(dot(F.col("embedding"), F.col("query")), 6).alias("score")).where("score > 0")
    each = Window.partitionBy("asked")
    rows = scored.withColumn("place", F.row_number().over(each.orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= limit)
    rows = rows.withColumn("best", F.max("score").over(each)).where(F.col("score") >= floor * F.col("best"))
    return rows.orderBy(*keys, F.desc("score"), "vec_id").select(*keys, "vec_id", "score")


def _rounded(score: np.ndarray) -> np.ndarray:
    """Six decimals, halves up, as ``F.round`` gives them."""
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = score * 1e6
        out = np.floor(scaled + 0.5) / 1e6
        doubtful = (np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4) | (np.abs(score) > 1e8)
    out[~np.isfinite(score)] = score[~np.isfinite(score)]
    for k in np.flatnonzero(doubtful & np.isfinite(score)):
        x = float(score[k])
        out[k] = x if abs(x) > 1e15 else float(Decimal(repr(x)).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out


class _Chunk:
    """Vectors of one size, in the order of their ids, that queries are multiplied with."""

    def __init__(self, parts: list[pa.RecordBatch], dim: int, limit: int) -> None:
        self.limit, self.dim = limit, dim
        x = np.concatenate([_matrix(p, dim) for p in parts])
        keep = self._without_copies(x)
        with np.errstate(over="ignore", invalid="ignore"):
            length = np.concatenate([np.sqrt((x[k : k + SCORED].astype(np.float64) ** 2).sum(axis=1)) for k in range(0, len(x), SCORED)])
        # long ones first: blocks hold vectors of like lengths, so that one long vector does not widen the margin of all
        length = np.where(length <= LONG, length, np.inf)
        order = keep[np.argsort(-length[keep], kind="stable")]
        self.place, self.length, self.x = order, length[order], x[order]
        with np.errstate(over="ignore"):
            self.x32 = self.x.astype(np.float32, copy=False)
        self.ids = pa.concat_arrays([p.column("vec_id") for p in parts])

    def _without_copies(self, x: np.ndarray) -> np.ndarray:
        """Rows without those that ``limit`` equal ones precede: these are no hit of any query."""
        bits = x.view(np.uint32 if x.itemsize == 4 else np.uint64)
        by = np.random.default_rng(7).integers(1, 1 << 63, self.dim, np.uint64) | np.uint64(1)
        names = np.concatenate([(bits[k : k + SCORED].astype(np.uint64) * by).sum(axis=1) for k in range(0, len(x), SCORED)])
        _, group, counts = np.unique(names, return_inverse=True, return_counts=True)
        many = np.flatnonzero(counts[group] > self.limit)
        keep = np.ones(len(x), bool)
        if len(many):
            _, group = np.unique(np.ascontiguousarray(x[many]).view(np.dtype((np.void, x.itemsize * self.dim))).ravel(), return_inverse=True)
            order = np.argsort(group, kind="stable")
            keep[many[order[_places(group[order]) >= self.limit]]] = False
        return np.flatnonzero(keep)

    def _scores(self, query: np.ndarray, qi: np.ndarray, vi: np.ndarray) -> np.ndarray:
        """Products in double precision, summed up from the first component on, as ``dot`` does."""
        out = np.zeros(len(qi))
        with np.errstate(over="ignore", invalid="ignore"):
            for k in range(0, len(qi), SCORED):
                product = self.x[vi[k : k + SCORED]].astype(np.float64) * query[qi[k : k + SCORED]]
                for j in range(self.dim):
                    out[k : k + SCORED] += product[:, j]
        return out

    def best(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The query, the place of the vector and the score of up to ``limit`` hits of each query.

        Blocks of products say which vectors may be hits: what is below the score that ``limit`` others reach, with a
        margin for rounding, is none. The others' scores are then computed exactly.
        """
        query = query.astype(np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            size = np.sqrt((query**2).sum(axis=1))
            query32 = query.astype(np.float32)
        plain = bool((size <= LONG).all())
        least = np.full(len(query), 4.9e-7)  # less rounds to zero
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0
        for begin in range(0, len(self.x), BLOCK):
            fast = plain and self.length[begin] <= LONG
            with np.errstate(over="ignore", invalid="ignore"):
                product = query32 @ self.x32[begin : begin + BLOCK].T if fast else query @ self.x[begin : begin + BLOCK].astype(np.float64).T
                margin = (self.dim + 4) * float(np.finfo(product.dtype).eps) * size * self.length[begin]
                if begin == 0 and product.shape[1] > self.limit:
                    least = np.maximum(least, np.partition(product, -self.limit, axis=1)[:, -self.limit] - margin - 1.1e-6)
                hits = np.flatnonzero(~(product < (least - margin).astype(product.dtype)[:, None]))  # also what is no number
            qi, vi = np.divmod(hits, product.shape[1])
            found.append((qi, vi + begin))
            waiting += len(qi)
            if waiting > 4 * self.limit * len(query) or begin + BLOCK >= len(self.x):
                held = self._trimmed(query, held, found, least)
                found, waiting = [], 0
        return held[0], self.place[held[1]], held[2]

    def _trimmed(self, query: np.ndarray, held: list[np.ndarray], found: list[tuple[np.ndarray, np.ndarray]], least: np.ndarray) -> list[np.ndarray]:
        """The first ``limit`` of each query; ``least`` rises to what the last of them lets pass."""
        qi, vi = (np.concatenate(x) for x in zip(*found, strict=True))
        qi, vi, score = (np.concatenate(x) for x in zip(held, (qi, vi, self._scores(query, qi, vi)), strict=True))
        shown = _rounded(score)
        some = np.flatnonzero(~(shown <= 0))
        qi, vi, score, shown = qi[some], vi[some], score[some], shown[some]
        odd = np.isnan(shown)  # before all others, as Spark and SQL order them
        order = np.lexsort((self.place[vi], np.where(odd, 0, -shown), ~odd, qi))
        at = _places(qi[order])
        order, at = order[at < self.limit], at[at < self.limit]
        last = order[at == self.limit - 1]
        least[qi[last]] = np.fmax(least[qi[last]], np.where(odd[last], np.inf, shown[last] - 5.1e-7))
        return [qi[order], vi[order], score[order]]


def _places(groups: np.ndarray) -> np.ndarray:
    """The place of each of ordered rows in its group."""
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else np.zeros(0, np.int64)
    return np.arange(len(groups)) - np.repeat(starts, np.diff(np.r_[starts, len(groups)]))


def _matrix(part: pa.RecordBatch, dim: int) -> np.ndarray:
    return part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _best_of_chunk(limit: int, carried: list[str]):
    """For sorted rows (dim, is_query, vec_id, vector, ...) the hits of each query among the vectors that are here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        chunk: _Chunk | None = None
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            asks = batch.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
            changes = np.flatnonzero((dims[1:] != dims[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in pairwise(dict.fromkeys([0, *changes.tolist(), batch.num_rows])):
                dim, rows = int(dims[a]), batch.slice(a, b - a)
                if not asks[a]:
                    if parts and parts[0].column("dim")[0].as_py() != dim:
                        parts = []
                    parts.append(rows)
                    chunk = None
                    continue
                if chunk is None and parts and parts[0].column("dim")[0].as_py() == dim:
                    chunk = _Chunk(parts, dim, limit)
                parts = []
                if chunk is None or chunk.dim != dim:
                    continue
                for k in range(0, rows.num_rows, QUERIES):
                    some = rows.slice(k, QUERIES)
                    qi, place, score = chunk.best(_matrix(some, dim))
                    named = [some.column(c).take(pa.array(qi)) for c in carried]
                    yield pa.RecordBatch.from_arrays([*named, chunk.ids.take(pa.array(place)), pa.array(score)], [*carried, "vec_id", "score"])

    return run


def top_k_of_many(vectors: DataFrame, query: DataFrame, limit: int = 20, floor: float = RELATIVE_FLOOR) -> DataFrame:
    """What ``top_k`` gives, for a set of queries of any size, with the rank of each hit and in no order.

    Vectors are dealt into chunks, which all queries visit in blocks of matrix products; a chunk gives ``limit`` hits of a
    query at most. So no pair of a query and a vector travels, and neither table is broadcast or collected.
    """
    keys = [c for c in query.columns if c != "query"]
    kinds = {vectors.schema["embedding"].dataType.simpleString(), query.schema["query"].dataType.simpleString()}
    kind = "array<float>" if kinds == {"array<float>"} else "array<double>"
    size = vectors.agg(F.sum(F.size("embedding").cast("long"))).first()[0] or 0
    chunks = max(2 * vectors.sparkSession.sparkContext.defaultParallelism, -(-size // CHUNK))
    sound = (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull())
    named = F.struct(*keys) if keys else F.lit(None).cast("int")
    id_type, name_type = vectors.schema["vec_id"].dataType, query.select(named.alias("named")).schema["named"].dataType
    own = vectors.select("vec_id", F.col("embedding").cast(kind).alias("vector")).where(sound)
    own = own.select(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(chunks)).cast("int").alias("chunk"), F.size("vector").alias("dim"), F.lit(False).alias("is_query"), "vec_id",
                     F.lit(None).cast("long").alias("asked"), F.lit(None).cast(name_type).alias("named"), "vector")
    asked = query.select(F.monotonically_increasing_id().alias("asked"), named.alias("named"), F.col("query").cast(kind).alias("vector")).where(sound)
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.size("vector").alias("dim"), F.lit(True).alias("is_query"),
                         F.lit(None).cast(id_type).alias("vec_id"), "asked", "named", "vector")
    dealt = own.unionByName(asked).repartitionById(chunks, "chunk").sortWithinPartitions("dim", "is_query", "vec_id").drop("chunk")
    schema = StructType([StructField("asked", LongType()), StructField("named", name_type), StructField("vec_id", id_type), StructField("score", DoubleType())])
    scored = dealt.mapInArrow(_best_of_chunk(limit, ["asked", "named"]), schema).withColumn("score", F.round("score", 6)).where("score > 0")
    each = Window.partitionBy("asked")
    rows = scored.withColumn("rank", F.row_number().over(each.orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= limit)
    rows = rows.withColumn("best", F.max("score").over(each)).where(F.col("score") >= floor * F.col("best"))
    return rows.select(*(["named.*"] if keys else []), "vec_id", "score", "rank")


def coverage(eligible: DataFrame, embedding: DataFrame) -> DataFrame:
    """Eligible rows and, for each model, how many have a vector and which share that is."""
    total = eligible.agg(F.count("*").alias("eligible"))
    have = embedding.join(eligible, "session_id", "left_semi").groupBy("model").agg(F.count("*").alias("embedded"))
    return have.crossJoin(F.broadcast(total)).select("model", "eligible", "embedded", F.round(F.col("embedded") / F.col("eligible"), 6).alias("share"))


def active_model(counts: DataFrame, configured: str, enough: float = 0.98) -> DataFrame:
    """The model to search with: the configured one if it covers enough, else another one that covers more."""
    own = F.max(F.when(F.col("model") == configured, F.col("embedded")))
    best = F.max_by(F.when(F.col("model") != configured, F.col("model")), F.when(F.col("model") != configured, F.struct("embedded", "model")))
    most = F.max(F.when(F.col("model") != configured, F.col("embedded")))
    row = counts.agg(own.alias("own"), best.alias("other"), most.alias("other_count"), F.max("eligible").alias("eligible"))
    good = (F.col("own") > 0) & (F.col("own") >= enough * F.col("eligible"))
    more = F.coalesce(F.col("other_count"), F.lit(0)) > F.coalesce(F.col("own"), F.lit(0))
    return row.select(F.when(good, F.lit(configured)).when(more, F.col("other")).when(F.col("own") > 0, F.lit(configured)).alias("model"))


def reciprocal_rank_fusion(keyword: DataFrame, semantic: DataFrame, limit: int = 50, key: str | None = None, asked: DataFrame | None = None) -> DataFrame:
    """keyword: id, group, rank; semantic: group, rank, representative; both with the query that they answer, if ``key``
    names its column: each query then has its own votes and up to ``limit`` hits. With ``asked``, the queries (``key``),
    keyword has no such column and its hits are those of all queries.

    A group found by meaning votes for each of its keyword hits, or else for its representative.
    """
    vote = lambda rank: 1.0 / (RRF_K + F.col(rank))
    keys = [key] if key else []
    own = keys if asked is None else []  # of keyword
    by_word = keyword.select(*own, "id", "group", F.col("rank").alias("word_rank"))
    by_meaning = semantic.where(F.col("rank") <= SEMANTIC_DEPTH).select(*keys, "group", F.col("rank").alias("meaning_rank"), "representative")
    if asked is None:
        both = by_word.join(by_meaning, [*keys, "group"], "left")
    else:
        # hits of groups that a query finds by meaning, and of the others only those that can come among its first: a hit
        # without a vote by meaning stands behind all hits whose words rank better, so it is among the first ``limit`` of these
        head = by_word.orderBy("word_rank", "id").limit(limit)
        alike = by_word.join(by_meaning, "group").select(key, "group", "id", "word_rank", "meaning_rank")
        rest = asked.select(key).crossJoin(F.broadcast(head)).join(by_meaning.select(key, "group"), [key, "group"], "left_anti")
        both = alike.unionByName(rest.select(key, "group", "id", "word_rank", F.lit(None).cast("int").alias("meaning_rank")))
    hits = both.select(*keys, "id", "word_rank", "meaning_rank", (vote("word_rank") + F.coalesce(vote("meaning_rank"), F.lit(0.0))).alias("score"))
    alone = by_meaning.join(by_word.select(*own, "group").distinct(), [*own, "group"], "left_anti")
    alone = alone.join(by_word.select(*own, F.col("id").alias("representative")), [*own, "representative"], "left_anti")
    alone = alone.select(*keys, F.col("representative").alias("id"), F.lit(None).cast("int").alias("word_rank"), "meaning_rank", vote("meaning_rank").alias("score"))
    found = F.when(F.col("word_rank").isNull(), "meaning").when(F.col("meaning_rank").isNull(), "keyword").otherwise("both")
    rows = hits.unionByName(alone).select(*keys, "id", F.round("score", 9).alias("score"), found.alias("found_by"), "word_rank", "meaning_rank")
    order = [F.desc("score"), F.asc_nulls_last("word_rank"), F.asc_nulls_last("meaning_rank"), F.col("id")]
    if key is None:
        return rows.orderBy(*order).limit(limit).select("id", "score", "found_by")
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= limit).select(key, "id", "score", "found_by")


def representative(members: DataFrame, words: list[str], key: str) -> DataFrame:
    """A group's message with the most query words of three letters or more, then the longest, then the first."""
    hits = sum((F.when(F.contains(F.lower("plaintext"), F.lit(w.lower())), 1).otherwise(0) for w in words if len(w) >= 3), F.lit(0))
    rank = F.struct(hits.alias("hits"), F.length("plaintext").alias("length"), (-F.col("id")).alias("first"))
    return members.groupBy(key).agg(F.max_by("id", rank).alias("message_id"))  # combined before it travels


def hybrid(keyword: DataFrame, nearest: DataFrame, members: DataFrame, words: list[str], provenance: str | None = None, limit: int = 50) -> DataFrame:
    """Hits of a search by words and of one by meaning in one order.

    keyword: id, rank, session_id; nearest: session_id, rank; members: id, session_id, plaintext. Where a search asks for
    another provenance than messages, meaning has no say.
    """
    by_word = keyword.select("id", F.col("session_id").alias("group"), "rank")
    if provenance not in (None, "message"):
        nearest = nearest.where(F.lit(False))
    best = representative(members.join(nearest.select("session_id"), "session_id", "left_semi"), words, "session_id")
    semantic = nearest.join(best, "session_id").select(F.col("session_id").alias("group"), "rank", F.col("message_id").alias("representative"))
    return reciprocal_rank_fusion(by_word, semantic, limit)


def pending(session: DataFrame, embedding: DataFrame, version: str) -> DataFrame:
    """Sessions whose vector is missing or was made of other members or by another version.

    session: session_id, thread_id, member_hash, ended_at_unix; embedding: session_id, input_hash.
    """
    wanted = session.withColumn("input_hash", F.concat_ws("|", "member_hash", F.lit(version)))
    return wanted.join(embedding.select("session_id", "input_hash"), ["session_id", "input_hash"], "left_anti").select(session.columns)


def threads_pending(pending_sessions: DataFrame) -> DataFrame:
    """Threads with pending sessions, the hash of those and when the last one ended."""
    parts = F.sort_array(F.collect_list(F.concat_ws(":", "session_id", "member_hash")))
    rows = pending_sessions.groupBy("thread_id").agg(F.sha2(F.array_join(parts, "\n"), 256).alias("input_hash"), F.max("ended_at_unix").alias("last_unix"))
    return rows.select("thread_id", "input_hash", "last_unix")


def clear_unused(embedding: DataFrame, configured: str, active: str | None) -> DataFrame:
    """What stays when vectors of models that are neither configured nor active go."""
    return embedding.where(F.col("model").isin([m for m in (configured, active) if m is not None]))
