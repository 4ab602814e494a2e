"""Exact metric range join for near-duplicate vectors (operator 9).

Vectors of a label are points of the unit sphere, where cosine >= c means a distance of at most r = sqrt(2 - 2c).
Pivots, some vectors of the label, partition them into cells: a vector is at home with its nearest pivot p. By the
triangle inequality a vector y within r of some x at home with q has d(y, q) - d(y, p) <= 2 r; as distances are Euclidean,
y is also no farther than r from the half-space of points nearer to q than to p, so that
d(y, q)^2 - d(y, p)^2 <= 2 r d(p, q), which is tighter. So y also visits all cells q for which both hold, and no others. Each cell then joins its own vectors with all that are there,
independently of other cells; cells larger than a task's share are split into pairs of chunks. Equal vectors count
once, with their number. Results are counts and one edge for each vector and local component, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, connected_components, table

#: Vectors for one pivot, the most pivots of a label (about), vectors of a chunk of a cell, and rows of an assigning task.
PER_PIVOT, MOST_PIVOTS, CHUNK_VECTORS, ASSIGN_ROWS = 1500, 64, 2048, 20_000
#: What the bounds leave for rounding.
SLACK = 1e-9


def unit(rows: list[list[float]]) -> np.ndarray:
    """The rows as unit vectors in double precision."""
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def is_sound(vector: Column) -> Column:
    """Neither null nor zero, and all components finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], column: str = "") -> Iterator[tuple[tuple, pa.Table]]:
    """Whole groups of sorted rows, one after the other."""
    held: list[pa.RecordBatch] = []
    key: tuple | None = None
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in keys]
        rows = list(zip(*columns, strict=True))
        begin = 0
        for k in range(batch.num_rows + 1):
            if k == batch.num_rows or rows[k] != key:
                if k > begin:
                    held.append(batch.slice(begin, k - begin))
                begin = k
                if k < batch.num_rows:
                    if held:
                        yield key, pa.Table.from_batches(held)
                    held, key = [], rows[k]
    if held:
        yield key, pa.Table.from_batches(held)


def _assign(threshold: float):
    """Rows of a part of a label, pivots (kind 0) first: each vector at home and where else it visits."""
    radius = np.sqrt(2 - 2 * threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (label, dim, _), rows in _runs(batches, ["label", "dim", "part"]):
            kind = rows.column("kind").to_numpy()
            pivots = unit(rows.filter(pa.array(kind == 0)).column("vector").to_pylist())
            between = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
            rest = rows.filter(pa.array(kind == 1))
            for begin in range(0, rest.num_rows, 4096):
                part = rest.slice(begin, 4096).combine_chunks()
                x = unit(part.column("vector").to_pylist())
                far = np.sqrt(np.maximum(0, 2 - 2 * x @ pivots.T))
                home = far.argmin(axis=1)
                least = far.min(axis=1)[:, None]
                at, cell = np.nonzero((far - least <= 2 * radius + SLACK) & (far * far - least * least <= 2 * radius * between[home] + SLACK))
                out = part.take(pa.array(at))
                columns = [pa.array(np.full(len(at), label)), pa.array(np.full(len(at), dim)), pa.array(cell), pa.array(home[at] == cell)]
                batch = pa.Table.from_arrays([*columns, out.column("rep"), out.column("weight"), out.column("vector")], names=["label", "dim", "cell", "home", "rep", "weight", "vector"])
                yield from batch.to_batches()

    return run


def _join_cell(threshold: float):
    """Chunks of a cell, home vectors against visitors and one another: partial counts and local edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _runs(batches, ["label", "dim", "cell", "i", "j"]):
            asks = rows.column("asks").to_numpy()
            rep, weight = rows.column("rep").to_numpy(), rows.column("weight").to_numpy()
            x = unit(rows.column("vector").to_pylist())
            ask, other = np.flatnonzero(asks), np.flatnonzero(~asks)
            counts = np.zeros(len(ask), np.int64)
            ids, local = np.unique(rep, return_inverse=True)
            component = np.arange(len(ids))
            for begin in range(0, len(ask), 256):
                mine = ask[begin : begin + 256]
                near = (x[mine] @ x[other].T >= threshold) & (local[mine][:, None] != local[other][None, :])
                counts[begin : begin + len(mine)] = near @ weight[other]
                for k in np.flatnonzero(near.any(axis=1)).tolist():
                    now = component[np.append(local[other[near[k]]], local[mine[k]])]
                    least = now.min()
                    for joined in np.unique(now[now != least]).tolist():
                        component[component == joined] = least
            linked = np.flatnonzero(component != np.arange(len(ids)))
            edges = list(zip(ids[linked].tolist(), ids[component[linked]].tolist(), strict=True))
            some = np.flatnonzero(counts)
            u = [*rep[ask[some]].tolist(), *(a for a, _ in edges)]
            v = [*([None] * len(some)), *(b for _, b in edges)]
            n = [*counts[some].tolist(), *([0] * len(edges))]
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(n, pa.int64())], names=["u", "v", "n"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of ``vectors`` (vec_id, embedding, label).

    A null, empty or zero vector, one with null or non-finite components, and one without a label or without a vec_id
    links with nothing; the last is kept and has no component. Vectors of different lengths do not link. Equal vectors
    link; repeated rows count as vectors of their own. Other columns are left out; an empty table gives no rows.
    """
    label = F.when(F.col("vec_id").isNotNull(), F.col("label").cast("long"))
    rows = vectors.select(F.col("vec_id").cast("long"), label.alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    sound = rows.where(F.col("label").isNotNull() & is_sound(F.col("vector")))
    same = sound.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    same = checkpoint(same.withColumn("dim", F.size("vector").cast("long")))

    labels = same.groupBy("label", "dim").agg(F.count("*").alias("n"), F.min("rep").alias("least"))
    wanted = F.least(F.lit(MOST_PIVOTS), F.ceil(F.col("n") / PER_PIVOT))
    labels = labels.select("label", "dim", "least", F.ceil(F.col("n") / wanted).alias("stride"), F.ceil(F.col("n") / ASSIGN_ROWS).alias("parts"))
    dealt = same.join(labels, ["label", "dim"])
    turn = F.xxhash64("rep")
    pivots = dealt.where((F.pmod(turn, F.col("stride")) == 0) | (F.col("rep") == F.col("least")))
    columns = ["label", "dim", "part", "kind", "rep", "weight", "vector"]
    pivots = pivots.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("kind", F.lit(0)).select(columns)
    rest = dealt.withColumn("part", F.pmod(turn, F.col("parts"))).withColumn("kind", F.lit(1)).select(columns)
    ordered = pivots.unionByName(rest).repartition("label", "dim", "part").sortWithinPartitions("label", "dim", "part", "kind", "rep")
    placed = checkpoint(ordered.mapInArrow(_assign(threshold), "label long, dim long, cell long, home boolean, rep long, weight long, vector array<double>"))

    cells = placed.groupBy("label", "dim", "cell").agg(F.count_if("home").alias("homes"), F.count("*").alias("all"))
    cells = cells.select("label", "dim", "cell", *(F.ceil(F.col(c) / CHUNK_VECTORS).alias(k) for c, k in (("homes", "rows_of"), ("all", "columns_of"))))
    split = placed.join(cells, ["label", "dim", "cell"])
    chunk = lambda of: F.pmod(F.xxhash64("rep"), F.col(of))
    each = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    key = ["label", "dim", "cell"]
    asking = split.where("home").select(*key, chunk("rows_of").alias("i"), each("columns_of").alias("j"), F.lit(True).alias("asks"), "rep", "weight", "vector")
    asked = split.where("rows_of > 0").select(*key, each("rows_of").alias("i"), chunk("columns_of").alias("j"), F.lit(False).alias("asks"), "rep", "weight", "vector")
    pairs = asking.unionByName(asked).repartition(*key, "i", "j").sortWithinPartitions(*key, "i", "j")
    found = checkpoint(pairs.mapInArrow(_join_cell(threshold), "u long, v long, n long"))

    counts = found.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("others"))
    components = connected_components(found.where("v is not null")).withColumnRenamed("node", "rep")
    classes = same.join(counts, "rep", "left").join(components, "rep", "left")
    classes = classes.select("label", "vector", "rep", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    own = rows.join(classes, ["label", "vector"], "left")
    component = F.coalesce("component_id", "vec_id")
    return own.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op9_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([c for c in embedding if c IS NULL OR isnan(c) OR isinf(c)]) = 0 AND len([c for c in embedding if c <> 0]) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
reach(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
c AS (SELECT u, min(v) AS least FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS n_links FROM links GROUP BY u)
SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.least, e.vec_id)) AS component_id,
       e.vec_id IS NOT DISTINCT FROM least(e.vec_id, coalesce(c.least, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN c ON c.u = e.vec_id LEFT JOIN n ON n.u = e.vec_id
"""
