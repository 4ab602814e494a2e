"""Mixing sources to target weights by systematic sampling (operator 5), native.

Each document of a source is expected as often as its source's target asks, target / size of the source. The prefix
sums of these expected copies, moved by one random offset for each source, are cut at the integers, and a document is
taken once for each integer that its own part crosses. Documents of a source lie in the order of their sizes, so that
the words taken differ from the target by less than the source's largest document, whatever the offset. The offset is
drawn a few times, and the draw whose words come nearest to the target counts.

No task holds a source: documents are range-partitioned by source, size and doc_id. Ranks are the rows' places in their
partitions, behind what the partitions before hold; what is taken doesn't depend on how many there are. Only the list of
sources itself (a row each) is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, table

#: Rows of a partition, about, and draws of a source's offset.
BLOCK_ROWS, DRAWS = 1 << 20, 16
WORDS = r"[^\x20\x09-\x0D]+"


def source_key(source: Column) -> Column:
    """A key that is never null; null sources come last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """key, source_size, target of each row of ``sizes`` (key, source_size).

    The sources, in the order of their keys, weigh as ``weights`` say, repeating. Together they get ``share`` of all
    sizes, by weight, but none more than ``most`` times its size: what exceeds that is shared among the others by
    weight until none exceeds it. That ends at one level of target a weight, below which no source is cut.
    """
    order = Window.orderBy("key")
    place = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    rows = sizes.select("key", "source_size", weight.alias("weight"), cap.alias("cap"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    cut = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - cut) / left
    rows = rows.withColumn("level", level)
    chosen = F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(everything)
    target = F.least(F.col("cap"), F.col("weight") * F.col("chosen"))
    return rows.withColumn("chosen", chosen).select("key", "source_size", target.alias("target"))


def offset(key: Column, seed: int, draw: int) -> Column:
    """A random offset of a source, from 0 to less than 1, the same in every run."""
    digits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{seed}|{draw}")).cast("binary")), 1, 8), 16, 10)
    return digits.cast("double") / F.lit(float(1 << 32))


def crossed(offset: Column, rate: Column, rank: Column) -> Column:
    """Integers that the part of the prefix sums at a rank crosses."""
    return (F.floor(offset + rate * rank) - F.floor(offset + rate * (rank - 1))).cast("long")


def mixed(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7
) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken of each row of ``docs`` (doc_id, text, source).

    Size is the words of the text; a null or empty text has none and takes none. A null source is a source of its own,
    after all others. A source without words has the target 0. Repeated rows are documents of their own; an empty table
    gives no rows; other columns are left out.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long"), source_key(F.col("source").cast("string")).alias("key"), size.alias("size"))
    rows = checkpoint(rows.withColumn("row", F.monotonically_increasing_id()))
    order = [F.col("key"), F.col("size"), F.col("doc_id").asc_nulls_last(), F.col("row")]
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // BLOCK_ROWS))
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # of a row in its partition
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = checkpoint(rows.select("doc_id", "key", "size", F.spark_partition_id().alias("part"), place.alias("place")))
    counts = rows.groupBy("key", "part").agg(F.count("*").alias("n"), F.sum("size").alias("part_size"), F.min("place").alias("first"))
    goals = targets(counts.groupBy("key").agg(F.sum("part_size").alias("source_size")), weights, share, most)
    ahead = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    behind = F.coalesce(F.sum("n").over(ahead), F.lit(0)) - F.col("first") + 1
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    draws = [f"draw{k}" for k in range(DRAWS)]
    blocks = counts.withColumn("behind", behind).join(goals, "key").withColumn("rate", rate)
    drawn = blocks.select("key", "part", "behind", "rate", *[offset(F.col("key"), seed, k).alias(draw) for k, draw in enumerate(draws)])
    rank = F.col("place") + F.col("behind")
    sums = rows.join(drawn, ["key", "part"]).groupBy("key").agg(*[F.sum(crossed(F.col(draw), F.col("rate"), rank) * F.col("size")).alias(draw) for draw in draws])
    miss = [F.struct(F.abs(F.col(draw) - F.col("target")).alias("miss"), F.lit(k).alias("draw"), offset(F.col("key"), seed, k).alias("offset")) for k, draw in enumerate(draws)]
    best = sums.join(goals, "key").select("key", F.array_min(F.array(*miss))["offset"].alias("offset"))
    chosen = blocks.join(best, "key").select("key", "part", "behind", "rate", "offset", "source_size", "target")
    placed = rows.join(chosen, ["key", "part"]).withColumn("rank", rank)
    placed = placed.withColumn("copies", crossed(F.col("offset"), F.col("rate"), F.col("rank")))
    return placed.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` (all columns; doc_id is a key), each as often as the mix takes it.

    Rows of one doc_id all come as often as the one of them that the mix takes most.
    """
    taken = mixed(docs, **parameters).where("copies > 0").select(F.col("doc_id").alias("mixed_id"), "copies")
    wanted = taken.groupBy("mixed_id").agg(F.max("copies").alias("copies"))
    both = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["mixed_id"]))
    copy, known = "copy", {c.lower() for c in docs.columns}
    while copy in known:
        copy += "_"
    each = F.explode(F.sequence(F.lit(1).cast("long"), wanted["copies"])).alias(copy)
    return both.select(*[docs[c] for c in docs.columns], each).drop(copy)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (
  SELECT key, sum(size)::BIGINT AS source_size FROM d GROUP BY key),
w AS (
  SELECT key, source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY key) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
         source_size::DOUBLE * 2.0::DOUBLE AS cap FROM s),
l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
     - coalesce(sum(cap) OVER (ORDER BY cap / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
     / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) AS level
  FROM w),
g AS (
  SELECT key, source_size, least(cap, weight * max(CASE WHEN level <= cap / weight THEN level END) OVER ()) AS target FROM l),
r AS (
  SELECT d.doc_id, d.size, d.key, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0::DOUBLE END AS rate,
         row_number() OVER (PARTITION BY d.key ORDER BY d.size, d.doc_id) AS rank
  FROM d JOIN g ON d.key = g.key),
u AS (
  SELECT key, target, k, ('0x' || substr(md5(key || '|7|' || k), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM g, range(16) x(k)),
m AS (
  SELECT u.key, u.k, u.u, abs(sum((floor(u + rate * rank) - floor(u + rate * (rank - 1)))::BIGINT * size)::BIGINT::DOUBLE - any_value(u.target)) AS miss
  FROM r JOIN u ON r.key = u.key GROUP BY u.key, u.k, u.u),
b AS (
  SELECT key, arg_min(u, (miss, k)) AS u FROM m GROUP BY key),
c AS (
  SELECT r.*, (floor(u + rate * rank) - floor(u + rate * (rank - 1)))::BIGINT AS copies FROM r JOIN b ON r.key = b.key)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM c
"""
