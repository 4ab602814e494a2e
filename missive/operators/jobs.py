"""The work queue and the log of model calls, as pure rewrites of their tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_ATTEMPTS, LEASE, LOG_ROWS, DAY = 3, 900, 5000, 86400


def enqueue(queue: DataFrame, wanted: DataFrame) -> DataFrame:
    """The queue after an upsert: a job is pending again, its attempts 0 and its lease (lease_unix, if there is one) gone, only
    where its input changed (nulls compare). One that runs on the same input keeps its lease: to lose it would have the job
    reclaimed, and run twice."""
    new = wanted.select("kind", "subject_id", F.col("input_hash").alias("new_hash"), F.col("priority").alias("new_priority"), F.lit(True).alias("asked"))
    rows = queue.join(new, ["kind", "subject_id"], "full")
    changed = F.col("asked").isNotNull() & (F.col("state").isNull() | ~F.col("input_hash").eqNullSafe(F.col("new_hash")))
    return rows.select(
        "kind", "subject_id",
        F.when(changed, F.lit("pending")).otherwise(F.col("state")).alias("state"),
        F.when(changed, F.lit(0).cast("long")).otherwise(F.col("attempts")).alias("attempts"),
        F.when(F.col("asked"), F.col("new_hash")).otherwise(F.col("input_hash")).alias("input_hash"),
        F.coalesce("new_priority", "priority").alias("priority"),
        *([F.when(~changed, F.col("lease_unix")).alias("lease_unix")] if "lease_unix" in queue.columns else []),
    )


def claim(queue: DataFrame, withheld: list[str], now: int, limit: int = 1) -> DataFrame:
    """The next pending jobs as they are once claimed."""
    rows = queue.where(F.col("state") == "pending").where(~F.col("kind").isin(withheld))
    rows = rows.orderBy(F.desc("priority"), "id").limit(limit)
    return rows.select("id", "kind", F.lit("running").alias("state"), (F.col("attempts") + 1).alias("attempts"), F.lit(now + LEASE).cast("long").alias("lease_unix"))


def complete(queue: DataFrame, done: DataFrame) -> DataFrame:
    """The queue with some jobs finished, or left for somebody to look at. done: id, needs_review."""
    rows = queue.join(done.select("id", "needs_review"), "id", "left")
    finished = F.col("needs_review").isNotNull()
    state = F.when(F.col("needs_review"), "needs_review").when(finished, "done").otherwise(F.col("state"))
    rows = rows.withColumn("state", state).withColumn("lease_unix", F.when(~finished, F.col("lease_unix")))
    return rows.select(queue.columns)


def retry(queue: DataFrame) -> DataFrame:
    """The queue with every failed job pending again, with all its attempts."""
    failed = F.col("state") == "failed"
    rows = queue.withColumn("attempts", F.when(failed, F.lit(0)).otherwise(F.col("attempts")).cast("long")).withColumn("lease_unix", F.when(~failed, F.col("lease_unix")))
    return rows.withColumn("state", F.when(failed, "pending").otherwise(F.col("state")))


def clear(queue: DataFrame) -> DataFrame:
    """An empty queue."""
    return queue.where(F.lit(False))


def priority(unix: str) -> Column:
    """Whole days: the newest is done first."""
    return F.expr(f"{unix} div {DAY}")


def fail(queue: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Running jobs after a failure: tried again until they have had all their attempts."""
    return queue.where("state = 'running'").select("id", F.when(F.col("attempts") >= max_attempts, "failed").otherwise("pending").alias("state"))


def reclaim(queue: DataFrame, now: int) -> DataFrame:
    """Running jobs whose lease is gone or past are pending again."""
    gone = (F.col("state") == "running") & (F.col("lease_unix").isNull() | (F.col("lease_unix") < now))
    return queue.select("id", F.when(gone, "pending").otherwise(F.col("state")).alias("state"), F.when(~gone, F.col("lease_unix")).alias("lease_unix"))


def counts(queue: DataFrame) -> DataFrame:
    """Jobs of each kind by state; any other state needs a look."""
    known = ("pending", "running", "done", "failed")
    return queue.groupBy("kind").agg(*[F.count_if(F.col("state") == s).alias(s) for s in known], F.count_if(~F.col("state").isin(*known)).alias("needs_review"))


def interaction_totals(log: DataFrame) -> DataFrame:
    """Calls of each model and purpose with the lower median of their durations."""
    median = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY duration_ms)").cast("long")
    return log.groupBy("model", "purpose").agg(F.count("*").alias("calls"), F.count_if("failed").alias("failures"), F.sum("total_tokens").alias("tokens"), median.alias("median_ms"))


def failure_kinds(log: DataFrame, limit: int = 8) -> DataFrame:
    rows = log.where("failed").groupBy(F.coalesce("failure_kind", F.lit("unknown")).alias("kind")).agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "kind").limit(limit)


def tokens_since(log: DataFrame, now: int, budget: int) -> DataFrame:
    """Tokens of the last day, and whether a budget above 0 is used up."""
    spent = log.where(F.col("created_unix") >= now - DAY).agg(F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("spent"))
    return spent.withColumn("reached", (F.lit(budget) > 0) & (F.col("spent") >= budget))


def prune(log: DataFrame, now: int, keep: int = LOG_ROWS) -> DataFrame:
    """The newest rows and everything of the last day."""
    newest = log.select("id").orderBy(F.desc("id")).limit(keep).agg(F.min("id").alias("from_id"))
    return log.crossJoin(F.broadcast(newest)).where((F.col("id") >= F.col("from_id")) | (F.col("created_unix") >= now - DAY)).select("id", "created_unix")


def next_per_kind(queue: DataFrame, each: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("priority"), "id"))
    return queue.where("state = 'pending'").withColumn("place", place).where(F.col("place") <= each).select("kind", "id", F.col("place").cast("long").alias("place"))


def cursors(state: DataFrame) -> DataFrame:
    """The latest cursor of each (source_id, scope). state: also id (order of writing) and cursor."""
    return state.groupBy("source_id", "scope").agg(F.max_by("cursor", "id").alias("cursor"))


def revive(queue: DataFrame, kind: str, artifact: DataFrame) -> DataFrame:
    """Done jobs of a kind whose artifact (subject_id) is gone are pending again, with all their attempts."""
    there = artifact.select("subject_id", F.lit(True).alias("there")).distinct()
    rows = queue.join(there, "subject_id", "left")
    again = (F.col("kind") == kind) & (F.col("state") == "done") & F.col("there").isNull()
    return rows.withColumn("attempts", F.when(again, 0).otherwise(F.col("attempts")).cast("long")).withColumn("state", F.when(again, "pending").otherwise(F.col("state"))).drop("there")


def exclude(table: DataFrame, ids: list[str], excluded: bool = True) -> DataFrame:
    """Threads or people (id, ai_excluded) with the flag of some of them set or taken back."""
    return table.withColumn("ai_excluded", F.when(F.col("id").isin(ids), F.lit(excluded)).otherwise(F.col("ai_excluded")))


def forget(derived: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """How many rows of each derived table go, and the tables without them."""
    sizes = [t.agg(F.lit(name).alias("name"), F.count("*").alias("rows")) for name, t in derived.items()]
    total = sizes[0]
    for size in sizes[1:]:
        total = total.unionByName(size)
    return total, {name: t.where(F.lit(False)) for name, t in derived.items()}
