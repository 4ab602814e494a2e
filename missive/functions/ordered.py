"""What is ahead of a row in its thread, without a task that holds a thread: rows are ordered by thread and day, and days
are put in order by their bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86400
_KEYS = ("thread_id", "day_")


def gaps(message: DataFrame, begins: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, days): rows of ``message`` (thread_id, sent_at_unix, id, ...) by day with ``gap_`` (seconds since the row ahead
    of it in its day, null for the first), ``first_`` (whether it is that), ``marks_`` (rows of the day up to it, but for the
    first, for which ``begins``, a condition on gap_, holds); days with ``gap_`` (seconds between the day's first row and the
    last one of the day ahead, null for a thread's first) and ``ahead_``, the marks of all days ahead of it.
    """
    order = Window.partitionBy(*_KEYS).orderBy("sent_at_unix", "id")
    rows = message.withColumn("day_", F.expr(f"sent_at_unix div {DAY}"))
    rows = rows.withColumn("first_", F.row_number().over(order) == 1).withColumn("gap_", F.col("sent_at_unix") - F.lag("sent_at_unix").over(order))
    mark = F.lit(0) if begins is None else F.when(F.col("first_"), 0).otherwise(F.coalesce(begins.cast("int"), F.lit(1)))
    rows = rows.withColumn("marks_", F.sum(mark).over(order))
    days = rows.groupBy(*_KEYS).agg(F.min("sent_at_unix").alias("begin_"), F.max("sent_at_unix").alias("end_"), F.max("marks_").alias("inner_"))
    by_day = Window.partitionBy("thread_id").orderBy("day_")  # a row a day
    days = days.withColumn("gap_", F.col("begin_") - F.lag("end_").over(by_day))
    own = F.col("inner_") if begins is None else F.col("inner_") + F.coalesce(begins.cast("int"), F.lit(1))
    ahead = F.coalesce(F.sum(own).over(by_day.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows, days.withColumn("ahead_", ahead).select(*_KEYS, "gap_", "ahead_")


def with_days(rows: DataFrame, days: DataFrame) -> DataFrame:
    """Rows with what ``gaps`` says of their day: day_gap_ and ahead_."""
    of = days.select(F.col("thread_id").alias("thread_"), F.col("day_").alias("of_"), F.col("gap_").alias("day_gap_"), "ahead_")
    return rows.join(of, rows["thread_id"].eqNullSafe(of["thread_"]) & rows["day_"].eqNullSafe(of["of_"])).drop("thread_", "of_")
