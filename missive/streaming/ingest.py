"""Live ingestion: micro-batches of messages and deletions into a stored table, and sessions of a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

MESSAGE = "uid string, thread_id string, id long, sent_at_unix long, plaintext string, event string"
#: Kinds of chats whose messages are numbered together, so that a deletion need not name its chat.
TOGETHER = ("user", "chat")


def stored(spark: SparkSession, target: str) -> DataFrame:
    """Messages of all committed batches, one for each uid: the latest body, and whether a deletion was seen."""
    return latest(spark.read.parquet(target))


def latest(rows: DataFrame) -> DataFrame:
    """The newest body of each uid: that of the last batch, and in it of the last place."""
    newest = F.max_by(F.struct("thread_id", "id", "sent_at_unix", "plaintext"), F.struct("batch", "position"))
    bodies = rows.where("event = 'message'").groupBy("uid").agg(newest.alias("m"))
    gone = rows.where("event = 'deletion'").select("uid").distinct().withColumn("deleted", F.lit(True))
    return bodies.join(gone, "uid", "left").select("uid", "m.*", F.coalesce("deleted", F.lit(False)).alias("deleted"))


def compact(spark: SparkSession, target: str, compacted: str) -> None:
    """What is stored as one batch, so that readers need not go over the history: bodies, and deletions of their own."""
    rows = stored(spark, target).withColumn("position", F.lit(0).cast("long"))
    bodies = rows.withColumn("event", F.lit("message")).drop("deleted")
    gone = rows.where("deleted").withColumn("event", F.lit("deletion")).drop("deleted")
    bodies.unionByName(gone).write.mode("overwrite").parquet(f"{compacted}/batch=0")


def resolve_deletions(deletions: DataFrame, message: DataFrame, chats: DataFrame) -> DataFrame:
    """uid of the messages that deletions (thread_id, id) mean.

    One that names no chat means the message with its number in the first of the included chats that are numbered together.
    chats: thread_id, peer_kind, decision, place; message: uid, thread_id, id. Unknown messages are passed over.
    """
    named = deletions.where("thread_id IS NOT NULL").join(message.select("uid", "thread_id", "id"), ["thread_id", "id"]).select("uid")
    among = chats.where(F.col("peer_kind").isin(*TOGETHER) & (F.col("decision") == "include")).select("thread_id", "place")
    loose = deletions.where("thread_id IS NULL").select("id").distinct().join(message.select("uid", "thread_id", "id"), "id").join(among, "thread_id")
    first = loose.groupBy("id").agg(F.min_by("uid", F.struct("place", "thread_id")).alias("uid")).select("uid")
    return named.unionByName(first).distinct()


def commit_batch(target: str, included: DataFrame | Callable[[], DataFrame] | None = None):
    """A sink that writes each batch once into a folder of its own; a batch that is run again replaces it.

    ``included`` (thread_id) names the chats to keep; a function is asked anew for each batch, so a chat that is added or
    dropped while the stream runs counts from the next batch on. Deletions apply after the batch's messages, whatever
    their order, as ``latest`` reads them.
    """

    def write(rows: DataFrame, batch: int) -> None:
        if included is not None:
            rows = rows.join(included() if callable(included) else included, "thread_id", "left_semi")
        rows = rows.withColumn("position", F.monotonically_increasing_id())
        rows = rows.groupBy("uid", "thread_id", "id", "sent_at_unix", "plaintext", "event").agg(F.max("position").alias("position"))
        rows.write.mode("overwrite").parquet(f"{target}/batch={batch}")

    return write


def follow(
    spark: SparkSession, folder: str, target: str, checkpoint: str, included: DataFrame | Callable[[], DataFrame] | None = None,
    per_trigger: int = 100, every: str | None = None,
) -> StreamingQuery:
    """Ingests what lies in a watched folder (JSON lines of MESSAGE): all there is, and ends, or with ``every`` ("2 seconds")
    what comes, until it is stopped. A further call goes on where it ended."""
    stream = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", per_trigger).json(folder)
    sink = stream.writeStream.foreachBatch(commit_batch(target, included)).option("checkpointLocation", checkpoint)
    return (sink.trigger(processingTime=every) if every else sink.trigger(availableNow=True)).start()


def stream_sessions(stream: DataFrame, gap_seconds: int = 4 * 3600, late: str = "1 day") -> DataFrame:
    """Sessions of a stream (thread_id, sent_at_unix). A session window keeps rows together that are exactly its gap
    apart, where a gap of ``gap_seconds`` must divide them; times are whole seconds, so its gap is one second less."""
    rows = stream.withColumn("at", F.timestamp_seconds("sent_at_unix")).withWatermark("at", late)
    window = F.session_window("at", f"{gap_seconds - 1} seconds")
    out = rows.groupBy("thread_id", window.alias("w")).agg(F.count("*").alias("message_count"), F.max("sent_at_unix").alias("ended_at_unix"))
    return out.select("thread_id", F.unix_seconds("w.start").alias("started_at_unix"), "ended_at_unix", "message_count")
