"""Read-side queries: summary, people, threads, pages, context, sources, synchronised chats.

Every order ends in an id, so pages and cursors are exact where timestamps tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import gaps, with_days
from .ingest import canonical_json

DIRECT = ("dm", "saved")
ORDER = ("sent_at_unix", "id")
#: Seconds of silence that divide a conversation: 30 days.
SILENCE = 30 * 86400


def save_summary(message: DataFrame, thread: DataFrame, identity: DataFrame, person: DataFrame, source: DataFrame, media: DataFrame, import_run: DataFrame) -> DataFrame:
    """One row of seven counts, the owner's name, and when the last completed run ended."""
    counted = ((message, "messages"), (thread, "threads"), (person, "people"), (source, "sources"), (media, "media"))
    parts = [t.agg(F.count("*").alias(n)) for t, n in counted]
    parts.append(identity.agg(F.count("*").alias("identities"), F.count_if("is_synthetic").alias("synthetic")))
    parts.append(person.where("is_owner").agg(F.min("display_name").alias("owner_name")))
    parts.append(import_run.where("status = 'completed'").agg(F.max("finished_unix").alias("last_finished")))
    out = parts[0]
    for one in parts[1:]:
        out = out.crossJoin(one)  # one row each
    return out.select("messages", "threads", "people", "identities", "synthetic", "sources", "media", "owner_name", "last_finished")


def people(person: DataFrame, identity: DataFrame, identity_person: DataFrame, message: DataFrame, search: str | None = None) -> DataFrame:
    """People with their numbers of identities and messages; ``search`` is looked for in their names, whatever its case."""
    sent = message.groupBy("sender_identity_id").agg(F.count("*").alias("n"))
    own = identity_person.join(sent, F.col("identity_id") == F.col("sender_identity_id"), "left")
    per = own.groupBy("person_id").agg(F.count("*").alias("identity_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("message_count"))
    rows = person
    if search is not None:
        named = lambda c: F.contains(F.lower(c), F.lit(search.lower()))
        by_identity = identity_person.join(identity.where(named("display_name")), F.col("identity_id") == F.col("id"), "left_semi")
        hit = by_identity.select(F.col("person_id").alias("hit")).distinct()
        rows = person.join(hit, F.col("id") == F.col("hit"), "left").where(named("display_name") | F.col("hit").isNotNull())
    out = rows.join(per, F.col("id") == F.col("person_id"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("id", "display_name", "is_owner", zero("identity_count"), zero("message_count"))


def identities(identity: DataFrame, identity_person: DataFrame, message: DataFrame, synthetic_only: bool = False) -> DataFrame:
    sent = message.groupBy("sender_identity_id").agg(F.count("*").alias("message_count"))
    rows = identity.where("is_synthetic") if synthetic_only else identity
    rows = rows.join(identity_person, F.col("id") == F.col("identity_id"))
    rows = rows.join(sent, F.col("id") == F.col("sender_identity_id"), "left")
    return rows.select("id", "display_name", "platform", "handle", "is_synthetic", "person_id", F.coalesce("message_count", F.lit(0)).alias("message_count"))


def threads(thread: DataFrame, message: DataFrame, participant: DataFrame, identity: DataFrame, search: str | None = None) -> DataFrame:
    """Threads with counts, last message and the first three participants by name."""
    sent = message.groupBy("thread_id").agg(F.count("*").alias("message_count"), F.max("sent_at_unix").alias("last_unix"))
    named = participant.join(identity.select(F.col("id").alias("identity_id"), "display_name"), "identity_id")
    place = F.row_number().over(Window.partitionBy("thread_id").orderBy("display_name", "identity_id"))
    first = named.withColumn("place", place).groupBy("thread_id").agg(
        F.count("*").alias("participant_count"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("place") <= 3, F.struct("place", "display_name")))), lambda x: x["display_name"]), ", ").alias("preview"),
    )
    rows = thread if search is None else thread.where(F.contains(F.lower("title"), F.lit(search.lower())))
    rows = rows.join(sent, F.col("id") == sent["thread_id"], "left").drop("thread_id").join(first, F.col("id") == first["thread_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("id", "kind", "title", zero("message_count"), "last_unix", zero("participant_count"), F.coalesce("preview", F.lit("")).alias("preview"))


def thread_participants(participant: DataFrame, identity: DataFrame, identity_person: DataFrame, person: DataFrame, message: DataFrame) -> DataFrame:
    """Participants of each thread, under their person's name or else the identity's, with their messages in it."""
    sent = message.groupBy("thread_id", F.col("sender_identity_id").alias("identity_id")).agg(F.count("*").alias("message_count"))
    names = identity.select(F.col("id").alias("identity_id"), "display_name").join(identity_person, "identity_id", "left")
    names = names.join(person.select(F.col("id").alias("person_id"), F.col("display_name").alias("person_name"), "is_owner"), "person_id", "left")
    rows = participant.join(names, "identity_id", "left").join(sent, ["thread_id", "identity_id"], "left")
    name = F.coalesce("person_name", "display_name").alias("name")
    return rows.select("thread_id", "identity_id", "person_id", name, F.coalesce("is_owner", F.lit(False)).alias("is_owner"), F.coalesce("message_count", F.lit(0)).alias("message_count"))


def _beyond(cursor: tuple[int, int], forward: bool, inclusive: bool = False) -> Column:
    """Rows after (before) a cursor by (sent_at_unix, id)."""
    unix, row = (F.lit(x) for x in cursor)
    t, i = F.col("sent_at_unix"), F.col("id")
    strict = (t > unix) | ((t == unix) & (i > row)) if forward else (t < unix) | ((t == unix) & (i < row))
    return strict | ((t == unix) & (i == row)) if inclusive else strict


def _page(rows: DataFrame, limit: int, cursor: tuple[int, int] | None, forward: bool = False, inclusive: bool = False) -> DataFrame:
    if cursor is not None:
        rows = rows.where(_beyond(cursor, forward, inclusive))
    order = [F.col(c).asc() if forward else F.col(c).desc() for c in ORDER]
    return rows.orderBy(*order).limit(limit)


def thread_page(message: DataFrame, thread_id: str, limit: int = 50, cursor: tuple[int, int] | None = None) -> DataFrame:
    """A thread's newest messages, or the newest before a cursor. The last row is the next cursor if the page is full."""
    rows = message.where(F.col("thread_id") == thread_id)
    return _page(rows.select("id", "thread_id", "sender_identity_id", "sent_at_unix", "kind"), limit, cursor)


def direct_threads(thread: DataFrame, participant: DataFrame, identity_person: DataFrame) -> DataFrame:
    """(person_id, thread_id) of direct threads that one of a person's identities takes part in."""
    direct = thread.where(F.col("kind").isin(*DIRECT)).select(F.col("id").alias("thread_id"))
    return participant.join(direct, "thread_id", "left_semi").join(identity_person, "identity_id").select("person_id", "thread_id").distinct()


def person_page(
    message: DataFrame, thread: DataFrame, participant: DataFrame, identity_person: DataFrame, person_id: str,
    limit: int = 50, cursor: tuple[int, int] | None = None, forward: bool = False, inclusive: bool = False,
) -> DataFrame:
    """A person's conversation: all of their direct threads, and what they sent elsewhere."""
    mine = identity_person.where(F.col("person_id") == person_id)
    direct = direct_threads(thread, participant, mine).select("thread_id")
    columns = ["id", "thread_id", "sender_identity_id", "sent_at_unix"]
    both = message.join(direct, "thread_id", "left_semi").select(*columns, F.lit("dm").alias("origin"))
    sent = message.join(mine, F.col("sender_identity_id") == F.col("identity_id"), "left_semi").join(direct, "thread_id", "left_anti")
    rows = both.unionByName(sent.select(*columns, F.lit("group").alias("origin")))
    return _page(rows, limit, cursor, forward, inclusive)


def message_context(message: DataFrame, anchors: DataFrame, radius: int = 8) -> DataFrame:
    """For each anchor (id) the messages of its thread from ``radius`` before to ``radius`` after it."""
    own = message.join(anchors.select(F.col("id").alias("anchor_id")), F.col("id") == F.col("anchor_id"), "left_semi").select("thread_id").distinct()
    inside = Window.partitionBy("thread_id").orderBy(*ORDER)
    near = F.collect_list("id").over(inside.rowsBetween(-radius, radius))
    # how many stand before the anchor in its list
    ahead = F.least(F.row_number().over(inside) - 1, F.lit(radius))
    rows = message.join(own, "thread_id", "left_semi").select("id", "thread_id", near.alias("near"), ahead.alias("ahead"))
    at = rows.join(anchors.select(F.col("id").alias("anchor_id")), F.col("id") == F.col("anchor_id"))
    each = at.select("anchor_id", "thread_id", "ahead", F.posexplode("near").alias("at", "id"))
    return each.select("anchor_id", "id", "thread_id", (F.col("at") - F.col("ahead")).cast("long").alias("distance"))


def message_context_of(message: DataFrame, anchor_id: int, radius: int = 8) -> DataFrame:
    """The context of one message: its neighbours on either side are the first rows of two orders of its thread."""
    at = message.where(F.col("id") == anchor_id).select("thread_id", F.col("sent_at_unix").alias("unix"), F.col("id").alias("anchor_id")).limit(1)
    rows = message.select("id", "thread_id", "sent_at_unix").join(F.broadcast(at), "thread_id")  # one row
    here = F.struct("sent_at_unix", "id") >= F.struct("unix", "anchor_id")
    columns = ["anchor_id", "id", "thread_id", "sent_at_unix"]
    after = rows.where(here).orderBy("sent_at_unix", "id").limit(radius + 1).select(*columns)
    before = rows.where(~here).orderBy(F.desc("sent_at_unix"), F.desc("id")).limit(radius).select(*columns)
    forth, back = (F.row_number().over(Window.orderBy(*order)).cast("long") for order in (("sent_at_unix", "id"), (F.desc("sent_at_unix"), F.desc("id"))))  # 17 rows at most
    out = after.withColumn("distance", forth - 1).unionByName(before.withColumn("distance", -back))
    return out.select("anchor_id", "id", "thread_id", "distance")


def person_of(message: DataFrame, thread: DataFrame, participant: DataFrame, identity_person: DataFrame, person: DataFrame) -> DataFrame:
    """The person a message belongs with: in a direct thread the other one (the least if there are several), else the sender."""
    direct = thread.where(F.col("kind").isin(*DIRECT)).select(F.col("id").alias("thread_id"))
    others = participant.join(direct, "thread_id", "left_semi").join(identity_person, "identity_id")
    others = others.join(person.where("is_owner").select(F.col("id").alias("person_id")), "person_id", "left_anti")
    other = others.groupBy("thread_id").agg(F.min("person_id").alias("other"))
    sender = identity_person.select(F.col("identity_id").alias("sender_identity_id"), F.col("person_id").alias("sender"))
    rows = message.select("id", "thread_id", "sender_identity_id").join(other, "thread_id", "left").join(sender, "sender_identity_id", "left")
    return rows.select("id", F.coalesce("other", "sender").alias("person_id"))


def silence_label(days: Column) -> Column:
    years = F.concat(F.floor(days / 365).cast("string"), F.lit(" years"))
    months = F.concat(F.floor(days / 30).cast("string"), F.lit(" months"))
    return F.when(days >= 730, years).when(days >= 365, F.lit("a year")).when(days >= 60, months).otherwise(F.concat(days.cast("string"), F.lit(" days")))


def silence_gaps(message: DataFrame, silence: int = SILENCE) -> DataFrame:
    """Messages that end a silence in their thread, with its whole days and its label. No task holds a thread, only a day of it."""
    rows, days = gaps(message.select("id", "thread_id", "sent_at_unix"))
    rows = with_days(rows, days)
    rows = rows.withColumn("gap", F.when(F.col("first_"), F.col("day_gap_")).otherwise(F.col("gap_"))).where(F.col("gap") >= silence)
    whole = F.floor(F.col("gap") / 86400).cast("long")
    return rows.select("id", "thread_id", whole.alias("days"), silence_label(whole).alias("label"))


def source_counts(message: DataFrame, import_run: DataFrame) -> DataFrame:
    """Messages and runs of each source, and when its last completed run ended."""
    sent = message.groupBy("source_id").agg(F.count("*").alias("message_count"))
    runs = import_run.groupBy("source_id").agg(F.count("*").alias("run_count"), F.max(F.when(F.col("status") == "completed", F.col("finished_unix"))).alias("last_finished"))
    rows = sent.join(runs, "source_id", "full")
    return rows.select("source_id", F.coalesce("message_count", F.lit(0)).alias("message_count"), F.coalesce("run_count", F.lit(0)).alias("run_count"), "last_finished")


def already_imported(import_run: DataFrame, wanted: DataFrame) -> DataFrame:
    """Those of ``wanted`` (source_path, source_fingerprint) that a completed run has read."""
    done = import_run.where("status = 'completed'")
    return wanted.join(done, ["source_path", "source_fingerprint"], "left_semi")


def storage_stats(table: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, and the bytes of each column as a floating-point total (0.0 where there are none)."""
    totals = [F.coalesce(F.sum(F.octet_length(c)).cast("double"), F.lit(0.0)).alias(f"{c}_bytes") for c in columns]
    return table.agg(F.count("*").alias("row_count"), *totals)


def sync_chats(chat: DataFrame, message: DataFrame) -> DataFrame:
    """Chats of a source with the messages stored of each."""
    stored = message.groupBy(F.col("thread_id").alias("chat_id")).agg(F.count("*").alias("stored"))
    return chat.join(stored, "chat_id", "left").select("chat_id", "title", "peer_kind", "decision", "last_message_unix", F.coalesce("stored", F.lit(0)).alias("stored"))


def decide_kind(chat: DataFrame, kind: str, decision: str, undecided_only: bool = True) -> DataFrame:
    """Chats with a decision for all of a kind; by default only where none was made."""
    applies = F.col("peer_kind") == kind
    if undecided_only:
        applies &= F.col("decision").isNull()
    return chat.withColumn("decision", F.when(applies, F.lit(decision)).otherwise(F.col("decision")))


def decide(chat: DataFrame, chat_id: str, decision: str) -> DataFrame:
    """Chats with the decision for one of them, whatever it was before."""
    return chat.withColumn("decision", F.when(F.col("chat_id") == chat_id, F.lit(decision)).otherwise(F.col("decision")))


def upsert_chats(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Stored chats brought up to date: titles and kinds as seen, the later last message, decisions kept."""
    new = seen.select("chat_id", F.col("title").alias("new_title"), F.col("peer_kind").alias("new_kind"), F.col("last_message_unix").alias("new_last"))
    rows = stored.join(new, "chat_id", "full")
    return rows.select("chat_id", F.coalesce("new_title", "title").alias("title"), F.coalesce("new_kind", "peer_kind").alias("peer_kind"), "decision", F.greatest("last_message_unix", "new_last").alias("last_message_unix"))


def dataset_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: messages (uid, thread_id, id, plaintext, service_action, entities) in both, those of them that differ in text,
    action or entities (as JSON without its white space), and those on one side only inside the ids that the right side
    covers of a thread."""
    fields = ("plaintext", "service_action", "entities")
    a = left.select("uid", "thread_id", F.col("id").alias("left_id"), *[F.col(c).alias(f"left_{c}") for c in fields])
    b = right.select("uid", F.col("thread_id").alias("right_thread"), F.col("id").alias("right_id"), *[F.col(c).alias(f"right_{c}") for c in fields])
    span = right.groupBy(F.col("thread_id").alias("span_thread")).agg(F.min("id").alias("low"), F.max("id").alias("high"))
    rows = a.join(b, "uid", "full").withColumn("t", F.coalesce("thread_id", "right_thread")).join(span, F.col("t") == F.col("span_thread"), "left")
    inside = F.coalesce("left_id", "right_id").between(F.col("low"), F.col("high"))
    shared = F.col("left_id").isNotNull() & F.col("right_id").isNotNull()
    equal = {c: F.col(f"left_{c}").eqNullSafe(F.col(f"right_{c}")) for c in fields}
    # only entities that differ as they are written are read as JSON
    doubtful = shared & ~equal["entities"]
    one, other = (canonical_json(F.when(doubtful, F.col(f"{side}_entities"))) for side in ("left", "right"))
    rows = rows.withColumn("left_json", one).withColumn("right_json", other)
    blank = lambda c: F.when(F.trim(c) != "", F.col(c))
    same = equal["plaintext"] & equal["service_action"] & (equal["entities"] | blank("left_json").eqNullSafe(blank("right_json")))
    out = rows.agg(
        F.count_if(shared).alias("shared"), F.count_if(shared & ~same).alias("differ"),
        F.count_if(F.col("right_id").isNull() & inside).alias("left_only"), F.count_if(F.col("left_id").isNull() & inside).alias("right_only"),
    )
    return out.withColumn("clean", F.expr("shared > 0 AND differ = 0 AND left_only = 0 AND right_only = 0"))


def people_with_suggestions(person: DataFrame, identity_person: DataFrame, suggestions: DataFrame) -> DataFrame:
    """People of whom an identity may be somebody else's too. suggestions: left_id, right_id."""
    named = suggestions.select(F.col("left_id").alias("identity_id")).unionByName(suggestions.select(F.col("right_id").alias("identity_id")))
    theirs = identity_person.join(named, "identity_id", "left_semi").select(F.col("person_id").alias("id"))
    return person.join(theirs, "id", "left_semi")


def people_with_synthetic(person: DataFrame, identity_person: DataFrame, identity: DataFrame) -> DataFrame:
    """People with an account that an export names without an id."""
    synthetic = identity.where("is_synthetic").select(F.col("id").alias("identity_id"))
    theirs = identity_person.join(synthetic, "identity_id", "left_semi").select(F.col("person_id").alias("id"))
    return person.join(theirs, "id", "left_semi")


def owner_accounts(person: DataFrame, identity_person: DataFrame, identity: DataFrame) -> DataFrame:
    """The owner's name with each account; one row without an account where there is none."""
    accounts = identity_person.join(identity.select(F.col("id").alias("identity_id"), "platform", "handle"), "identity_id")
    owner = person.where("is_owner").select(F.col("id").alias("person_id"), F.col("display_name").alias("owner"))
    return owner.join(accounts.select("person_id", "platform", "handle"), "person_id", "left").select("owner", "platform", "handle")


def backup(tables: dict[str, DataFrame], folder: str) -> None:
    """Writes each table into a folder of its own; refuses where one is there already."""
    for name, table in tables.items():
        table.write.mode("errorifexists").parquet(f"{folder}/{name}")
