"""Entity resolution: suggestions, merges, edges, owners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_suggestions(identity: DataFrame, identity_person: DataFrame, message: DataFrame, dismissed: DataFrame, limit: int | None = 50) -> DataFrame:
    """Pairs of identities of different people that share a handle or a name, whatever its case.

    Two equi-joins, one for handles and one for names; a pair of one platform counts only if one of them is synthetic
    or their handles are equal. dismissed: left_id, right_id.
    """
    volume = message.groupBy(F.col("sender_identity_id").alias("id")).agg(F.count("*").alias("volume"))
    rows = identity.join(identity_person.select(F.col("identity_id").alias("id"), "person_id"), "id").join(volume, "id", "left")
    rows = rows.select("id", "display_name", F.lower("display_name").alias("name"), "handle", "platform", "is_synthetic", "person_id", F.coalesce("volume", F.lit(0)).alias("volume"))
    a, b = (rows.select([F.col(c).alias(f"{side}_{c}") for c in rows.columns]) for side in ("left", "right"))
    apart = (F.col("right_id") > F.col("left_id")) & (F.col("left_person_id") != F.col("right_person_id"))
    by_handle = a.where("left_handle <> ''").join(b, (F.col("left_handle") == F.col("right_handle")) & apart)
    by_name = a.join(b, (F.col("left_name") == F.col("right_name")) & apart)
    pairs = by_handle.unionByName(by_name).dropDuplicates(["left_id", "right_id"]).join(dismissed, ["left_id", "right_id"], "left_anti")
    handle = F.coalesce(F.col("left_handle") == F.col("right_handle"), F.lit(False))
    pairs = pairs.where((F.col("left_platform") != F.col("right_platform")) | F.col("left_is_synthetic") | F.col("right_is_synthetic") | handle)
    strength = F.when(handle, 30).when(F.col("left_is_synthetic") | F.col("right_is_synthetic"), 20).otherwise(10)
    out = pairs.select("left_id", "right_id", "left_display_name", strength.alias("strength"), (F.col("left_volume") + F.col("right_volume")).alias("volume"))
    out = out.select("left_id", "right_id", "strength", "volume", "left_display_name")
    if limit is None:
        return out
    return out.orderBy(F.desc("strength"), F.desc("volume"), "left_display_name", "left_id", "right_id").limit(limit)


def _without_empty(person: DataFrame, bridge: DataFrame) -> DataFrame:
    """People without those left with no identity, but for the owner."""
    used = bridge.select(F.col("person_id").alias("id")).distinct()
    return person.where("is_owner").unionByName(person.where(~F.col("is_owner")).join(used, "id", "left_semi"))


def _owner_flag(person: DataFrame, person_id: str) -> bool:
    row = person.where(F.col("id") == person_id).select("is_owner").first()
    if row is None:
        raise ValueError(f"no such person: {person_id}")
    return row["is_owner"]


def merge_people(identity_person: DataFrame, person: DataFrame, source: str, target: str, confirm_owner: bool = False) -> tuple[DataFrame, DataFrame]:
    """The bridge with all of a person's identities at another, and the people without those left with none.

    Merging a person with itself changes nothing; the owner can't be a source, and is a target only if that is confirmed.
    """
    if source == target:
        return identity_person, person
    if _owner_flag(person, source):
        raise ValueError("the owner can't be merged into somebody else")
    if _owner_flag(person, target) and not confirm_owner:
        raise ValueError("merging somebody into the owner needs to be confirmed")
    moved = F.col("person_id") == source
    bridge = identity_person.select("identity_id", F.when(moved, target).otherwise(F.col("person_id")).alias("person_id"), F.when(moved, "manual").otherwise(F.col("confidence")).alias("confidence"))
    return bridge, _without_empty(person, bridge)


def merge_identity(identity_person: DataFrame, person: DataFrame, identity_id: str, target: str, confirm_owner: bool = False) -> tuple[DataFrame, DataFrame, str | None]:
    """The bridge with one identity at another person, the people without those left with none, and the person whose last
    identity it was, if so: what is known of them moves too (``move_knowledge``). The owner as a target must be confirmed."""
    if _owner_flag(person, target) and not confirm_owner:
        raise ValueError("merging an identity into the owner needs to be confirmed")
    link = identity_person.where(F.col("identity_id") == identity_id).first()
    if link is None:
        raise ValueError(f"no such identity: {identity_id}")
    it = F.col("identity_id") == identity_id
    bridge = identity_person.select("identity_id", F.when(it, target).otherwise(F.col("person_id")).alias("person_id"), F.when(it, "manual").otherwise(F.col("confidence")).alias("confidence"))
    before = link["person_id"]
    emptied = before != target and bridge.where(F.col("person_id") == before).isEmpty()
    return bridge, _without_empty(person, bridge), before if emptied else None


def move_knowledge(fact: DataFrame, edge: DataFrame, job: DataFrame, source: str, target: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, edges, jobs) after a person became another one.

    Facts about the source are about the target. An edge of the source becomes the target's; where the target has that
    edge already, its facts join it. The edge between the two goes, with its facts, and so do jobs about the source.
    fact: subject_person_id, subject_edge_id and others; edge: id, person_a_id, person_b_id; job: subject_kind, subject_id.
    """
    here = (F.col("person_a_id") == source) | (F.col("person_b_id") == source)
    between = here & ((F.col("person_a_id") == target) | (F.col("person_b_id") == target))
    other = F.when(F.col("person_a_id") == source, F.col("person_b_id")).otherwise(F.col("person_a_id"))
    ends = (F.least(other, F.lit(target)).alias("person_a_id"), F.greatest(other, F.lit(target)).alias("person_b_id"))
    moving = edge.where(here & ~between).select(F.col("id").alias("moving_id"), *ends)
    theirs = edge.where(~here).select(F.col("id").alias("kept_id"), "person_a_id", "person_b_id")
    moved = moving.join(theirs, ["person_a_id", "person_b_id"], "left")
    goes = edge.where(between).select(F.col("id").alias("subject_edge_id"))
    facts = fact.join(goes, "subject_edge_id", "left_anti")
    facts = facts.join(moved.where("kept_id IS NOT NULL").select(F.col("moving_id").alias("subject_edge_id"), "kept_id"), "subject_edge_id", "left")
    facts = facts.withColumn("subject_edge_id", F.coalesce("kept_id", "subject_edge_id"))
    facts = facts.withColumn("subject_person_id", F.when(F.col("subject_person_id") == source, target).otherwise(F.col("subject_person_id")))
    became = moved.where("kept_id IS NULL").select(F.col("moving_id").alias("id"), "person_a_id", "person_b_id")
    edges_ = edge.where(~here).select("id", "person_a_id", "person_b_id").unionByName(became)
    return facts.select(fact.columns), edges_, job.where(~((F.col("subject_kind") == "person") & (F.col("subject_id") == source)))


def ensure_identities(seen: DataFrame, identity: DataFrame, person: DataFrame, identity_person: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(identities, people, bridge) with the identities that an import sees (columns of ``identity``).

    A known identity stays as it is. A new one, of several with its id the least by name, gets a person of its own named
    like it.
    """
    fields = [c for c in identity.columns if c != "id"]
    new = seen.join(identity.select("id"), "id", "left_anti").groupBy("id").agg(F.min(F.struct("display_name", *[c for c in fields if c != "display_name"])).alias("x"))
    new = new.select("id", *[F.col(f"x.{c}").alias(c) for c in fields])
    own = F.concat(F.lit("p:"), "id")
    people = new.select(own.alias("id"), "display_name", F.lit(False).alias("is_owner")).join(person.select("id"), "id", "left_anti")
    links = new.select(F.col("id").alias("identity_id"), own.alias("person_id"), F.lit("auto").alias("confidence"))
    links = links.join(identity_person.select("identity_id"), "identity_id", "left_anti")
    return identity.unionByName(new), person.select("id", "display_name", "is_owner").unionByName(people), identity_person.unionByName(links)


def seed_owner(identity: DataFrame, person: DataFrame, identity_person: DataFrame, identity_id: str) -> tuple[DataFrame, DataFrame]:
    """(people, bridge) with an identity as the owner's, whoever it was before: by the export's word (``seed``), or by a guess
    (``auto``) if the identity is synthetic. Without an owner there is one from now on; people left with no identity go."""
    it = identity.where(F.col("id") == identity_id).select("display_name", "is_synthetic").first()
    if it is None:
        raise ValueError(f"no such identity: {identity_id}")
    known = person.where("is_owner").select("id").first()
    owner = known["id"] if known else "owner"
    people = person.select("id", "display_name", "is_owner")
    if known is None:
        fresh = person.sparkSession.createDataFrame([(owner, it["display_name"], True)], "id string, display_name string, is_owner boolean")
        people = people.unionByName(fresh)
    linked = person.sparkSession.createDataFrame([(identity_id, owner, "auto" if it["is_synthetic"] else "seed")], "identity_id string, person_id string, confidence string")
    bridge = identity_person.select(linked.columns).where(F.col("identity_id") != identity_id).unionByName(linked)
    return _without_empty(people, bridge), bridge


def ensure_participants(roster: DataFrame, stored: DataFrame) -> DataFrame:
    """Participants that a roster (thread_id, identity_id, first_seen_unix) adds to the stored ones, each once, whether or
    not they said anything."""
    rows = roster.groupBy("thread_id", "identity_id").agg(F.min("first_seen_unix").alias("first_seen_unix"))
    return rows.join(stored.select("thread_id", "identity_id"), ["thread_id", "identity_id"], "left_anti")


def edges(pairs: DataFrame) -> DataFrame:
    """Undirected edges, the lesser person first, each once; a person has none with itself."""
    a, b = F.least("a", "b"), F.greatest("a", "b")
    return pairs.where(F.col("a") != F.col("b")).select(a.alias("person_a_id"), b.alias("person_b_id")).distinct()


def move_edges(edge: DataFrame, source: str, target: str) -> DataFrame:
    """Edges after a merge: the source's become the target's, the one between them goes."""
    to = lambda c: F.when(F.col(c) == source, target).otherwise(F.col(c))
    return edges(edge.select(to("person_a_id").alias("a"), to("person_b_id").alias("b")))


def infer_owner(roster: DataFrame) -> DataFrame:
    """The one member of all threads of each source, where there are two threads or more and just one such member.

    roster: source_id, thread_id, member.
    """
    threads = roster.groupBy("source_id").agg(F.count_distinct("thread_id").alias("threads"))
    present = roster.groupBy("source_id", "member").agg(F.count_distinct("thread_id").alias("there"))
    always = present.join(threads, "source_id").where((F.col("there") == F.col("threads")) & (F.col("threads") >= 2))
    return always.groupBy("source_id").agg(F.min("member").alias("owner"), F.count("*").alias("n")).where("n = 1").select("source_id", "owner")


def owner_candidates(lines: DataFrame, limit: int = 5) -> DataFrame:
    """Senders by the chats they are in, their lines and their names. lines: thread_id, sender."""
    rows = lines.groupBy("sender").agg(F.count_distinct("thread_id").alias("chats"), F.count("*").alias("line_count"))
    return rows.orderBy(F.desc("chats"), F.desc("line_count"), "sender").limit(limit)


def unmerge(identity: DataFrame, identity_person: DataFrame, person: DataFrame, identity_id: str) -> tuple[DataFrame, DataFrame]:
    """An identity gets a person of its own, named like it; people left with no identity go, but for the owner.

    The identity that the export itself names as the owner's (confidence ``seed``) can't be taken from its person; an
    unknown identity raises.
    """
    link = identity_person.where(F.col("identity_id") == identity_id).join(identity.select(F.col("id").alias("identity_id"), "display_name"), "identity_id").first()
    if link is None:
        raise ValueError(f"no such identity: {identity_id}")
    if link["confidence"] == "seed":
        raise ValueError("the owner's own account can't be detached")
    fresh = f"p:{identity_id}:own"
    it = F.col("identity_id") == identity_id
    bridge = identity_person.select("identity_id", F.when(it, fresh).otherwise(F.col("person_id")).alias("person_id"), F.when(it, "manual").otherwise(F.col("confidence")).alias("confidence"))
    kept = _without_empty(person.select("id", "display_name", "is_owner").where(F.col("id") != fresh), bridge)
    return bridge, kept.unionByName(identity.where(F.col("id") == identity_id).select(F.lit(fresh).alias("id"), "display_name", F.lit(False).alias("is_owner")))


def rename(person: DataFrame, person_id: str, name: str) -> DataFrame:
    """A person under another name; a blank name raises."""
    if not name.strip():
        raise ValueError("a person needs a name")
    return person.withColumn("display_name", F.when(F.col("id") == person_id, name).otherwise(F.col("display_name")))


def dismiss(dismissed: DataFrame, one: str, other: str) -> DataFrame:
    """The pair is no longer suggested, whichever is named first; once is enough."""
    left, right = sorted((one, other))
    pair = dismissed.sparkSession.createDataFrame([(left, right)], "left_id string, right_id string")
    return dismissed.select("left_id", "right_id").unionByName(pair).distinct()


def restore(dismissed: DataFrame, one: str, other: str) -> DataFrame:
    """A dismissal taken back."""
    left, right = sorted((one, other))
    return dismissed.where(~((F.col("left_id") == left) & (F.col("right_id") == right)))


def move_facts(fact: DataFrame, source: str, target: str) -> DataFrame:
    """Facts after a merge: those about the source are about the target."""
    return fact.withColumn("subject_person_id", F.when(F.col("subject_person_id") == source, target).otherwise(F.col("subject_person_id")))
