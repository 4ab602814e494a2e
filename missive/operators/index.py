"""A stored word index that follows inserts, edits and deletions.

An index is a folder of three tables, in segments that commits add: ``postings`` (term, id, position, and the document's
length), each file in order of terms, so that a query reads the row groups of its terms only; ``documents`` (id, length and
what searches filter by), in which a document's newest segment counts; and ``totals``, a row a segment. A commit writes the
words of its new and changed documents and the ids of deleted ones; each task puts its own documents' words in order, and
nothing is shuffled. ``compact`` makes one segment of all, in which a term is in one file or in files that follow each
other. An index of one segment without deletions answers from its postings and totals, and reads documents only to filter
by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import words
from .ingest import replayed
from .search import Term, frequencies, parse_query, scored

FILTERS = ("thread_id", "person_id", "provenance", "sent_at_unix")


ORDER = ("term", "id", "position")


def _write_postings(rows: DataFrame, folder: str, segment: int) -> None:
    rows.select(*ORDER, "length").write.mode("overwrite").parquet(f"{folder}/postings/segment={segment}")


def _write_documents(rows: DataFrame, folder: str, segment: int) -> None:
    """rows: id, length, deleted, and columns of FILTERS."""
    rows.write.mode("overwrite").parquet(f"{folder}/documents/segment={segment}")
    written = rows.sparkSession.read.parquet(f"{folder}/documents/segment={segment}")
    totals = written.agg(F.count_if(~F.col("deleted")).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("words"), F.count_if("deleted").alias("gone"))
    totals.coalesce(1).write.mode("overwrite").parquet(f"{folder}/totals/segment={segment}")


def commit(documents: DataFrame, folder: str, segment: int, deleted: DataFrame | None = None) -> None:
    """Writes a segment: new and changed documents (id, body, and the columns of FILTERS that there are), ids of deleted
    ones. A segment that is written again replaces itself. A null body has no words."""
    kept = [c for c in FILTERS if c in documents.columns]
    cut = documents.select("id", *kept, F.coalesce(words(F.col("body")), F.array().cast("array<string>")).alias("words"))
    cut = cut.withColumn("length", F.size("words"))
    _write_postings(cut.select("id", "length", F.posexplode("words").alias("position", "term")).sortWithinPartitions(*ORDER), folder, segment)
    rows = cut.select("id", "length", *kept, F.lit(False).alias("deleted"))
    if deleted is not None:
        rows = rows.unionByName(deleted.select("id", F.lit(True).alias("deleted")), allowMissingColumns=True)
    _write_documents(rows, folder, segment)


def follow(batch: DataFrame, stored: DataFrame, folder: str, segment: int, deleted: DataFrame | None = None, order: list[str] | None = None) -> None:
    """Writes the segment of a batch that ``ingest.commit`` takes: only documents whose body the batch changes or adds, of
    several with one id the last. batch and stored: id, content_hash; batch also body and columns of FILTERS."""
    newest = replayed(batch, stored, "id", order).where("newest")
    changed = newest.join(stored.select("id", "content_hash"), ["id", "content_hash"], "left_anti")
    commit(changed, folder, segment, deleted)


def live(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the index, each once, with the segment that has its words."""
    rows = spark.read.parquet(f"{folder}/documents")
    newest = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("segment"), "deleted"))
    return rows.withColumn("place", newest).where("place = 1 AND NOT deleted").drop("place", "deleted")


def postings(spark: SparkSession, folder: str) -> DataFrame:
    """term, id, position and length of the words of live documents."""
    rows = spark.read.parquet(f"{folder}/postings")
    return rows.join(live(spark, folder).select("id", "segment"), ["id", "segment"], "left_semi").select("term", "id", "position", "length")


def compact(spark: SparkSession, folder: str, target: str) -> None:
    """The index of ``folder`` as one segment of ``target``."""
    _write_postings(postings(spark, folder).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER), target, 0)
    _write_documents(live(spark, folder).drop("segment").withColumn("deleted", F.lit(False)), target, 0)


def _is(term: Term, k: int) -> Column:
    """Whether a posting is a term's word k, in a form that the scan can prune by."""
    word = term.words[k]
    if term.prefix and k == len(term.words) - 1:
        return F.col("term").startswith(word)
    return F.col("term") == word


def counted(spark: SparkSession, folder: str, terms: list[Term]) -> DataFrame:
    """Documents of segments with a term (id, segment, length) and how often each term stands in them: tf0, tf1, ...

    Words of a phrase stand at places that are equal less their numbers in it.
    """
    wanted = {(t.words[k], t.prefix and k == len(t.words) - 1): _is(t, k) for t in terms for k in range(len(t.words))}
    any_word = F.lit(False)
    for condition in wanted.values():
        any_word |= condition
    counts = []
    for n, term in enumerate(terms):
        if len(term.words) == 1:
            counts.append(F.count_if(_is(term, 0)).alias(f"tf{n}"))
        else:
            starts = [F.collect_list(F.when(_is(term, k), F.col("position") - k)) for k in range(len(term.words))]
            both = starts[0]
            for other in starts[1:]:
                both = F.array_intersect(both, other)
            counts.append(F.size(both).cast("long").alias(f"tf{n}"))
    rows = spark.read.parquet(f"{folder}/postings").where(any_word)
    return rows.groupBy("id", "segment").agg(F.first("length").alias("length"), *counts)


def search(spark: SparkSession, folder: str, query: str, limit: int | None = 200, **filters) -> DataFrame:
    """What ``search.search`` finds in the documents of the index, from their postings."""
    terms = parse_query(query)
    if not terms:
        return live(spark, folder).select("id", F.lit(0.0).alias("score")).where(F.lit(False))
    found = counted(spark, folder, terms)
    segments = spark.read.parquet(f"{folder}/totals").select("n", "words", "gone").collect()  # a row a segment
    if len(segments) == 1 and not segments[0]["gone"]:
        sizes = spark.range(1).select(F.lit(segments[0]["n"]).alias("n"), F.lit(segments[0]["words"] / max(1, segments[0]["n"])).alias("mean"))
    else:
        found = found.join(live(spark, folder).select("id", "segment"), ["id", "segment"], "left_semi")
        sizes = live(spark, folder).agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    stats = found.agg(*frequencies(len(terms))).crossJoin(F.broadcast(sizes))  # one row each
    if any(v is not None for v in filters.values()):
        found = found.join(live(spark, folder).drop("length"), ["id", "segment"])
    return scored(found, stats, len(terms), limit, **filters)
