"""Exact deduplication with a heavy-hitter split.

Texts are equal when they are identical after every character of ``[\\x20\\x09-\\x0D]`` is deleted;
of equal texts the row with the most code points in its original text stays, then the smallest
``doc_id`` (null last).

1. One pass over the texts keeps (row id, doc id, SHA-256, code points) as a stored table.
2. Misra-Gries summaries, one per task and of ``slots`` counters each, are added up. What a digest's
   count lacks in the sum is at most rows / (slots + 1), so every digest with twice that many rows
   reaches the threshold; as the counts add up to at most the number of rows, no more than
   ``slots + 1`` digests can reach it: this bounds what is broadcast.
3. Those digests are counted exactly and their winners chosen with a partial aggregate; the winners
   are broadcast, so rows of frequent digests are decided where they are, without a shuffle.
4. All other rows go through an ordinary shuffle by digest; none of its groups is large.

Defined results: null text counts as empty, and empty texts are equal to each other; rows that
repeat in every column are told apart by a row id and exactly one of them stays; an empty table
gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections import Counter
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from capforge.llm.common import SPACE, columns_of, fresh, stored, text_or_empty, with_row_id

SLOTS = 1000
#: A digest with fewer rows than this is never treated as frequent.
LEAST_HEAVY = 64


def shrink(counts: Counter, slots: int) -> Counter:
    """Misra-Gries step: with more than ``slots`` counters, take the (slots+1)-th largest count off all."""
    if len(counts) <= slots:
        return counts
    cut = sorted(counts.values(), reverse=True)[slots]
    return Counter({k: v - cut for k, v in counts.items() if v > cut})


def frequent(digests: DataFrame, slots: int) -> DataFrame:
    """(digest, lower bound of its count) from one summary per task."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            counts.update(batch.column(0).to_pylist())
            counts = shrink(counts, slots)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["digest", "least"])

    return digests.mapInArrow(summarise, "digest binary, least long").groupBy("digest").agg(F.sum("least").alias("least"))


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.regexp_replace(text_or_empty(text), SPACE + "+", ""), 256))


def digests(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Stored (rid, id, digest, points) of every row."""
    return stored(with_row_id(docs.select(F.col(doc_id).alias("id"), digest_of(F.col(text)).alias("digest"),
                                          F.length(text_or_empty(F.col(text))).alias("points")), "rid"), "digests")


#: Which of equal rows stays: the smallest of these.
BEST = ("struct(-points AS p, id IS NULL AS n, id AS id, rid AS rid)")


def heavy_winners(rows: DataFrame, slots: int) -> list[Row]:
    """(digest, group_size, best, same) of the frequent digests, counted exactly: at most slots + 1 rows (see
    2. above). same: rows with the winner's id and points."""
    least = max(LEAST_HEAVY, rows.count() // (slots + 1) + 1)
    candidates = frequent(rows.select("digest"), slots).filter(F.col("least") >= least).select("digest")
    alike = rows.join(F.broadcast(candidates), "digest").groupBy("digest", "id", "points").agg(
        F.count(F.lit(1)).alias("same"), F.min("rid").alias("rid"))
    return alike.groupBy("digest").agg(F.sum("same").alias("group_size"), F.expr(f"min({BEST})").alias("best"),
                                       F.expr(f"min_by(same, {BEST})").alias("same")).collect()


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = digests(docs, doc_id, text)
    heavy = docs.sparkSession.createDataFrame(
        [(bytes(w.digest), w.group_size, w.best.id, w.best.rid) for w in heavy_winners(rows, slots)],
        f"digest binary, group_size long, keep_id {rows.schema['id'].dataType.simpleString()}, keep_rid long")
    mapped = rows.join(F.broadcast(heavy), "digest")
    by_digest, best = Window.partitionBy("digest"), F.expr(f"min({BEST})")
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").select(
        "*", F.count(F.lit(1)).over(by_digest).alias("group_size"), best.over(by_digest).alias("best")).select(
        "digest", "rid", "id", "points", "group_size", F.col("best.id").alias("keep_id"), F.col("best.rid").alias("keep_rid"))
    return mapped.unionByName(rest).select(
        F.col("id").alias("doc_id"), "keep_id", F.col("group_size").cast("long").alias("group_size"),
        (F.col("rid") == F.col("keep_rid")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns. Losing rows of frequent digests go where they are; what is
    left is shuffled by digest, where the winner, and of rows that repeat it one, stays."""
    rows = digests(docs, doc_id, text)
    kind = rows.schema["id"].dataType.simpleString()
    heavy = docs.sparkSession.createDataFrame(
        [(bytes(w.digest), w.best.id, -w.best.p, w.same) for w in heavy_winners(rows, slots)],
        f"digest binary, id {kind}, points int, same long")
    key, points, of = (fresh(docs, f"__{c}") for c in ("digest", "points", "winner"))
    whole = docs.withColumn(key, digest_of(F.col(text))).withColumn(points, F.length(text_or_empty(F.col(text))))
    won = F.struct(F.col("digest"), F.col("id"), F.col("points"), F.col("same")).alias(of)
    here = whole.join(F.broadcast(heavy.select(F.col("digest").alias(f"{key}h"), won)), F.col(key) == F.col(f"{key}h"), "left").drop(f"{key}h")
    wins = F.col(doc_id).eqNullSafe(F.col(f"{of}.id")) & (F.col(points) == F.col(f"{of}.points"))
    often = F.coalesce(F.col(f"{of}.same") >= LEAST_HEAVY, F.lit(False))
    left = here.filter(F.col(of).isNull() | (wins & ~often)).drop(of)
    best = rows.groupBy("digest").agg(F.expr("min(struct(-points AS p, id IS NULL AS n, id AS id))").alias("b")).select(
        F.col("digest").alias(f"{key}w"), F.struct(F.col("b.id").alias("id"), (-F.col("b.p")).alias("points")).alias(of))
    won_rows = left.join(best, F.col(key) == F.col(f"{key}w")).filter(wins)
    one = fresh(whole, "__one")
    kept = won_rows.withColumn(one, F.row_number().over(Window.partitionBy(key).orderBy(points))).filter(F.col(one) == 1).select(*columns_of(docs))
    if not heavy.filter(F.col("same") >= LEAST_HEAVY).isEmpty():  # a winner that is repeated very often meets in a partial aggregate
        many = here.filter(wins & often).groupBy(key).agg(F.first(F.struct(*columns_of(docs))).alias(of))
        kept = kept.unionByName(many.select(f"{of}.*"))
    return kept
