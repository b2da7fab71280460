"""Mixing sources to target weights with hash-threshold histograms (DataFrame functions only).

A row's size is its number of words. Sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3,
... and share all words by weight; a target stops at ``most`` times its source's size and the excess
is shared again by weight until none is above. A source then gives ``full`` = floor(target / size)
whole copies of every row, and once more the rows whose hash is at most its cut, so that the words
come as near to the target as the hash order allows (of two cuts equally near, the smaller).

The cut is found without sorting rows: the words of each (source, leading 12 hash bits) are summed,
a running sum over at most 4096 buckets finds the bucket in which the remainder ends, only that
bucket's rows are summed by their next 12 bits, and only the rows of that second bucket by their
whole 48-bit hash. Sums are combined before the shuffle, so a large source is at most 4096 rows a task.

Defined results: a null or empty text has size 0; a source without words has target 0 and gives
nothing; rows with equal ids have equal hashes and are taken together; a null id hashes like an
empty one; an empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capforge.llm.common import WORD, columns_of, fresh, join_per_key, stored, text_or_empty

MOST = 3
WEIGHTS = (1, 2, 3)
SEED = "mix"
BITS = 12


def word_count(text: Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def id_hash(doc_id: Column, seed: str = SEED) -> Column:
    """48 bits of MD5 of ``seed:id``."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long")


def source_targets(rows: DataFrame, most: int = MOST) -> DataFrame:
    """Stored (source, source_size, target) from rows with source and size.

    Ranks come from a stored range-sorted table: counts by its partition number, added up, shift the
    numbers inside each partition. The rounds of sharing are one-row aggregates.
    """
    last = F.col("source").asc_nulls_last()
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = stored(per.orderBy(last).withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = per.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(  # a row for each partition
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(last)) + F.col("shift") - 1
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in WEIGHTS]), (rank % len(WEIGHTS) + 1).cast("int"))
    per = per.join(F.broadcast(shift), "part").withColumn("weight", weight).withColumn(
        "cap", most * F.col("source_size")).drop("part")
    per = stored(per, "weights")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    words, weights, capped = total, None, -1
    while True:
        share = F.lit(0.0) if weights is None else (F.col("weight") * F.lit(words)).cast("double") / F.lit(float(weights))
        at_cap = F.lit(False) if weights is None else share >= F.col("cap")
        left = per.agg(F.count_if(at_cap).alias("n"), F.sum(F.when(at_cap, F.col("cap"))).alias("cap"),
                       F.sum(F.when(~at_cap, F.col("weight"))).alias("weight")).first()
        if left.n == capped or not left.weight:
            break
        capped, words, weights = left.n, total - (left.cap or 0), left.weight
    target = F.when(at_cap, F.col("cap").cast("double")).otherwise(share)
    return per.select("source", "source_size", target.alias("target"))


def cuts(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Stored (source, source_size, target, full, cut) from rows with source, size and hash."""
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    plan = stored(plan, "plan")
    # (prefix, before): where each source's remainder is still open, and the words below that bucket
    open_ = plan.filter("rest > 0").select("source", "rest", F.lit(0).cast("long").alias("prefix"),
                                           F.lit(0).cast("long").alias("before"))
    for shift in (48 - BITS, 48 - 2 * BITS):
        inside = join_per_key(rows, open_, "source").filter(
            F.shiftright("hash", shift + BITS) == F.col("prefix"))
        sums = inside.groupBy("source", "rest", "before", F.shiftright("hash", shift).alias("bucket")).agg(
            F.sum("size").alias("words"))
        upto = F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        ends = sums.withColumn("upto", upto).filter(
            (F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest")))
        open_ = stored(ends.select("source", "rest", F.col("bucket").alias("prefix"),
                                   (F.col("upto") - F.col("words")).alias("before")), "open")
    inside = join_per_key(rows, open_, "source").filter(F.shiftright("hash", 48 - 2 * BITS) == F.col("prefix"))
    sums = inside.groupBy("source", "rest", "before", "hash").agg(F.sum("size").alias("words"))
    points = sums.select("source", "rest", F.col("hash").alias("cut"), (F.col("before") + F.sum("words").over(
        Window.partitionBy("source").orderBy("hash"))).alias("words"))
    below = open_.select("source", "rest", (F.shiftleft("prefix", 48 - 2 * BITS) - 1).alias("cut"),
                         F.col("before").alias("words"))
    nearest = points.unionByName(below).groupBy("source").agg(
        F.min(F.struct(F.abs(F.col("words") - F.col("rest")), "words", "cut")).alias("best")).select(
        F.col("source").alias("of"), F.col("best.cut").alias("cut"))
    return stored(plan.join(nearest, plan["source"].eqNullSafe(nearest["of"]), "left").select(
        "source", "source_size", "target", "full", F.coalesce("cut", F.lit(-1)).alias("cut")), "cuts")


def mix_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
             seed: str = SEED) -> DataFrame:
    """Stored (doc_id, source, size, hash): all that the mix reads of a row."""
    return stored(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                              word_count(F.col(text)).alias("size"), id_hash(F.col(doc_id), seed).alias("hash")), "sizes")


def copies(hash_: str, full: str, cut: str) -> Column:
    return F.col(full) + F.when(F.col(hash_) <= F.col(cut), 1).otherwise(0)


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                most: int = MOST, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken (words, repeats counted), copies."""
    rows = mix_rows(docs, doc_id, text, source, seed)
    plan = cuts(rows, source_targets(rows, most))
    n = copies("hash", "full", "cut")
    return join_per_key(rows, plan, "source").select(
        "doc_id", "size", "source_size", "target", (n * F.col("size")).alias("taken"), n.alias("copies"))


def take_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
             most: int = MOST, seed: str = SEED) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with its columns; texts are not shuffled."""
    rows = mix_rows(docs, doc_id, text, source, seed)
    of, key, plan, n = (fresh(docs, f"__{c}") for c in ("source", "hash", "plan", "copy"))
    per_source = cuts(rows, source_targets(rows, most)).select(F.col("source").alias(of), F.struct("full", "cut").alias(plan))
    joined = join_per_key(docs.withColumn(of, F.col(source)).withColumn(key, id_hash(F.col(doc_id), seed)), per_source, of)
    times = copies(key, plan + ".full", plan + ".cut")
    return joined.filter(times > 0).withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), times))).select(*columns_of(docs))
