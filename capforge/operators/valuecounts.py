"""Distinct values and the most frequent ones, counted by digest.

Cells are counted by (column, digest of 128 bits, first ``PIECE`` characters), so a shuffled row has a bounded size
however long the texts are. The counts are written once; the number of distinct values and the most frequent ones
come from them. Values no longer than a piece are whole already. Of longer ones only the candidates for the
first k places are read again, by a join of their digests with the table; candidates that share count and piece are told apart by
longer pieces first, until few are left.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capforge.session import materialised

#: Characters of a value that its count carries, and by how much longer pieces grow.
PIECE, GROWTH = 32, 8
#: Values whose whole texts may be read at once.
FETCHED = 1000


def quoted(name: str) -> str:
    """A column name quoted for SQL text."""
    return "`" + name.replace("`", "``") + "`"


def _cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(id, value): every cell of the columns as text, NULL where missing."""
    pairs = ", ".join(f"named_struct('id', {i}, 'value', CAST({quoted(c)} AS STRING))" for i, c in enumerate(columns))
    return df.select(F.expr(f"inline(array({pairs}))"))


def _digests(cells: DataFrame, length: int, *kept: str | Column) -> DataFrame:
    """(id, h1, h2, piece, whole); the digests are two hashes with different seeds."""
    value = F.col("value")
    return cells.select("id", F.when(value.isNotNull(), F.xxhash64(value)).alias("h1"),
                        F.when(value.isNotNull(), F.xxhash64(F.lit("second"), value)).alias("h2"),
                        F.substring(value, 1, length).alias("piece"), (F.char_length(value) <= length).alias("whole"), *kept)


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Stored (id, h1, h2, piece, whole, count), a row for each distinct value of each column; missing cells are a
    value without digest."""
    return materialised(_digests(_cells(df, columns), PIECE).groupBy("id", "h1", "h2", "piece", "whole").agg(
        F.count(F.lit(1)).alias("count")), "value-counts")


def per_column(counts: DataFrame) -> dict[int, tuple[int, int]]:
    """id -> (distinct values, missing cells)."""
    found = counts.groupBy("id").agg(F.count("h1").alias("distinct"), F.coalesce(F.sum(F.when(F.col("h1").isNull(), F.col("count"))), F.lit(0)).alias("missing"))
    return {r.id: (r.distinct, r.missing) for r in found.collect()}


def _leading(counts: DataFrame, k: int, value: str) -> DataFrame:
    """The rows that are among the first k of their column, or share count and ``value`` with the k-th."""
    order = Window.partitionBy("id").orderBy(F.col("count").desc(), value)
    return counts.withColumn("place", F.rank().over(order)).filter(F.col("place") <= k).drop("place")


def top_counts(df: DataFrame, columns: Sequence[str], counts: DataFrame, k: int) -> DataFrame:
    """(id, rank, value, count): the k most frequent values of each column, ties by value."""
    digest, length = ["id", "h1", "h2"], PIECE
    leading = materialised(_leading(counts.filter("h1 is not null"), k, "piece"), "leading")
    order = Window.partitionBy("id").orderBy(F.col("count").desc(), "value")
    while (cut := leading.filter("NOT whole").count()) > FETCHED:
        # very many values of one count that begin alike: compare longer pieces of these
        length *= GROWTH
        longer = _digests(_cells(df, columns), length).join(leading.filter("NOT whole").select(*digest, "count"), digest).dropDuplicates(digest)
        again = leading.filter("whole").unionByName(longer.select(*leading.columns))
        leading = materialised(_leading(again, k, "piece"), "leading")
    values = leading.filter("whole").select("id", F.col("piece").alias("value"), "count")
    if cut:
        few = F.broadcast(leading.filter("NOT whole").select(*digest, "count"))  # at most FETCHED rows
        texts = _digests(_cells(df, columns), 0, "value").join(few, digest).dropDuplicates(digest)
        values = values.unionByName(texts.select("id", "value", "count"))
    return values.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("id", "rank", "value", "count")
