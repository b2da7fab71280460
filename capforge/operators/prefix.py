"""Distributed running counts over a global order.

A window over a whole column would put every value into one task, so instead:

1. the (already de-duplicated) rows are range-sorted once and written with the number of the partition
   that each row fell into; everything after reads that table, so a row's partition is a stored value
   and not the outcome of another sampling of range bounds;
2. each partition is summed per group (at most ``partitions x groups`` rows), and running sums over
   these give every partition its offset;
3. a running sum inside each stored partition is added to the partition's offset.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capforge.session import materialised


def running_counts(df: DataFrame, groups: Sequence[str], order: str | Sequence[str], weight: str) -> DataFrame:
    """Add ``__before``: sum of ``weight`` over rows of the same group ordered strictly before.

    ``(groups, order)`` must be unique (aggregate first). The sorted rows are written to the shared folder.
    """
    groups, order = list(groups), [order] if isinstance(order, str) else list(order)
    rows = materialised(df.orderBy(*groups, *order).withColumn("__part", F.spark_partition_id()), "sorted")
    sums = rows.groupBy(*groups, "__part").agg(F.sum(weight).alias("__sum"))
    upto = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(g).alias(f"__group{i}") for i, g in enumerate(groups)], F.col("__part").alias("__in"),
                          F.coalesce(F.sum("__sum").over(upto), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*groups, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("__local", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    same = F.col("__part") == F.col("__in")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"__group{i}"))
    joined = local.join(offsets, same)
    return joined.withColumn("__before", F.col("__local") + F.col("__offset")).select(*df.columns, "__before")
