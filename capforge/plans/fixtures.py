"""Views of the driver's tables in the shapes the operators consume (FIXTURES.md §1).

Each function reads whole tables with ``spark.read.parquet`` and only projects /
joins, so Catalyst prunes columns and pushes filters into the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def device_metrics(spark: SparkSession, sf_dir: str, truncate_to_day: bool = False) -> DataFrame:
    """``(Type, Application, IP, Date, Value, event_id)`` from ``events``.

    ``event_id`` is kept as the unique tie-break of rows sharing a timestamp;
    ``truncate_to_day`` makes many such ties (up to 5 per device and day).
    """
    e = table(spark, sf_dir, "events")
    date = F.date_trunc("day", F.col("ts")).cast("timestamp_ntz") if truncate_to_day else F.col("ts")
    return e.select(
        F.col("event_type").alias("Type"),
        F.concat(F.lit("app"), (F.col("user_id") % 7).cast("string")).alias("Application"),
        F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")).alias("IP"),
        date.alias("Date"),
        F.col("value").alias("Value"),
        F.col("event_id"),
    )


def host_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sample_datasets``-shaped host series from ``lineitem ⋈ supplier``.

    The supplier side is joined on its key; Spark/AQE choose broadcast only when
    the runtime size of that side is under the broadcast threshold.
    """
    li = table(spark, sf_dir, "lineitem")
    su = table(spark, sf_dir, "supplier")
    j = li.join(su, li.l_suppkey == su.s_suppkey, "inner")
    return j.select(
        F.col("s_name").alias("hostname"),
        F.col("l_shipdate").alias("datetime"),
        F.col("l_linenumber").alias("core_number"),
        F.col("l_quantity").alias("cpu_usage_percentage"),
        F.col("l_extendedprice").alias("memory_number"),
        (F.col("l_discount") * F.lit(100)).alias("memory_usage_percentage"),
        F.col("l_orderkey"),
        F.col("l_linenumber"),
    )
