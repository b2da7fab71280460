"""Registered queries over the driver tables and their DuckDB oracles.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs one operator of SURVEY §2 on
whole tables; ``ORACLE[name]`` is SQL computing the same rows in DuckDB over the
same parquet files (views named like the tables). Doubles are rounded to 6
digits on both sides; every computed column has the same alias on both sides.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


# Shared SQL fragments -------------------------------------------------------

DEVICE_SQL = """
SELECT event_type AS "Type", 'app' || CAST(user_id % 7 AS VARCHAR) AS "Application",
       '10.0.0.' || CAST(user_id AS VARCHAR) AS "IP", {date} AS "Date", value AS "Value", event_id
FROM events
"""

HOST_SQL = """
SELECT s.s_name AS hostname, l.l_shipdate AS datetime, l.l_linenumber AS core_number,
       l.l_quantity AS cpu_usage_percentage, l.l_extendedprice AS memory_number,
       l.l_discount * 100 AS memory_usage_percentage, l.l_orderkey, l.l_linenumber
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
"""


def device_sql(truncate: bool = False) -> str:
    return DEVICE_SQL.format(date="date_trunc('day', ts)::TIMESTAMP" if truncate else "ts")


# Import the modules that register queries (order = registration order).
from capforge.plans import checks_windows, checks_relational, checks_joins, checks_profile, checks_ranking  # noqa: E402,F401,E501
from capforge.plans import checks_pipeline, checks_sources, checks_ml  # noqa: E402,F401
