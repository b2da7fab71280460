"""Checks for joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from capforge.functions.scalar import round_doubles
from capforge.operators import joins as J
from capforge.plans.checks import HOST_SQL, register
from capforge.plans.checks_relational import (DATASETS_SQL, HOST_ID_SQL, UUID_SQL, datasets_registry,
                                             models_registry)
from capforge.plans.fixtures import host_metrics, table

_GAP_MEANS = ("core_number", "cpu_usage_percentage", "memory_number", "memory_usage_percentage")

# By definition: every reading with each reading of its host exactly two days later, and the readings
# that have none, with missing means.
GAP_BASE_SQL = f"""
reading AS (
  SELECT hostname, {HOST_ID_SQL.format(c='hostname')} AS host_id, datetime, {', '.join(_GAP_MEANS)} FROM ({HOST_SQL}) h
),
gap AS (
  SELECT r.hostname, r.host_id, r.datetime AS datetime_1, later.datetime AS datetime_2,
    {', '.join(f"round((CAST(r.{c} AS DOUBLE) + later.{c}) / 2, 6) AS {c}_avg" for c in _GAP_MEANS)}
  FROM reading r, reading later
  WHERE later.host_id = r.host_id AND later.datetime - INTERVAL 2 DAY = r.datetime
  UNION ALL
  SELECT hostname, host_id, datetime, NULL, {', '.join('NULL' for _ in _GAP_MEANS)}
  FROM reading r
  WHERE NOT EXISTS (SELECT 1 FROM reading o WHERE o.host_id = r.host_id AND o.datetime - INTERVAL 2 DAY = r.datetime)
)"""


@register("gap_join", f"WITH {GAP_BASE_SQL} SELECT * FROM gap")
def q_gap_join(spark, sf_dir):
    return round_doubles(J.gap_join(host_metrics(spark, sf_dir), gap_days=2))


@register("gap_report", f"""
WITH {GAP_BASE_SQL},
ranked AS (
  SELECT *, CAST(row_number() OVER (ORDER BY host_id NULLS LAST, datetime_1 NULLS LAST, hostname NULLS LAST,
      datetime_2 NULLS LAST, core_number_avg NULLS LAST, cpu_usage_percentage_avg NULLS LAST,
      memory_number_avg NULLS LAST, memory_usage_percentage_avg NULLS LAST) AS INTEGER) AS row_number
  FROM gap
)
SELECT hostname, host_id, datetime_1, datetime_2, cpu_usage_percentage_avg, CAST(NULL AS VARCHAR) AS no_such_column,
       row_number, 2 AS gap_days, 'all' AS host_id_filter, (SELECT count(*) FROM gap) AS row_count
FROM ranked WHERE row_number <= 20
""")
def q_gap_report(spark, sf_dir):
    cols = "hostname,host_id,datetime_1,datetime_2,cpu_usage_percentage_avg,no_such_column"
    return round_doubles(J.gap_report(host_metrics(spark, sf_dir), cols, gap_days=2, n=20))


@register("gap_join_host", f"WITH {GAP_BASE_SQL.replace('INTERVAL 2 DAY', 'INTERVAL 3 DAY')} "
          "SELECT * FROM gap WHERE host_id = 7")
def q_gap_join_host(spark, sf_dir):
    """Gap analysis for one host (the optional host filter) with a 3-day gap."""
    return round_doubles(J.gap_join(host_metrics(spark, sf_dir), gap_days=3, host_id=7))


@register("params_join", f"""
SELECT h.hostname, h.datetime, h.l_orderkey, h.l_linenumber, 2 AS gap_days, CAST(NULL AS INTEGER) AS filter_host_id
FROM ({HOST_SQL}) h
""")
def q_params_join(spark, sf_dir):
    h = host_metrics(spark, sf_dir).select("hostname", "datetime", "l_orderkey", "l_linenumber")
    return J.params_join(h, {"gap_days": 2, "filter_host_id": None}).withColumn(
        "filter_host_id", F.col("filter_host_id").cast("int"))


@register("exists_flag", f"""
SELECT d.*, EXISTS (SELECT 1 FROM lineitem l WHERE l.l_returnflag = 'R' AND CAST(l.l_orderkey AS VARCHAR) = d.id)
       AS has_engineered
FROM ({DATASETS_SQL}) d
""")
def q_exists_flag(spark, sf_dir):
    eng = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").cast("string").alias("dataset_id"))
    return J.exists_flag(datasets_registry(spark, sf_dir), eng, "id", "dataset_id")


@register("child_count", """
SELECT c.c_custkey, c.c_name, CAST(coalesce(n, 0) AS BIGINT) AS dataset_count
FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey
""")
def q_child_count(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return J.child_count(c, table(spark, sf_dir, "orders"), "c_custkey", "o_custkey")


def selections_registry(spark, sf_dir):
    """Selection runs derived from lineitem: one per order, features = its part keys by line number."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_partkey")))),
                    lambda s: F.concat(F.lit("p"), s["l_partkey"].cast("string"))).alias("selected_features"))


@register("model_features", f"""
SELECT {UUID_SQL.format(k='o.o_orderkey')} AS model_id,
  CAST(row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey) - 1 AS INTEGER) AS position,
  'p' || CAST(l.l_partkey AS VARCHAR) AS feature
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey
""")
def q_model_features(spark, sf_dir):
    return J.model_features(models_registry(spark, sf_dir), selections_registry(spark, sf_dir))


@register("purge_project", """
SELECT l.* FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_custkey = 1)
""")
def q_purge_project(spark, sf_dir):
    """Lineitem rows (engineered-table stand-in) left after deleting project 1's datasets."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "id")
    li = table(spark, sf_dir, "lineitem")
    out = J.purge_project(1, {"datasets": (orders, "o_custkey")},
                          {"engineered": (li, "l_orderkey", "datasets")})
    return out["engineered"]


@register("purge_project_datasets", "SELECT * FROM orders WHERE o_custkey IS NULL OR o_custkey <> 1")
def q_purge_project_datasets(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return J.purge_project(1, {"datasets": (orders, "o_custkey")})["datasets"]


@register("gap_join_zero", f"WITH {GAP_BASE_SQL.replace('INTERVAL 2 DAY', 'INTERVAL 0 DAY')} SELECT * FROM gap")
def q_gap_join_zero(spark, sf_dir):
    """Gap 0: every row pairs with itself and with its duplicates at the same (host, time)."""
    return round_doubles(J.gap_join(host_metrics(spark, sf_dir), gap_days=0))


@register("gap_join_negative", f"WITH {GAP_BASE_SQL.replace('- INTERVAL 2 DAY', '+ INTERVAL 5 DAY')} SELECT * FROM gap")
def q_gap_join_negative(spark, sf_dir):
    """Negative gap: pairs each row with the same host's rows 5 days earlier."""
    return round_doubles(J.gap_join(host_metrics(spark, sf_dir), gap_days=-5))
