"""Checks for the declared feature-pipeline steps."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from capforge.functions.scalar import round_doubles
from capforge.plans import pipeline as PL
from capforge.plans.checks import register
from capforge.plans.fixtures import table


@register("step_filter", "SELECT * FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
def q_step_filter(spark, sf_dir):
    return PL.step_filter(table(spark, sf_dir, "orders"), "o_totalprice > 100000 AND o_orderstatus = 'F'")


@register("step_aggregate", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 6) AS sum_qty, round(avg(l_extendedprice), 6) AS avg_price,
       count(*) AS n_rows
FROM lineitem GROUP BY l_returnflag, l_linestatus
""")
def q_step_aggregate(spark, sf_dir):
    return round_doubles(PL.step_aggregate(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"],
                                           {"sum_qty": "sum(l_quantity)", "avg_price": "avg(l_extendedprice)",
                                            "n_rows": "count(*)"}))


@register("step_date_conversion", """
SELECT o_orderkey, strftime(l_shipdate, '%Y-%m') AS ship_month_text, date_trunc('month', l_shipdate) AS l_shipdate
FROM (SELECT l_orderkey AS o_orderkey, l_shipdate FROM lineitem)
""")
def q_step_date_conversion(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    li = PL.step_date_conversion(li, "l_shipdate", to="string", format="yyyy-MM", name="ship_month_text")
    return PL.step_date_conversion(li, "l_shipdate", to="trunc", unit="month")


@register("step_join", "SELECT * FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def q_step_join(spark, sf_dir):
    return PL.step_join(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"),
                        [["o_custkey", "c_custkey"]], "INNER")


# One pipeline's step rows, as they would sit in the step table (valid JSON parameters).
PIPELINE_STEPS = [
    {"pipeline_id": "p1", "feature_name": "segment_month_total", "function_name": "filter",
     "input_param_value": json.dumps({"condition": "o_orderstatus <> 'P'"}), "sequence_num": 1},
    {"pipeline_id": "p1", "feature_name": "segment_month_total", "function_name": "JOIN",
     "input_param_value": json.dumps({"table": "customer", "on": [["o_custkey", "c_custkey"]], "how": "INNER"}),
     "sequence_num": 2},
    {"pipeline_id": "p1", "feature_name": "segment_month_total", "function_name": "aggregate",
     "input_param_value": json.dumps({"group_by": ["c_mktsegment", "c_nationkey"],
                                      "aggregations": {"n_orders": "count(*)", "total": "sum(o_totalprice)"}}),
     "sequence_num": 3},
    {"pipeline_id": "p1", "feature_name": "segment_month_total", "function_name": "shift",
     "input_param_value": json.dumps({"partition_by": ["c_mktsegment"], "order_by": ["c_nationkey"],
                                      "column": "total", "periods": 1, "name": "prev_total"}),
     "sequence_num": 4},
]


@register("run_pipeline", """
WITH a AS (
  SELECT c_mktsegment, c_nationkey, count(*) AS n_orders, sum(o_totalprice) AS total
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o_orderstatus <> 'P'
  GROUP BY c_mktsegment, c_nationkey
)
SELECT c_mktsegment, c_nationkey, n_orders, round(total, 6) AS total,
       round(lag(total) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey), 6) AS prev_total
FROM a
""")
def q_run_pipeline(spark, sf_dir):
    steps = spark.createDataFrame(PIPELINE_STEPS[::-1])  # stored order does not matter: sequence_num does
    out = PL.run_pipeline(table(spark, sf_dir, "orders"), steps, "p1", {"customer": table(spark, sf_dir, "customer")})
    return round_doubles(out)


@register("horizon_split", """
SELECT *, CASE WHEN l_shipdate >= TIMESTAMP '1999-01-01' - INTERVAL 84 DAY AND l_shipdate < TIMESTAMP '1999-01-01' THEN 'train'
               WHEN l_shipdate >= TIMESTAMP '1999-01-01' AND l_shipdate < TIMESTAMP '1999-01-01' + INTERVAL 28 DAY THEN 'horizon_1'
               ELSE 'horizon_2' END AS part
FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1999-01-01' - INTERVAL 84 DAY AND l_shipdate < TIMESTAMP '1999-01-01' + INTERVAL 56 DAY
""")
def q_horizon_split(spark, sf_dir):
    return PL.horizon_split(table(spark, sf_dir, "lineitem"), "l_shipdate", "1999-01-01", 12, 4, 8)
