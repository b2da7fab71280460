"""Checks for projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from capforge.functions.scalar import round_doubles
from capforge.operators import relational as R
from capforge.plans.checks import device_sql, register
from capforge.plans.fixtures import device_metrics, host_metrics, table

# Registry stand-ins (FIXTURES §1 registries): datasets = orders, models = orders.
UUID_SQL = ("substr(md5(CAST({k} AS VARCHAR)), 1, 8) || '-' || substr(md5(CAST({k} AS VARCHAR)), 9, 4) || '-' || "
            "substr(md5(CAST({k} AS VARCHAR)), 13, 4) || '-' || substr(md5(CAST({k} AS VARCHAR)), 17, 4) || '-' || "
            "substr(md5(CAST({k} AS VARCHAR)), 21, 12)")


def uuid_of(col: str):
    h = F.md5(F.col(col).cast("string"))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def datasets_registry(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("project_id"),
                    F.col("o_orderpriority").alias("name"),
                    F.concat(F.lit("orders_"), F.col("o_orderkey").cast("string"), F.lit(".csv")).alias("filename"),
                    F.col("o_orderdate").alias("created_at"))


DATASETS_SQL = """
SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS project_id, o_orderpriority AS name,
       'orders_' || CAST(o_orderkey AS VARCHAR) || '.csv' AS filename, o_orderdate AS created_at
FROM orders
"""


def models_registry(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(uuid_of("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("project_id"),
                    F.col("o_orderkey").cast("string").alias("dataset_id"),
                    F.col("o_orderkey").alias("selection_id"),
                    F.when(F.col("o_orderstatus") == "F", "classification").otherwise("regression").alias("task_type"),
                    F.lit("Target").alias("target_column"),
                    F.create_map(F.lit("accuracy"), F.col("o_totalprice") / 1e6).alias("metrics"),
                    F.concat(F.lit("models/"), F.col("o_orderkey").cast("string")).alias("artifact_path"))


@register("lookup_by_key", """
SELECT * FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'
ORDER BY o_totalprice DESC, o_orderkey LIMIT 1
""")
def q_lookup_by_key(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    o = o.withColumn("__neg", -F.col("o_totalprice"))
    return R.lookup_by_key(o, order=["__neg", "o_orderkey"], o_orderstatus="O",
                           o_orderpriority="1-URGENT").drop("__neg")


@register("search_name", "SELECT * FROM part WHERE p_name ILIKE '%RING%'")
def q_search_name(spark, sf_dir):
    return R.search_name(table(spark, sf_dir, "part"), "p_name", "RING")


@register("select_requested", """
SELECT l_shipdate, l_quantity, CAST(NULL AS VARCHAR) AS not_a_column, l_orderkey FROM lineitem
""")
def q_select_requested(spark, sf_dir):
    return R.select_requested(table(spark, sf_dir, "lineitem"), "l_shipdate, l_quantity,not_a_column , l_orderkey")


@register("select_numeric", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem
""")
def q_select_numeric(spark, sf_dir):
    return R.select_numeric(table(spark, sf_dir, "lineitem"))


@register("require_columns", "SELECT l_orderkey, l_quantity, l_shipdate FROM lineitem")
def q_require_columns(spark, sf_dir):
    return R.require_columns(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_quantity", "l_shipdate"])


@register("parse_dates", "SELECT o_orderkey, o_orderdate AS o_orderdate_text FROM orders")
def q_parse_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate_text"))
    return R.parse_dates(o, "o_orderdate_text", strict=True)


@register("date_offsets", f"""
SELECT *, "Date" + INTERVAL 14 DAY AS "Date_Next_2Weeks", "Date" + INTERVAL 21 DAY AS "Date_Next_3Weeks"
FROM ({device_sql()}) d
""")
def q_date_offsets(spark, sf_dir):
    return R.date_offsets(device_metrics(spark, sf_dir), "Date")


HOST_ID_SQL = "CAST(NULLIF(regexp_extract(trim({c}), '[0-9]+', 0), '') AS INTEGER)"


@register("host_id_extract", f"""
SELECT name, {HOST_ID_SQL.format(c='name')} AS host_id
FROM (SELECT s_name AS name FROM supplier UNION ALL SELECT n_name FROM nation
      UNION ALL SELECT c_mktsegment FROM customer)
""")
def q_host_id_extract(spark, sf_dir):
    names = (table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))
             .unionByName(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")))
             .unionByName(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name"))))
    return R.host_id_extract(names, "name")


@register("filter_optional", f"""
SELECT * FROM (SELECT h.*, {HOST_ID_SQL.format(c='hostname')} AS host_id FROM (
  SELECT s.s_name AS hostname, l.l_shipdate AS datetime, l.l_orderkey, l.l_linenumber
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey) h) WHERE host_id = 7
""")
def q_filter_optional(spark, sf_dir):
    h = R.host_id_extract(host_metrics(spark, sf_dir).select("hostname", "datetime", "l_orderkey", "l_linenumber"))
    return R.filter_optional(h, "host_id", 7)


@register("filter_optional_all", f"""
SELECT h.*, {HOST_ID_SQL.format(c='hostname')} AS host_id FROM (
  SELECT s.s_name AS hostname, l.l_shipdate AS datetime, l.l_orderkey, l.l_linenumber
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey) h
""")
def q_filter_optional_all(spark, sf_dir):
    h = R.host_id_extract(host_metrics(spark, sf_dir).select("hostname", "datetime", "l_orderkey", "l_linenumber"))
    return R.filter_optional(h, "host_id", None)


@register("threshold_flags", f"""
SELECT *, CAST(coalesce("Value" > 70, false) AS INTEGER) AS "Value_Above_70",
          CAST(coalesce("Value" >= 80, false) AS INTEGER) AS "Value_AtLeast_80"
FROM ({device_sql()}) d
""")
def q_threshold_flags(spark, sf_dir):
    return R.threshold_flags(device_metrics(spark, sf_dir), "Value", 70.0, 80.0)


@register("fill_missing", """
SELECT l_orderkey, l_linenumber, round(coalesce(CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount END, 0), 6)
       AS l_discount_gap, l_returnflag, l_shipdate
FROM lineitem
""")
def q_fill_missing(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_linenumber") == 3, F.lit(None)).otherwise(F.col("l_discount")).alias("l_discount_gap"),
        "l_returnflag", "l_shipdate")
    return round_doubles(R.fill_missing(li, 0))


# ISO text has a fraction only where it isn't zero.
_ISO_SQL = """CASE WHEN date_part('microseconds', {c}) % 1000000 = 0 THEN strftime({c}, '%Y-%m-%dT%H:%M:%S')
  ELSE strftime({c}, '%Y-%m-%dT%H:%M:%S.%f') END"""


@register("rows_to_json_fractions", f"""
SELECT CAST(to_json(struct_pack(event_id := event_id, moment := {_ISO_SQL.format(c="moment")}, raw := raw)) AS VARCHAR) AS json
FROM (SELECT event_id, ts + to_microseconds(CASE WHEN event_id % 2 = 0 THEN 250000 ELSE 0 END)
             - to_microseconds(date_part('microseconds', ts) % 1000000) AS moment,
             CASE WHEN event_id % 3 = 0 THEN 'ab' ELSE 'é' END AS raw FROM events)
""")
def q_rows_to_json_fractions(spark, sf_dir):
    """Times with and without a fraction; bytes that aren't UTF-8 left out."""
    whole = F.date_trunc("second", F.col("ts")).cast("timestamp_ntz")
    quarter = F.expr("make_dt_interval(0, 0, 0, CASE WHEN event_id % 2 = 0 THEN 0.25 ELSE 0 END)")
    raw = F.when(F.col("event_id") % 3 == 0, F.unhex(F.lit("61FF62"))).otherwise(F.encode(F.lit("é"), "UTF-8"))
    return R.rows_to_json(table(spark, sf_dir, "events").select("event_id", (whole + quarter).alias("moment"), raw.alias("raw")))


@register("rows_to_json", f"""
SELECT CAST(to_json(struct_pack(o_orderkey := o_orderkey, o_custkey := o_custkey, o_orderstatus := o_orderstatus,
  o_totalprice := o_totalprice, o_orderdate := {_ISO_SQL.format(c='o_orderdate')},
  o_orderpriority := o_orderpriority)) AS VARCHAR) AS json
FROM orders
""")
def q_rows_to_json(spark, sf_dir):
    return R.rows_to_json(table(spark, sf_dir, "orders"))


@register("project_registry", f"""
SELECT id, name, 'Filename: ' || filename AS description, filename AS offline_dataset_path, created_at
FROM ({DATASETS_SQL}) d
""")
def q_project_registry(spark, sf_dir):
    return R.project_registry(datasets_registry(spark, sf_dir))


@register("model_label", f"""
SELECT id, task_type,
  CASE task_type WHEN 'classification' THEN 'Classification' WHEN 'time_series' THEN 'Time_Series' ELSE 'Multi-Class Regression' END
    || 'Model-' || substr(id, 1, 6) AS model_name,
  replace(id, '-', '_') AS table_suffix
FROM (SELECT {UUID_SQL.format(k='o_orderkey')} AS id,
             CASE o_orderstatus WHEN 'F' THEN 'classification' WHEN 'O' THEN 'time_series' ELSE 'multi-class REGRESSION' END AS task_type
      FROM orders)
""")
def q_model_label(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    task = F.when(F.col("o_orderstatus") == "F", "classification").when(F.col("o_orderstatus") == "O", "time_series").otherwise(
        "multi-class REGRESSION")
    return R.model_label(o.select(uuid_of("o_orderkey").alias("id"), task.alias("task_type")))
