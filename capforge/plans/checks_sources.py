"""Checks for sources and sinks: write from the driver tables into a
fresh folder under the shared checkpoint folder, read back, compare with the source rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from capforge.functions.scalar import round_doubles
from capforge.session import scratch_dir
from capforge.sources import files as IO
from capforge.sources import registry as REG
from capforge.sources.versions import VersionedTable
from capforge.plans.checks import register
from capforge.plans.checks_relational import DATASETS_SQL, datasets_registry
from capforge.plans.fixtures import table

CUSTOMER_AS_CSV_SQL = """
SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment
FROM customer
"""


@register("scan_csv", CUSTOMER_AS_CSV_SQL)
def q_scan_csv(spark, sf_dir):
    path = scratch_dir(spark, "csv-customer")
    table(spark, sf_dir, "customer").write.option("header", True).csv(path)
    return round_doubles(IO.scan_csv(spark, path))


@register("scan_csv_missing_tokens", """
SELECT c_custkey, CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE round(c_acctbal, 6) END AS c_acctbal,
       CASE WHEN c_nationkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment,
       c_nationkey % 2 = 0 AS even_nation
FROM customer
""")
def q_scan_csv_missing_tokens(spark, sf_dir):
    """pandas missing tokens (``NA``, ``null``, empty) become NULL; ``True``/``False`` become booleans."""
    c = table(spark, sf_dir, "customer")
    text = c.select(
        F.col("c_custkey").cast("string").alias("c_custkey"),
        F.when(F.col("c_nationkey") % 5 == 0, F.lit("NA")).otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal"),
        F.when(F.col("c_nationkey") % 7 == 0, F.lit("null")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
        F.when(F.col("c_nationkey") % 2 == 0, F.lit("True")).otherwise(F.lit("False")).alias("even_nation"))
    path = scratch_dir(spark, "csv-tokens")
    text.write.option("header", True).csv(path)
    return round_doubles(IO.scan_csv(spark, path))


ODD_TEXT_SQL = r"""
SELECT conv_id, CAST(turn AS BIGINT) AS turn, CASE WHEN turn % 2 = 0 THEN 'say "' || role || '", ok' ELSE 'end"\' END AS quoted,
       CASE WHEN turn % 2 = 0 THEN 'two' || chr(10) || 'lines' ELSE 'one, line' END AS broken,
       CAST(turn AS VARCHAR) || 'D' AS code, TIMESTAMP '2024-01-02 03:04:05' + to_seconds(turn) AS moment,
       turn % 3 = 0 AS third, text
FROM conversations
"""


def _odd_text(spark, sf_dir):
    even = F.col("turn") % 2 == 0
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(even, F.concat(F.lit('say "'), F.col("role"), F.lit('", ok'))).otherwise('end"\\').alias("quoted"),
        F.when(even, "two\nlines").otherwise("one, line").alias("broken"), F.concat(F.col("turn").cast("string"), F.lit("D")).alias("code"),
        F.expr("timestamp_ntz'2024-01-02 03:04:05' + make_dt_interval(0, 0, 0, turn)").alias("moment"),
        (F.col("turn") % 3 == 0).alias("third"), "text")


@register("csv_round_trip", ODD_TEXT_SQL)
def q_csv_round_trip(spark, sf_dir):
    """Quoted quotes, a backslash before a closing quote, line breaks, codes that look like numbers, times, whole texts."""
    path = scratch_dir(spark, "csv-odd")
    IO.sink_csv(_odd_text(spark, sf_dir), path)
    return IO.scan_csv(spark, path).withColumn("moment", F.col("moment").cast("timestamp_ntz"))


@register("csv_times_as_text", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || CASE WHEN o_orderkey % 2 = 0 THEN '.500000' ELSE '' END AS moment
FROM orders
""")
def q_csv_times_as_text(spark, sf_dir):
    """Written times as the text that is in the file."""
    path = scratch_dir(spark, "csv-times")
    half = F.expr("make_dt_interval(0, 0, 0, CASE WHEN o_orderkey % 2 = 0 THEN 0.5 ELSE 0 END)")
    IO.sink_csv(table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderdate").cast("timestamp_ntz") + half).alias("moment")), path)
    return IO.scan_csv(spark, path)


@register("csv_short_rows", """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS c_name,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE round(c_acctbal, 6) END AS c_acctbal
FROM customer
""")
def q_csv_short_rows(spark, sf_dir):
    """Rows with fewer cells than the header get missing values (files split into lines)."""
    path = scratch_dir(spark, "csv-short")
    c = table(spark, sf_dir, "customer")
    line = F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey").cast("string")).otherwise(
        F.concat_ws(",", "c_custkey", "c_name", "c_acctbal"))
    lines = c.select(line.alias("value"))
    header = "c_custkey,c_name,c_acctbal"

    def with_header(batches):
        yield pa.RecordBatch.from_arrays([pa.array([header])], ["value"])
        yield from batches

    spark.createDataFrame([(header,)], "value string").write.text(path)  # also without rows a file has the header
    lines.mapInArrow(with_header, "value string").write.mode("append").text(path)
    return round_doubles(IO.scan_csv(spark, path, multi_line=False))


@register("scan_table", "SELECT * FROM lineitem")
def q_scan_table(spark, sf_dir):
    return IO.scan_table(spark, f"{sf_dir.rstrip('/')}/lineitem.parquet")


@register("sink_table", "SELECT * FROM orders")
def q_sink_table(spark, sf_dir):
    path = scratch_dir(spark, "table-orders")
    IO.sink_table(table(spark, sf_dir, "orders"), path)
    return IO.scan_table(spark, path)


@register("sink_csv", CUSTOMER_AS_CSV_SQL)
def q_sink_csv(spark, sf_dir):
    path = scratch_dir(spark, "csv-out")
    IO.sink_csv(table(spark, sf_dir, "customer"), path)
    return round_doubles(IO.scan_csv(spark, path))


@register("ingest_predictions", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(l_quantity * 1500, 6) AS predicted_l_extendedprice
FROM lineitem
""")
def q_ingest_predictions(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") * 1500).alias("predicted_l_extendedprice"))
    src = scratch_dir(spark, "ext-pred-csv")
    li.write.option("header", True).csv(src)
    return round_doubles(IO.ingest_predictions(spark, src, scratch_dir(spark, "ext_pred")))


@register("append_records", DATASETS_SQL)
def q_append_records(spark, sf_dir):
    path = scratch_dir(spark, "registry-datasets")
    d = datasets_registry(spark, sf_dir)
    REG.append_records(d.filter(F.col("name") <= "2"), path)
    REG.append_records(d.filter(F.col("name") > "2"), path)
    return spark.read.parquet(path)


@register("insert_if_absent", f"""
SELECT * FROM ({DATASETS_SQL}) d
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_returnflag = 'R' AND CAST(l.l_orderkey AS VARCHAR) = d.id)
""")
def q_insert_if_absent(spark, sf_dir):
    existing = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").cast("string").alias("id"))
    return REG.insert_if_absent(datasets_registry(spark, sf_dir), existing, "id")


# Declared columns of a dataset-status table (names/types/defaults as a YAML spec would give them).
STATUS_SPEC = [
    {"name": "dataset_id", "type": "VARCHAR", "default": "NULL"},
    {"name": "project_id", "type": "VARCHAR", "default": "NULL"},
    {"name": "num_columns", "type": "INTEGER", "default": "NULL"},
    {"name": "total", "type": "FLOAT", "default": "NULL"},
    {"name": "status", "type": "VARCHAR", "default": "'ON PROGRESS'"},
    {"name": "order_day", "type": "DATE", "default": "NULL"},
]


@register("conform_schema", """
SELECT CAST(o_orderkey AS VARCHAR) AS dataset_id, CAST(o_custkey AS VARCHAR) AS project_id,
       CAST(NULL AS INTEGER) AS num_columns, round(o_totalprice, 6) AS total,
       coalesce(CASE WHEN o_orderstatus = 'F' THEN 'DONE' END, 'ON PROGRESS') AS status,
       CAST(o_orderdate AS DATE) AS order_day
FROM orders
""")
def q_conform_schema(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("dataset_id"), F.col("o_custkey").alias("project_id"),
        F.col("o_totalprice").alias("total"),
        F.when(F.col("o_orderstatus") == "F", "DONE").alias("status"), F.col("o_orderdate").alias("order_day"))
    return round_doubles(REG.conform_schema(o, STATUS_SPEC))


@register("recreate_tables", """
SELECT CAST(o_orderkey AS VARCHAR) AS dataset_id, CAST(o_custkey AS VARCHAR) AS project_id,
       'ON PROGRESS' AS status, CAST(NULL AS INTEGER) AS num_columns
FROM orders
""")
def q_recreate_tables(spark, sf_dir):
    """Declared table re-created empty, then filled from ``orders`` naming only some columns:
    the others take their declared defaults (``'ON PROGRESS'``, ``NOW()``, NULL)."""
    loc = scratch_dir(spark, "declared")
    name = "cf_dataset_status_" + loc.rstrip("/").rsplit("-", 1)[-1]
    spec = [{"table_name": name, "columns": [
        {"name": "dataset_id", "type": "VARCHAR", "default": "NULL"},
        {"name": "project_id", "type": "VARCHAR", "default": "NULL"},
        {"name": "status", "type": "VARCHAR", "default": "'ON PROGRESS'"},
        {"name": "num_columns", "type": "INTEGER", "default": "NULL"},
        {"name": "creation_date", "type": "TIMESTAMPTZ", "default": "NOW()"}]}]
    REG.recreate_tables(spark, spec, loc)
    table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("dataset_id"),
        F.col("o_custkey").cast("string").alias("project_id")).createOrReplaceTempView(f"{name}_src")
    spark.sql(f"INSERT INTO `{name}` (dataset_id, project_id) SELECT dataset_id, project_id FROM `{name}_src`")
    out = spark.table(name)
    if out.filter(F.col("creation_date").isNull()).limit(1).count():
        raise AssertionError("declared NOW() default was not applied")
    return out.drop("creation_date")


@register("versioned_insert", """
SELECT o_custkey AS id, coalesce(min(o_orderkey) FILTER (WHERE o_orderstatus = 'F'), min(o_orderkey)) AS order_key FROM orders GROUP BY o_custkey
""")
def q_versioned_insert(spark, sf_dir):
    """A table of commits: the first inserts of customers come from finished orders, the next ones from all."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("order_key"), "o_orderstatus")
    registry = VersionedTable(spark, scratch_dir(spark, "versions"), "id long, order_key long")
    registry.insert_if_absent(orders.filter("o_orderstatus = 'F'").drop("o_orderstatus"), "id")
    registry.insert_if_absent(orders.drop("o_orderstatus"), "id")
    return registry.read()
