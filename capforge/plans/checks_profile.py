"""Checks for profiles, correlations and metrics."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from capforge.functions.scalar import round_doubles
from capforge.operators import metrics as M
from capforge.operators import profile as P
from capforge.plans.checks import register
from capforge.plans.fixtures import table

# lineitem plus a column with gaps and a constant column (FIXTURES §1, generic table)
NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
           "l_discount", "l_tax", "l_discount_gap", "const_one"]
TEXT = ["l_returnflag", "l_linestatus", "l_shipdate"]
ALL = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
       "l_tax", "l_returnflag", "l_linestatus", "l_shipdate", "l_discount_gap", "const_one"]

BASE_SQL = """(SELECT *, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount END AS l_discount_gap,
       CAST(1.0 AS DOUBLE) AS const_one FROM lineitem)"""


def profiled(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("*", F.when(F.col("l_linenumber") == 3, F.lit(None)).otherwise(F.col("l_discount"))
                     .alias("l_discount_gap"), F.lit(1.0).alias("const_one"))


def _union(parts):
    return "\nUNION ALL\n".join(parts)


SPARK_TYPES = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
               "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
               "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}
LINEITEM = list(SPARK_TYPES)


@register("table_metadata", "SELECT * FROM (VALUES " + ", ".join(
    f"({i + 1}, '{c}', '{SPARK_TYPES[c]}', true)" for i, c in enumerate(LINEITEM))
    + ") AS t(ordinal, column_name, data_type, nullable) CROSS JOIN (SELECT count(*) AS row_count FROM lineitem)")
def q_table_metadata(spark, sf_dir):
    return P.table_metadata(table(spark, sf_dir, "lineitem")).drop("sample_rows")


@register("table_metadata_sample", """
WITH c AS (SELECT * FROM (VALUES (1, 'o_orderkey', 'bigint', true), (2, 'o_custkey', 'bigint', true), (3, 'o_orderstatus', 'string', true),
  (4, 'o_totalprice', 'double', true), (5, 'o_orderdate', 'timestamp_ntz', true), (6, 'o_orderpriority', 'string', true))
  AS t(ordinal, column_name, data_type, nullable)),
r AS (SELECT o_orderkey AS k, CAST(to_json(struct_pack(o_orderkey := o_orderkey, o_custkey := o_custkey, o_orderstatus := o_orderstatus,
  o_totalprice := o_totalprice, o_orderdate := strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), o_orderpriority := o_orderpriority)) AS VARCHAR) AS json
  FROM orders ORDER BY o_orderkey LIMIT 3)
SELECT c.*, (SELECT count(*) FROM orders) AS row_count, (SELECT '[' || string_agg(json, ',' ORDER BY k) || ']' FROM r) AS sample_rows FROM c
""")
def q_table_metadata_sample(spark, sf_dir):
    """With the first three rows by key."""
    return P.table_metadata(table(spark, sf_dir, "orders"), 3, ["o_orderkey"])


def _numeric_sql(cols=NUMERIC):
    return _union([
        f"""SELECT '{c}' AS "column", round(min(CAST({c} AS DOUBLE)), 6) AS min, round(max(CAST({c} AS DOUBLE)), 6) AS max,
       round(avg(CAST({c} AS DOUBLE)), 6) AS mean, round(median(CAST({c} AS DOUBLE)), 6) AS median,
       round(stddev_samp(CAST({c} AS DOUBLE)), 6) AS std FROM {BASE_SQL} b""" for c in cols])


@register("profile_numeric", _numeric_sql())
def q_profile_numeric(spark, sf_dir):
    return round_doubles(P.profile_numeric(profiled(spark, sf_dir)))


@register("profile_categorical", _union([
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS unique_count FROM lineitem""" for c in TEXT]))
def q_profile_categorical(spark, sf_dir):
    return P.profile_categorical(profiled(spark, sf_dir))


def _top_sql(k=5):
    counts = _union([f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS count
       FROM lineitem WHERE {c} IS NOT NULL GROUP BY 2""" for c in TEXT])
    return f"""SELECT "column", rank, value, count FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS INTEGER) AS rank
  FROM ({counts})) WHERE rank <= {k}"""


@register("top_values", _top_sql())
def q_top_values(spark, sf_dir):
    return P.top_values(profiled(spark, sf_dir), 5)


FLOATING = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_discount_gap", "const_one")


def _missing_sql():
    def cond(c):
        return f"{c} IS NULL OR isnan({c})" if c in FLOATING else f"{c} IS NULL"
    return _union([f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {cond(c)}) AS missing
       FROM {BASE_SQL} b""" for c in ALL])


@register("missing_counts", _missing_sql())
def q_missing_counts(spark, sf_dir):
    return P.missing_counts(profiled(spark, sf_dir))


def _stats_sql():
    n = f"SELECT '*' AS \"column\", 'row_count' AS stat, CAST(NULL AS VARCHAR) AS item, CAST(count(*) AS DOUBLE) AS value FROM lineitem"
    cc = f"SELECT '*', 'column_count', NULL, CAST({len(ALL)} AS DOUBLE)"
    num = f"""SELECT "column", s.stat, CAST(NULL AS VARCHAR), s.value FROM ({_numeric_sql()}) x,
       LATERAL (VALUES ('min', x.min), ('max', x.max), ('mean', x.mean), ('median', x.median), ('std', x.std)) s(stat, value)"""
    uq = f"""SELECT "column", 'unique_count', NULL, CAST(unique_count AS DOUBLE) FROM ({_union([
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS unique_count FROM lineitem" for c in TEXT])})"""
    top = f"""SELECT "column", 'top_value', value, CAST(count AS DOUBLE) FROM ({_top_sql()})"""
    miss = f"""SELECT "column", 'missing', NULL, CAST(missing AS DOUBLE) FROM ({_missing_sql()})"""
    types = {**SPARK_TYPES, "l_discount_gap": "double", "const_one": "double"}
    return _union([n, cc, _dtype_sql([(c, types[c]) for c in ALL]), num, uq, top, miss])


def _dtype_sql(pairs) -> str:
    rows = ", ".join(f"('{c}', '{t}')" for c, t in pairs)
    return f"""SELECT c, 'dtype', t, CAST(NULL AS DOUBLE) FROM (VALUES {rows}) AS v(c, t)"""


@register("dataset_statistics", _stats_sql())
def q_dataset_statistics(spark, sf_dir):
    return round_doubles(P.dataset_statistics(profiled(spark, sf_dir)))


def _corr_sql(x, y):
    return (f"CASE WHEN stddev_samp(CASE WHEN {y} IS NOT NULL THEN {x} END) * stddev_samp(CASE WHEN {x} IS NOT NULL THEN {y} END) > 0 "
            f"THEN covar_samp({x}, {y}) / (stddev_samp(CASE WHEN {y} IS NOT NULL THEN {x} END) * "
            f"stddev_samp(CASE WHEN {x} IS NOT NULL THEN {y} END)) END")


@register("target_correlation", _union([
    f"SELECT '{c}' AS feature, round({_corr_sql(f'CAST({c} AS DOUBLE)', 'l_extendedprice')}, 6) AS correlation FROM {BASE_SQL} b"
    for c in NUMERIC if c != "l_extendedprice"]))
def q_target_correlation(spark, sf_dir):
    return round_doubles(P.target_correlation(profiled(spark, sf_dir), "l_extendedprice"))


@register("correlation_matrix", _union([
    f"SELECT '{a}' AS column_1, '{b}' AS column_2, round({_corr_sql(f'CAST({a} AS DOUBLE)', f'CAST({b} AS DOUBLE)')}, 6) AS correlation FROM {BASE_SQL} x"
    for a, b in itertools.combinations(NUMERIC, 2)]))
def q_correlation_matrix(spark, sf_dir):
    return round_doubles(P.correlation_matrix(profiled(spark, sf_dir)))


def _class_sql(label: str, pred: str) -> str:
    return f"""
WITH p AS (SELECT CAST({label} AS DOUBLE) AS y, CAST({pred} AS DOUBLE) AS p FROM lineitem),
cls AS (SELECT c, sum(tp) AS tp, sum(sup) AS support, sum(pr) AS predicted FROM (
  SELECT y AS c, CASE WHEN y = p THEN 1 ELSE 0 END AS tp, 1 AS sup, 0 AS pr FROM p
  UNION ALL SELECT p, 0, 0, 1 FROM p) GROUP BY c),
m AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS prec,
                CASE WHEN support > 0 THEN tp / support ELSE 0 END AS rec FROM cls)
SELECT round(sum(tp) / sum(support), 6) AS accuracy,
  round(sum(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END * support) / sum(support), 6) AS f1,
  round(sum(prec * support) / sum(support), 6) AS precision,
  round(sum(rec * support) / sum(support), 6) AS recall
FROM m"""


@register("classification_metrics", _class_sql("l_linenumber % 3", "CAST(floor(l_quantity) AS INTEGER) % 3"))
def q_classification_metrics(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 3).alias("label"),
                                                 (F.col("l_quantity").cast("int") % 3).alias("prediction"))
    return round_doubles(M.classification_metrics(li, "label", "prediction"))


@register("classification_metrics_unpredicted", _class_sql("l_linenumber % 4", "l_linenumber % 3"))
def q_classification_metrics_unpredicted(spark, sf_dir):
    """Class 3 occurs as a label but is never predicted: its precision counts as 0."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 4).alias("label"),
                                                 (F.col("l_linenumber") % 3).alias("prediction"))
    return round_doubles(M.classification_metrics(li, "label", "prediction"))


@register("regression_metrics", """
WITH e AS (SELECT l_extendedprice AS y, l_extendedprice - l_quantity * 1500 AS e FROM lineitem)
SELECT round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae,
  round(CASE WHEN var_pop(y) > 0 THEN 1 - avg(e * e) / var_pop(y) WHEN avg(e * e) = 0 THEN 1.0 ELSE 0.0 END, 6) AS r2
FROM e
""")
def q_regression_metrics(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("label"),
                                                 (F.col("l_quantity") * 1500).alias("prediction"))
    return round_doubles(M.regression_metrics(li, "label", "prediction"))


@register("auc", """
WITH s AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_quantity AS sc FROM lineitem),
r AS (SELECT y, rank() OVER (ORDER BY sc) + (count(*) OVER (PARTITION BY sc) - 1) / 2.0 AS avg_rank FROM s),
t AS (SELECT sum(avg_rank) FILTER (WHERE y = 1) AS rs, count(*) FILTER (WHERE y = 1) AS pos,
             count(*) FILTER (WHERE y = 0) AS neg FROM r)
SELECT round((rs - pos * (pos + 1) / 2.0) / (pos * neg), 6) AS auc FROM t
""")
def q_auc(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("label"),
                                                 F.col("l_quantity").alias("score"))
    return round_doubles(M.auc(li, "label", "score"))


@register("auc_many_scores", """
WITH s AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_extendedprice AS sc FROM lineitem),
r AS (SELECT y, rank() OVER (ORDER BY sc) + (count(*) OVER (PARTITION BY sc) - 1) / 2.0 AS avg_rank FROM s),
t AS (SELECT sum(avg_rank) FILTER (WHERE y = 1) AS rs, count(*) FILTER (WHERE y = 1) AS pos,
             count(*) FILTER (WHERE y = 0) AS neg FROM r)
SELECT round((rs - pos * (pos + 1) / 2.0) / (pos * neg), 6) AS auc FROM t
""")
def q_auc_many_scores(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("label"),
                                                 F.col("l_extendedprice").alias("score"))
    return round_doubles(M.auc(li, "label", "score"))


# ---------------------------------------------------------------- the same profiles on other tables
def _profile_sql(base: str, numeric, text, all_cols, floating, types) -> str:
    num = [f"""SELECT '{c}' AS "column", s.stat, CAST(NULL AS VARCHAR) AS item, s.value FROM (
      SELECT round(min(CAST({c} AS DOUBLE)), 6) AS mn, round(max(CAST({c} AS DOUBLE)), 6) AS mx,
             round(avg(CAST({c} AS DOUBLE)), 6) AS me, round(median(CAST({c} AS DOUBLE)), 6) AS md,
             round(stddev_samp(CAST({c} AS DOUBLE)), 6) AS sd FROM {base} b) x,
      LATERAL (VALUES ('min', x.mn), ('max', x.mx), ('mean', x.me), ('median', x.md), ('std', x.sd)) s(stat, value)"""
           for c in numeric]
    uq = [f"""SELECT '{c}', 'unique_count', NULL, CAST(count(DISTINCT {c}) AS DOUBLE) FROM {base} b""" for c in text]
    counts = _union([f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS count
       FROM {base} b WHERE {c} IS NOT NULL GROUP BY 2""" for c in text])
    top = [f"""SELECT "column", 'top_value', value, CAST(count AS DOUBLE) FROM (
      SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS rank FROM ({counts}))
      WHERE rank <= 5"""] if text else []
    miss = [f"""SELECT '{c}', 'missing', NULL, CAST(count(*) FILTER (WHERE {c} IS NULL{' OR isnan(' + c + ')' if c in floating else ''}) AS DOUBLE) FROM {base} b"""
            for c in all_cols]
    head = [f"""SELECT '*' AS "column", 'row_count' AS stat, CAST(NULL AS VARCHAR) AS item, CAST(count(*) AS DOUBLE) AS value FROM {base} b""",
            f"SELECT '*', 'column_count', NULL, CAST({len(all_cols)} AS DOUBLE)"]
    return _union(head + [_dtype_sql([(c, types[c]) for c in all_cols])] + num + uq + top + miss)


@register("dataset_statistics_documents", _profile_sql(
    "documents", ["doc_id", "n_chars"], ["text", "lang", "source"], ["doc_id", "text", "lang", "source", "n_chars"], (),
    {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}))
def q_dataset_statistics_documents(spark, sf_dir):
    """Statistics of a text table: whole texts are the values counted for distinct and top values."""
    return round_doubles(P.dataset_statistics(table(spark, sf_dir, "documents")))


@register("dataset_statistics_customer", _profile_sql(
    "customer", ["c_custkey", "c_nationkey", "c_acctbal"], ["c_name", "c_mktsegment"],
    ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], ("c_acctbal",),
    {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}))
def q_dataset_statistics_customer(spark, sf_dir):
    return round_doubles(P.dataset_statistics(table(spark, sf_dir, "customer")))


@register("dataset_statistics_part", _profile_sql(
    "part", ["p_partkey", "p_size", "p_retailprice"], ["p_name", "p_brand", "p_type"],
    ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"], ("p_retailprice",),
    {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int",
     "p_retailprice": "double"}))
def q_dataset_statistics_part(spark, sf_dir):
    return round_doubles(P.dataset_statistics(table(spark, sf_dir, "part")))
