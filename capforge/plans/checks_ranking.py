"""Checks for sorts, pages, previews and feature ranking."""

from __future__ import annotations


from capforge.functions.scalar import round_doubles
from capforge.operators import ranking as K
from capforge.operators import windows as W
from capforge.plans.checks import device_sql, register
from capforge.plans.checks_relational import DATASETS_SQL, datasets_registry
from capforge.plans.checks_windows import _flagship_sql
from capforge.plans.fixtures import device_metrics, table


@register("sort_series", f"""
SELECT * FROM ({device_sql()}) d ORDER BY "Type", "Application", "IP", "Date", event_id
""")
def q_sort_series(spark, sf_dir):
    return K.sort_series(device_metrics(spark, sf_dir), tiebreak=["event_id"])


@register("page", f"""
SELECT d.*, t.total, 3 AS page, 10 AS page_size, t.total_pages FROM (
  SELECT * FROM ({DATASETS_SQL}) x ORDER BY created_at DESC NULLS LAST, id LIMIT 10 OFFSET 20) d
CROSS JOIN (SELECT count(*) AS total, CAST(ceil(count(*) / 10.0) AS BIGINT) AS total_pages FROM orders) t
""")
def q_page(spark, sf_dir):
    return K.page(datasets_registry(spark, sf_dir), "created_at", "id", page_no=3, size=10)


_LI_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
             "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@register("preview", f"SELECT * FROM lineitem ORDER BY {', '.join(_LI_ORDER)} LIMIT 5")
def q_preview(spark, sf_dir):
    return K.preview(table(spark, sf_dir, "lineitem"), _LI_ORDER, 5)


_FEATS = ["Value", "event_id", "Value_target_Max", *W.FEATURE_COLUMNS[2:]]


def _ranked_sql() -> str:
    flag = _flagship_sql(False, rounded=False)
    corr = lambda x: (f"CASE WHEN stddev_samp(CAST({x} AS DOUBLE)) * stddev_samp(CAST(\"Target\" AS DOUBLE)) > 0 "  # noqa: E731
                      f"THEN covar_samp(CAST({x} AS DOUBLE), CAST(\"Target\" AS DOUBLE)) / "
                      f"(stddev_samp(CAST({x} AS DOUBLE)) * stddev_samp(CAST(\"Target\" AS DOUBLE))) END")
    parts = "\nUNION ALL\n".join(f"SELECT '{c}' AS feature, {corr(chr(34) + c + chr(34))} AS correlation FROM f"
                                 for c in _FEATS)
    return f"""WITH f AS ({flag}),
c AS ({parts}),
r AS (SELECT *, CAST(row_number() OVER (ORDER BY abs(correlation) DESC NULLS LAST, feature) AS INTEGER) AS rank FROM c)"""


@register("select_top_features", _ranked_sql() + "\nSELECT rank, feature, round(correlation, 6) AS correlation FROM r WHERE rank <= 10")
def q_select_top_features(spark, sf_dir):
    feats = W.engineer_features(device_metrics(spark, sf_dir), tiebreak=["event_id"])
    return round_doubles(K.select_top_features(feats, "Target", k=10))


@register("dropped_features", _ranked_sql() + f"\nSELECT feature, '{K.DROP_REASON}' AS reason FROM r WHERE rank > 10")
def q_dropped_features(spark, sf_dir):
    feats = W.engineer_features(device_metrics(spark, sf_dir), tiebreak=["event_id"])
    return K.dropped_features(feats, "Target", k=10)


@register("list_projects", """
WITH p AS (
  SELECT c.c_custkey, c.c_name, c.c_acctbal, CAST(coalesce(n, 0) AS BIGINT) AS dataset_count
  FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o
    ON o.o_custkey = c.c_custkey
  WHERE c.c_name ILIKE '%00001%'
)
SELECT x.*, t.total, 2 AS page, 20 AS page_size, t.total_pages FROM (
  SELECT * FROM p ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 20 OFFSET 20) x
CROSS JOIN (SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages FROM p) t
""")
def q_list_projects(spark, sf_dir):
    """Project listing as in the reference: name search, dataset count per project, page 2 of 20."""
    from capforge.operators import joins as J
    from capforge.operators import relational as R

    c = R.search_name(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_name", "00001")
    counted = J.child_count(c, table(spark, sf_dir, "orders"), "c_custkey", "o_custkey")
    return K.page(counted, "c_acctbal", "c_custkey", page_no=2, size=20)
