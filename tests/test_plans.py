"""The physical plans keep the properties the operators are designed for."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_step_is_pushed_into_the_scan(spark):
    p = plan(E.queries()["step_filter"](spark, SF))
    assert "PushedFilters: [IsNotNull(o_totalprice), IsNotNull(o_orderstatus), GreaterThan(o_totalprice,100000.0)" in p


def test_projection_is_pruned_at_the_scan(spark):
    p = plan(E.queries()["select_requested"](spark, SF))
    scan = [line for line in p.splitlines() if "FileScan parquet" in line][0]
    assert "FileScan parquet [l_orderkey#" in scan or "FileScan parquet [l_quantity#" in scan
    for dropped in ("l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag"):
        assert dropped not in scan


@pytest.mark.parametrize("name", ["lookup_by_key", "preview", "page"])
def test_first_rows_are_a_top_n_not_a_sort(spark, name):
    p = plan(E.queries()[name](spark, SF))
    assert "TakeOrderedAndProject" in p
    assert "Exchange rangepartitioning" not in p


@pytest.mark.parametrize("name", ["gap_join", "exists_flag", "child_count", "step_join", "model_features",
                                  "purge_project", "insert_if_absent"])
def test_joins_are_equi_joins(spark, name):
    p = plan(E.queries()[name](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_gap_join_partitions_on_host_and_time(spark):
    p = plan(E.queries()["gap_join"](spark, SF))
    assert "hashpartitioning(host_id" in p and "__t" in p


def test_flagship_has_no_sliding_window(spark):
    """One pass over rows sorted by device and time; the only window is over a device's blocks."""
    p = plan(E.queries()["engineer_features"](spark, SF))
    assert p.count("MapInArrow") == 1 and "PythonUDF" not in p
    assert all("lead(__from" in line for line in p.splitlines() if "Window [" in line), p


def test_top_values_limits_groups_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(E.queries()["top_values"](spark, SF))


def test_aggregates_are_partial_before_the_shuffle(spark):
    for name in ("classification_metrics", "step_aggregate", "child_count"):
        p = plan(E.queries()[name](spark, SF))
        assert "partial_" in p, name


def executed(df) -> str:
    """The final plan of a run that took every row."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def scans(plans: str, table: str) -> int:
    return sum("FileScan" in line and table in line for line in plans.splitlines())


def test_gap_report_reads_the_host_table_once(spark, monkeypatch):
    from capforge.operators import joins

    stored = []
    monkeypatch.setattr(joins, "materialised", lambda df, name, one=joins.materialised: stored.append(df) or one(df, name))
    p = executed(E.queries()["gap_report"](spark, SF))
    assert scans(p, "lineitem") == 0 and "TakeOrderedAndProject" in p and "Exchange rangepartitioning" not in p
    assert len(stored) == 1 and scans(plan(stored[0]), "lineitem") == 1


def test_dataset_statistics_passes(spark, monkeypatch):
    """At most three passes for the numeric columns and one for the others, when these hold short values."""
    from capforge.operators import selection, valuecounts

    stored = []
    for module in (selection, valuecounts):
        monkeypatch.setattr(module, "materialised", lambda df, name, one=module.materialised: stored.append(df) or one(df, name))
    p = executed(E.queries()["dataset_statistics"](spark, SF))
    assert sum(scans(plan(df), "lineitem") for df in stored) + scans(p, "lineitem") <= 4


def test_correlation_matrix_reads_the_table_once(spark):
    p = plan(E.queries()["correlation_matrix"](spark, SF))
    assert p.count("FileScan parquet") == 1 and "MapInPandas" in p


def test_global_sort_is_range_partitioned(spark):
    p = plan(E.queries()["sort_series"](spark, SF))
    assert "Exchange rangepartitioning" in p and "SinglePartition" not in p
