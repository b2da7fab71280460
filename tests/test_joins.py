import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from capforge.operators import joins as J
from capforge.operators import relational as R

T0 = dt.datetime(2024, 1, 1)
D = dt.timedelta(days=1)
HOST = ("hostname string, datetime timestamp_ntz, core_number int, cpu_usage_percentage double, "
        "memory_number double, memory_usage_percentage double")


def hosts(spark):
    rows = [("  host7 ", T0, 4, 10.0, 100.0, 50.0), ("host7", T0 + 2 * D, 8, 30.0, 300.0, 70.0),
            ("server", T0, 2, 1.0, 1.0, 1.0), ("host12", T0, 1, 5.0, 5.0, 5.0),
            ("host12", T0, 3, 7.0, 7.0, 7.0)]
    return spark.createDataFrame(rows, HOST)


def test_gap_join_pairs_and_keeps_unmatched(spark):
    out = J.gap_join(hosts(spark), 2).orderBy("host_id", "datetime_1", "core_number_avg").collect()
    h7 = [r for r in out if r.host_id == 7]
    assert len(h7) == 2
    assert h7[0].datetime_2 == T0 + 2 * D and h7[0].core_number_avg == 6.0 and h7[0].cpu_usage_percentage_avg == 20.0
    assert h7[1].datetime_2 is None and h7[1].core_number_avg is None
    server = [r for r in out if r.hostname == "server"][0]
    assert server.host_id is None and server.datetime_2 is None  # no digits: NULL id, never matches


def test_gap_zero_pairs_with_itself_and_duplicates_multiply(spark):
    out = J.gap_join(hosts(spark), 0).filter(F.col("host_id") == 12).collect()
    assert len(out) == 4  # 2 rows at the same (host, time) -> 2 x 2
    assert sorted(r.core_number_avg for r in out) == [1.0, 2.0, 2.0, 3.0]


def test_negative_gap_and_unknown_host(spark):
    out = J.gap_join(hosts(spark), -2).filter(F.col("host_id") == 7).orderBy("datetime_1").collect()
    assert out[0].datetime_2 is None and out[1].datetime_2 == T0
    assert J.gap_join(hosts(spark), 2, host_id=999).count() == 0


def test_gap_report_top_rows_and_count(spark):
    rep = J.gap_report(hosts(spark), "hostname, host_id, nope", 2, n=2).collect()
    assert [r.row_number for r in rep] == [1, 2] or sorted(r.row_number for r in rep) == [1, 2]
    assert all(r.row_count == 5 for r in rep)
    assert all(r.nope is None for r in rep)
    assert set(rep[0].asDict()) == {"hostname", "host_id", "nope", "row_number", "gap_days", "host_id_filter", "row_count"}


def test_exists_flag_and_child_count(spark):
    parent = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, name string")
    child = spark.createDataFrame([(1,), (1,), (3,), (None,)], "pid int")
    flags = {r.id: r.has_engineered for r in J.exists_flag(parent, child, "id", "pid").collect()}
    assert flags == {1: True, 2: False, 3: True}
    counts = {r.id: r.dataset_count for r in J.child_count(parent, child, "id", "pid").collect()}
    assert counts == {1: 2, 2: 0, 3: 1}


def test_model_features_and_broken_links(spark):
    models = spark.createDataFrame([("m1", "s1"), ("m2", "s9")], "id string, selection_id string")
    sel = spark.createDataFrame([("s1", ["b", "a"])], "id string, selected_features array<string>")
    rows = J.model_features(models, sel).orderBy("position").collect()
    assert [(r.model_id, r.position, r.feature) for r in rows] == [("m1", 0, "b"), ("m1", 1, "a")]
    assert [r.id for r in J.broken_model_links(models, sel).collect()] == ["m2"]


def test_params_join_is_broadcast(spark):
    out = J.params_join(hosts(spark), {"gap_days": 2, "filter_host_id": None})
    assert out.count() == 5 and "BroadcastNestedLoopJoin" in out._jdf.queryExecution().executedPlan().toString()


def test_select_requested_and_host_id(spark):
    df = R.host_id_extract(hosts(spark))
    out = R.select_requested(df, "host_id,missing,hostname")
    assert out.columns == ["host_id", "missing", "hostname"]
    assert sorted({r.host_id for r in out.collect()}, key=lambda x: (x is None, x)) == [7, 12, None]
    assert R.filter_optional(df, "host_id", None).count() == 5
    assert R.filter_optional(df, "host_id", 12).count() == 2


def test_purge_project(spark):
    ds = spark.createDataFrame([("d1", "p1"), ("d2", "p2"), ("d3", None)], "id string, project_id string")
    eng = spark.createDataFrame([("d1",), ("d2",), ("d9",)], "dataset_id string")
    out = J.purge_project("p1", {"datasets": (ds, "project_id")}, {"engineered": (eng, "dataset_id", "datasets")})
    assert sorted(r.id for r in out["datasets"].collect()) == ["d2", "d3"]
    assert sorted(r.dataset_id for r in out["engineered"].collect()) == ["d2", "d9"]


def test_gap_row_count_and_report_with_null_hosts(spark):
    h = hosts(spark)
    for gap in (0, 2, -2):
        assert J.gap_row_count(h, gap).collect()[0].row_count == J.gap_join(h, gap).count()
    rep = J.gap_report(h, "hostname,host_id,datetime_2", 0, n=50).collect()
    assert len(rep) == J.gap_join(h, 0).count() == rep[0].row_count == 7
    assert [r.host_id for r in sorted(rep, key=lambda r: r.row_number)][-1] is None  # NULL host last


@pytest.mark.parametrize("n,gap,held", [(1, 2, 100_000), (20, 0, 5), (20, 2, 5), (500, -3, 50), (7, 2, 1)])
def test_gap_report_from_one_read(spark, monkeypatch, n, gap, held):
    """Equal to sorting all of the join, for duplicated keys, missing hosts, times and metrics, and many tasks."""
    monkeypatch.setattr(J, "HELD_ROWS", held)
    rng = random.Random(n)
    rows = [(rng.choice(["server", None, "host3", "h 3", "host12", "node5", "x4y"]), rng.choice([None] + [T0 + i * D for i in range(6)]), rng.choice([None, 1, 2, 9]),
             *[rng.choice([None, 1.0, 2.5]) for _ in range(3)]) for _ in range(240)]
    df = spark.createDataFrame(rows, HOST).repartition(9)
    columns = ",".join(J.GAP_COLUMNS)
    want = [tuple(r) for r in J.sort_gap_rows(J.gap_join(df, gap)).limit(n).collect()]
    got = sorted(J.gap_report(df, columns, gap, n=n).collect(), key=lambda r: r.row_number)
    assert [tuple(r)[:len(J.GAP_COLUMNS)] for r in got] == want and [r.row_number for r in got] == list(range(1, len(want) + 1))
    assert {r.row_count for r in got} == {J.gap_join(df, gap).count()}
    one = J.gap_report(df, "hostname", gap, host_id=3, n=n).collect()
    assert {r.row_count for r in one} == {J.gap_join(df, gap, 3).count()}


def test_gap_report_of_an_empty_table(spark):
    assert J.gap_report(spark.createDataFrame([], HOST), "hostname").collect() == []
