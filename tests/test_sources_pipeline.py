import datetime as dt
import json

import pytest

from capforge.plans import pipeline as PL
from capforge.operators import ranking as K
from capforge.sources import files as IO
from capforge.sources import registry as REG


def write_text(spark, path, header, lines):
    rows = [(l,) for l in [header] + lines]
    spark.createDataFrame(rows, "value string").coalesce(1).write.mode("overwrite").text(path)


def test_csv_missing_tokens_and_types(spark, scratch):
    p = scratch("csv")
    write_text(spark, p, "id,score,flag,name,when", ["1,1.5,True,a,2024-01-01", "2,NA,False,,2024-01-02",
                                                      "3,null,true,NaN,2024-01-03", "4,2,FALSE,d,"])
    df = IO.scan_csv(spark, p)
    types = dict(df.dtypes)
    assert types == {"id": "bigint", "score": "double", "flag": "boolean", "name": "string", "when": "string"}
    rows = df.orderBy("id").collect()
    assert rows[1].score is None and rows[2].score is None and rows[1].name is None and rows[2].name is None
    assert rows[3].when is None and rows[0].flag is True and rows[3].flag is False


def test_csv_rejects_other_suffix_and_empty_prediction_file(spark, scratch):
    with pytest.raises(ValueError):
        IO.scan_csv(spark, "/some/where/data.xlsx")
    p = scratch("empty")
    write_text(spark, p, "id,pred", [])
    with pytest.raises(ValueError, match="empty"):
        IO.ingest_predictions(spark, p, scratch("dest"))


def test_sinks_round_trip(spark, scratch):
    df = spark.createDataFrame([(1, "a", 2.5), (2, None, None)], "id long, s string, v double")
    t = scratch("t")
    IO.sink_table(df, t)
    IO.sink_table(df.filter("id = 1"), t)  # replaces
    assert IO.scan_table(spark, t).count() == 1
    c = scratch("c")
    IO.sink_csv(df, c)
    back = IO.scan_csv(spark, c).orderBy("id").collect()
    assert back[0].v == 2.5 and back[1].s is None


def test_registry_append_insert_conform(spark, scratch):
    reg = scratch("reg")
    a = spark.createDataFrame([("d1", "p"), ("d2", "p")], "id string, project_id string")
    REG.append_records(a, reg)
    new = spark.createDataFrame([("d2", "p"), ("d3", "p"), ("d3", "q")], "id string, project_id string")
    fresh = REG.insert_if_absent(new, spark.read.parquet(reg), "id")
    assert [(r.id, r.project_id) for r in fresh.collect()] == [("d3", "p")]
    REG.append_records(fresh, reg)
    assert spark.read.parquet(reg).count() == 3
    spec = [{"name": "id", "type": "VARCHAR", "default": "NULL"},
            {"name": "status", "type": "VARCHAR", "default": "'ON PROGRESS'"},
            {"name": "created", "type": "TIMESTAMPTZ", "default": "NOW()"},
            {"name": "n", "type": "INTEGER", "default": None}]
    out = REG.conform_schema(a, spec).collect()
    assert out[0].status == "ON PROGRESS" and out[0].created is not None and out[0].n is None
    with pytest.raises(ValueError, match="Unsupported type"):
        REG.conform_schema(a, [{"name": "x", "type": "BLOB"}])


def test_recreate_tables_with_defaults(spark, scratch):
    loc = scratch("ddl")
    tables = [{"table_name": "cf_runs", "columns": [
        {"name": "id", "type": "VARCHAR", "default": "NULL"},
        {"name": "status", "type": "VARCHAR", "default": "'ON PROGRESS'"},
        {"name": "created", "type": "TIMESTAMPTZ", "default": "NOW()"}]}]
    REG.recreate_tables(spark, tables, loc)
    assert spark.table("cf_runs").count() == 0
    spark.sql("INSERT INTO cf_runs (id) VALUES ('r1')")
    r = spark.table("cf_runs").collect()[0]
    assert r.status == "ON PROGRESS" and r.created is not None
    REG.recreate_tables(spark, tables, loc)
    assert spark.table("cf_runs").count() == 0


def test_replace_table_from_itself(spark, scratch):
    p = scratch("self")
    spark.createDataFrame([(1,), (2,), (3,)], "id int").write.parquet(p)
    REG.replace_table(spark.read.parquet(p).filter("id <> 2"), p)
    assert sorted(r.id for r in spark.read.parquet(p).collect()) == [1, 3]


def test_run_pipeline_orders_by_sequence(spark):
    df = spark.createDataFrame([(1, "a", 10.0), (2, "a", 20.0), (3, "b", 5.0), (4, "b", 1.0)],
                               "id int, g string, v double")
    steps = [
        {"function_name": "aggregate", "sequence_num": 2,
         "input_param_value": json.dumps({"group_by": ["g"], "aggregations": {"total": "sum(v)"}})},
        {"function_name": "filter", "sequence_num": 1, "input_param_value": json.dumps({"condition": "v > 1"})},
        {"function_name": "shift", "sequence_num": 3, "input_param_value": json.dumps(
            {"order_by": ["g"], "column": "total", "periods": 1, "name": "prev"})},
    ]
    out = PL.run_pipeline(df, steps).orderBy("g").collect()
    assert [(r.g, r.total, r.prev) for r in out] == [("a", 30.0, None), ("b", 5.0, 30.0)]
    with pytest.raises(ValueError):
        PL.apply_step(df, "explode", {}, {})


def test_horizon_split_edges(spark):
    c = dt.datetime(2024, 6, 1)
    rows = [(c - dt.timedelta(weeks=12),), (c - dt.timedelta(microseconds=1),), (c,),
            (c + dt.timedelta(weeks=4),), (c + dt.timedelta(weeks=8),), (c - dt.timedelta(weeks=13),)]
    df = spark.createDataFrame(rows, "t timestamp_ntz")
    parts = [r.part for r in PL.horizon_split(df, "t", "2024-06-01").orderBy("t").collect()]
    assert parts == ["train", "train", "horizon_1", "horizon_2"]


def test_page_beyond_end_and_limits(spark):
    df = spark.createDataFrame([(str(i), dt.datetime(2024, 1, 1 + i)) for i in range(25)], "id string, created_at timestamp")
    p3 = K.page(df, page_no=3, size=10).collect()
    assert len(p3) == 5 and p3[0].total == 25 and p3[0].total_pages == 3 and p3[0].id == "4" and p3[0].page == 3
    assert K.page(df, page_no=4, size=10).count() == 0
    with pytest.raises(ValueError):
        K.page(df, size=101)


def test_purge_project_tables_and_upload_run(spark, scratch):
    ds, eng = scratch("ds"), scratch("eng")
    spark.createDataFrame([("d1", "p1"), ("d2", "p2")], "id string, project_id string").write.parquet(ds)
    spark.createDataFrame([("d1", "t1"), ("d2", "t2")], "dataset_id string, table_name string").write.parquet(eng)
    spark.sql("CREATE OR REPLACE TEMP VIEW cf_raw_d1 AS SELECT 1 AS x")
    counts = REG.purge_project_tables(spark, "p1", {"datasets": (ds, "project_id")},
                                      {"engineered": (eng, "dataset_id", "datasets")}, drop=["cf_raw_d1"])
    assert counts == {"datasets": 1, "engineered": 1}
    assert [r.table_name for r in spark.read.parquet(eng).collect()] == ["t2"]
    assert not spark.catalog.tableExists("cf_raw_d1")
    src, runs = scratch("up"), scratch("runs")
    write_text(spark, src, "id,pred", ["1,0.5", "2,0.7"])
    out = IO.ingest_predictions(spark, src, scratch("ext"), runs, {"id": "u1", "project_id": "p2"})
    assert out.count() == 2
    r = spark.read.parquet(runs).collect()[0]
    assert r.status == "UPLOADED" and r.project_id == "p2" and r.created_at is not None


def test_generic_source_and_sink_formats(spark, scratch):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    p = scratch("fmt")
    IO.sink_table(df, p, format="csv", header="true")
    back = IO.scan_table(spark, p, format="csv", header="true", inferSchema="true")
    assert sorted((r.id, r.s) for r in back.collect()) == [(1, "a"), (2, "b")]


def test_date_conversion_modes(spark):
    df = spark.createDataFrame([("02/01/2024 10:30", dt.datetime(2024, 1, 2, 10, 30))], "s string, t timestamp_ntz")
    r = PL.step_date_conversion(df, "s", to="timestamp", format="dd/MM/yyyy HH:mm", name="ts").collect()[0]
    assert r.ts == dt.datetime(2024, 1, 2, 10, 30)
    r = PL.step_date_conversion(df, "t", to="date", name="d").collect()[0]
    assert r.d == dt.date(2024, 1, 2)
    r = PL.step_date_conversion(df, "t", to="trunc", unit="hour", name="h").collect()[0]
    assert r.h == dt.datetime(2024, 1, 2, 10, 0)
    with pytest.raises(ValueError):
        PL.step_date_conversion(df, "t", to="weekday")


def test_params_frame_is_one_row(spark):
    from capforge.operators.joins import params_frame
    rows = params_frame(spark, {"gap_days": 2, "filter_host_id": None, "label": "x", "rate": 0.5}).collect()
    assert len(rows) == 1 and rows[0].gap_days == 2 and rows[0].filter_host_id is None and rows[0].rate == 0.5


def test_partitioned_sink_and_csv_with_schema(spark, scratch):
    import os
    df = spark.createDataFrame([(1, "a", 2.0), (2, "b", None), (3, "a", 4.5)], "id int, g string, v double")
    p = scratch("parts")
    IO.sink_table(df, p, partition_by=["g"])
    assert sorted(d for d in os.listdir(p.replace("file:", "")) if d.startswith("g=")) == ["g=a", "g=b"]
    back = IO.scan_table(spark, p).filter("g = 'a'")
    assert sorted(r.id for r in back.collect()) == [1, 3]
    c = scratch("typed")
    write_text(spark, c, "id,v,note", ["1,2.5,x", "2,NA,", "3,null,y"])
    typed = IO.scan_csv(spark, c, schema="id int, v double, note string").orderBy("id").collect()
    assert [(r.id, r.v, r.note) for r in typed] == [(1, 2.5, "x"), (2, None, None), (3, None, "y")]


def test_short_rows_are_written_in_parallel(spark, tmp_path, monkeypatch):
    from capforge.plans import checks_sources as C

    rows = [(i, f"name {i}", i / 4) for i in range(1, 31)]
    c = spark.createDataFrame(rows, "c_custkey long, c_name string, c_acctbal double").repartition(3)
    path = str(tmp_path / "short")
    monkeypatch.setattr(C, "table", lambda *a: c)
    monkeypatch.setattr(C, "scratch_dir", lambda *a: path)
    got = sorted(tuple(r) for r in C.q_csv_short_rows(spark, "").collect())
    assert got == [(i, None, None) if i % 3 == 0 else (i, n, b) for i, n, b in rows]
    assert sum(len(p.read_text().splitlines()) > 1 for p in tmp_path.glob("short/part-*")) == 3
