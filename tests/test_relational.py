import datetime as dt
import json

import pytest

from capforge.operators import relational as R


def test_parse_dates_strict_and_lenient(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05",), ("not a date",), (None,)], "d string")
    with pytest.raises(Exception):
        R.parse_dates(df, "d", strict=True).collect()
    got = [r.d for r in R.parse_dates(df, "d", strict=False).collect()]
    assert got == [dt.datetime(2024, 1, 2, 3, 4, 5), None, None]
    ok = R.parse_dates(spark.createDataFrame([("2024-01-02 03:04:05",)], "d string"), "d").collect()[0].d
    assert ok == dt.datetime(2024, 1, 2, 3, 4, 5)


def test_search_is_case_insensitive_and_unescaped(spark):
    df = spark.createDataFrame([("Big Ring",), ("ring_x",), ("ringAx",), ("other",)], "n string")
    assert sorted(r.n for r in R.search_name(df, "n", "RING").collect()) == ["Big Ring", "ringAx", "ring_x"]
    assert sorted(r.n for r in R.search_name(df, "n", "ring_x").collect()) == ["ringAx", "ring_x"]  # _ is a wildcard


def test_lookup_first_match_and_flags(spark):
    df = spark.createDataFrame([(1, "a", 75.0), (2, "a", 80.0), (3, "b", None)], "id int, k string, Value double")
    assert R.lookup_by_key(df, order=["id"], k="a").collect()[0].id == 1
    flags = {r.id: (r.Value_Above_70, r.Value_AtLeast_80) for r in R.threshold_flags(df).collect()}
    assert flags == {1: (1, 0), 2: (1, 1), 3: (0, 0)}


def test_fill_missing_numbers_only(spark):
    df = spark.createDataFrame([(None, float("nan"), None, None)], "a int, b double, s string, t timestamp")
    r = R.fill_missing(df).collect()[0]
    assert (r.a, r.b, r.s, r.t) == (0, 0.0, None, None)


def test_rows_to_json_formats(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 2, 3, 4, 5, 6), dt.date(2024, 1, 2), None, bytearray(b"hi"))],
                               "id long, ts timestamp_ntz, d date, missing string, b binary")
    doc = json.loads(R.rows_to_json(df).collect()[0].json)
    assert doc == {"id": 1, "ts": "2024-01-02T03:04:05.000006", "d": "2024-01-02", "missing": None, "b": "hi"}


def test_model_label_and_require_columns(spark):
    df = spark.createDataFrame([("classification", "1a2b3c4d-aaaa")], "task_type string, id string")
    r = R.model_label(df).collect()[0]
    assert r.model_name == "ClassificationModel-1a2b3c" and r.table_suffix == "1a2b3c4d_aaaa"
    with pytest.raises(ValueError, match="missing"):
        R.require_columns(df, ["id", "nope"])
    assert R.select_numeric(df.selectExpr("1 AS n", "'x' AS s")).columns == ["n"]
    assert R.date_offsets(spark.createDataFrame([(dt.datetime(2024, 1, 1),)], "Date timestamp_ntz")).collect()[0] \
        .Date_Next_3Weeks == dt.datetime(2024, 1, 22)
