import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, HealthCheck
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from capforge.operators import windows as W
from pandas_model import features as pandas_features

T0 = dt.datetime(2024, 3, 1, 12, 0, 0)
D = dt.timedelta(days=1)
US = dt.timedelta(microseconds=1)
SCHEMA = "Type string, Application string, IP string, Date timestamp_ntz, Value double, event_id long"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def run(spark, rows, **kw):
    out = W.engineer_features(frame(spark, rows), tiebreak=["event_id"], **kw).toPandas()
    return out.sort_values("event_id").reset_index(drop=True)


def compare(spark, rows, **kw):
    got = run(spark, rows, **kw)
    pdf = pd.DataFrame(rows, columns=["Type", "Application", "IP", "Date", "Value", "event_id"])
    want = pandas_features(pdf).sort_values("event_id").reset_index(drop=True)
    for c in W.FEATURE_COLUMNS:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=c)
    return got


def dev(i, t, v, ip="1"):
    return ("mem", "app", ip, t, v, i)


def test_window_edges(spark):
    rows = [dev(0, T0, 10.0), dev(1, T0 + D, 20.0), dev(2, T0 + 3 * D, 90.0), dev(3, T0 + 3 * D + US, 30.0),
            dev(4, T0 + 28 * D, 75.0)]
    got = compare(spark, rows)
    # row 3 carries row 2's window: (T0, T0+3d] -> rows 1, 2 (row 0 is exactly 3 days older: excluded)
    assert got.loc[3, "Value_Last_3Days"] == 90.0
    assert got.loc[3, "Date_MinMax_Range_Last_3Days"] == 70.0


def test_shift_over_long_gap(spark):
    rows = [dev(0, T0, 10.0), dev(1, T0 + D, 20.0), dev(2, T0 + 60 * D, 5.0)]
    got = compare(spark, rows)
    # the previous row is 59 days back; its own window still holds rows 0 and 1
    assert got.loc[2, "Value_Last_1Day"] == 20.0
    assert got.loc[2, "Date_Value_Last_28Days_Median"] == 15.0


def test_ties_end_window_at_the_row(spark):
    rows = [dev(0, T0, 5.0), dev(1, T0 + D, 50.0), dev(2, T0 + D, 80.0), dev(3, T0 + D, 20.0), dev(4, T0 + 2 * D, 1.0)]
    got = compare(spark, rows)
    assert list(got["Value_Last_3Days"]) == [0.0, 5.0, 50.0, 80.0, 80.0]


def test_single_row(spark):
    got = compare(spark, [dev(0, T0, 42.0)])
    assert (got[list(W.FEATURE_COLUMNS)] == 0).all().all()


def test_future_edge(spark):
    rows = [dev(0, T0, 1.0), dev(1, T0 + 21 * D, 85.0), dev(2, T0 + 21 * D + US, 99.0)]
    got = compare(spark, rows)
    assert got.loc[0, "Value_target_Max"] == 85.0 and got.loc[0, "Target"] == 1


def test_missing_value_and_key(spark):
    rows = [dev(0, T0, None), dev(1, T0 + D, 75.0), dev(2, T0 + 2 * D, None), ("mem", "app", None, T0, 3.0, 3)]
    got = run(spark, rows)
    assert 3 not in set(got["event_id"])  # NULL key dropped
    assert got.loc[got.event_id == 0, "Value"].item() == 0.0  # missing value -> 0 in the output
    compare(spark, rows[:3])


def test_missing_date_is_an_error(spark):
    with pytest.raises(Exception):
        run(spark, [dev(0, None, 1.0), dev(1, T0, 2.0)])


def test_blocked_equals_plain(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(400):
        ip = str(i % 4)
        t = T0 + dt.timedelta(hours=int(rng.integers(0, 24 * 120)))
        rows.append(dev(i, t, float(rng.integers(0, 100)), ip))
    plain = run(spark, rows)
    for b in (5, 30):
        blocked = run(spark, rows, block_days=b)
        pd.testing.assert_frame_equal(plain, blocked)


def test_gaps_of_any_length_between_blocks(spark):
    rng = np.random.default_rng(11)
    rows, t = [], T0
    for i in range(160):
        t += dt.timedelta(hours=float(rng.choice([2, 30, 24 * 27, 24 * 29, 24 * 55, 24 * 120])))
        rows.append(dev(i, t, float(rng.integers(0, 100)), str(i % 2)))
    for b in (3, 20, 90):
        compare(spark, rows, block_days=b)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 40 * 24), st.integers(0, 3), st.floats(0, 100)),
                min_size=1, max_size=40))
def test_property_matches_pandas_model(spark, items):
    rows = [dev(i, T0 + dt.timedelta(hours=h) + m * US, round(v, 3), str(ip)) for i, (ip, h, m, v) in enumerate(items)]
    got = compare(spark, rows)
    assert (got["Date_MinMax_Range_Last_28Days"] >= 0).all()
    for a, b in ((3, 7), (7, 14), (14, 28)):
        assert (got[f"Date_Count_Value_Above_70_Last_{a}Days"] <= got[f"Date_Count_Value_Above_70_Last_{b}Days"]).all()


def test_repartition_invariance(spark):
    rows = [dev(i, T0 + dt.timedelta(hours=7 * i), float(i % 13 * 9), str(i % 3)) for i in range(90)]
    a = W.engineer_features(frame(spark, rows), tiebreak=["event_id"]).toPandas().sort_values("event_id")
    b = W.engineer_features(frame(spark, rows).repartition(7), tiebreak=["event_id"]).toPandas().sort_values("event_id")
    pd.testing.assert_frame_equal(a.reset_index(drop=True), b.reset_index(drop=True))


def test_plan_has_no_sliding_window(spark):
    rows = [dev(i, T0 + dt.timedelta(hours=i), 1.0) for i in range(5)]
    out = W.engineer_features(frame(spark, rows), tiebreak=["event_id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "RangeFrame" not in plan.replace("RangeFrame, unboundedpreceding$(), currentrow$()", ""), plan


def test_sentinel_date_beside_ordinary_ones(spark):
    rows = [dev(0, dt.datetime(1900, 1, 1), 7.0), dev(1, dt.datetime(1900, 1, 2), 9.0), dev(2, T0, 3.0), dev(3, T0 + D, 8.0),
            dev(4, dt.datetime(2250, 12, 1), 5.0), dev(5, T0, 1.0, "2"), dev(6, T0 + 2 * D, 2.0, "2")]
    compare(spark, rows)


def test_dense_device_takes_time_in_proportion(spark):
    """40 000 readings of one device in 28 days."""
    import time

    def took(n):
        df = spark.range(n).select(F.lit("m").alias("Type"), F.lit("a").alias("Application"), F.lit("1").alias("IP"),
                                   (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") * 28 * 86400.0 / n)).alias("Date"),
                                   F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("Value"), F.col("id").alias("event_id"))
        began = time.time()
        assert W.engineer_features(df, tiebreak=["event_id"]).agg(F.count(F.lit(1)), F.sum("Date_Value_Last_28Days_Median")).first()[0] == n
        return time.time() - began

    took(1000)
    assert took(40_000) < 30 and took(80_000) < 45


def test_many_batches_and_groups(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rng = np.random.default_rng(2)
    rows = [dev(i, T0 + dt.timedelta(hours=int(rng.integers(0, 24 * 200))), float(rng.integers(0, 100)), str(i % 9)) for i in range(700)]
    try:
        for n in ("1", "7", "64"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            compare(spark, rows, block_days=25)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_rolling_stat_and_shift(spark):
    rows = [dev(0, T0, 10.0), dev(1, T0 + D, 30.0), dev(2, T0 + 20 * D, 5.0)]
    r = W.rolling_stat(frame(spark, rows), days=14, stat="max", tiebreak=["event_id"]).toPandas().sort_values("event_id")
    assert list(r["Value_Last_14Days_Max"]) == [10.0, 30.0, 5.0]
    s = W.shift_rows(frame(spark, rows), list(W.DEVICE_KEYS), ["Date", "event_id"], "Value").toPandas().sort_values("event_id")
    assert s["Value_shift_1"].isna().tolist() == [True, False, False]


@pytest.mark.parametrize("n", [1, 3, -2])
@pytest.mark.parametrize("keys", [list(W.DEVICE_KEYS), []])
def test_shift_rows_equals_lag(spark, n, keys):
    rng = np.random.default_rng(5)
    rows = [dev(i, T0 + dt.timedelta(hours=int(rng.integers(0, 24 * 200))), float(i), "hot" if i % 2 else str(i % 3)) for i in range(240)]
    rows += [("mem", "app", None, None, 1.0, 500), ("mem", "app", None, T0, 2.0, 501)]
    df = frame(spark, rows)
    got = {r.event_id: r.s for r in W.shift_rows(df, keys, ["Date", "event_id"], "Value", n, "s").collect()}
    w = Window.partitionBy(*keys).orderBy("Date", "event_id")
    assert got == {r.event_id: r.s for r in df.withColumn("s", F.lag("Value", n).over(w)).collect()}


def test_nan_value_is_missing_like_null(spark):
    base = [dev(0, T0, 75.0), dev(1, T0 + D, None), dev(2, T0 + 2 * D, 90.0), dev(3, T0 + 3 * D, 10.0)]
    with_nan = [r if r[4] is not None else r[:4] + (float("nan"),) + r[5:] for r in base]
    a, b = run(spark, base), run(spark, with_nan)
    pd.testing.assert_frame_equal(a, b)
    assert a.loc[2, "Date_Value_Last_28Days_SDev"] == 0.0  # previous window holds one present value -> std undefined -> 0
    compare(spark, base)


@pytest.mark.parametrize("stat,method", [("max", "max"), ("min", "min"), ("sum", "sum"), ("mean", "mean"),
                                         ("std", "std"), ("median", "median")])
def test_rolling_stat_matches_pandas_rolling(spark, stat, method):
    rng = np.random.default_rng(3)
    rows = [dev(i, T0 + dt.timedelta(hours=int(h)), float(rng.integers(0, 50)), str(i % 2))
            for i, h in enumerate(sorted(rng.integers(0, 24 * 40, 120)))]
    got = W.rolling_stat(frame(spark, rows), days=7, stat=stat, tiebreak=["event_id"]).toPandas()
    got = got.set_index("event_id")[f"Value_Last_7Days_{stat.capitalize()}"]
    pdf = pd.DataFrame(rows, columns=["Type", "Application", "IP", "Date", "Value", "event_id"])
    want = {}
    for _, g in pdf.groupby("IP"):
        g = g.sort_values(["Date", "event_id"]).set_index("Date")
        r = getattr(g["Value"].rolling("7D"), method)()
        want.update(dict(zip(g["event_id"], r.to_numpy())))
    ids = sorted(want)
    np.testing.assert_allclose(got.loc[ids].to_numpy(dtype=float), np.array([want[i] for i in ids], dtype=float),
                               rtol=1e-9, atol=1e-9, equal_nan=True)


def test_many_rows_on_one_timestamp(spark):
    rows = [dev(i, T0 + D, float(i % 97), "1") for i in range(5000)]
    rows += [dev(5000 + i, T0 + i * D / 3, float(i), "1") for i in range(6)]
    got = compare(spark, rows)
    assert len(got) == 5006
