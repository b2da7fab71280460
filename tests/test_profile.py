import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from capforge.operators import profile as P
from capforge.operators import ranking as K


def sample(spark):
    rng = np.random.default_rng(3)
    n = 501
    pdf = pd.DataFrame({
        "a": rng.normal(10, 3, n).round(3),
        "b": rng.integers(0, 7, n).astype("int64"),
        "c": np.where(np.arange(n) % 5 == 0, np.nan, rng.normal(0, 1, n)),
        "const": np.ones(n),
        "cat": rng.choice(["x", "y", "z", None], n),
    })
    pdf["y"] = pdf["a"] * 2 + rng.normal(0, 1, n)
    return pdf, spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None),
                                      "a double, b long, c double, const double, cat string, y double")


def test_profile_numeric_matches_pandas(spark):
    pdf, df = sample(spark)
    got = {r.column: r for r in P.profile_numeric(df).collect()}
    for c in ["a", "b", "c", "const", "y"]:
        s = pdf[c]
        assert got[c].min == pytest.approx(s.min()) and got[c].max == pytest.approx(s.max())
        assert got[c].mean == pytest.approx(s.mean()) and got[c].median == pytest.approx(s.median())
        assert got[c].std == pytest.approx(s.std())


def test_exact_median_even_odd_duplicates_empty(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (2.0, 5.0, None), (3.0, 1.0, None), (10.0, 5.0, None)],
                               "e double, d double, n double")
    got = {r.column: r.median for r in P.exact_medians(df, ["e", "d", "n"]).collect()}
    assert got == {"e": 2.5, "d": 5.0, "n": None}


def test_categorical_top_missing(spark):
    pdf, df = sample(spark)
    uc = {r.column: r.unique_count for r in P.profile_categorical(df).collect()}
    assert uc == {"cat": pdf["cat"].nunique()}
    top = P.top_values(df, 2).orderBy("rank").collect()
    vc = pdf["cat"].value_counts()
    assert [r["count"] for r in top] == list(vc.values[:2])
    miss = {r.column: r.missing for r in P.missing_counts(df).collect()}
    assert miss["c"] == pdf["c"].isna().sum() and miss["cat"] == pdf["cat"].isna().sum() and miss["a"] == 0


def test_correlation_pairwise_and_constant(spark):
    pdf, df = sample(spark)
    corr = {r.feature: r.correlation for r in P.target_correlation(df, "y").collect()}
    want = pdf.drop(columns=["cat"]).corr()["y"]
    for c in ["a", "b", "c"]:
        assert corr[c] == pytest.approx(want[c], abs=1e-9)
    assert corr["const"] is None and math.isnan(want["const"])
    m = {(r.column_1, r.column_2): r.correlation for r in P.correlation_matrix(df).collect()}
    assert m[("a", "c")] == pytest.approx(pdf[["a", "c"]].corr().iloc[0, 1], abs=1e-9)


def test_select_top_features_k_larger_than_columns(spark):
    pdf, df = sample(spark)
    top = K.select_top_features(df, "y", k=50).orderBy("rank").collect()
    assert [r.feature for r in top][:1] == ["a"]
    assert top[-1].feature == "const" and top[-1].correlation is None  # undefined correlation last
    assert K.dropped_features(df, "y", k=50).count() == 0
    assert [r.feature for r in K.dropped_features(df, "y", k=1).collect()] != []
    rec = K.selection_record(df, "y", k=2).collect()[0]
    assert rec.selected_features == ["a", "b"] or rec.selected_features[0] == "a"


def test_dataset_statistics_shape(spark):
    _, df = sample(spark)
    st = P.dataset_statistics(df).collect()
    stats = {(r.column, r.stat) for r in st}
    assert ("*", "row_count") in stats and ("a", "median") in stats and ("cat", "unique_count") in stats
    assert ("cat", "top_value") in stats and ("c", "missing") in stats


def test_top_values_plan_limits_before_shuffle(spark):
    _, df = sample(spark)
    plan = P.top_values(df, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_approx_profiles_are_close(spark):
    pdf, df = sample(spark)
    got = {r.column: r for r in P.profile_numeric(df, approx=True).collect()}
    assert got["a"].median == pytest.approx(pdf["a"].median(), rel=0.01)
    assert got["a"].mean == pytest.approx(pdf["a"].mean())
    uc = {r.column: r.unique_count for r in P.profile_categorical(df, approx=True).collect()}
    assert uc["cat"] == pdf["cat"].nunique()


from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5), st.floats(-1e6, 1e6, allow_nan=False)), min_size=0,
                max_size=60), st.integers(1, 9))
def test_exact_median_property(spark, values, parts):
    df = spark.createDataFrame([(None if v is None else float(v), 1.0) for v in values], "v double, w double")
    got = {r.column: r.median for r in P.exact_medians(df, ["v", "w"]).collect()}
    present = [float(v) for v in values if v is not None]
    want = float(np.median(present)) if present else None
    if want is None:
        assert got["v"] is None
    else:
        assert got["v"] == pytest.approx(want, rel=1e-12, abs=1e-12)
    assert got["w"] == (1.0 if values else None)


def test_correlation_matrix_wide_table(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    base = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
    cols = []
    for i in range(30):
        a, b = base[i % 5], base[(i * 3 + 1) % 5]
        expr = f"CASE WHEN (l_orderkey + {i}) % 11 = 0 THEN NULL ELSE {a} * {i + 1} + {b} * {(i % 4) - 1.5} END"
        cols.append(F.expr(expr).alias(f"c{i}"))
    wide = li.select(*cols)
    got = {(r.column_1, r.column_2): r.correlation for r in P.correlation_matrix(wide).collect()}
    assert len(got) == 30 * 29 // 2
    want = wide.toPandas().astype(float).corr()
    for (a, b), v in got.items():
        assert v == pytest.approx(want.loc[a, b], abs=1e-9), (a, b)


def test_summaries_read_the_table_three_times_at_most(spark, monkeypatch):
    from capforge.operators import selection

    passes = []
    one = selection._digit_counts
    monkeypatch.setattr(selection, "_digit_counts", lambda numbers, level, prefixes: passes.append(level) or one(numbers, level, prefixes))
    df = spark.range(50_000).select(*[(F.rand(i) * 10 ** i - 3).alias(f"c{i}") for i in range(9)], F.col("id").cast("double").alias("whole"))
    pdf = df.toPandas()
    got = {r.column: r for r in P.profile_numeric(df).collect()}
    assert passes == list(range(len(passes))) and len(passes) <= 3
    for c in pdf:
        assert got[c].median == np.median(pdf[c]) and got[c].std == pytest.approx(pdf[c].std(), rel=1e-9) and got[c].max == pdf[c].max()
    passes.clear()
    P.profile_numeric(df.select("whole")).collect()
    assert len(passes) <= 2  # whole numbers fit the first two digits


def test_moments_far_from_zero(spark):
    df = spark.range(10_000, numPartitions=7).select((F.col("id") % 10 + 1e12).alias("v"))
    r = P.profile_numeric(df).first()
    assert r.std == pytest.approx(np.std(np.arange(10_000) % 10, ddof=1), rel=1e-6) and r["mean"] == pytest.approx(1e12 + 4.5, rel=1e-12)


def test_long_values_by_digest(spark, monkeypatch):
    from capforge.operators import valuecounts as V

    start = "the same beginning of every text, longer than a piece of a count " * 5
    rows = [(f"{start}{i:04d}",) for i in range(300)] + [(f"{start}0007",)] * 2 + [("short",)] * 3 + [(None,)] * 4 + [("",)]
    df = spark.createDataFrame(rows, "`a.text` string").repartition(5)
    want = [("short", 3), (f"{start}0007", 3), ("", 1), (f"{start}0000", 1), (f"{start}0001", 1)]
    for fetched in (1000, 10):  # ten: longer pieces decide first
        monkeypatch.setattr(V, "FETCHED", fetched)
        got = sorted(P.top_values(df).collect(), key=lambda r: r["rank"])
        assert [(r.value, r["count"]) for r in got] == want and {r.column for r in got} == {"a.text"}
    assert P.profile_categorical(df).first().unique_count == 302
    stats = {(r["column"], r.stat): r.value for r in P.dataset_statistics(df).filter("stat <> 'top_value'").collect()}
    assert stats["a.text", "missing"] == 4 and stats["a.text", "unique_count"] == 302 and stats["*", "row_count"] == len(rows)


def test_texts_are_not_shuffled(spark):
    """What is shuffled for the counts holds digests and a bounded piece, not the texts."""
    from capforge.operators import valuecounts as V

    df = spark.createDataFrame([("x" * 10_000,)] * 20 + [("y" * 10_000,)], "t string").repartition(2)
    stored = V.value_counts(df, ["t"])
    assert stored.columns == ["id", "h1", "h2", "piece", "whole", "count"]
    assert max(len(r.piece) for r in stored.collect()) == V.PIECE


def test_wide_target_correlation(spark, monkeypatch):
    """Blocks of columns give what the generated aggregate of few columns gives."""
    from capforge.operators import comoments

    _, df = sample(spark)
    want = {r.feature: r.correlation for r in P.target_correlation(df, "y").collect()}
    monkeypatch.setattr(P, "WIDE", 1)
    monkeypatch.setattr(comoments, "PARTNERS", 2)
    got = {r.feature: r.correlation for r in P.target_correlation(df.repartition(4), "y").collect()}
    assert got.keys() == want.keys() and got["const"] is None
    assert all(want[c] is got[c] is None or got[c] == pytest.approx(want[c], abs=1e-9) for c in want)


def test_tiles_equal_one_tile(spark, monkeypatch):
    from capforge.operators import comoments

    _, df = sample(spark)
    one = {(r.column_1, r.column_2): r.correlation for r in P.correlation_matrix(df).collect()}
    monkeypatch.setattr(comoments, "TILE", 2)
    got = {(r.column_1, r.column_2): r.correlation for r in P.correlation_matrix(df.repartition(4)).collect()}
    assert got.keys() == one.keys() and all(one[k] is got[k] is None or got[k] == pytest.approx(one[k], abs=1e-12) for k in one)


def test_table_metadata_sample_rows(spark):
    import json

    df = spark.createDataFrame([(3, "c"), (1, "a"), (None, "z"), (2, None)], "`k.x` int, s string").repartition(3)
    r = P.table_metadata(df, 2, ["k.x"]).collect()
    assert {x.row_count for x in r} == {4} and json.loads(r[0].sample_rows) == [{"k.x": 1, "s": "a"}, {"k.x": 2, "s": None}]
    assert P.table_metadata(df.limit(0)).first().sample_rows == "[]" and len(json.loads(P.table_metadata(df).first().sample_rows)) == 1
