import pandas as pd

from capforge.operators.grouped import grouped_apply

SCHEMA = "k long, s string, n long, total long, yes long, top double, kinds string, at timestamp_ntz"


def rows(spark):
    d = spark.range(4000).selectExpr(
        "if(id % 7 = 0, null, id % 300) AS k", "if(id % 11 = 0, null, concat('s', id % 2)) AS s",
        "if(id % 300 = 5, null, 9007199254740993 + id) AS whole", "if(id % 13 = 0, null, id % 2 = 0) AS yes",
        "if(id % 17 = 0, null, id / 3) AS x", "timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(0, 0, int(id)) AS at")
    return d.unionByName(d.selectExpr("-1L AS k", "'one' AS s", "whole", "yes", "x", "at"))  # longer than a batch below


def summary(pdf: pd.DataFrame) -> dict:
    return {"k": None if pdf["k"].isna().all() else int(pdf["k"].iloc[0]), "s": pdf["s"].iloc[0], "n": len(pdf),
            "total": None if pdf["whole"].isna().any() else int(pdf["whole"].max()), "yes": int((pdf["yes"] == True).sum()),  # noqa: E712
            "top": pdf["x"].max(), "kinds": f"{pdf['whole'].dtype} {pdf['yes'].dtype} {list(pdf.index) == list(range(len(pdf)))}",
            "at": pdf["at"].min()}


def test_groups_are_whole_and_typed_as_apply_in_pandas_gives_them(spark):
    def frame(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([summary_(pdf)])

    def two(key, pdf):
        assert len(key) == 2
        return pd.DataFrame([summary_(pdf)] * (0 if key[1] == "s1" else 2))

    code = summary.__code__
    summary_ = type(summary)(code, {"pd": pd, "len": len})  # by value: workers don't import this file
    d = rows(spark)
    key = lambda df: sorted(map(repr, df.collect()))
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, pairs = (key(d.groupBy("k", "s").applyInPandas(f, SCHEMA)) for f in (frame, two))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        assert key(grouped_apply(d, ["k", "s"], frame, SCHEMA)) == want
        assert key(grouped_apply(d, ["k", "s"], summary_, SCHEMA, partitions=3)) == want  # a mapping is one row
        assert key(grouped_apply(d, ["k", "s"], two, SCHEMA)) == pairs
        assert grouped_apply(d.limit(0), ["k", "s"], summary_, SCHEMA).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_many_groups_share_a_stream(spark):
    p = grouped_apply(rows(spark), ["k"], lambda pdf: pdf[["k"]].head(1), "k long")._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in p and "FlatMapGroupsInPandas" not in p
