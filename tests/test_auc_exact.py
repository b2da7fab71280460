"""AUC and medians on many distinct values: the same exact result for any partitioning and with exchange reuse on or off."""

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from capforge.operators import metrics as M
from capforge.operators import profile as P
from capforge.operators import selection


@pytest.fixture(scope="module")
def scores(spark):
    li = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet")
    # the key's hash as low digits makes nearly every score its own
    return li.select((F.col("l_returnflag") == "R").cast("int").alias("label"),
                     (F.col("l_extendedprice") + F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(10 ** 6)) / 1e9).alias("score"))


@pytest.fixture(scope="module")
def exact(scores):
    assert scores.select("score").distinct().count() >= 500_000
    area = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0).evaluate(scores)
    return area, scores.agg(F.median("score")).first()[0]


@pytest.mark.parametrize("reuse", ["true", "false"])
@pytest.mark.parametrize("parts", ["8", "16", "200"])
def test_same_for_any_partitioning(spark, scores, exact, parts, reuse):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.exchange.reuse")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        for _ in range(2):
            assert M.auc(scores).first()[0] == pytest.approx(exact[0], abs=1e-9)
            assert P.exact_medians(scores, ["score"]).first()["median"] == pytest.approx(exact[1], abs=1e-9)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("digits,held", [((18, 23, 23), 200_000), ((3, 4, 20, 20, 17), 2), ((40, 24), 100), ((64,), 10)])
def test_medians_with_other_digits(spark, monkeypatch, digits, held):
    monkeypatch.setattr(selection, "DIGITS", digits)
    monkeypatch.setattr(selection, "HELD", held)
    df = spark.range(20_001).select(F.pmod(F.xxhash64("id"), F.lit(5000)).cast("double").alias("a"), F.when(F.col("id") < 15_000, 3.0).otherwise(
        F.col("id")).alias("b"), (F.col("id") * 1.0).alias("c"), F.lit(None).cast("double").alias("d"),
        F.when(F.col("id") % 2 == 0, float("inf")).otherwise(-1.0).alias("e"))
    want = df.agg(*[F.median(c).alias(c) for c in "abcde"]).first()
    assert {r["column"]: r["median"] for r in P.exact_medians(df, list("abcde")).collect()} == want.asDict()


def test_auc_by_group(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.1), ("b", 1, 0.2), ("b", 0, 0.3), ("b", 0, 0.2), ("c", 1, 0.5), (None, 0, 1.0), (None, 1, 2.0)],
                               "g string, label int, score double")
    assert {r.g: r.auc for r in M.auc(df, by=["g"]).collect()} == {"a": 1.0, "b": 0.25, "c": None, None: 1.0}
    assert {r.part: r.auc for r in M.auc(df.withColumnRenamed("g", "part"), by=["part"]).collect()}["b"] == 0.25
