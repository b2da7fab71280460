import pytest
from pyspark.ml.evaluation import (BinaryClassificationEvaluator, MulticlassClassificationEvaluator,
                                   RegressionEvaluator)
from pyspark.sql import functions as F

from capforge.operators import metrics as M

SF = "/root/testdata/sf0.01"


def test_classification_matches_spark_ml(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet").select(
        (F.col("l_linenumber") % 3).cast("double").alias("label"),
        (F.col("l_quantity").cast("int") % 3).cast("double").alias("prediction"))
    got = M.classification_metrics(li).collect()[0]
    ev = MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction")
    for ours, name in (("accuracy", "accuracy"), ("f1", "f1"), ("precision", "weightedPrecision"),
                       ("recall", "weightedRecall")):
        assert got[ours] == pytest.approx(ev.setMetricName(name).evaluate(li), abs=1e-12)
    assert got.accuracy == pytest.approx(0.33215)


def test_class_never_predicted_counts_zero(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (2, 1)], "label int, prediction int")
    r = M.classification_metrics(df).collect()[0]
    # class 2: precision 0/0 -> 0, recall 0; class 1: precision 1/3
    assert r.accuracy == 0.5
    assert r.precision == pytest.approx((1 * 1 + 1 * (1 / 3) + 2 * 0) / 4)


def test_regression_matches_spark_ml_and_constant_label(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet").select(
        F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500).alias("prediction"))
    got = M.regression_metrics(li).collect()[0]
    ev = RegressionEvaluator(labelCol="label", predictionCol="prediction")
    assert got.rmse == pytest.approx(ev.setMetricName("rmse").evaluate(li))
    assert got.mae == pytest.approx(ev.setMetricName("mae").evaluate(li))
    assert got.r2 == pytest.approx(ev.setMetricName("r2").evaluate(li))
    assert got.rmse == pytest.approx(39908.100777) and got.r2 == pytest.approx(-0.759907, abs=1e-6)
    const = spark.createDataFrame([(5.0, 5.0), (5.0, 5.0)], "label double, prediction double")
    assert M.regression_metrics(const).collect()[0].r2 == 1.0
    const2 = spark.createDataFrame([(5.0, 4.0), (5.0, 5.0)], "label double, prediction double")
    assert M.regression_metrics(const2).collect()[0].r2 == 0.0


def test_auc_matches_exact_spark_ml(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet").select(
        (F.col("l_returnflag") == "R").cast("double").alias("label"), F.col("l_quantity").alias("score"))
    got = M.auc(li).collect()[0].auc
    ev = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="score", numBins=0)
    assert got == pytest.approx(ev.evaluate(li), abs=1e-12)
    assert got == pytest.approx(0.49898975411067237, abs=1e-12)


def test_auc_single_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.5)], "label int, score double")
    assert M.auc(df).collect()[0].auc is None
