"""Checks for model jobs.

Scores cannot equal another library's trees, so training and scoring are rows-only
checks (no oracle); the split, registry listing and grouped apply have oracles.
Training uses the reference's settings (100 rounds, depth 6, rate 0.1, seed 42).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from capforge.functions.scalar import round_doubles
from capforge.operators import grouped as G
from capforge.operators import ml as ML
from capforge.plans.checks import device_sql, register
from capforge.plans.checks_relational import UUID_SQL, models_registry
from capforge.plans.fixtures import device_metrics, table
from capforge.session import scratch_dir

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def labelled(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", *FEATURES, "l_shipdate",
                     (F.col("l_returnflag") == "R").cast("int").alias("is_returned"),
                     F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_key"))


@register("train_test_split", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN ('0x' || substr(md5(CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' ||
       CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) || ':42'), 1, 8))::BIGINT % 100 < 80
       THEN 'train' ELSE 'test' END AS split
FROM lineitem
""")
def q_train_test_split(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    keyed = li.withColumn("__k", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return ML.with_split(keyed, "__k").drop("__k")


@register("train_classifier")
def q_train_classifier(spark, sf_dir):
    _, metrics = ML.train_classifier(labelled(spark, sf_dir), FEATURES, "is_returned", key="row_key")
    return round_doubles(metrics)


_MODELS: dict = {}


def _fitted(spark, sf_dir):
    """The classifier of ``train_classifier``, fitted once per Spark application and table folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MODELS:
        _MODELS[key], _ = ML.train_classifier(labelled(spark, sf_dir), FEATURES, "is_returned", key="row_key")
    return _MODELS[key]


REGRESSION_FEATURES = ["l_quantity", "l_discount", "l_tax"]


def _fitted_regressor(spark, sf_dir):
    """(model, metrics) of ``train_regressor``, fitted once per Spark application and table folder."""
    key = (spark.sparkContext.applicationId, sf_dir, "regressor")
    if key not in _MODELS:
        model, metrics = ML.train_regressor(labelled(spark, sf_dir), REGRESSION_FEATURES, "l_extendedprice", key="row_key")
        _MODELS[key] = model, metrics.first()
    return _MODELS[key]


@register("train_regressor")
def q_train_regressor(spark, sf_dir):
    metrics = _fitted_regressor(spark, sf_dir)[1]
    return round_doubles(spark.createDataFrame([metrics.asDict()], "rmse double, mae double, r2 double"))


_ROW_KEY_SQL = ("CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) "
                "|| '-' || CAST(l_suppkey AS VARCHAR)")
_RETURNED_SQL = "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END"


@register("train_split_support", f"""
SELECT {_RETURNED_SQL} AS is_returned,
       count(*) FILTER (WHERE ('0x' || substr(md5({_ROW_KEY_SQL} || ':42'), 1, 8))::BIGINT % 100 < 80) AS train_rows,
       count(*) FILTER (WHERE ('0x' || substr(md5({_ROW_KEY_SQL} || ':42'), 1, 8))::BIGINT % 100 >= 80) AS test_rows
FROM lineitem GROUP BY 1
""")
def q_train_split_support(spark, sf_dir):
    """Rows of each class that a training job fits and tests on."""
    train, test = ML.train_test_split(labelled(spark, sf_dir), "row_key")
    both = train.withColumn("t", F.lit(True)).unionByName(test.withColumn("t", F.lit(False)))
    return both.groupBy("is_returned").agg(F.count_if("t").alias("train_rows"), F.count_if(~F.col("t")).alias("test_rows"))


def _close(a, b):
    return F.coalesce(F.abs(a - b) <= F.lit(1e-9) * (1 + F.abs(b)), F.lit(False))


@register("train_regressor_checked", f"""
SELECT count(*) AS n, true AS rmse_same, true AS mae_same, true AS r2_same, true AS better_than_mean FROM lineitem
WHERE ('0x' || substr(md5({_ROW_KEY_SQL} || ':42'), 1, 8))::BIGINT % 100 >= 80
""")
def q_train_regressor_checked(spark, sf_dir):
    """The reported metrics are those of the stored predictions of the test rows, and better than the mean's."""
    model, reported = _fitted_regressor(spark, sf_dir)
    _, test = ML.train_test_split(labelled(spark, sf_dir), "row_key")
    path = scratch_dir(spark, "regression")
    ML.batch_predict(model, test, REGRESSION_FEATURES, "l_extendedprice").write.parquet(path)
    y, p = F.col("l_extendedprice"), F.col("predicted_l_extendedprice")
    again = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"), F.avg(F.abs(y - p)).alias("mae"),
                                         (1 - F.sum((y - p) * (y - p)) / (F.var_pop(y) * F.count(F.lit(1)))).alias("r2"))
    return again.select("n", *[_close(F.col(m), F.lit(float(reported[m]))).alias(f"{m}_same") for m in ("rmse", "mae", "r2")],
                        (F.col("r2") > 0).alias("better_than_mean"))


@register("batch_predict_rows", f"SELECT {_ROW_KEY_SQL} AS row_key, {_RETURNED_SQL} AS is_returned, true AS is_label FROM lineitem")
def q_batch_predict_rows(spark, sf_dir):
    """Every row is scored once, keeps its key and target, and gets one of the labels."""
    scored = ML.batch_predict(_fitted(spark, sf_dir), labelled(spark, sf_dir), FEATURES, "is_returned", keep=["row_key"])
    return scored.select("row_key", "is_returned", F.col("predicted_is_returned").isin(0.0, 1.0).alias("is_label"))


@register("save_load_same", "SELECT count(*) AS n, 0 AS differing FROM lineitem")
def q_save_load_same(spark, sf_dir):
    """A reloaded model predicts what the one in memory does."""
    path, model, data = scratch_dir(spark, "model"), _fitted(spark, sf_dir), labelled(spark, sf_dir)
    ML.save_model(model, path)
    again = ML.load_model(path)
    for stage, name in ((model, "__kept"), (again, "__loaded")):
        data = ML.score(stage, data.na.fill(0, subset=FEATURES)).withColumnRenamed("__prediction", name)
    return data.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("__kept") != F.col("__loaded")).alias("differing"))


@register("predict_and_record_run", "SELECT 'run-2' AS id, 'completed' AS status, count(*) AS n, min(l_quantity) AS least FROM lineitem")
def q_predict_and_record_run(spark, sf_dir):
    """The run's registry row, the size of its table, and the input columns of its preview."""
    out, runs = scratch_dir(spark, "pred_res"), scratch_dir(spark, "pred_runs")
    preview = ML.predict_and_record(_fitted(spark, sf_dir), labelled(spark, sf_dir), FEATURES, "is_returned", out, runs,
                                    {"id": "run-2", "project_id": "p"}, keep=["row_key"])
    if set(labelled(spark, sf_dir).columns) - set(preview.columns):
        raise AssertionError("the preview lacks input columns")
    stored = spark.read.parquet(out)
    least = labelled(spark, sf_dir).join(stored.select("row_key"), "row_key", "left_semi").agg(F.min("l_quantity").alias("least"))
    return spark.read.parquet(runs).select("id", "status").crossJoin(F.broadcast(stored.agg(F.count(F.lit(1)).alias("n")))).crossJoin(
        F.broadcast(least))


@register("oot_parts", """
SELECT part, count(*) AS n, true AS scored FROM (
  SELECT CASE WHEN l_shipdate < TIMESTAMP '1999-01-01' + INTERVAL 28 DAY THEN 'horizon_1' ELSE 'horizon_2' END AS part FROM lineitem
  WHERE l_shipdate >= TIMESTAMP '1999-01-01' AND l_shipdate < TIMESTAMP '1999-01-01' + INTERVAL 56 DAY) GROUP BY part
""")
def q_oot_parts(spark, sf_dir):
    """Each out-of-time part has its rows and all its metrics within bounds."""
    data = labelled(spark, sf_dir)
    m = ML.oot_evaluation(_fitted(spark, sf_dir), data, FEATURES, "is_returned", "l_shipdate", "1999-01-01")
    inside = F.lit(True)
    for c in ("accuracy", "f1", "precision", "recall", "auc"):
        inside = inside & F.col(c).between(0, 1)
    later = ML.horizon_split(data, "l_shipdate", "1999-01-01", 12, 4, 8).filter("part <> 'train'").groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    return later.join(m, "part").select("part", "n", inside.alias("scored"))


@register("oot_metrics_checked", """
SELECT part, count(*) AS n, true AS accuracy_same, true AS f1_same, true AS precision_same, true AS recall_same, true AS auc_same FROM (
  SELECT CASE WHEN l_shipdate < TIMESTAMP '1999-01-01' + INTERVAL 28 DAY THEN 'horizon_1' ELSE 'horizon_2' END AS part FROM lineitem
  WHERE l_shipdate >= TIMESTAMP '1999-01-01' AND l_shipdate < TIMESTAMP '1999-01-01' + INTERVAL 56 DAY) GROUP BY part
""")
def q_oot_metrics_checked(spark, sf_dir):
    """The reported metrics of each part are those that Spark ML's evaluators find in its stored scores."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
    from pyspark.ml.functions import vector_to_array

    model, data, path = _fitted(spark, sf_dir), labelled(spark, sf_dir), scratch_dir(spark, "oot")
    reported = ML.oot_evaluation(model, data, FEATURES, "is_returned", "l_shipdate", "1999-01-01")
    later = ML.horizon_split(data, "l_shipdate", "1999-01-01", 12, 4, 8).filter("part <> 'train'")
    model.transform(later.na.fill(0, subset=FEATURES)).select("part", F.col("is_returned").cast("double").alias("label"), F.col("__prediction").alias("prediction"),
                                                             vector_to_array("probability")[1].alias("score")).write.parquet(path)
    rows = []
    for part in ("horizon_1", "horizon_2"):
        stored = spark.read.parquet(path).filter(F.col("part") == part)
        if stored.isEmpty():
            continue
        found = {m: MulticlassClassificationEvaluator(metricName=k).evaluate(stored) for m, k in (
            ("accuracy", "accuracy"), ("f1", "f1"), ("precision", "weightedPrecision"), ("recall", "weightedRecall"))}
        both = stored.select("label").distinct().count() == 2  # else the area is undefined
        area = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0).evaluate(stored) if both else None
        rows.append((part, stored.count(), *found.values(), area))
    again = spark.createDataFrame(rows, "part string, n long, " + ", ".join(f"x_{m} double" for m in ("accuracy", "f1", "precision", "recall", "auc")))
    same = [(_close(F.col(m), F.col(f"x_{m}")) | (F.col(m).isNull() & F.col(f"x_{m}").isNull())).alias(f"{m}_same")
            for m in ("accuracy", "f1", "precision", "recall", "auc")]
    return again.join(reported, "part").select("part", "n", *same)


@register("save_load_model")
def q_save_load_model(spark, sf_dir):
    path = scratch_dir(spark, "model")
    ML.save_model(_fitted(spark, sf_dir), path)
    model = ML.load_model(path)
    return ML.batch_predict(model, labelled(spark, sf_dir), FEATURES, "is_returned", keep=["row_key"])


@register("batch_predict")
def q_batch_predict(spark, sf_dir):
    return ML.batch_predict(_fitted(spark, sf_dir), labelled(spark, sf_dir), FEATURES, "is_returned",
                            keep=["row_key"])


@register("predict_and_record")
def q_predict_and_record(spark, sf_dir):
    run = {"id": "run-1", "project_id": "p", "model_id": "m", "dataset_id": "lineitem"}
    return ML.predict_and_record(_fitted(spark, sf_dir), labelled(spark, sf_dir), FEATURES, "is_returned",
                                 scratch_dir(spark, "pred_res"), scratch_dir(spark, "pred_runs"), run,
                                 keep=["row_key"])


@register("oot_evaluation")
def q_oot_evaluation(spark, sf_dir):
    data = labelled(spark, sf_dir)
    train = data.filter(F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
    model, _ = ML.train_classifier(train, FEATURES, "is_returned", key="row_key")
    return round_doubles(ML.oot_evaluation(model, data, FEATURES, "is_returned", "l_shipdate", "1999-01-01"))


@register("list_models", f"""
SELECT {UUID_SQL.format(k='o_orderkey')} AS id,
  CASE WHEN o_orderstatus = 'F' THEN 'Classification' ELSE 'Regression' END || 'Model-' ||
    substr({UUID_SQL.format(k='o_orderkey')}, 1, 6) AS name,
  CAST(o_custkey AS VARCHAR) AS project_id, CAST(o_orderkey AS VARCHAR) AS dataset_id,
  CASE WHEN o_orderstatus = 'F' THEN 'classification' ELSE 'regression' END AS task_type,
  'Target' AS target_column, round(o_totalprice / 1e6, 6) AS accuracy,
  'models/' || CAST(o_orderkey AS VARCHAR) AS artifact_path
FROM orders WHERE o_custkey = 7
""")
def q_list_models(spark, sf_dir):
    from capforge.operators.relational import model_label
    m = model_label(models_registry(spark, sf_dir)).withColumn("name", F.col("model_name"))
    out = ML.list_models(m, "7")
    return round_doubles(out.select("*", F.col("metrics")["accuracy"].alias("accuracy")).drop("metrics"))


@register("grouped_apply", f"""
SELECT "Type", "IP", date_trunc('day', "Date") AS day, count(*) AS n, round(max("Value"), 6) AS max_value,
       round(avg("Value"), 6) AS mean_value
FROM ({device_sql()}) d GROUP BY 1, 2, 3
""")
def q_grouped_apply(spark, sf_dir):
    # defined here so it is pickled by value: workers need not import this package
    def _day_summary(pdf: pd.DataFrame) -> dict:
        return {
            "Type": pdf["Type"].iloc[0], "IP": pdf["IP"].iloc[0], "day": pdf["day"].iloc[0],
            "n": len(pdf), "max_value": pdf["Value"].max(), "mean_value": pdf["Value"].mean(),
        }

    d = device_metrics(spark, sf_dir).withColumn("day", F.date_trunc("day", "Date").cast("timestamp_ntz"))
    out = G.grouped_apply(d.select("Type", "IP", "day", "Value"), ["Type", "IP", "day"], _day_summary,
                          "Type string, IP string, day timestamp_ntz, n long, max_value double, mean_value double")
    return round_doubles(out)
