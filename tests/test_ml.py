import pytest
from pyspark.sql import functions as F

from capforge.operators import ml as ML

SF = "/root/testdata/sf0.001"
FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def data(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    return li.select(*FEATS, "l_linenumber", "l_shipdate", (F.col("l_returnflag") == "R").cast("int").alias("y"),
                     F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("k"))


def test_split_is_stable_and_about_80_20(spark):
    d = data(spark)
    tr, te = ML.train_test_split(d, "k")
    n, a, b = d.count(), tr.count(), te.count()
    assert a + b == n and 0.75 < a / n < 0.85
    tr2, _ = ML.train_test_split(d.repartition(5), "k")
    assert sorted(r.k for r in tr.collect()) == sorted(r.k for r in tr2.collect())


def test_classifier_deterministic_and_save_load(spark, scratch):
    d = data(spark)
    m1, s1 = ML.train_classifier(d, FEATS, "y", key="k", maxIter=5)
    m2, s2 = ML.train_classifier(d, FEATS, "y", key="k", maxIter=5)
    assert s1.collect() == s2.collect()
    p = scratch("model")
    ML.save_model(m1, p)
    m3 = ML.load_model(p)
    a = ML.batch_predict(m1, d, FEATS, "y", keep=["k"]).orderBy("k").collect()
    b = ML.batch_predict(m3, d, FEATS, "y", keep=["k"]).orderBy("k").collect()
    assert a == b and set(a[0].asDict()) == {"k", "y", "predicted_y"}
    with pytest.raises(ValueError, match="missing"):
        ML.batch_predict(m1, d.drop("l_tax"), FEATS, "y")


def test_multiclass_and_regression(spark):
    d = data(spark).withColumn("cls", F.col("l_linenumber") % 3)
    _, m = ML.train_classifier(d, FEATS, "cls", key="k", maxIter=3)
    r = m.collect()[0]
    assert 0 <= r.accuracy <= 1 and 0 <= r.f1 <= 1
    _, rm = ML.train_regressor(d, ["l_quantity", "l_discount"], "l_extendedprice", key="k", maxIter=3)
    assert rm.collect()[0].rmse > 0


def test_predict_record_and_oot(spark, scratch):
    d = data(spark)
    model, _ = ML.train_classifier(d.filter(F.col("l_shipdate") < "1999-01-01"), FEATS, "y", key="k", maxIter=3)
    runs = scratch("runs")
    prev = ML.predict_and_record(model, d, FEATS, "y", scratch("out"), runs, {"id": "r1", "project_id": "p"},
                                 keep=["k"])
    assert prev.count() == 5 and spark.read.parquet(runs).collect()[0].status == "completed"
    oot = ML.oot_evaluation(model, d, FEATS, "y", "l_shipdate", "1999-01-01").collect()
    assert {r.part for r in oot} == {"horizon_1", "horizon_2"}


def test_rounds_go_over_counted_cells_with_the_same_trees(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.regression import GBTRegressor

    d = spark.range(3000).selectExpr(
        "(id * 7919) % 3001 / 3001.0 AS a", "CAST((id * 31) % 9 AS double) AS b", "if(id % 50 = 0, id % 7, 0) AS c", "CAST(id AS string) AS k")
    d = d.withColumn("y", F.expr(
        "int(pmod(hash(k), 100) < 20 + 60 * int(a > 0.4 and b < 5) + 10 * c)")).withColumn("z", F.expr("100 * a * b + c + pmod(hash(k), 50)"))
    big = d.union(d).union(d).withColumn("k", F.concat_ws("-", "k", F.monotonically_increasing_id()))
    feats = ["a", "b", "c"]
    for train, est, label, by_label in ((ML.train_classifier, GBTClassifier, "y", True), (ML.train_regressor, GBTRegressor, "z", False)):
        model, _ = train(big, feats, label, key="k", maxIter=4, maxDepth=4)
        bins, assembler, fitted = model.stages
        rows, _ = ML.train_test_split(big.withColumn("__label", F.col(label).cast("double")), "k")
        cells = ML._cells(rows, bins, by_label)
        assert cells.count() <= 32 * 9 * 7 * (2 if by_label else 1) < rows.count()
        assert cells.agg(F.sum("__weight")).first()[0] == rows.count()
        # the same trees from single rows
        names = bins.getOutputCols()
        one = bins.transform(rows).select(*[F.col(c).alias(c, metadata={}) for c in names], "__label")
        plain = est(featuresCol="__features", labelCol="__label", predictionCol="__prediction", seed=42, maxIter=4, maxDepth=4,
                    stepSize=0.1).fit(assembler.transform(one))
        a = [r[0] for r in model.transform(d).orderBy("k").select("__prediction").collect()]
        b = [r[0] for r in plain.transform(assembler.transform(bins.transform(d))).orderBy("k").select("__prediction").collect()]
        assert a == pytest.approx(b, abs=1e-9) and len(set(a)) > 1


def test_bins_hold_every_frequent_value_alone():
    assert ML.bin_bounds([1.0, 1.0, 2.0, 4.0], 3) == [1.5, 3.0]
    assert ML.bin_bounds([3.0] * 5, 32) == [] and ML.bin_bounds([], 32) == []
    assert ML.bin_bounds([float("-inf"), 1.0, float("inf")], 4) == [1.0]
    skewed = [0.0] * 900 + [float(i) for i in range(1, 101)]
    bounds = ML.bin_bounds(skewed, 32)
    assert bounds[0] == 0.5 and len(bounds) == 31 and max(b - a for a, b in zip(bounds, bounds[1:])) <= 5


def test_missing_labels_and_settings_by_row(spark):
    d = spark.range(400).selectExpr("id % 5 AS a", "if(id % 5 = 3, null, id * 1.5D) AS z", "id % 2 AS y", "id AS k")
    with pytest.raises(Exception, match="(?i)null"):
        ML.train_regressor(d, ["a"], "z", key="k", maxIter=1)
    model, m = ML.train_classifier(d, ["a"], "y", key="k", maxIter=1, subsamplingRate=0.5)
    assert len(model.stages) == 2 and 0 <= m.first().accuracy <= 1
    model, _ = ML.train_classifier(d.withColumn("a", F.lit(1)), ["a"], "y", key="k", maxIter=1)  # one value
    assert model.transform(d.withColumn("a", F.lit(1))).count() == 400


def test_scores_are_looked_up_by_cell(spark, monkeypatch):
    d = spark.range(900).selectExpr("(id * 7919) % 901 / 901.0 AS a", "CAST(id % 9 AS double) AS b", "id AS k", "int(id % 9 > 4) AS y",
                                    "id % 3 AS cls", "id % 9 + (id * 7919) % 901 / 9.0 AS z")
    odd = spark.createDataFrame([(v, w, 1000 + 10 * i + j, 0, 0, 0.0) for i, v in enumerate([None, float("nan"), float("inf"), -1e300, 0.0, 2.0])
                                 for j, w in enumerate([None, float("nan"), float("-inf"), 4.5, 99.0])], "a double, b double, k long, y int, cls long, z double")
    data = d.union(odd).union(odd)  # rows that repeat stay
    for train, label, outputs in ((ML.train_classifier, "y", ["__prediction", "probability"]), (ML.train_classifier, "cls", ["__prediction"]),
                                  (ML.train_regressor, "z", ["__prediction"])):
        model, _ = train(d, ["a", "b"], label, key="k", maxIter=3, maxDepth=3)
        plan = ML.score(model, data)._jdf.queryExecution().optimizedPlan().toString()
        assert "Range (0" in plan and "broadcast" in plan  # before: every row went through every tree
        want = sorted(str(tuple(r)) for r in model.transform(data).select(*data.columns, *outputs).collect())
        assert sorted(str(tuple(r)) for r in ML.score(model, data, outputs).collect()) == want
        with monkeypatch.context() as m:
            m.setattr(ML, "GRID", 1)  # a grid beyond the bound isn't built
            assert sorted(str(tuple(r)) for r in ML.score(model, data, outputs).collect()) == want
