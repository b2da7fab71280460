
from capforge.plans import lifecycle as L
from capforge.plans.fixtures import device_metrics

SF = "/root/testdata/sf0.001"


def test_lifecycle_end_to_end(spark, scratch):
    reg = L.Registries(scratch("lifecycle"))
    raw = device_metrics(spark, SF)
    cols = L.run_feature_engineering(spark, reg, "ds-1", "p1", raw=raw, tiebreak=["event_id"])
    assert "Value_target_Max" in cols
    L.run_feature_engineering(spark, reg, "ds-1", "p1", raw=raw, tiebreak=["event_id"])  # registry row once
    assert spark.read.parquet(reg.path("engineered")).count() == 1
    sel = L.run_feature_selection(spark, reg, "ds-1", "p1", "Target", k=4, exclude=["Value_target_Max"])
    assert len(sel["selected_features"]) == 4 and "Value_target_Max" not in sel["selected_features"]
    trained = L.train_model(spark, reg, "ds-1", sel["selection_id"], "p1", "classification", key="event_id",
                            maxIter=3)
    assert 0.0 <= trained["metrics"]["accuracy"] <= 1.0
    m = spark.read.parquet(reg.path("models")).collect()[0]
    assert m.name.startswith("ClassificationModel-") and m.metrics["accuracy"] == trained["metrics"]["accuracy"]
    preview = L.run_prediction(spark, reg, trained["model_id"], "ds-1", "p1", keep=["event_id"])
    assert preview.count() == 5 and "predicted_Target" in preview.columns
    run = spark.read.parquet(reg.path("predictions")).collect()[0]
    assert run.status == "completed" and spark.read.parquet(run.output_path).count() == raw.count()


def test_upload_download_and_delete(spark, scratch):
    import pytest

    from capforge.sources.files import scan_csv, sink_csv
    from capforge.sources.registry import path_exists

    reg, src = L.Registries(scratch("lifecycle")), scratch("upload")
    raw = device_metrics(spark, SF)
    sink_csv(raw, src)
    for project, dataset in (("p1", "ds-1"), ("p2", "ds-2")):
        up = L.upload_dataset(spark, reg, src, project, dataset_id=dataset)
        assert up["rows"] == raw.count() and up["columns"] == raw.columns
        L.run_feature_engineering(spark, reg, dataset, project, tiebreak=["event_id"])
    sel = L.run_feature_selection(spark, reg, "ds-1", "p1", "Target", k=4, exclude=["Value_target_Max"])
    model = L.train_model(spark, reg, "ds-1", sel["selection_id"], "p1", "classification", key="event_id", maxIter=2)
    preview = L.run_prediction(spark, reg, model["model_id"], "ds-1", "p1", keep=["event_id"])
    assert set(raw.columns) <= set(preview.columns)
    run = spark.read.parquet(reg.path("predictions")).first()
    out = scan_csv(spark, L.download_prediction(spark, reg, run.id, scratch("download")))
    assert out.count() == raw.count() and "predicted_Target" in out.columns
    with pytest.raises(ValueError, match="ds-9"):
        L.load_raw(spark, reg, "ds-9")
    with pytest.raises(ValueError, match="numeric"):
        L.run_feature_selection(spark, reg, "ds-1", "p1", "Type")
    gone = L.delete_project(spark, reg, "p1")
    assert len(gone) == 4 and not any(path_exists(spark, p) for p in gone)
    left = {name: [r.project_id for r in spark.read.parquet(reg.path(name)).collect()] for name in
            ("datasets", "engineered", "selections", "models", "predictions")}
    assert left == {"datasets": ["p2"], "engineered": ["p2"], "selections": [], "models": [], "predictions": []}
    assert L.load_engineered(spark, reg, "ds-2").count() == raw.count()
    assert L.delete_project(spark, reg, "p1") == []
