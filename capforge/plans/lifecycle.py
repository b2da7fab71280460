"""The forecasting lifecycle as a sequence of Spark jobs.

Each step reads its input table, runs the DataFrame operators, writes its output
table and appends one registry row. Table contents never pass through the
driver; only registry rows, feature lists and one-row metrics do.

Registry locations are parquet folders given in ``Registries``; data tables are
parquet folders under ``Registries.tables``.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from typing import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capforge.functions.scalar import model_label
from capforge.operators import ml as ML
from capforge.operators.ranking import selection_record
from capforge.operators.windows import engineer_features
from capforge.sources.files import scan_csv, scan_table, sink_csv, sink_table
from capforge.sources.registry import (REGISTRY_SCHEMAS, append_records, delete_path, insert_if_absent, path_exists,
                                       registry_schema, replace_table)


@dataclass(frozen=True)
class Registries:
    """Where the registry tables and the data tables live (shared storage on a cluster)."""

    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/registry/{name}"

    @property
    def tables(self) -> str:
        return f"{self.root.rstrip('/')}/tables"

    def table(self, kind: str, id_: str) -> str:
        return f"{self.tables}/{kind}_{id_.replace('-', '_')}"


def _read_or_empty(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A registry table; empty where none has been written yet (any other failure is raised)."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], registry_schema(name))


def _registered(spark: SparkSession, reg: "Registries", registry: str, column: str, value: str):
    """The one registry row with ``column = value``; an error if there is none."""
    row = _read_or_empty(spark, reg.path(registry), registry).filter(F.col(column) == value).first()
    if row is None:
        raise ValueError(f"no {registry} row has {column} {value}")
    return row


def _row(spark: SparkSession, name: str, values: dict) -> DataFrame:
    schema = registry_schema(name)
    df = spark.createDataFrame([tuple(values.get(f.name) for f in schema.fields)], schema)
    return df.withColumn("created_at", F.coalesce(F.col("created_at"), F.current_timestamp()))


def upload_dataset(spark: SparkSession, reg: Registries, csv_path: str, project_id: str, name: str | None = None,
                   dataset_id: str | None = None, target_column: str | None = None) -> dict:
    """CSV → raw table ``raw_<id>`` + datasets registry row; the id, columns and row count."""
    dataset_id = dataset_id or str(uuid.uuid4())
    data, dest = scan_csv(spark, csv_path), reg.table("raw", dataset_id)
    sink_table(data, dest)
    filename = csv_path.rstrip("/").rsplit("/", 1)[-1]
    append_records(_row(spark, "datasets", {"id": dataset_id, "project_id": project_id, "name": name or filename,
                                            "filename": filename, "target_column": target_column}), reg.path("datasets"))
    return {"dataset_id": dataset_id, "columns": data.columns, "rows": scan_table(spark, dest).count()}


def load_raw(spark: SparkSession, reg: Registries, dataset_id: str) -> DataFrame:
    """The raw table of a registered dataset; an unknown dataset is an error."""
    return scan_table(spark, reg.table("raw", _registered(spark, reg, "datasets", "id", dataset_id).id))


def load_engineered(spark: SparkSession, reg: Registries, dataset_id: str) -> DataFrame:
    """The engineered table that the registry names for a dataset; an error where there is none."""
    return scan_table(spark, _registered(spark, reg, "engineered", "dataset_id", dataset_id).table_name)


def download_prediction(spark: SparkSession, reg: Registries, run_id: str, path: str) -> str:
    """The prediction table of a run as CSV files in the folder ``path``."""
    sink_csv(scan_table(spark, _registered(spark, reg, "predictions", "id", run_id).output_path), path)
    return path


def delete_project(spark: SparkSession, reg: Registries, project_id: str) -> list[str]:
    """Delete a project's rows from all five registries and then its raw, engineered, prediction and model
    folders, which the registries name. Every registry is written beside the old one and swapped in; the
    folders deleted are returned. Running it again after a failure finishes the job, as rows go last."""
    mine = F.col("project_id") == project_id
    tables = {name: _read_or_empty(spark, reg.path(name), name) for name in REGISTRY_SCHEMAS}
    paths = [reg.table("raw", r.id) for r in tables["datasets"].filter(mine).select("id").collect()]
    for name, column in (("engineered", "table_name"), ("predictions", "output_path"), ("models", "artifact_path")):
        paths += [r[0] for r in tables[name].filter(mine & F.col(column).isNotNull()).select(column).collect()]
    for path in paths:
        delete_path(spark, path)
    for name, table in tables.items():
        if path_exists(spark, reg.path(name)):
            replace_table(table.filter(~mine | F.col("project_id").isNull()), reg.path(name))
    return paths


def run_feature_engineering(spark: SparkSession, reg: Registries, dataset_id: str, project_id: str,
                            raw: DataFrame | None = None, tiebreak: Sequence[str] | None = None) -> list[str]:
    """Raw device table → engineered table ``feat_<id>`` + engineered registry row (once per dataset)."""
    raw = raw if raw is not None else load_raw(spark, reg, dataset_id)
    dest = reg.table("feat", dataset_id)
    feats = engineer_features(raw, tiebreak=tiebreak)
    sink_table(feats, dest)
    row = _row(spark, "engineered", {"dataset_id": dataset_id, "project_id": project_id, "table_name": dest})
    fresh = insert_if_absent(row, _read_or_empty(spark, reg.path("engineered"), "engineered"), "dataset_id")
    append_records(fresh, reg.path("engineered"))
    return feats.columns


def run_feature_selection(spark: SparkSession, reg: Registries, dataset_id: str, project_id: str, target: str,
                          k: int = 10, exclude: Sequence[str] = ()) -> dict:
    """Engineered table → top-k features by |Pearson| with the target + selection registry row."""
    feats = load_engineered(spark, reg, dataset_id)
    if target not in feats.columns:
        raise ValueError(f"{target} is none of the columns {feats.columns}")
    if not isinstance(feats.schema[target].dataType, (T.NumericType, T.BooleanType)):
        raise ValueError(f"{target} isn't numeric: features can't be ranked by correlation with it")
    rec = selection_record(feats, target, k, exclude).first()
    run_id = str(uuid.uuid4())
    append_records(_row(spark, "selections", {
        "id": run_id, "project_id": project_id, "dataset_id": dataset_id, "target_column": target,
        "selected_features": list(rec.selected_features),
        "dropped_features": [(d.name, d.reason) for d in rec.dropped_features]}), reg.path("selections"))
    return {"selection_id": run_id, "selected_features": list(rec.selected_features),
            "dropped_features": [d.asDict() for d in rec.dropped_features]}


def train_model(spark: SparkSession, reg: Registries, dataset_id: str, selection_id: str, project_id: str,
                task_type: str, key: str | None = None, **gbt) -> dict:
    """Selection run → fitted GBT on the engineered table, saved with Spark ML + model registry row."""
    sel = _registered(spark, reg, "selections", "id", selection_id)
    feats = load_engineered(spark, reg, dataset_id)
    train = ML.train_classifier if task_type == "classification" else ML.train_regressor
    model, metrics = train(feats, list(sel.selected_features), sel.target_column, key=key, **gbt)
    model_id = str(uuid.uuid4())
    path = reg.table("model", model_id)
    ML.save_model(model, path)
    m = {k: float(v) for k, v in metrics.first().asDict().items() if v is not None}
    append_records(_row(spark, "models", {
        "id": model_id, "project_id": project_id,
        "dataset_id": dataset_id, "selection_id": selection_id, "task_type": task_type,
        "target_column": sel.target_column, "metrics": m, "artifact_path": path}).withColumn(
        "name", model_label("task_type", "id")), reg.path("models"))
    return {"model_id": model_id, "metrics": m}


def run_prediction(spark: SparkSession, reg: Registries, model_id: str, dataset_id: str, project_id: str,
                   keep: Sequence[str] = ()) -> DataFrame:
    """Model + dataset → prediction table ``pred_res_<run>`` + prediction-run row; first 5 rows back."""
    models = _registered(spark, reg, "models", "id", model_id)
    sel = _registered(spark, reg, "selections", "id", models.selection_id)
    model = ML.load_model(models.artifact_path)
    data = load_engineered(spark, reg, dataset_id)
    run_id = str(uuid.uuid4())
    return ML.predict_and_record(model, data, list(sel.selected_features), models.target_column,
                                 reg.table("pred_res", run_id), reg.path("predictions"),
                                 {"id": run_id, "project_id": project_id, "model_id": model_id,
                                  "dataset_id": dataset_id}, keep=keep)
