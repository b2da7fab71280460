"""Model jobs on tables with Spark ML.

Gradient-boosted trees replace the reference's boosted-tree library with the same
settings (100 rounds, depth 6, rate 0.1, seed 42). Training, scoring and metrics
are distributed; only the fitted model and the one-row metrics reach the driver.
"""

from __future__ import annotations

import math
from collections import Counter
from typing import Sequence

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, OneVsRestModel
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capforge.functions import fixed as FX
from capforge.operators.metrics import auc, classification_metrics, regression_metrics
from capforge.operators.relational import missing_columns
from capforge.plans.pipeline import horizon_split
from capforge.session import materialised

GBT_DEFAULTS = {"maxIter": FX.GBT_ROUNDS, "maxDepth": FX.GBT_DEPTH, "stepSize": FX.GBT_RATE, "seed": FX.SEED}


def split_bucket(key: str | Column, seed: int = 42) -> Column:
    """Stable bucket 0–99 of a key: first 8 hex digits of ``md5('<key>:<seed>')``.

    Independent of partitioning and recomputation (unlike ``randomSplit``), and
    the same formula runs in SQL engines, so the split can be checked.
    """
    k = F.col(key) if isinstance(key, str) else key
    h = F.conv(F.substring(F.md5(F.concat(k.cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10)
    return (h.cast("long") % 100).cast("int")


def train_test_split(df: DataFrame, key: str, test: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """80/20 (by default) split on a key hash (row 63) → ``(train, test)``."""
    cut = int(round(100 * (1 - test)))
    b = split_bucket(key, seed)
    return df.filter(b < cut), df.filter(b >= cut)


def with_split(df: DataFrame, key: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    cut = int(round(100 * (1 - test)))
    return df.withColumn("split", F.when(split_bucket(key, seed) < cut, "train").otherwise("test"))


def _features_frame(df: DataFrame, features: Sequence[str]) -> DataFrame:
    missing = missing_columns(df, features)
    if missing:
        raise ValueError(f"feature columns missing from the data: {missing}")
    return df.na.fill(0, subset=list(features))


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="__features", handleInvalid="keep")


#: Quantiles of a feature that its bins are cut from.
SKETCH = 10_000

#: Settings under which equal rows may be counted together; others (``subsamplingRate``, ``minInstancesPerNode``,
#: another loss, columns of weights) tell rows apart.
_COUNTABLE = {"maxIter", "maxDepth", "stepSize", "seed", "maxBins", "minInfoGain", "maxMemoryInMB", "cacheNodeIds",
              "checkpointInterval", "featureSubsetStrategy"}


def bin_bounds(values: Sequence[float], bins: int) -> list[float]:
    """Bounds between at most ``bins`` bins of ``values``: each value its own where that suffices, else about
    equal shares, frequent values alone."""
    counts = sorted(Counter(values).items())
    bounds, left, room, held = [], len(values), bins, 0
    for (value, n), (after, follows) in zip(counts, counts[1:]):
        held += n
        if len(counts) <= bins or held * room >= left or follows * room >= left:
            between = value / 2 + after / 2
            bounds.append(between if value < between <= after else after)
            left, room, held = left - held, room - 1, 0
    return [b for b in bounds if math.isfinite(b)]


def _binned(data: DataFrame, features: Sequence[str], bins: int) -> Bucketizer:
    """The bins of each feature over all rows of ``data``, from quantiles found in one pass."""
    at = F.split(F.lit(",".join(str(i / SKETCH) for i in range(SKETCH + 1))), ",").cast("array<double>")
    found = data.agg(*[F.percentile_approx(F.col(f"`{c}`").cast("double"), at, SKETCH).alias(f"q{i}")
                       for i, c in enumerate(features)]).first()
    bounds = [bin_bounds(q or [], bins) or [next((x for x in q or [] if math.isfinite(x)), 0.0)] for q in found]
    return Bucketizer(splitsArray=[[-math.inf, *b, math.inf] for b in bounds], inputCols=list(features),
                      outputCols=[f"__bin_{c}" for c in features], handleInvalid="keep")


def _cells(train: DataFrame, bins: Bucketizer, by_label: bool) -> DataFrame:
    """The rows of ``train`` counted by cell (the bins of all features) and label, as ``__weight``; without
    ``by_label`` by cell alone, with the mean label."""
    cols = [F.col(f"`{c}`") for c in bins.getOutputCols()]
    kept = bins.transform(train).select(*cols, "__label")
    n = F.count(F.lit(1)).cast("double").alias("__weight")
    if by_label:
        return kept.groupBy(*cols, "__label").agg(n)
    mean = F.when(F.count("__label") == F.count(F.lit(1)), F.avg("__label"))  # a missing label stays an error
    return kept.groupBy(*cols).agg(n, mean.alias("__label"))


def _fit(train: DataFrame, features: Sequence[str], gbt: dict, estimator, by_label: bool) -> PipelineModel:
    """The pipeline of ``estimator(**columns)`` on all of ``train``.

    Trees see a row as its cell (the bins of its features) only, and add up labels or residuals by cell. So rows
    are counted by cell and label once, and every round goes over the weighted cells, whose number the features
    bound (bins to the power of features, times classes), not the rows. Under squared loss the trees need of a
    cell's labels only their number and mean: what labels vary by within a cell is the same on both sides of a split.
    """
    numeric = all(isinstance(train.schema[c].dataType, T.NumericType) for c in features)
    if not numeric or set(gbt) - _COUNTABLE:
        train = train.persist(StorageLevel.MEMORY_AND_DISK)  # one pass for each round otherwise
        model = Pipeline(stages=[_assembler(features), estimator()]).fit(train)
        train.unpersist()
        return model
    bins = _binned(train, features, gbt.get("maxBins", 32))
    cells = _cells(train, bins, by_label).persist(StorageLevel.MEMORY_AND_DISK)
    n = cells.count()
    cores = train.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(math.ceil(n / 20_000), max(cores, math.ceil(n / 500_000))))
    names = bins.getOutputCols()
    # bins are ordered numbers to the trees, not categories; the order of rows doesn't hang on the shuffle
    ordered = cells.select(*[F.col(f"`{c}`").alias(c, metadata={}) for c in names], "__label", "__weight").repartition(
        tasks, *[F.col(f"`{c}`") for c in names]).sortWithinPartitions(*[F.col(f"`{c}`") for c in names], "__label")
    assembler = _assembler(names)
    fitted = estimator(weightCol="__weight").fit(assembler.transform(ordered))
    cells.unpersist()
    return PipelineModel([bins, assembler, fitted])


def train_classifier(df: DataFrame, features: Sequence[str], label: str, key: str | None = None,
                     test: float = 0.2, **gbt) -> tuple[PipelineModel, DataFrame]:
    """Fit GBT classification on the train split; metrics on the test split (row 64).

    More than two classes → one-vs-rest over binary GBTs. → ``(model, metrics row)``
    with ``accuracy, f1, precision, recall``.
    """
    params = {**GBT_DEFAULTS, **gbt}
    data = _features_frame(df, features).withColumn("__label", F.col(label).cast("double"))
    train, test_df = _split(data, key, test, params["seed"])
    n_classes = data.select("__label").distinct().limit(3).count()

    def estimator(**cols):
        base = GBTClassifier(featuresCol="__features", labelCol="__label", predictionCol="__prediction", **params)
        return base.setParams(**cols) if n_classes <= 2 else OneVsRest(
            classifier=base, featuresCol="__features", labelCol="__label", predictionCol="__prediction", **cols)

    model = _fit(train, features, params, estimator, by_label=True)
    return model, classification_metrics(score(model, test_df), "__label", "__prediction")


def train_regressor(df: DataFrame, features: Sequence[str], label: str, key: str | None = None,
                    test: float = 0.2, **gbt) -> tuple[PipelineModel, DataFrame]:
    """Fit GBT regression; ``rmse, mae, r2`` on the test split (row 65)."""
    params = {**GBT_DEFAULTS, **gbt}
    data = _features_frame(df, features).withColumn("__label", F.col(label).cast("double"))
    train, test_df = _split(data, key, test, params["seed"])

    def estimator(**cols):
        return GBTRegressor(featuresCol="__features", labelCol="__label", predictionCol="__prediction", **params, **cols)

    model = _fit(train, features, params, estimator, by_label=False)
    return model, regression_metrics(score(model, test_df), "__label", "__prediction")


def _split(df: DataFrame, key: str | None, test: float, seed: int):
    if key is None:
        key_col = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
        df = df.withColumn("__rowkey", key_col)
        key = "__rowkey"
    train, test_df = train_test_split(df, key, test, seed)
    return train, test_df


def save_model(model: PipelineModel, path: str) -> None:
    """Persist with Spark ML's writer (row 66); never pickle."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


#: Cells of a model up to which their scores are tabulated.
GRID = 1 << 18


def score(model: PipelineModel, df: DataFrame, outputs: Sequence[str] = ("__prediction",)) -> DataFrame:
    """``df`` with the columns ``outputs`` that the model adds.

    Trees on bins see a row as its cell only. Where bins and features bound the cells to ``GRID``, the model scores each
    cell of the grid once, and a row looks up its cell's; otherwise each row goes through the trees.
    """
    bins = model.stages[0]
    kept, added = [F.col(f"`{c}`") for c in df.columns], [F.col(f"`{c}`") for c in outputs]
    sizes = [len(s) for s in bins.getSplitsArray()] if isinstance(bins, Bucketizer) else []  # the last bin: missing values
    if not sizes or math.prod(sizes) > GRID:
        return model.transform(df).select(*kept, *added)
    strides = [math.prod(sizes[:i]) for i in range(len(sizes))]
    names = bins.getOutputCols()
    grid = df.sparkSession.range(math.prod(sizes)).select(F.col("id").alias("__cell"), *[
        (F.floor(F.col("id") / F.lit(step)) % size).cast("double").alias(c) for c, size, step in zip(names, sizes, strides)])
    scores = PipelineModel(model.stages[1:]).transform(grid).select("__cell", *added)
    cell = sum((F.coalesce(F.col(f"`{c}`").cast("long"), F.lit(size - 1)) * step for c, size, step in zip(names, sizes, strides)), F.lit(0))
    placed = bins.transform(df).select(*kept, cell.cast("long").alias("__cell"))
    return placed.join(F.broadcast(scores), "__cell", "left").select(*kept, *added)


def batch_predict(model: PipelineModel, df: DataFrame, features: Sequence[str], target: str | None = None,
                  keep: Sequence[str] = ()) -> DataFrame:
    """Check features, fill 0, score; keep ``[keep..., target?, predicted_<target>]`` (row 67)."""
    data = _features_frame(df, features)
    scored = score(model, data)
    name = f"predicted_{target}" if target else "prediction"
    cols = [F.col(f"`{c}`") for c in keep]
    if target and target in df.columns:
        cols.append(F.col(f"`{target}`"))
    return scored.select(*cols, F.col("__prediction").alias(name))


def predict_and_record(model: PipelineModel, df: DataFrame, features: Sequence[str], target: str | None,
                       output_path: str, runs_path: str, run: dict, keep: Sequence[str] = (),
                       n: int = 5) -> DataFrame:
    """Score, write the prediction table (``keep``, target, prediction), append the run row, return the first
    ``n`` scored rows with all input columns (row 68)."""
    from capforge.sources.registry import append_records, registry_schema

    name = f"predicted_{target}" if target else "prediction"
    scored = score(model, _features_frame(df, features)).withColumn(name, F.col("__prediction")).select(*df.columns, name)
    spark = df.sparkSession
    kept = [*keep, *([target] if target and target in df.columns else []), name]
    scored.select(*kept).write.mode("overwrite").parquet(output_path)
    row = {**run, "output_path": output_path, "status": run.get("status", FX.RUN_DONE)}
    schema = registry_schema("predictions")
    rec = spark.createDataFrame([tuple(row.get(f.name) for f in schema.fields)], schema)
    rec = rec.withColumn("created_at", F.coalesce(F.col("created_at"), F.current_timestamp()))
    append_records(rec, runs_path)
    order = list(keep) or kept
    return scored.orderBy(*[F.col(f"`{c}`").asc_nulls_last() for c in order]).limit(n)


def oot_evaluation(model: PipelineModel, df: DataFrame, features: Sequence[str], label: str, ts: str,
                   cutoff: str, past_weeks: int = 12, n1_weeks: int = 4, n2_weeks: int = 8) -> DataFrame:
    """Out-of-time evaluation (row 69): score the rows after ``cutoff`` and report, per horizon part,
    ``accuracy, f1, precision, recall`` and ``auc`` (probability of class 1 as the score)."""
    later = horizon_split(df, ts, cutoff, past_weeks, n1_weeks, n2_weeks).filter(F.col("part") != "train")
    later = _features_frame(later, features)
    if hasattr(model.stages[-1], "getProbabilityCol") and not isinstance(model.stages[-1], OneVsRestModel):
        from pyspark.ml.functions import vector_to_array
        scored = score(model, later, ["__prediction", "probability"]).withColumn("__score", vector_to_array("probability")[1])
    else:
        scored = score(model, later).withColumn("__score", F.col("__prediction"))
    # scored once: both metrics read the stored scores
    scored = materialised(scored.select("part", F.col(label).alias("label"), "__prediction", "__score"), "scored")
    quality = classification_metrics(scored, "label", "__prediction", by=["part"])
    area = auc(scored, "label", "__score", by=["part"])
    parts = df.sparkSession.createDataFrame([("horizon_1",), ("horizon_2",)], "part string")
    return parts.join(quality, "part", "left").join(area, "part", "left")


def list_models(models: DataFrame, project_id: str) -> DataFrame:
    """Models of one project with their metrics map (row 70)."""
    return models.filter(F.col("project_id") == F.lit(project_id)).select(
        "id", "name", "project_id", "dataset_id", "task_type", "target_column", "metrics", "artifact_path")
