"""Model-quality metrics as aggregates.

Each takes a frame of (label, prediction/score) rows and returns one row. The
only pass over the data is a grouped count (map-side combined); the rest works
on per-class or per-score summaries.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capforge.operators.prefix import running_counts


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                           by: Sequence[str] = ()) -> DataFrame:
    """``accuracy`` and support-weighted ``f1``, ``precision``, ``recall`` (row 39), for each group of ``by``.

    An undefined precision/recall/F1 of a class (no predictions, no support) is 0,
    as with ``zero_division=0``. Rows with a NULL label or prediction are ignored.
    """
    by = list(by)
    pairs = (df.select(*by, F.col(label).cast("double").alias("y"), F.col(prediction).cast("double").alias("p"))
               .filter(F.col("y").isNotNull() & F.col("p").isNotNull())
               .groupBy(*by, "y", "p").agg(F.count(F.lit(1)).alias("n")))
    # per class: true positives, support (rows with that label), predicted (rows with that prediction)
    per = pairs.select(*by, F.explode(F.array(
        F.struct(F.col("y").alias("cls"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("tp"),
                 F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("p").alias("cls"), F.lit(0).cast("long").alias("tp"),
                 F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")))).alias("r")).select(*by, "r.*")
    cls = per.groupBy(*by, "cls").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"),
                                      F.sum("predicted").alias("predicted"))
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    cls = cls.select("*", prec.alias("prec"), rec.alias("rec"))
    f1 = F.when(F.col("prec") + F.col("rec") > 0,
                2 * F.col("prec") * F.col("rec") / (F.col("prec") + F.col("rec"))).otherwise(0.0)
    total = F.sum("support")
    return cls.groupBy(*by).agg(
        (F.sum("tp") / total).alias("accuracy"),
        (F.sum(f1 * F.col("support")) / total).alias("f1"),
        (F.sum(F.col("prec") * F.col("support")) / total).alias("precision"),
        (F.sum(F.col("rec") * F.col("support")) / total).alias("recall"),
    )


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``rmse``, ``mae``, ``r2`` (row 40). With a constant label R² is 1.0 for a perfect fit, else 0.0."""
    y = F.col(label).cast("double")
    e = y - F.col(prediction).cast("double")
    a = df.filter(F.col(label).isNotNull() & F.col(prediction).isNotNull()).agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("var_y"))
    r2 = (F.when(F.col("var_y") > 0, 1 - F.col("mse") / F.col("var_y"))
           .when(F.col("mse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return a.select(F.sqrt("mse").alias("rmse"), F.col("mae"), r2.alias("r2"))


def auc(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve, ties counted half (rank-sum / Mann–Whitney form) (row 41), for each group of ``by``.

    Scores are grouped to ``(score, positives, negatives)``; the negatives below
    each score come from distributed running counts, so no task sorts all scores.
    → one row ``auc`` (NULL when a class is absent) for each group.
    """
    by, y = list(by), F.col(label).cast("double")
    per = (df.select(*by, y.alias("y"), F.col(score).cast("double").alias("s"))
             .filter(F.col("y").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s"))
             .groupBy(*by, "s").agg(F.sum(F.when(F.col("y") > 0, 1).otherwise(0)).cast("long").alias("pos"),
                                    F.sum(F.when(F.col("y") > 0, 0).otherwise(1)).cast("long").alias("neg")))
    groups = by or ["__g"]
    ranked = running_counts(per if by else per.withColumn("__g", F.lit(0)), groups, "s", "neg")
    a = ranked.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("__before") + F.col("neg") / 2.0)).alias("num"),
                                F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return a.select(*by, F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("num") / (F.col("P") * F.col("N")))
                    .alias("auc"))
