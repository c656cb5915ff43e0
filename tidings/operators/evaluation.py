"""Confusion counts, metrics, rankings and report tables.

Everything after the confusion counts works on one row per model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidings import fixed
from tidings.functions.scores import round2
from tidings.functions.text import percent

METRICS = ["accuracy", "precision", "recall", "f1"]


def attach_truth(predictions: DataFrame, truth: DataFrame, id_col: str = "msg_id") -> DataFrame:
    """Align predictions with labels by id."""
    return predictions.join(truth.select(id_col, F.col("label").alias("truth")), id_col)


def confusion(
    df: DataFrame, by: str = "model_key", truth: str = "truth", prediction: str = "prediction"
) -> DataFrame:
    """Counts per model with spam as the positive class; one combining aggregate."""
    cells = [("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1)]
    return df.groupBy(by).agg(
        *[
            F.count_if((F.col(truth) == t) & (F.col(prediction) == p)).alias(name)
            for name, t, p in cells
        ]
    )


def metrics_from_confusion(df: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 in percent; 0 where undefined."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def ratio(top: Column, bottom: Column) -> Column:
        return round2(F.coalesce(F.try_divide(top, bottom), F.lit(0.0)) * 100)

    return df.withColumns(
        {
            "accuracy": ratio(tp + tn, tn + fp + fn + tp),
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
        }
    )


def enrich_metrics(metrics: DataFrame, registry: DataFrame) -> DataFrame:
    """Metrics with the descriptive attributes of their model."""
    attributes = registry.select(
        "model_key",
        F.col("model_name").alias("name"),
        "short",
        F.upper("type").alias("type"),
        "member",
        "color",
    )
    return metrics.join(attributes, "model_key")


def upsert_metrics(old: DataFrame, new: DataFrame, key: str = "model_key") -> DataFrame:
    """New rows replace old ones of the same key; other old rows stay."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def report(metrics: DataFrame) -> DataFrame:
    """Metrics spelled as percentages."""
    return metrics.withColumns({m: percent(F.col(m)) for m in METRICS})


def leaderboard(metrics: DataFrame) -> DataFrame:
    """Models by falling F1; equal ones in key order, the order a JSON map has."""
    rank = F.row_number().over(Window.orderBy(F.desc("f1"), "model_key"))
    rank_class = F.lit(fixed.RANK_CLASS_OTHER)
    for place, name in enumerate(fixed.RANK_CLASSES, start=1):
        rank_class = F.when(F.col("rank") == place, F.lit(name)).otherwise(rank_class)
    return metrics.withColumn("rank", rank).withColumn("rank_class", rank_class)


def best_models(metrics: DataFrame) -> DataFrame:
    """Best accuracy and best F1, taken independently, and the model of the latter."""
    first = F.struct(-F.col("f1"), "model_key")
    return metrics.agg(
        F.max("accuracy").alias("best_accuracy"),
        F.max("f1").alias("best_f1"),
        F.min_by("model_key", first).alias("best_key"),
        F.when(F.max("f1") > 0, F.min_by("name", first)).otherwise(F.lit("")).alias("best_model"),
    )


def chart_matrix(metrics: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Metric by model in a fixed order; a model without metrics shows zeros."""
    keys = keys or fixed.COMPARE_ORDER
    spark = metrics.sparkSession
    listed = spark.createDataFrame(list(enumerate(keys, start=1)), "`order` INT, model_key STRING")
    filled = listed.join(metrics, "model_key", "left").select(
        "order",
        "model_key",
        F.coalesce(F.nullif("short", F.lit("")), F.upper("model_key")).alias("label"),
        F.coalesce(F.nullif("color", F.lit("")), F.lit(fixed.DEFAULT_COLOR)).alias("color"),
        *[F.coalesce(m, F.lit(0.0)).alias(m) for m in fixed.CHARTS],
    )
    return filled.unpivot(
        ["order", "model_key", "label", "color"], fixed.CHARTS, "metric", "value"
    )


def pivot_versions(metrics: DataFrame, value: str = "f1") -> DataFrame:
    """One row per model family, its versions side by side."""
    wide = metrics.groupBy("family").pivot("version", ["V1", "V2"]).agg(F.first(value))
    return wide.withColumn("gain", round2(F.col("V2") - F.col("V1")))


def nest_confusion(metrics: DataFrame) -> DataFrame:
    """Move the counts into one ``cm`` struct, as the comparison document has them."""
    cm = F.struct(*[F.col(c).alias(c.upper()) for c in ("tn", "fp", "fn", "tp")])
    return metrics.withColumn("cm", cm).drop("tn", "fp", "fn", "tp")
