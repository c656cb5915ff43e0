"""Declared schemas and the small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidings import fixed

RAW_MESSAGES = "label STRING, text STRING"
SPLIT = "msg_id BIGINT, text STRING, label INT"
REQUEST = "text STRING, model STRING"
PREDICTION = (
    "model_key STRING, model_name STRING, model_type STRING, member INT, "
    "prediction INT, label STRING, confidence DOUBLE"
)
METRICS = (
    "name STRING, short STRING, type STRING, member INT, accuracy DOUBLE, "
    "precision DOUBLE, recall DOUBLE, f1 DOUBLE, color STRING"
)
COMPARISON = (
    "name STRING, family STRING, version STRING, type STRING, accuracy DOUBLE, "
    "precision DOUBLE, recall DOUBLE, f1 DOUBLE, "
    "cm STRUCT<TN: BIGINT, FP: BIGINT, FN: BIGINT, TP: BIGINT>"
)


def registry(spark: SparkSession) -> DataFrame:
    """One row per known model, with its place in the compare order."""
    rows = [
        (*entry, fixed.COMPARE_ORDER.index(entry[0]) + 1, registered)
        for registered, entry in enumerate(fixed.REGISTRY, start=1)
    ]
    return spark.createDataFrame(
        rows,
        "model_key STRING, model_name STRING, type STRING, member INT, short STRING, "
        "color STRING, status_name STRING, `order` INT, registered INT",
    )


def versioned_registry(spark: SparkSession) -> DataFrame:
    """Models of the version comparison, in listing order."""
    rows = [(*entry, i) for i, entry in enumerate(fixed.VERSIONED_MODELS, start=1)]
    return spark.createDataFrame(
        rows,
        "model_key STRING, name STRING, family STRING, version STRING, type STRING, `order` INT",
    )
