"""Fitted models: feature stages and learner in one artifact."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from tidings.sources.messages import path_exists


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_models(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, PipelineModel]:
    """Models whose artifact exists; the others are left out."""
    return {
        key: PipelineModel.load(path) for key, path in paths.items() if path_exists(spark, path)
    }


def available(spark: SparkSession, models: Mapping[str, PipelineModel]) -> DataFrame:
    return spark.createDataFrame([(k,) for k in models], "model_key STRING")
