"""Replies as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings import fixed
from tidings.operators.scoring import RECORD


def prediction_reply(df: DataFrame) -> DataFrame:
    """One JSON object per scored message."""
    return df.withColumn("value", F.to_json(F.struct(*RECORD)))


def to_response(compared: DataFrame, text: str = "text") -> DataFrame:
    """``{text, results}`` per message; only the best entry carries ``is_best``."""

    def entry(r: Column) -> Column:
        best = F.when(r["is_best"], F.lit(True))
        return F.struct(*[r[f].alias(f) for f in RECORD], best.alias("is_best"))

    results = F.transform("results", entry).alias("results")
    body = F.to_json(F.struct(F.col(text).alias("text"), results))
    none = F.to_json(F.struct(F.lit(fixed.ERROR_NO_MODELS).alias("error")))
    return compared.withColumn("value", F.when(F.size("results") == 0, none).otherwise(body))


def error_reply(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.to_json(F.struct("error")))
