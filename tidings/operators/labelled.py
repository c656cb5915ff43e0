"""Labelled tables: missing rows, class counts, class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidings import fixed
from tidings.functions.scores import round_even


def is_missing(text: Column) -> Column:
    return text.isNull() | text.isin(fixed.NA_WORDS)


def drop_missing(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Keep rows whose label is known and whose text survives a CSV round trip."""
    return df.where(~is_missing(F.col(text)) & F.col(label).isNotNull())


def class_distribution(df: DataFrame, by: str | None = None, label: str = "label") -> DataFrame:
    """Rows, spam, ham and their shares in percent, overall or per group."""
    spam = F.count_if(F.col(label) == 1)
    counted = df.groupBy(*([by] if by else [])).agg(
        F.count("*").alias("total"), spam.alias("spam"), (F.count("*") - spam).alias("ham")
    )

    def share(n: str) -> Column:
        return round_even(F.try_divide(F.col(n), F.col("total")) * 100, 1)

    return counted.withColumns({"spam_pct": share("spam"), "ham_pct": share("ham")})


def split_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Per class: rows, the weight of positives against negatives, balanced weight.

    One aggregate over the data; the window sees one row per class.
    """
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(
        F.count("*").alias("n")
    )
    classes = Window.partitionBy()

    def rows(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n"))).over(classes)

    c = F.col("label")
    return counts.select(
        "label",
        "n",
        F.when(c == 1, F.try_divide(rows(c == 0), rows(c == 1)))
        .otherwise(F.lit(1.0))
        .alias("scale_pos"),
        (rows(c.isNotNull()) / (F.count("*").over(classes) * F.col("n"))).alias("balanced"),
    )


def with_weights(
    df: DataFrame, kind: str, label: str = "label", weight: str = "w"
) -> DataFrame:
    """Attach a class weight column; kind is ``scale_pos`` or ``balanced``.

    There are as many weights as classes, so they become one expression.
    """
    by_class = {r["label"]: r[kind] for r in class_weights(df, label).collect()}
    value = F.lit(1.0)
    if None in by_class.values():
        raise ValueError(f"{kind} weights need rows of both classes")
    for cls, w in by_class.items():
        value = F.when(F.col(label) == cls, F.lit(float(w))).otherwise(value)
    return df.withColumn(weight, value)

