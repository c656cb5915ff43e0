"""Labels, decisions and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidings import fixed


def encode_label(label: Column) -> Column:
    """ham to 0, spam to 1, anything else to null."""
    code = F.lit(None).cast("int")
    for name, value in fixed.LABELS.items():
        code = F.when(label == name, F.lit(value)).otherwise(code)
    return code


def decode_label(prediction: Column) -> Column:
    return F.when(prediction == 1, F.lit("spam")).otherwise(F.lit("ham"))


def round_even(value: Column, digits: int) -> Column:
    """Round to some decimals, ties of the scaled value to even."""
    scale = 10**digits
    return F.rint(value * scale) / scale


def round2(value: Column) -> Column:
    return round_even(value, 2)


def decide(spam_probability: Column, threshold: float = fixed.THRESHOLD) -> Column:
    """Verdict of a score: strictly above the threshold is spam.

    The confidence is that of the class chosen, in percent.
    """
    is_spam = spam_probability > threshold
    sure = F.when(is_spam, spam_probability).otherwise(1 - spam_probability)
    return F.struct(
        is_spam.cast("int").alias("prediction"),
        decode_label(is_spam.cast("int")).alias("label"),
        round2(sure * 100).alias("confidence"),
    )
