"""Rule scorers: deterministic stand-ins for fitted models.

They give the relational operators behind a model (decisions, confusion counts,
rankings) scores that any SQL engine can reproduce from the message text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings import fixed
from tidings.functions.explain import indicator_count
from tidings.operators.scoring import record

# points per matched indicator, base points; the LSTM is deliberately absent
RULES = {"lr": (15, 10), "rf": (15, 20), "xgb": (20, 5), "cnn": (10, 30), "transformer": (15, 20)}
VERSIONED_RULES = {"xgb_v1": (15, 5), "xgb_v2": (20, 5), "tf_v1": (15, 10), "tf_v2": (25, 0)}


def rule_results(
    messages: DataFrame, rules: dict[str, tuple[int, int]] = RULES, keep: tuple[str, ...] = ()
) -> DataFrame:
    """msg_id, truth and one array with a reply per rule, in rule order."""
    counted = messages.select(
        "msg_id", *keep, F.col("label").alias("truth"), indicator_count(F.col("text")).alias("hits")
    )
    listed = sorted(
        rules, key=lambda k: fixed.COMPARE_ORDER.index(k) if k in fixed.COMPARE_ORDER else 0
    )
    replies = [
        record(key, F.least(F.lit(100), F.col("hits") * rules[key][0] + rules[key][1]) / 100)
        for key in listed
    ]
    return counted.select("msg_id", *keep, "truth", F.array(*replies).alias("results"))


def rule_predictions(
    messages: DataFrame, rules: dict[str, tuple[int, int]] = RULES, keep: tuple[str, ...] = ()
) -> DataFrame:
    """The same in long form; the array is unpacked inside each row."""
    # The outer form: the array is never empty, and no emptiness test that would
    # score every message a second time is pushed down to the scan.
    results = rule_results(messages, rules, keep)
    return results.select("msg_id", *keep, "truth", F.inline_outer("results"))
