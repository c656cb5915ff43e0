"""Vectors of a message's words: positions, masked pooling, attention.

A vector table ``id, vector`` is joined to the word ids of messages; Spark chooses how,
by its size.  Padding (id 0) and ids without a vector take no part.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def token_vectors(df: DataFrame, vectors: DataFrame, ids: str = "ids", id_col: str = "msg_id") -> DataFrame:
    """``id_col, pos, vector``: one row a word, in a message without words one with nulls."""
    placed = F.transform(ids, lambda x, i: F.struct(i.alias("pos"), x.cast("long").alias("id")))
    words = df.select(id_col, F.inline_outer(F.filter(placed, lambda t: t["id"] != 0)))
    return words.join(vectors.select(F.col("id").cast("long").alias("id"), "vector"), "id", "left").select(
        id_col, "pos", "vector"
    )


def pool_positions(tokens: DataFrame, dim: int, how: str = "max", id_col: str = "msg_id") -> DataFrame:
    """``id_col, n, vector``: largest (``max``) or average (``mean``) value of each dimension.

    Every dimension is an aggregate that combines on the map side.  A message
    without vectors gets zeros.
    """
    combine = {"max": F.max, "mean": F.avg}[how]
    values = [F.coalesce(combine(F.get("vector", F.lit(d))), F.lit(0.0)) for d in range(dim)]
    return tokens.groupBy(id_col).agg(F.count("vector").alias("n"), F.array(*values).alias("vector"))


def position_code(pos: Column, d: Column, dim: int) -> Column:
    """Value of dimension ``d`` at a position: sines and cosines of falling frequency."""
    even = d - d % 2
    angle = pos / F.pow(F.lit(10_000.0), even / dim)
    return F.when(d % 2 == 0, F.sin(angle)).otherwise(F.cos(angle))


def with_positions(tokens: DataFrame, dim: int) -> DataFrame:
    """Vectors plus the codes of their positions."""
    coded = F.transform("vector", lambda v, d: v + position_code(F.col("pos"), d, dim))
    return tokens.withColumn("vector", coded)


def attend(tokens: DataFrame, query: Sequence[float], id_col: str = "msg_id") -> DataFrame:
    """``id_col, n, vector``: vectors averaged by the softmax of their scaled product with ``query``.

    A message's words meet once, for the largest score, which keeps the powers in
    range; padded sequences bound their number.  The averages are aggregates over the
    same dealing.  A message without vectors gets zeros.
    """
    dim = len(query)
    parts = [F.get("vector", F.lit(d)) for d in range(dim)]
    score = reduce(add, [x * float(q) for x, q in zip(parts, query)]) / F.sqrt(F.lit(float(dim)))
    rows = tokens.withColumn("_score", score)
    rows = rows.withColumn("_power", F.exp(F.col("_score") - F.max("_score").over(Window.partitionBy(id_col))))
    share = F.sum("_power")
    values = [F.coalesce(F.sum(F.col("_power") * x) / share, F.lit(0.0)) for x in parts]
    return rows.groupBy(id_col).agg(F.count("vector").alias("n"), F.array(*values).alias("vector"))
