"""Sharding by extendible hashing: only oversized buckets split on another bit.

A row's hash bits are 60 bits of its id's MD5, then 60 bits of the MD5 of its place
in the table; the latter only matter where equal ids alone exceed the limit.  A
shard is a prefix of these bits: the shortest whose rows fit the limit.  A prefix
with one row is not split further, so a row above the limit is a shard of its own.

Defined results: null ids hash as the empty text, null texts have no bytes; an empty
table gives an empty result; repeated rows are told apart by their places.

Sizes come from one combining aggregate over prefixes of a depth that the total
suggests; only cells that are still too large are counted again, deeper.  No row is
collected or sorted, and a hot id is one row a task in the counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.llm.common import documents, stored, text_or_empty

LIMIT = 1 << 20  # bytes of text in a shard
BITS = 120
STEP = 6
SHARD = "tidings_shard"  # the partition column of written shards


def _bits(value: Column) -> Column:
    """60 hash bits as text of zeros and ones."""
    digits = F.substring(F.md5(F.coalesce(value.cast("string"), F.lit(""))), 1, 15)
    return F.lpad(F.conv(digits, 16, 2), 60, "0")


def directory(rows: DataFrame, limit: int, low: int, depth: int) -> DataFrame:
    """``cell, shard, shard_bytes, shard_rows`` for the cells (prefixes of ``depth`` bits) of ``rows``.

    The last three are null for a cell that must be counted deeper.
    """
    cells = rows.groupBy(F.substring("bits", 1, depth).alias("cell")).agg(
        F.sum("n_bytes").alias("b"), F.count("*").alias("n")
    )
    each = cells.withColumn("d", F.explode(F.sequence(F.lit(low), F.lit(depth)))).withColumn(
        "prefix", F.expr("substring(cell, 1, d)")
    )
    sizes = each.groupBy("d", "prefix").agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
    fits = sizes.where((F.col("b") <= limit) | (F.col("n") == 1) | (F.col("d") == BITS))
    leaf = each.select("cell", "d", "prefix").join(fits, ["d", "prefix"], "left")
    first = F.min(F.when(F.col("b").isNotNull(), F.struct("d", "prefix", "b", "n")))
    return (
        leaf.groupBy("cell")
        .agg(first.alias("leaf"))
        .select(
            "cell",
            F.col("leaf.prefix").alias("shard"),
            F.col("leaf.b").alias("shard_bytes"),
            F.col("leaf.n").alias("shard_rows"),
        )
    )


def shards(
    docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", place_col: str | None = None
) -> DataFrame:
    """``id, n_bytes, shard, depth, shard_bytes, shard_rows`` for every row.

    With ``place_col``, a column that numbers the rows, its value comes as ``place`` too.
    """
    at = F.col(place_col) if place_col else F.monotonically_increasing_id()
    place = ["place"] if place_col else []
    rows = docs.select(
        F.col(id_col).alias("id"),
        *[at.alias(x) for x in place],
        F.octet_length(text_or_empty(text_col)).cast("long").alias("n_bytes"),
        F.concat(_bits(F.col(id_col)), _bits(at)).alias("bits"),
    )
    rows = stored(rows, "shard-rows")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    low, depth = 0, min(60, max(0, math.ceil(math.log2(max(1, total / limit)))) + 4)
    placed: DataFrame | None = None
    while True:
        rows = rows.withColumn("cell", F.substring("bits", 1, depth))
        found = stored(directory(rows, limit, low, depth), "directory")
        fit = found.where("shard IS NOT NULL")
        part = rows.join(fit, "cell").select(
            "id", *place, "n_bytes", "shard", F.length("shard").alias("depth"), "shard_bytes", "shard_rows"
        )
        placed = part if placed is None else placed.union(part)
        over = found.where("shard IS NULL").select("cell")
        if over.isEmpty():
            return placed
        rows = rows.join(over, "cell", "left_semi").drop("cell")
        low, depth = depth + 1, min(BITS, depth + STEP)


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write whole rows below ``path/tidings_shard=<bits>``, each once, whatever its id.

    Rows are numbered once and stored, then joined with their shards by that number.
    """
    place = "_tidings_place"
    rows = stored(docs.withColumn(place, F.monotonically_increasing_id()), "placed")
    assigned = shards(rows, limit, id_col, text_col, place).select(
        F.col("place").alias(place), F.col("shard").alias(SHARD)
    )
    rows.join(assigned, place).drop(place).repartition(SHARD).write.partitionBy(SHARD).parquet(path)


def op9_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


OP9_SQL = f"""
WITH t AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
             bin(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)) AS b FROM documents),
r AS (SELECT doc_id, n_bytes, right(repeat('0', 60) || b, 60) AS bits FROM t),
d AS (SELECT unnest(range(0, 25)) AS depth),
s AS (SELECT depth, substr(bits, 1, depth) AS shard, sum(n_bytes) AS shard_bytes, count(*) AS shard_rows
      FROM r, d GROUP BY ALL HAVING sum(n_bytes) <= {LIMIT} OR count(*) = 1),
f AS (SELECT r.doc_id, min(s.depth) AS depth FROM r, s WHERE substr(r.bits, 1, s.depth) = s.shard GROUP BY r.doc_id)
SELECT r.doc_id, r.n_bytes, s.shard, CAST(s.depth AS INTEGER) AS depth,
       CAST(s.shard_bytes AS BIGINT) AS shard_bytes, s.shard_rows
FROM r JOIN f USING (doc_id) JOIN s ON s.depth = f.depth AND s.shard = substr(r.bits, 1, f.depth)
"""
