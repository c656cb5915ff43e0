"""Deterministic train, validation and test splits as a function of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidings import fixed


def _digest(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def _hex_number(digest: Column, start: int, length: int) -> Column:
    return F.conv(F.substring(digest, start, length), 16, 10).cast("long")


def assign_split(
    df: DataFrame,
    id_col: str = "msg_id",
    seed: int = fixed.SPLIT_SEED,
    test: float = 0.15,
    val: float = 0.15,
) -> DataFrame:
    """Hash split: a projection, the same for every column set of a message."""
    bucket = _hex_number(_digest(id_col, seed), 1, 8) % 1000
    cut_test, cut_val = round(test * 1000), round((test + val) * 1000)
    return df.withColumn(
        "split",
        F.when(bucket < cut_test, F.lit("test"))
        .when(bucket < cut_val, F.lit("val"))
        .otherwise(F.lit("train")),
    )


def _narrow(counted: DataFrame, bucket: str, group: list[str]) -> DataFrame:
    """The bucket that holds the wanted rank, and the rank inside it.

    Windows here run over histogram rows, at most 65,536 per wanted rank.
    """
    running = F.sum("n").over(
        Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        counted.withColumn("upto", running)
        .where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
        .select(*group, bucket, (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"))
    )


def assign_split_exact(
    df: DataFrame,
    id_col: str = "msg_id",
    seed: int = fixed.SPLIT_SEED,
    test: float = fixed.TEST_FRACTION,
    val: float = fixed.VALIDATION_FRACTION_OF_REST,
) -> DataFrame:
    """Seeded shuffle and cut with exact sizes; ids must be unique.

    ``ceil(test n)`` rows go to test and ``ceil(val (n - test))`` to validation.
    No global sort: two histograms of the hash, 16 bits each, find the bucket
    each cut falls into, and only the ids of that bucket are ranked, already
    counted.
    """
    digest = _digest(id_col, seed)
    keys = df.select(
        F.col(id_col).alias("id"),
        digest.alias("digest"),
        _hex_number(digest, 1, 4).alias("b1"),
        _hex_number(digest, 5, 4).alias("b2"),
    )
    first = keys.groupBy("b1").agg(F.count("*").alias("n"))
    # Over at most 65,536 histogram rows.
    total = F.sum("n").over(Window.partitionBy())
    n_test = F.ceil(F.col("total") * F.lit(test))
    n_val = F.ceil((F.col("total") - n_test) * F.lit(val))
    wanted = F.array(
        F.struct(F.lit("test").alias("cut"), n_test.alias("rank")),
        F.struct(F.lit("val").alias("cut"), (n_test + n_val).alias("rank")),
    )
    targets = first.withColumn("total", total).select("b1", "n", F.inline(wanted))
    cut1 = _narrow(targets, "b1", ["cut"])
    second = (
        keys.join(F.broadcast(cut1), "b1")
        .groupBy("cut", "b1", "rank", "b2")
        .agg(F.count("*").alias("n"))
    )
    cut2 = _narrow(second, "b2", ["cut", "b1"])
    third = (
        keys.join(F.broadcast(cut2), ["b1", "b2"])
        .groupBy("cut", "rank", F.struct("digest", "id").alias("key"))
        .agg(F.count("*").alias("n"))
    )
    last = _narrow(third, "key", ["cut"])
    of_cut = lambda cut: F.max(F.when(F.col("cut") == cut, F.col("key"))).alias(cut)
    cuts = last.agg(of_cut("test"), of_cut("val")).select(F.struct("test", "val")).scalar()
    key = F.struct(digest.alias("digest"), F.col(id_col).alias("id"))
    return df.withColumn(
        "split",
        F.when(key <= cuts["test"], F.lit("test"))
        .when(key <= cuts["val"], F.lit("val"))
        .otherwise(F.lit("train")),
    )


def shuffle_positions(df: DataFrame, path: str, id_col: str = "msg_id", seed: int = fixed.SPLIT_SEED) -> DataFrame:
    """``df`` with ``position``, each row's place (from 0) in a seeded shuffle; ids must be unique.

    Rows are dealt to ranges of their digest and sorted there, no range in more
    than one task's reach; a row's position is its place in its range after the
    sizes of the ranges before.  The sorted ranges are written to ``path``, so that
    counting and numbering see the same ones.
    """
    digest = _digest(id_col, seed)
    place = F.monotonically_increasing_id()
    dealt = df.withColumn("_digest", digest).repartitionByRange("_digest", id_col).sortWithinPartitions("_digest", id_col)
    dealt.withColumns({"_range": F.shiftright(place, 33), "_row": place.bitwiseAND(F.lit((1 << 33) - 1))}).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    # over one row a range
    before = F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")
    starts = sizes.select("_range", before.alias("_start"))
    placed = rows.join(starts, "_range").withColumn("position", F.col("_start") + F.col("_row"))
    return placed.select(*df.columns, "position")


def multiset_digest(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """``n, total, mix`` of the rows, in any order: their number, and the sum and xor of their hashes.

    Two tables hold the same rows, repeats included, if these agree, up to a
    chance of about one in 2^60.
    """
    fields = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    digest = F.md5(F.concat_ws("\x1f", *fields))
    h = _hex_number(digest, 1, 15)
    return df.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("total"), F.bit_xor(h).alias("mix")
    )


def complete(parts: DataFrame, source: DataFrame, columns: list[str], part: str = "split") -> DataFrame:
    """``part, n, total, mix, complete``: a digest of every part and of the source (``all``).

    ``complete`` says that the parts together hold the rows of the source, each
    once.  Each table is read once; nothing is compared row by row.
    """
    each = multiset_digest(parts, columns, [part]).withColumnRenamed(part, "part")
    whole = multiset_digest(source, columns).select(F.lit("all").alias("part"), "n", "total", "mix")
    # a few rows from here on
    sums = each.agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.bit_xor("mix").alias("mix"))
    same = sums.select(F.struct("n", F.col("total").cast("decimal(38,0)"), "mix")).scalar() == whole.select(
        F.struct("n", "total", "mix")
    ).scalar()
    return each.union(whole).withColumn("complete", same)
