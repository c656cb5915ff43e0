"""Reading and writing message tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidings import schemas
from tidings.operators.labelled import drop_missing


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hadoop_path)


def remove_path(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(hadoop_path, True)


def listed(spark: SparkSession, path: str, start: str) -> list[str]:
    """Names in a folder that begin so."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(hadoop_path)]
    return sorted(n for n in names if n.startswith(start))


def read_messages(
    spark: SparkSession, path: str, sep: str = "\t", multiline: bool = False
) -> DataFrame:
    """Header-less ``label, text`` files: msg_id, label, text.

    Ids depend on content alone, so files may be added, split or renamed.  Quoted
    fields that span lines need ``multiline``, which makes a file one task.
    """
    raw = (
        spark.read.schema(schemas.RAW_MESSAGES)
        .options(sep=sep, quote='"', escape='"', multiLine=multiline)
        .csv(path)
    )
    return with_content_ids(raw)


def with_content_ids(df: DataFrame) -> DataFrame:
    """``label, text`` rows with ``msg_id``: 60 bits of a hash of both and an ordinal.

    The ordinal counts equal rows from 0 (null equals empty).  It is the row's place
    among its equals in its own input partition plus their number in earlier ones, so
    a text that makes up most rows is numbered by as many tasks as it is read by.
    Two of n rows share an id with a chance of about n * n / 2 ** 61.
    """
    content = F.concat(F.coalesce("label", F.lit("")), F.lit("\t"), F.coalesce("text", F.lit("")))
    rows = df.select("label", "text", F.md5(content).alias("_key"), F.spark_partition_id().alias("_part"))
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_part", "_key").agg(F.count("*").alias("n"))
    sizes = sizes.select("_part", "_key", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("_part", "_key").orderBy("_part")) - 1
    placed = rows.withColumn("own", own).join(sizes, ["_part", "_key"])
    ordinal = (F.col("own") + F.col("before")).cast("string")
    digest = F.md5(F.concat("_key", F.lit(":"), ordinal))
    return placed.select(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("msg_id"), "label", "text")


def read_split(
    spark: SparkSession, path: str, split: str | None = None, fmt: str = "parquet"
) -> DataFrame:
    """A written split table without missing rows; the split filter prunes folders."""
    reader = spark.read.schema(f"{schemas.SPLIT}, split STRING")
    if fmt == "csv":
        reader = reader.options(header=True, quote='"', escape='"', multiLine=True)
    df = reader.format(fmt).load(path)
    if split:
        df = df.where(F.col("split") == split)
    return drop_missing(df)


def write_splits(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder per split, replaced as a whole."""
    writer = df.select("msg_id", "text", "label", "split").write.mode("overwrite")
    if fmt == "csv":
        writer = writer.options(header=True, quote='"', escape='"', quoteAll=True)
    writer.partitionBy("split").format(fmt).save(path)


def read_first_existing(
    spark: SparkSession, candidates: Sequence[tuple[str, Mapping[str, str]]]
) -> DataFrame:
    """The first path that exists, its columns renamed; an error when none does.

    Raw text comes first, cleaned text is the fallback.
    """
    for path, renames in candidates:
        if path_exists(spark, path):
            df = spark.read.options(header=True, quote='"', escape='"', multiLine=True).csv(path)
            df = df.withColumnsRenamed(dict(renames))
            return drop_missing(df.withColumn("label", F.col("label").try_cast("int")))
    raise FileNotFoundError(f"none of {[p for p, _ in candidates]} exists")
