"""Metric documents: one JSON object that maps a key to a record.

An updated document is one file in its folder.  The next one is written whole below
another name before it replaces that file, in one rename, so a reader sees the
old document or the new one, also when a write fails half-way.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidings import schemas
from tidings.operators.evaluation import nest_confusion, upsert_metrics
from tidings.sources.messages import listed, path_exists, remove_path


def read_metrics(
    spark: SparkSession,
    path: str,
    default: DataFrame | None = None,
    schema: str = schemas.METRICS,
) -> DataFrame:
    """model_key, the record's fields and ``order``, the place in the document."""
    if not path_exists(spark, path):
        if default is None:
            raise FileNotFoundError(f"{path} not found")
        return default
    document = spark.read.text(current_version(spark, path), wholetext=True)
    entries = F.from_json("value", f"map<string,struct<{_fields(schema)}>>")
    return (
        document.select(F.posexplode(entries).alias("pos", "model_key", "m"))
        .select("model_key", "m.*", (F.col("pos") + 1).alias("order"))
    )


def _fields(ddl: str) -> str:
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in StructType.fromDDL(ddl))


def _names(ddl: str) -> list[str]:
    return [f.name for f in StructType.fromDDL(ddl)]


def write_metrics(df: DataFrame, path: str, schema: str = schemas.METRICS) -> None:
    """One document, keys in ``order`` where there is one.

    The document has one entry per model, so a single row holds it.
    """
    names = _names(schema)
    order = F.col("order") if "order" in df.columns else F.lit(0)
    listed = F.array_sort(
        F.collect_list(F.struct(order.alias("order"), "model_key", F.struct(*names).alias("m")))
    )
    entries = F.map_from_entries(
        F.transform(listed, lambda e: F.struct(e["model_key"], e["m"]))
    )
    df.agg(F.to_json(entries).alias("value")).write.mode("overwrite").text(path)


DOCUMENT = "part-00000"
POINTER = "current"  # names the current version in documents of an older form


def current_version(spark: SparkSession, path: str) -> str:
    """Where the document at ``path`` lies: in one file, in the version its pointer names, or as it was written."""
    if path_exists(spark, f"{path}/{DOCUMENT}"):
        return f"{path}/{DOCUMENT}"
    if not path_exists(spark, f"{path}/{POINTER}"):
        return path
    name = spark.read.text(f"{path}/{POINTER}").first()[0]
    return f"{path}/{name}"


def swap(spark: SparkSession, path: str, name: str) -> None:
    """Let the document written to the folder ``name`` be the one at ``path``, in one rename."""
    jvm = spark.sparkContext._jvm
    fs_path = jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    (part,) = listed(spark, f"{path}/{name}", "part-")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs_path(path).getFileSystem(conf).getUri(), conf)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs_path(f"{path}/{name}/{part}"), fs_path(f"{path}/{DOCUMENT}"), options)


def update_metrics(spark: SparkSession, new: DataFrame, path: str) -> DataFrame:
    """Replace evaluated models in a stored document and keep the others.

    What an older form of the document has left is removed once the new one is in place.
    """
    columns = ["model_key", *_names(schemas.METRICS)]
    fresh = new.select(*columns)
    if path_exists(spark, path):
        fresh = upsert_metrics(read_metrics(spark, path).select(*columns), fresh)
    name = f"_staged-{uuid.uuid4().hex}"
    try:
        write_metrics(fresh, f"{path}/{name}")
        swap(spark, path, name)
    finally:
        if path_exists(spark, f"{path}/{name}"):
            remove_path(spark, f"{path}/{name}")
    for start in (POINTER, "version-", "part-"):
        for old in listed(spark, path, start):
            if old != DOCUMENT:
                remove_path(spark, f"{path}/{old}")
    return read_metrics(spark, path).select(*columns)


def write_comparison(df: DataFrame, path: str) -> None:
    """Version comparison with nested counts; replaced as a whole."""
    nested = nest_confusion(df) if "tn" in df.columns else df
    write_metrics(nested, path, schemas.COMPARISON)
