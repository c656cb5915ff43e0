"""Session settings the library relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "tidings", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC clocks.

    Shuffle parallelism is left to AQE: many small initial partitions are
    coalesced to the advisory size at run time, so the same setting serves a
    laptop and a large cluster.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    It is the one the cluster names in ``spark.checkpoint.dir``.  Only a local
    master may fall back to a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = os.path.join(tempfile.gettempdir(), f"tidings-{spark.sparkContext.applicationId}")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def enable_checkpoints(spark: SparkSession) -> None:
    """Let iterative learners cut their lineage in the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark) + "/lineage")
