"""The newest verdicts, in batch and as a stream."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from tidings import fixed
from tidings.functions.text import clock, escape_html, preview
from tidings.sources.messages import path_exists, remove_path

# Executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

COLUMNS = ["id", "ts", "is_spam", "confidence", "model_name", "message"]


def history_entries(df: DataFrame) -> DataFrame:
    """Verdicts as history entries: the message is stored cut, without a mark."""
    return df.select(
        "id", "ts", "is_spam", "confidence", "model_name",
        preview(F.col("message"), fixed.PREVIEW_STORED, ellipsis=False).alias("message"),
    )


def history_top(df: DataFrame, n: int = fixed.HISTORY_SIZE, id_col: str = "id") -> DataFrame:
    """The newest n entries."""
    return df.orderBy(F.desc("ts"), F.desc(id_col)).limit(n)


def render_history(df: DataFrame) -> DataFrame:
    """Entries as listed: verdict, escaped preview, model and clock time."""
    return df.withColumns(
        {
            "verdict": F.when(F.col("is_spam"), F.lit("SPAM")).otherwise(F.lit("HAM")),
            "shown": escape_html(preview(F.col("message"), fixed.PREVIEW_HISTORY)),
            "time": clock(F.col("ts")),
        }
    )


def update_history(
    batch: DataFrame, batch_id: int, path: str, n: int = fixed.HISTORY_SIZE
) -> None:
    """Merge a batch into the stored history.

    Every batch reads the state its predecessor left and writes its own, so
    replaying one changes nothing.  The last two states are kept.
    """
    spark, entries = batch.sparkSession, history_entries(batch)
    if batch_id > 0:
        before = f"{path}/batch_id={batch_id - 1}"
        if not path_exists(spark, before):
            raise FileNotFoundError(f"{before}: the state before this batch is gone")
        entries = entries.unionByName(spark.read.parquet(before))
    history_top(entries, n).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    if batch_id > 1:
        remove_path(spark, f"{path}/batch_id={batch_id - 2}")


def read_history(spark: SparkSession, path: str, n: int = fixed.HISTORY_SIZE) -> DataFrame:
    """The stored history: the state of the last batch alone."""
    states = spark.read.parquet(path)
    last = states.agg(F.max("batch_id")).first()[0]
    return history_top(states.where(F.col("batch_id") == last).drop("batch_id"), n)


def history_stream(verdicts: DataFrame, path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    return (
        verdicts.writeStream.foreachBatch(lambda df, i: update_history(df, i, path))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


# ------------------------------------------------------------------- keyed state
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def newest(rows: pd.DataFrame, n: int, by: list[str], id_col: str = "id") -> pd.DataFrame:
    """The newest n entries of each group, an entry given twice once."""
    rows = rows.drop_duplicates([*by, id_col], keep="last").sort_values(["ts", id_col], ascending=False)
    return rows.groupby(by, sort=False, dropna=False).head(n) if by else rows.head(n)


def cut_newest(df: DataFrame, n: int = fixed.HISTORY_SIZE, by: list[str] | None = None, id_col: str = "id") -> DataFrame:
    """At most the newest n entries of each group from each batch of rows in a task, also of a stream.

    No other can be among the newest n of all, so what is costly needs to be worked out for these only.
    """

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield newest(part, n, by or [], id_col)

    return df.mapInPandas(cut, df.schema)


class NewestEntries(StatefulProcessor):
    """Keeps the newest n entries of a key, and gives them out whenever the key has rows."""

    def __init__(self, n: int, schema: StructType) -> None:
        self.n, self.schema = n, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.top = handle.getListState("top", self.schema)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        names = self.schema.names
        parts = [pd.DataFrame([tuple(x) for x in self.top.get()], columns=names), *(r[names] for r in rows)]
        top = newest(pd.concat([p for p in parts if len(p)], ignore_index=True), self.n, [])
        self.top.put([tuple(x) for x in top.astype(object).itertuples(index=False, name=None)])
        yield top.assign(key=key[0])[["key", *names]]

    def close(self) -> None:
        pass


def history_state_stream(
    verdicts: DataFrame, path: str, checkpoint: str, key: str | None = None, n: int = fixed.HISTORY_SIZE, **trigger: object
) -> StreamingQuery:
    """The newest entries of every value of ``key`` (of all rows without one), as keyed state.

    Each task first cuts its rows to the newest n of a key, so a key with most of the
    rows sends few.  State holds n entries a key, and an entry that comes again
    changes nothing.  A batch writes the states it changed below its own number, so
    a batch that runs again replaces its own output; after a restart the stream goes on from
    its checkpoint.  State lives in RocksDB.
    """
    spark = verdicts.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = history_entries(verdicts).withColumn("key", F.col(key).cast("string") if key else F.lit("all"))
    rows = rows.select("key", *COLUMNS)

    entry = StructType([rows.schema[c] for c in COLUMNS])
    states = (
        cut_newest(rows, n, ["key"])
        .groupBy("key")
        .transformWithStateInPandas(NewestEntries(n, entry), rows.schema, "Update", "None")
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        states.writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_state_history(spark: SparkSession, path: str) -> DataFrame:
    """The last written state of every key: ``key`` and the entries."""
    states = spark.read.parquet(path)
    last = F.max("batch_id").over(Window.partitionBy("key"))
    return states.withColumn("_last", last).where("batch_id = _last").select("key", *COLUMNS)
