"""Scoring of messages as they arrive."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidings.operators.scoring import parse_requests, predict_requests, validate_requests


def score_stream(
    requests: DataFrame,
    models: Mapping[str, PipelineModel],
    ok_path: str,
    reject_path: str,
    checkpoint: str,
    body: str = "value",
    keep: tuple[str, ...] = ("msg_id",),
    **trigger: object,
) -> StreamingQuery:
    """JSON requests to scored messages and, apart, rejects with a reason.

    Both sinks are written per batch under the batch id, so a batch that is
    replayed after a failure replaces its own output.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        checked = validate_requests(parse_requests(batch, body), list(models)).persist()
        try:
            accepted = checked.where("status = 200")
            predict_requests(accepted, models, keep).write.mode("overwrite").parquet(
                f"{ok_path}/batch_id={batch_id}"
            )
            checked.where("status <> 200").select(*keep, "status", "error").write.mode(
                "overwrite"
            ).parquet(f"{reject_path}/batch_id={batch_id}")
        finally:
            checked.unpersist()

    return (
        requests.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
