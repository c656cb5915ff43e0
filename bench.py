"""Headline timings on one machine; prints one JSON line.

Each query writes its whole result to a sink that discards it.  Every family is warmed
by one run that does not count.  Relational queries give the median of three runs;
those that fit models run once.  ``BENCH_FULL=1`` adds those that take minutes.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tidings.functions import text  # noqa: E402
from tidings.operators import classifiers  # noqa: E402
from tidings.plans.queries import QUERIES, _train  # noqa: E402
from tidings.session import build_session  # noqa: E402
from tidings.sources import derived  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

RELATIONAL = [
    "clean_v1", "clean_v1_documents", "pre_v2", "pre_v2_pages", "pre_v2_documents",
    "html_unescape", "indicator_chips", "highlight", "split_assign", "split_exact_documents",
    "class_weights", "vocab_documents", "vocab_tfidf_v2", "vocab_tokenizer", "tfidf_weights",
    "seq_v1", "seq_v2", "predict_batch", "request_validate", "compare_rules", "compare_best",
    "eval_metrics", "leaderboard", "history_top20", "stream_history", "pool_positions_max", "attention_pool",
    "vocab_phrases", "transition_counts", "shuffle_position", "split_complete", "gbt_histogram",
]
PIPELINES = [
    "predict_lr", "predict_rf", "predict_ngram", "predict_seq", "predict_embed", "predict_gbt", "stream_score",
    "stream_history_state",
]
# minutes each, with full boosting rounds
LONG = ["predict_gbt_v2", "gbt_round_curve", "compare_all", "eval_models", "eval_v1_v2", "eval_documents"]
WARM_UP = ["pre_v2", "vocab_tfidf_v2", "eval_metrics", "stream_history"]


def sink(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def fits(spark, results: dict[str, float]) -> None:
    """Fitting of each learner on shared features, as separate steps."""
    train = _train(spark, SF_DIR)
    frame = train
    start = time.perf_counter()
    for stage in classifiers.tfidf_stages(1):
        model = stage.fit(frame) if hasattr(stage, "fit") else stage
        frame = model.transform(frame)
    frame = frame.select("msg_id", "label", "tfidf_v1").persist()
    frame.count()
    results["fit_tfidf_and_transform"] = round(time.perf_counter() - start, 3)
    for name, pipeline in {
        "fit_lr": classifiers.lr_pipeline(),
        "fit_rf": classifiers.rf_pipeline(),
        "fit_gbt_20_rounds": classifiers.gbt_pipeline(20),
    }.items():
        learner = pipeline.getStages()[-1]
        results[name] = timed(lambda f=learner, r=frame: f.fit(r))
    frame.unpersist()
    results["fit_embed"] = timed(
        lambda: classifiers.fit_models(train, {"transformer": classifiers.embed_pipeline()})
    )


def main() -> None:
    spark = build_session(
        "tidings-bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    sink(derived.table(spark, SF_DIR, "conversations").select(text.strip(F.col("text"))))
    results: dict[str, float] = {}

    def once(name: str) -> float:
        return timed(lambda: sink(QUERIES[name](spark, SF_DIR)))

    for name in WARM_UP:
        once(name)
    for name in RELATIONAL:
        results[name] = statistics.median(once(name) for _ in range(3))
    once("predict_lr")
    for name in PIPELINES + (LONG if os.environ.get("BENCH_FULL") else []):
        results[name] = once(name)
        print(name, results[name], file=sys.stderr, flush=True)
    fits(spark, results)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(results.values()), 3),
                "unit": "sec",
                "queries": results,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
                "cpus": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
