"""Scoring with one or all models, requests, best model per message."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassificationModel
from pyspark.ml.feature import Word2VecModel
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, FloatType

from tidings import fixed
from tidings.functions.scores import decide
from tidings.functions.text import model_key, strip, utf16_length

RECORD = [
    "model_key", "model_name", "model_type", "member", "prediction", "label", "confidence",
]
_KNOWN = {key: (name, kind.upper(), member) for key, name, kind, member, *_ in fixed.REGISTRY}
_KNOWN |= {
    key: (name, kind, 3) for key, name, _family, _version, kind in fixed.VERSIONED_MODELS
}


def record(key: str, spam_probability: Column) -> Column:
    """The reply for one message and one model."""
    name, kind, member = _KNOWN[key]
    verdict = decide(spam_probability)
    return F.struct(
        F.lit(key).alias("model_key"),
        F.lit(name).alias("model_name"),
        F.lit(kind).alias("model_type"),
        F.lit(member).alias("member"),
        *[verdict[f].alias(f) for f in ("prediction", "label", "confidence")],
    )


def _spam_probability(learner) -> Column:
    return vector_to_array(F.col(learner.getOrDefault("probabilityCol")))[1]


def predict(
    df: DataFrame, model: PipelineModel, key: str, keep: Iterable[str] = ("msg_id",)
) -> DataFrame:
    """Score messages with one model: kept columns plus the reply fields."""
    p = _spam_probability(model.stages[-1])
    scored = model.transform(df).select(*keep, p.alias("_p"))
    return scored.select(*keep, record(key, F.col("_p")).alias("r")).select(*keep, "r.*")


def predict_requests(
    df: DataFrame, models: Mapping[str, PipelineModel], keep: Iterable[str] = ("msg_id",)
) -> DataFrame:
    """Score each request with the model it asks for."""
    parts = [
        predict(df.where(F.col("model") == key), model, key, keep)
        for key, model in models.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def number_results(results: Column) -> Column:
    """Add the display index and mark the first most confident entry."""
    sure = F.transform(results, lambda r: r["confidence"])
    best = F.array_position(sure, F.array_max(sure))
    return F.transform(
        results,
        lambda r, i: F.struct(
            *[r[f].alias(f) for f in RECORD],
            (i + 1).alias("display_idx"),
            (i + 1 == best).alias("is_best"),
        ),
    )


def compare_all(
    df: DataFrame, models: Mapping[str, PipelineModel], keep: Iterable[str] = ("msg_id",)
) -> DataFrame:
    """Every loaded model on every message: kept columns plus ``results``.

    Messages are read once and every feature stage is applied once, for all the
    models whose stages agree up to it.  Because all replies for a message meet in
    one row, picking the best needs no shuffle.
    """
    order = [k for k in fixed.COMPARE_ORDER if k in models]
    order += [k for k in models if k not in order]
    out = _score_branch(df.select(*dict.fromkeys([*keep, "text"])), models, order, 0)
    results = out.select(*keep, F.array(*[f"_{key}" for key in order]).alias("results"))
    return results.withColumn("results", number_results(F.col("results")))


def _score_branch(
    df: DataFrame, models: Mapping[str, PipelineModel], keys: list[str], depth: int
) -> DataFrame:
    """``df`` with a reply ``_key`` for each model; their first ``depth`` stages are applied."""
    out, columns = df, df.columns
    branches: dict[str, list[str]] = {}
    for key in keys:
        *features, learner = models[key].stages
        if depth < len(features):
            branches.setdefault(features[depth].uid, []).append(key)
            continue
        out = learner.transform(out).withColumn("_p", _spam_probability(learner))
        columns = [*columns, f"_{key}"]
        out = out.withColumn(f"_{key}", record(key, F.col("_p"))).select(*columns)
    for shared in branches.values():
        out = models[shared[0]].stages[depth].transform(out)
        columns = [*columns, *[f"_{key}" for key in shared]]
        out = _score_branch(out, models, shared, depth + 1).select(*columns)
    return out


def long_results(compared: DataFrame, keep: Iterable[str] = ("msg_id",)) -> DataFrame:
    """One row per message and model.

    The outer form keeps Spark from pushing an emptiness test, and with it every
    model, below the scoring.
    """
    return compared.select(*keep, F.inline_outer("results"))


def mark_best(df: DataFrame, by: str = "msg_id", order: str = "order") -> DataFrame:
    """The same marks for a long table; groups are as large as the model list."""
    listed = Window.partitionBy(by).orderBy(order)
    ranked = Window.partitionBy(by).orderBy(F.desc("confidence"), order)
    return df.withColumns(
        {
            "display_idx": F.row_number().over(listed),
            "is_best": F.row_number().over(ranked) == 1,
        }
    )


_FALSY = ["0", "-0", "0.0", "-0.0", "false", "[]", "{}", ""]
_PY_TYPES = [("BIGINT", "int"), ("DECIMAL", "float"), ("DOUBLE", "float"), ("BOOLEAN", "bool"),
             ("ARRAY", "list"), ("OBJECT", "dict")]


def parse_requests(df: DataFrame, body: str = "value", for_model: bool = True) -> DataFrame:
    """JSON bodies to ``text``, ``model`` and ``fault``.

    Missing and falsy values take their defaults.  A value of another type is a
    fault, as is a body that is not a JSON object.  Requests to compare all
    models (``for_model=False``) may hold anything as their model.
    """
    v = F.col("_v")

    def field(name: str) -> tuple[Column, Column]:
        raw = F.try_variant_get(v, f"$.{name}", "string")
        kind = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
        wrong = F.lit(None).cast("string")
        for prefix, py in _PY_TYPES:
            wrong = F.when(kind.startswith(prefix) & ~F.coalesce(raw, F.lit("?")).isin(_FALSY), py).otherwise(wrong)
        return F.when(kind == "STRING", raw), wrong

    text, text_fault = field("text")
    model, model_fault = field("model")
    if not for_model:
        model_fault = F.lit(None).cast("string")
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    fault = F.when(~is_object, F.lit("malformed JSON body")).otherwise(
        F.format_string(fixed.ERROR_BAD_TYPE, F.coalesce(text_fault, model_fault))
    )
    parsed = df.withColumn("_v", F.try_parse_json(body))
    return parsed.withColumns(
        {
            "text": strip(F.coalesce(text, F.lit(""))),
            "model": model_key(model),
            "fault": F.when(
                ~is_object | F.coalesce(text_fault, model_fault).isNotNull(), fault
            ),
        }
    ).drop("_v")


def check_length(text: Column, lo: int = fixed.MIN_CHARS, hi: int = fixed.MAX_CHARS) -> Column:
    """What a form would object to: null when the trimmed text is fine."""
    n = utf16_length(strip(text))
    return (
        F.when(n == 0, F.lit(fixed.ERROR_TEXT_MISSING))
        .when(n < lo, F.lit(fixed.ERROR_TOO_SHORT))
        .when(n > hi, F.lit(f"more than {hi} characters"))
    )


def validate_requests(df: DataFrame, available: Iterable[str] | Column) -> DataFrame:
    """Add ``status`` and ``error``; the first failing check decides.

    ``available`` names the loaded models, as a list or as an array column.
    """
    if not isinstance(available, Column):
        available = F.array(*[F.lit(k) for k in available]).cast("array<string>")
    checks = [
        *_text_checks(df),
        (
            ~F.col("model").isin(fixed.COMPARE_ORDER),
            400,
            F.format_string(fixed.ERROR_UNKNOWN_KEY, F.col("model")),
        ),
        (
            ~F.array_contains(available, F.col("model")),
            503,
            F.format_string(fixed.ERROR_NOT_LOADED, F.col("model")),
        ),
    ]
    return _first_failed(df, checks)


def validate_compare(df: DataFrame, available: Iterable[str] | Column) -> DataFrame:
    """The same for requests to compare all models: the model asked for is ignored.

    Without any loaded model a request fails with 503.
    """
    if not isinstance(available, Column):
        available = F.array(*[F.lit(k) for k in available]).cast("array<string>")
    none = (F.size(available) == 0, 503, F.lit(fixed.ERROR_NO_MODELS))
    return _first_failed(df, [*_text_checks(df), none])


_Check = tuple[Column, int, Column]


def _text_checks(df: DataFrame) -> list[_Check]:
    fault = F.col("fault") if "fault" in df.columns else F.lit(None).cast("string")
    return [
        (fault.isNotNull(), 500, fault),
        (strip(F.col("text")) == "", 400, F.lit(fixed.ERROR_TEXT_MISSING)),
    ]


def _first_failed(df: DataFrame, checks: list[_Check]) -> DataFrame:
    status, error = F.lit(200), F.lit(None).cast("string")
    for failed, code, reason in reversed(checks):
        status = F.when(failed, F.lit(code)).otherwise(status)
        error = F.when(failed, reason).otherwise(error)
    return df.withColumns({"status": status, "error": error})


def model_status(registry: DataFrame, available: DataFrame) -> DataFrame:
    """Every registered model with ``Ready`` or ``Missing``."""
    loaded = available.select("model_key").distinct().withColumn("loaded", F.lit(True))
    return registry.join(loaded, "model_key", "left").withColumns(
        {
            "loaded": F.coalesce("loaded", F.lit(False)),
            "state": F.when(F.col("loaded"), F.lit("Ready")).otherwise(F.lit("Missing")),
        }
    )


def health(status: DataFrame) -> DataFrame:
    """Loaded keys in registration order, and how many."""
    loaded = F.collect_list(F.when(F.col("loaded"), F.struct("registered", "model_key")))
    return status.agg(
        F.transform(F.array_sort(loaded), lambda s: s["model_key"]).alias("loaded_models"),
        F.count_if("loaded").alias("total_loaded"),
    )


def skipped(registry: DataFrame, available: DataFrame) -> DataFrame:
    """Registered models without a stored artifact."""
    return registry.join(available.select("model_key"), "model_key", "left_anti")


def batch_score(
    make_predict_fn: Callable, batch_size: int = 1024, input_len: int = fixed.MAXLEN, return_type: DataType | None = None
):
    """A vectorised scorer over id arrays: one number per row, Arrow batches."""
    return predict_batch_udf(
        make_predict_fn,
        return_type=return_type or FloatType(),
        batch_size=batch_size,
        input_tensor_shapes=[[input_len]],
    )


def dense_predictor(vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> Callable:
    """A predict function over id arrays: masked mean of word vectors, then a dense net.

    Row i of ``vectors`` belongs to id i; padding and ids without a vector are
    zeros.  The mean counts all ids but padding.  Hidden layers are logistic, the
    last one gives class shares, of which the second is returned.
    """

    def make() -> Callable[[np.ndarray], np.ndarray]:
        def predict(ids: np.ndarray) -> np.ndarray:
            ids = ids.astype(np.int64)
            used = ids != 0
            table = np.vstack([vectors, np.zeros(vectors.shape[1])])
            rows = table[np.where(ids < len(vectors), ids, len(vectors))] * used[:, :, None]
            x = rows.sum(axis=1) / np.maximum(used.sum(axis=1), 1)[:, None]
            for weights, bias in layers[:-1]:
                x = 1 / (1 + np.exp(-(x @ weights + bias)))
            weights, bias = layers[-1]
            x = x @ weights + bias
            x = np.exp(x - x.max(axis=1, keepdims=True))
            return x[:, 1] / x.sum(axis=1)

        return predict

    return make


def exported(model: PipelineModel) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Word vectors by id and layer weights of a fitted pipeline of word vectors and a net.

    The word index bounds the vectors, so they fit the driver and every task.
    """
    vectors = next(s for s in model.stages if isinstance(s, Word2VecModel))
    net = next(s for s in model.stages if isinstance(s, MultilayerPerceptronClassificationModel))
    rows = {int(r["word"]): r["vector"].toArray() for r in vectors.getVectors().collect()}
    table = np.zeros((max(rows, default=0) + 1, vectors.getVectorSize()))
    for i, vector in rows.items():
        table[i] = vector
    flat, sizes, layers, at = net.weights.toArray(), net.getLayers(), [], 0
    for n, m in zip(sizes, sizes[1:]):
        weights = flat[at : at + n * m].reshape(n, m)  # stored input by input
        layers.append((weights, flat[at + n * m : at + n * m + m]))
        at += n * m + m
    return table, layers


def best_only(df: DataFrame) -> DataFrame:
    return df.where("is_best")
