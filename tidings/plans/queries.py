"""Registered queries: every operator over whole tables."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidings import fixed, schemas
from tidings.functions import explain, scores, text, tokens
from tidings.operators import (
    boosting, classifiers, evaluation, features, labelled, scoring, sequences, splits, transitions, vocabulary,
)
from tidings.plans.rules import VERSIONED_RULES, rule_predictions, rule_results
from tidings.session import shared_folder
from tidings.sources import artifacts, derived, messages, metrics, replies
from tidings.streaming import history, scoring as stream_scoring

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _work(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _split(spark: SparkSession, sf: str, part: str | None = None) -> DataFrame:
    df = splits.assign_split(derived.labelled(spark, sf))
    return df.where(F.col("split") == part) if part else df


def _projected(name: str, source: str, id_col: str, column: str, fn: Callable[[Column], Column]):
    """Register one text function over one column of a table."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = derived.sms(spark, sf) if source == "sms" else derived.table(spark, sf, source)
        return df.select(id_col, fn(F.col(column)).alias("out"))

    run.__name__ = name
    QUERIES[name] = run


# ------------------------------------------------------------------ normalisation
for _name, _fn in {
    "clean_v1": text.clean_v1,
    "pre_v2": text.preprocess_v2,
    "pre_v2_url": text.replace_urls,
    "pre_v2_money": text.replace_money,
    "pre_v2_phone": text.replace_phones,
    "pre_v2_punctuation": text.replace_punctuation,
    "pre_v2_num": text.replace_numbers,
    "highlight": explain.highlight,
    "length_tier": text.length_tier,
    "length_check": scoring.check_length,
}.items():
    _projected(_name, "sms", "msg_id", "text", _fn)
_projected("clean_v1_documents", "documents", "doc_id", "text", text.clean_v1)
_projected("pre_v2_documents", "documents", "doc_id", "text", text.preprocess_v2)
_projected("html_unescape", "pages", "page_id", "html", text.html_unescape)
_projected("pre_v2_pages", "pages", "page_id", "html", text.preprocess_v2)


@query
def indicator_chips(spark: SparkSession, sf: str) -> DataFrame:
    df = derived.labelled(spark, sf)
    chips = explain.indicator_chips(F.col("text"), F.col("label") == 1)
    return df.select("msg_id", F.array_join(chips, ", ").alias("chips"))


@query
def previews(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("text")
    return derived.sms(spark, sf).select(
        "msg_id",
        text.preview(c, fixed.PREVIEW_RESULT).alias("result_preview"),
        text.preview(c, fixed.PREVIEW_STORED, ellipsis=False).alias("stored"),
        text.escape_html(text.preview(c, fixed.PREVIEW_HISTORY)).alias("history_preview"),
    )


# ----------------------------------------------------------- labels and their rows
@query
def label_encode(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as given, and roles, which are no labels and become null."""
    df = derived.sms(spark, sf)
    roles = derived.table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), F.col("role").alias("label")
    )
    return df.select("msg_id", "label").unionByName(roles).select(
        "msg_id", "label", scores.encode_label(F.col("label")).cast("string").alias("code")
    )


@query
def drop_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned texts that survive; some texts and labels are blanked first."""
    k = F.col("msg_id")
    raw = derived.sms(spark, sf).select(
        "msg_id",
        F.when(k % 7 == 1, "").when(k % 7 == 2, "NULL").when(k % 7 == 3, F.lit(None))
        .when(k % 7 == 4, "?!").when(k % 7 == 5, "none").otherwise(F.col("text")).alias("text"),
        F.when(k % 5 == 4, "other").otherwise(F.col("label")).alias("label"),
    )
    cleaned = raw.select(
        "msg_id",
        text.clean_v1(F.col("text")).alias("text"),
        scores.encode_label(F.col("label")).alias("label"),
    )
    return labelled.drop_missing(cleaned)


@query
def class_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return labelled.class_distribution(_split(spark, sf), "split")


@query
def class_distribution_documents(spark: SparkSession, sf: str) -> DataFrame:
    df = derived.table(spark, sf, "labels").select((1 - F.col("quality")).alias("label"))
    return labelled.class_distribution(df)


@query
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    df = labelled.class_weights(_split(spark, sf, "train"))
    return df.select(
        "label", "n",
        F.round("scale_pos", 6).alias("scale_pos"), F.round("balanced", 6).alias("balanced"),
    )


@query
def split_assign(spark: SparkSession, sf: str) -> DataFrame:
    return _split(spark, sf).select("msg_id", "split")


@query
def split_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return labelled.split_sizes(_split(spark, sf))


@query
def split_exact(spark: SparkSession, sf: str) -> DataFrame:
    return splits.assign_split_exact(derived.sms(spark, sf)).select("msg_id", "split")


@query
def split_exact_documents(spark: SparkSession, sf: str) -> DataFrame:
    df = splits.assign_split_exact(derived.table(spark, sf, "documents"), "doc_id")
    return df.select("doc_id", "split")


@query
def split_raw_and_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Raw and cleaned text of the test part, in one row."""
    rows = splits.assign_split(derived.sms(spark, sf)).where("split = 'test'")
    return rows.select("msg_id", F.col("text").alias("raw_text"), text.preprocess_v2(F.col("text")).alias("text"))


# ------------------------------------------------------------------------ features
def _tokens_v1(spark: SparkSession, sf: str, part: str | None = None) -> DataFrame:
    return _split(spark, sf, part).select(
        "msg_id", tokens.tokens(text.clean_v1(F.col("text"))).alias("tokens")
    )


def _tokens_v2(spark: SparkSession, sf: str, part: str | None = None) -> DataFrame:
    return _split(spark, sf, part).select(
        "msg_id", tokens.tokens(text.preprocess_v2(F.col("text")), 1).alias("tokens")
    )


def _ngrams_v2(spark: SparkSession, sf: str, part: str | None = None) -> DataFrame:
    return _tokens_v2(spark, sf, part).select(
        "msg_id", tokens.ngrams(F.col("tokens"), 1, 2).alias("tokens")
    )


def _words(spark: SparkSession, sf: str, version: int, part: str | None = None) -> DataFrame:
    c = F.col("text")
    words = (
        tokens.sequence_words(text.clean_v1(c))
        if version == 1
        else tokens.sequence_words(text.preprocess_v2(c), fixed.SEQUENCE_FILTERS_V2)
    )
    return _split(spark, sf, part).select("msg_id", words.alias("words"))


@query
def tokens_v1(spark: SparkSession, sf: str) -> DataFrame:
    return _tokens_v1(spark, sf).select("msg_id", F.array_join("tokens", " ").alias("tokens"))


@query
def tokens_v1_documents(spark: SparkSession, sf: str) -> DataFrame:
    return derived.table(spark, sf, "documents").select(
        "doc_id", F.array_join(tokens.tokens(F.col("text")), " ").alias("tokens")
    )


@query
def tokens_v2(spark: SparkSession, sf: str) -> DataFrame:
    return _tokens_v2(spark, sf).select("msg_id", F.array_join("tokens", " ").alias("tokens"))


@query
def ngrams_v2(spark: SparkSession, sf: str) -> DataFrame:
    return _ngrams_v2(spark, sf).select("msg_id", F.array_join("tokens", "|").alias("ngrams"))


@query
def vocab_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.fit_vocab(_tokens_v1(spark, sf, "train"), fixed.TFIDF_FEATURES)


@query
def vocab_documents(spark: SparkSession, sf: str) -> DataFrame:
    df = derived.table(spark, sf, "documents").select(
        F.col("doc_id").alias("msg_id"),
        tokens.tokens(text.clean_v1(F.col("text"))).alias("tokens"),
    )
    return vocabulary.fit_vocab(df, fixed.TFIDF_FEATURES)


@query
def vocab_tfidf_v2(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.fit_vocab(
        _ngrams_v2(spark, sf, "train"), fixed.TFIDF_FEATURES_V2, fixed.MIN_DF_V2, fixed.MAX_DF_V2
    )


@query
def vocab_tokenizer(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.fit_word_index(_words(spark, sf, 1, "train"))


@query
def vocab_tokenizer_v2(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.fit_word_index(_words(spark, sf, 2, "train"), oov=True)


def _tfidf(spark: SparkSession, sf: str, part: str) -> DataFrame:
    model = features.TfidfVectorizer().fit(_tokens_v1(spark, sf, "train"))
    entries = features.vector_entries(model.transform(_tokens_v1(spark, sf, part)), "features")
    return entries.select("msg_id", "idx", F.round("weight", 4).alias("weight"))


@query
def tfidf_weights(spark: SparkSession, sf: str) -> DataFrame:
    return _tfidf(spark, sf, "train")


@query
def tfidf_transform(spark: SparkSession, sf: str) -> DataFrame:
    return _tfidf(spark, sf, "test")


def _ids(spark: SparkSession, sf: str, version: int) -> DataFrame:
    index = vocabulary.fit_word_index(_words(spark, sf, version, "train"), oov=version == 2)
    ids = features.to_ids(_words(spark, sf, version), index, 1 if version == 2 else None)
    n, side = (fixed.MAXLEN, "pre") if version == 1 else (fixed.MAXLEN_V2, "post")
    return ids.select("msg_id", tokens.pad(F.col("ids"), n, side).alias("ids"))


@query
def seq_v1(spark: SparkSession, sf: str) -> DataFrame:
    return _ids(spark, sf, 1).select("msg_id", F.array_join("ids", " ").alias("ids"))


@query
def seq_v2(spark: SparkSession, sf: str) -> DataFrame:
    return _ids(spark, sf, 2).select("msg_id", F.array_join("ids", " ").alias("ids"))


@query
def pad_mask(spark: SparkSession, sf: str) -> DataFrame:
    mask = tokens.pad_mask(F.col("ids"))
    kept = F.filter(F.arrays_zip(tokens.positions(fixed.MAXLEN_V2).alias("p"), mask.alias("m")), lambda z: z["m"])
    return _ids(spark, sf, 2).select(
        "msg_id",
        F.array_join(mask.cast("array<string>"), " ").alias("mask"),
        F.array_join(F.transform(kept, lambda z: z["p"]), " ").alias("positions"),
    )


@query
def pool_max(spark: SparkSession, sf: str) -> DataFrame:
    """Largest value of each dimension over the vectors of a label."""
    return features.pool(derived.table(spark, sf, "embeddings"), "embedding", "label")


def _fill_rate():
    """A batch scorer: the share of an id row that is not padding."""

    def score(ids: np.ndarray) -> np.ndarray:
        return (ids != 0).mean(axis=1).astype(np.float32)

    return score


@query
def predict_batch(spark: SparkSession, sf: str) -> DataFrame:
    score = scoring.batch_score(_fill_rate)
    return _ids(spark, sf, 1).select(
        "msg_id", F.round(score("ids").cast("double"), 4).alias("score")
    )


#: Components of the fixed vectors and of the fixed attention query.
DIM = 8


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    """A vector for every word of the index, by a rule on its id."""
    index = vocabulary.fit_word_index(_words(spark, sf, 2, "train"), oov=True)
    ids = index.select(F.col("idx").cast("long").alias("id")).union(spark.range(1, 2))
    parts = [((F.col("id") * (2 * d + 3) + 7 * d * d) % 1001 - 500) / 1000 for d in range(DIM)]
    return ids.select("id", F.array(*parts).alias("vector"))


def _token_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.token_vectors(_ids(spark, sf, 2), _vectors(spark, sf))


def _dims(pooled: DataFrame) -> DataFrame:
    values = pooled.select("msg_id", F.posexplode("vector").alias("dim", "value"))
    return values.select("msg_id", F.col("dim").cast("long").alias("dim"), F.round("value", 9).alias("value"))


@query
def pool_positions_max(spark: SparkSession, sf: str) -> DataFrame:
    """Largest value of each dimension over a message's words, padding left out."""
    return _dims(sequences.pool_positions(_token_vectors(spark, sf), DIM, "max"))


@query
def pool_positions_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _dims(sequences.pool_positions(_token_vectors(spark, sf), DIM, "mean"))


@query
def attention_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Word vectors with position codes, averaged by attention to a fixed query."""
    coded = sequences.with_positions(_token_vectors(spark, sf), DIM)
    return _dims(sequences.attend(coded, [(-1) ** d * (d + 1) / 2 for d in range(DIM)]))


def _id_words(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of the training part as words, padding left out."""
    rows = _ids(spark, sf, 1).join(_split(spark, sf, "train").select("msg_id", "label"), "msg_id")
    return features.IdsToWords(inputCol="ids", outputCol="words").transform(rows)


@query
def vocab_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Phrases of up to five words that the training part uses three times or more."""
    return vocabulary.frequent_phrases(_id_words(spark, sf), 5, 3).select("phrase", F.col("length").cast("long").alias("length"), "n")


@query
def transition_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How often a word follows another one, in both classes of the training part."""
    return transitions.transition_counts(_id_words(spark, sf))


@query
def shuffle_position(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's place in a seeded shuffle of all."""
    docs = derived.table(spark, sf, "documents").select("doc_id")
    return splits.shuffle_positions(docs, _work(spark, "shuffled"), "doc_id")


@query
def split_complete(spark: SparkSession, sf: str) -> DataFrame:
    """The parts of the messages hold every message once, by digests that need no order."""
    rows = _split(spark, sf)
    found = splits.complete(rows, derived.labelled(spark, sf), ["msg_id", "text", "label"])
    return found.select("part", "n", F.col("total").cast("string").alias("total"), "mix", "complete")


@query
def gbt_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Gradients and Hessians by feature before the first tree, values that are not zero in one bin."""
    model = features.TfidfVectorizer().fit(_tokens_v1(spark, sf, "train"))
    labels = _split(spark, sf, "train").select("msg_id", "label")
    rows = model.transform(_tokens_v1(spark, sf, "train")).join(labels, "msg_id")
    edges = boosting.quantile_edges(rows, "features", 1)
    level = boosting.Level(boosting.Tree.empty(1), 0, [0], len(edges), 1)
    found = boosting.histogram_table(boosting.blocks(rows, "features", edges), level)
    sums = found.groupBy("feature").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    return sums


# ----------------------------------------------------- decisions, requests, replies
@query
def threshold_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return rule_predictions(derived.labelled(spark, sf)).drop("truth")


@query
def compare_best(spark: SparkSession, sf: str) -> DataFrame:
    """Best and display index within each message, from rows that arrive apart."""
    registry = schemas.registry(spark).select("model_key", "order")
    rows = rule_predictions(derived.labelled(spark, sf)).join(F.broadcast(registry), "model_key")
    return scoring.mark_best(rows).select(
        "msg_id", "model_key", "confidence", "display_idx", "is_best"
    )


@query
def compare_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The same inside each row, where all replies already meet."""
    rows = rule_results(derived.labelled(spark, sf))
    marked = rows.withColumn("results", scoring.number_results(F.col("results")))
    return scoring.long_results(marked).select(
        "msg_id", "model_key", "confidence", "display_idx", "is_best"
    )


@query
def compare_json(spark: SparkSession, sf: str) -> DataFrame:
    """Replies written as JSON and read back."""
    rows = rule_results(derived.labelled(spark, sf), keep=("text",))
    marked = rows.withColumn("results", scoring.number_results(F.col("results")))
    body = replies.to_response(marked).select("msg_id", "value")
    entry = schemas.PREDICTION + ", is_best BOOLEAN"
    parsed = F.from_json("value", f"text STRING, results ARRAY<STRUCT<{entry}>>")
    return (
        body.select("msg_id", parsed.alias("r"))
        .select("msg_id", F.length("r.text").alias("n_text"), F.inline("r.results"))
        .select("msg_id", "n_text", "model_key", "label", "confidence", F.coalesce("is_best", F.lit(False)).alias("is_best"))
    )


def _requests(df: DataFrame) -> DataFrame:
    """JSON bodies with missing, blank, foreign and ill-typed values among them."""
    k = F.col("msg_id")
    asked = F.when(k % 11 == 3, F.lit("   ")).when(k % 13 == 5, F.lit(None)).otherwise(F.concat(F.lit(" "), "text"))
    model = (
        F.when(k % 7 == 0, F.lit(None)).when(k % 7 == 1, "").when(k % 7 == 2, " RF ")
        .when(k % 7 == 3, "zz").when(k % 7 == 4, "LSTM").when(k % 7 == 5, "xgb").otherwise("lr")
    )
    body = F.to_json(F.struct(asked.alias("text"), model.alias("model")))
    number = F.concat(F.lit('{"text": '), k.cast("string"), F.lit("}"))
    return df.select("msg_id", F.when(k % 17 == 2, number).otherwise(body).alias("value"))


@query
def request_parse(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.parse_requests(_requests(derived.sms(spark, sf))).drop("value")


@query
def request_validate(spark: SparkSession, sf: str) -> DataFrame:
    parsed = scoring.parse_requests(_requests(derived.sms(spark, sf)))
    return scoring.validate_requests(parsed, ["lr", "rf"]).select(
        "msg_id", "model", "status", "error"
    )


@query
def compare_validate(spark: SparkSession, sf: str) -> DataFrame:
    """Requests to compare all models; for some of them none is loaded."""
    parsed = scoring.parse_requests(_requests(derived.sms(spark, sf)), for_model=False)
    loaded = F.when(F.col("msg_id") % 19 == 4, F.array().cast("array<string>")).otherwise(F.array(F.lit("lr")))
    return scoring.validate_compare(parsed, loaded).select("msg_id", "status", "error")


def _stored_models(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of the registered models that have an artifact.

    One is fitted and saved for an application and table, and shared by the
    queries that look for artifacts.
    """
    path = f"{shared_folder(spark)}/models-{spark.sparkContext.applicationId}-{zlib.crc32(sf.encode()):x}"
    if not messages.path_exists(spark, path):
        fitted = classifiers.fit_models(_split(spark, sf, "train"), {"lr": classifiers.lr_pipeline()})
        for key, model in fitted.items():
            artifacts.save_model(model, f"{path}/{key}")
    loaded = artifacts.load_models(spark, {key: f"{path}/{key}" for key in fixed.COMPARE_ORDER})
    return artifacts.available(spark, loaded)


@query
def model_status(spark: SparkSession, sf: str) -> DataFrame:
    """Models with a stored artifact are ready, others missing."""
    status = scoring.model_status(schemas.registry(spark), _stored_models(spark, sf))
    return status.select("model_key", "status_name", "state")


@query
def model_health(spark: SparkSession, sf: str) -> DataFrame:
    status = scoring.model_status(schemas.registry(spark), _stored_models(spark, sf))
    return scoring.health(status).select(
        F.array_join("loaded_models", ",").alias("loaded_models"), "total_loaded"
    )


@query
def model_skipped(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.skipped(schemas.registry(spark), _stored_models(spark, sf)).select("model_key", "model_name")


# ---------------------------------------------------------------------- evaluation
@query
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions joined to labels by id, then counted per model."""
    truth = derived.labelled(spark, sf)
    predictions = rule_predictions(truth).drop("truth")
    return evaluation.confusion(evaluation.attach_truth(predictions, truth))


def _metrics(spark: SparkSession, sf: str, part: str | None = None) -> DataFrame:
    counts = evaluation.confusion(rule_predictions(_split(spark, sf, part)))
    return evaluation.metrics_from_confusion(counts)


def _enriched(spark: SparkSession, sf: str, part: str | None = None) -> DataFrame:
    return evaluation.enrich_metrics(_metrics(spark, sf, part), schemas.registry(spark))


@query
def eval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(spark, sf)


@query
def metrics_enrich(spark: SparkSession, sf: str) -> DataFrame:
    return _enriched(spark, sf).drop("tn", "fp", "fn", "tp")


@query
def eval_report(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.report(_enriched(spark, sf)).select(
        "name", "type", *evaluation.METRICS, "fp", "fn"
    )


@query
def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.leaderboard(_enriched(spark, sf)).select(
        "rank", "rank_class", "model_key", "name", "f1"
    )


@query
def kpi_best(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.best_models(_enriched(spark, sf))


@query
def chart_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.chart_matrix(_enriched(spark, sf)).select(
        F.col("order").alias("place"), "model_key", "label", "color", "metric", "value"
    )


@query
def metrics_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Validation metrics of all models, overwritten by test metrics of three."""
    columns = ["model_key", *evaluation.METRICS]
    old = _metrics(spark, sf, "val").select(*columns)
    new = _metrics(spark, sf, "test").where(F.col("model_key").isin("lr", "rf", "xgb"))
    return evaluation.upsert_metrics(old, new.select(*columns))


def _versioned(spark: SparkSession, sf: str) -> DataFrame:
    counts = evaluation.confusion(rule_predictions(derived.labelled(spark, sf), VERSIONED_RULES))
    known = schemas.versioned_registry(spark)
    return evaluation.metrics_from_confusion(counts).join(F.broadcast(known), "model_key")


@query
def v1_v2_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.pivot_versions(_versioned(spark, sf)).select(
        "family", F.col("V1").alias("f1_v1"), F.col("V2").alias("f1_v2"), "gain"
    )


# ------------------------------------------------------------------ files and back
@query
def src_first_existing(spark: SparkSession, sf: str) -> DataFrame:
    """The first of several files that exists, its columns renamed, rows with missing values left out."""
    path = _work(spark, "first")
    rows = _split(spark, sf, "test").select(F.col("text").alias("cleaned_text"), "label")
    rows.write.options(header=True, quote='"', escape='"', quoteAll=True).csv(f"{path}/clean")
    found = messages.read_first_existing(
        spark, [(f"{path}/raw", {"raw_text": "text"}), (f"{path}/clean", {"cleaned_text": "text"})]
    )
    return found.groupBy("text", "label").agg(F.count("*").alias("n"))


@query
def src_tsv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Tab-separated messages written and read back, one line each."""
    path = _work(spark, "tsv")
    one_line = derived.sms(spark, sf).select("label", text.collapse_space(F.col("text")).alias("text"))
    one_line.write.options(sep="\t", quote='"', escape='"').csv(path)
    return splits.assign_split(messages.read_messages(spark, path)).select("msg_id", "label", "text", "split")


@query
def splits_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Split table written by part and read back whole."""
    path = _work(spark, "splits")
    messages.write_splits(_split(spark, sf), path)
    return messages.read_split(spark, path).select("msg_id", "text", "label", "split")


@query
def metrics_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Metric document: validation results, then updated with test results."""
    path = _work(spark, "metrics")
    metrics.update_metrics(spark, _enriched(spark, sf, "val"), path)
    newer = _enriched(spark, sf, "test").where(F.col("model_key").isin("lr", "rf"))
    metrics.update_metrics(spark, newer, path)
    return metrics.read_metrics(spark, path).select("model_key", "short", "f1")


@query
def comparison_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = _work(spark, "comparison")
    metrics.write_comparison(_versioned(spark, sf), path)
    read = metrics.read_metrics(spark, path, schema=schemas.COMPARISON)
    return read.select("model_key", "family", "version", "f1", "cm.TN", "cm.FP", "cm.FN", "cm.TP")


# ------------------------------------------------------------------------- history
def _timed(turns: DataFrame, events: DataFrame) -> DataFrame:
    """Messages with the time of their event."""
    return turns.join(
        events.select(F.col("event_id").alias("e"), "ts"),
        F.expr("msg_id DIV 1000 * 10 + msg_id % 1000") == F.col("e"),
    )


def _verdicts(timed: DataFrame) -> DataFrame:
    """Messages with a time and a rule verdict."""
    points = F.least(F.lit(100), explain.indicator_count(F.col("text")) * 15 + 10) / 100
    reply = scoring.record("lr", points)
    return timed.select("msg_id", "ts", "text", reply.alias("r")).select(
        F.col("msg_id").alias("id"),
        "ts",
        (F.col("r.prediction") == 1).alias("is_spam"),
        "r.confidence",
        "r.model_name",
        F.col("text").alias("message"),
    )


@query
def history_top20(spark: SparkSession, sf: str) -> DataFrame:
    timed = _timed(derived.sms(spark, sf), derived.table(spark, sf, "events"))
    verdicts = _verdicts(history.history_top(timed, id_col="msg_id"))
    return history.render_history(history.history_entries(verdicts)).select(
        "id", "verdict", "shown", "time", "confidence", "model_name"
    )


def _turn_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The conversation table as a stream of derived messages."""
    schema = derived.table(spark, sf, "conversations").schema
    turns = spark.readStream.schema(schema).parquet(f"{sf}/conversations*.parquet")
    return spark.sql(derived.SMS_SQL.replace("{conversations}", "{turns}"), turns=turns)


@query
def stream_history(spark: SparkSession, sf: str) -> DataFrame:
    path = _work(spark, "history")
    turns = derived.table(spark, sf, "conversations")
    turns.repartition(4).write.parquet(f"{path}/turns")  # a batch for each file
    stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/turns")
    stream = spark.sql(derived.SMS_SQL.replace("{conversations}", "{turns}"), turns=stream)
    verdicts = _verdicts(_timed(stream, derived.table(spark, sf, "events")))
    history.history_stream(verdicts, f"{path}/state", f"{path}/checkpoint").awaitTermination()
    return history.render_history(history.read_history(spark, f"{path}/state")).select("id", "verdict", "shown", "time")


@query
def stream_history_state(spark: SparkSession, sf: str) -> DataFrame:
    """The same by keyed state, with a restart in between and a file that comes twice."""
    path = _work(spark, "history-state")
    # the times are joined once, not again in every batch
    _timed(derived.sms(spark, sf), derived.table(spark, sf, "events")).drop("e").write.parquet(f"{path}/timed")
    turns = spark.read.parquet(f"{path}/timed")
    conv = F.expr("msg_id DIV 1000")
    halves = [turns.where(conv % 2 == 0), turns.where((conv % 2 == 1) | (conv % 5 == 0))]
    for half in halves:
        half.repartition(2, conv).write.mode("append").parquet(f"{path}/turns")
        stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/turns")
        verdicts = _verdicts(history.cut_newest(stream, id_col="msg_id"))
        history.history_state_stream(verdicts, f"{path}/state", f"{path}/checkpoint").awaitTermination()
    rows = history.read_state_history(spark, f"{path}/state")
    return history.render_history(rows).select("id", "verdict", "shown", "time")


def _stream(spark: SparkSession, sf: str, name: str) -> str:
    path = _work(spark, name)
    models = classifiers.fit_models(_split(spark, sf, "train"), {"lr": classifiers.lr_pipeline()})
    stream_scoring.score_stream(
        _requests(_turn_stream(spark, sf)), models, f"{path}/scored", f"{path}/rejects",
        f"{path}/checkpoint",
    ).awaitTermination()
    return path


@query
def stream_score(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{_stream(spark, sf, 'scored')}/scored").drop("batch_id")


@query
def stream_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{_stream(spark, sf, 'rejected')}/rejects").drop("batch_id")


# ------------------------------------------------------------------ learned models
def _train(spark: SparkSession, sf: str) -> DataFrame:
    return _split(spark, sf, "train")


def _weighted(spark: SparkSession, sf: str) -> DataFrame:
    return labelled.with_weights(_train(spark, sf), "scale_pos")


def _predict(key: str, pipeline: Callable, name: str, train: Query = _train) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        model = classifiers.fit_models(train(spark, sf), {key: pipeline()})[key]
        return scoring.predict(_split(spark, sf, "test"), model, key)

    run.__name__ = name
    QUERIES[name] = run


_predict("lr", classifiers.lr_pipeline, "predict_lr")
_predict("rf", classifiers.rf_pipeline, "predict_rf")
_predict("xgb", classifiers.gbt_pipeline, "predict_gbt")
_predict("xgb_v2", classifiers.gbt_v2_pipeline, "predict_gbt_v2", _weighted)
_predict("cnn", classifiers.ngram_pipeline, "predict_ngram")
_predict("transformer", classifiers.embed_pipeline, "predict_embed")
_predict("lstm", classifiers.sequence_pipeline, "predict_seq")


@query
def predict_batch_model(spark: SparkSession, sf: str) -> DataFrame:
    """A fitted net's forward pass on batches of ids, beside the pipeline's own scores."""
    model = classifiers.fit_models(_train(spark, sf), {"transformer": classifiers.embed_pipeline()})["transformer"]
    forward = scoring.batch_score(scoring.dense_predictor(*scoring.exported(model)), return_type=DoubleType())
    scored = model.transform(_split(spark, sf, "test"))
    own = vector_to_array(F.col("transformer_probability"))[1]
    return scored.select("msg_id", forward("ids_v1").alias("score"), own.alias("own"))


@query
def predict_batch_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Both agree to a millionth for every message of the test part."""
    agree = F.abs(F.col("score") - F.col("own")) < 1e-6
    return predict_batch_model(spark, sf).select("msg_id", agree.alias("agree"))


def _validated(spark: SparkSession, sf: str) -> DataFrame:
    """Training and validation part; rows of the latter are flagged."""
    rows = _split(spark, sf).where("split <> 'test'").withColumn("held", F.col("split") == "val")
    return labelled.with_weights(rows, "scale_pos")


@query
def gbt_round_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Validation loss and accuracy after every round kept, boosting having stopped by patience."""
    pipeline = classifiers.gbt_v2_pipeline(validation_col="held")
    model = classifiers.fit_models(_validated(spark, sf), {"xgb_v2": pipeline})["xgb_v2"]
    rows = _split(spark, sf, "val")
    for stage in model.stages[:-1]:
        rows = stage.transform(rows)
    return boosting.round_curve(rows, model.stages[-1])


def _all_models(spark: SparkSession, sf: str):
    return classifiers.fit_models(
        _train(spark, sf),
        {
            "lr": classifiers.lr_pipeline(),
            "rf": classifiers.rf_pipeline(),
            "xgb": classifiers.gbt_pipeline(),
            "cnn": classifiers.ngram_pipeline(),
            "lstm": classifiers.sequence_pipeline(),
            "transformer": classifiers.embed_pipeline(),
        },
    )


def _evaluated(compared: DataFrame) -> DataFrame:
    rows = scoring.long_results(compared, ("msg_id", "truth")).select("model_key", "truth", "prediction")
    return evaluation.metrics_from_confusion(evaluation.confusion(rows))


def _test(spark: SparkSession, sf: str) -> DataFrame:
    return _split(spark, sf, "test").withColumnRenamed("label", "truth")


@query
def compare_all(spark: SparkSession, sf: str) -> DataFrame:
    compared = scoring.compare_all(_test(spark, sf), _all_models(spark, sf))
    return scoring.long_results(compared)


def _sound(label: str = "label") -> list[Column]:
    """What holds for every reply: its label is its prediction's, its confidence 50 to 100."""
    return [
        (F.col(label) == scores.decode_label(F.col("prediction"))).alias("label_agrees"),
        F.col("confidence").between(50, 100).alias("confident"),
    ]


@query
def compare_contract(spark: SparkSession, sf: str) -> DataFrame:
    """What holds for the replies of fitted models, whatever they learned."""
    compared = scoring.compare_all(_test(spark, sf), _all_models(spark, sf))
    one_best = (F.size(F.filter("results", lambda r: r["is_best"])) == 1).alias("one_best")
    rows = compared.select("msg_id", one_best, F.inline_outer("results"))
    return rows.select(
        "msg_id", "model_key", "model_name", "model_type", "member", "display_idx", "one_best", *_sound()
    )


def _class_totals(measured: DataFrame, *keys: str) -> DataFrame:
    return measured.select(
        *keys, (F.col("tn") + F.col("fp")).alias("negatives"), (F.col("fn") + F.col("tp")).alias("positives")
    )


@query
def eval_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Confusion counts of fitted models add up to the classes."""
    return _class_totals(eval_models(spark, sf), "model_key")


@query
def versions_contract(spark: SparkSession, sf: str) -> DataFrame:
    """The same for both versions."""
    return _class_totals(eval_v1_v2(spark, sf), "model_key", "family", "version")


@query
def stream_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Every accepted request of a stream is answered once."""
    return stream_score(spark, sf).select("msg_id", "model_key", "model_name", "model_type", "member", *_sound())


@query
def eval_models(spark: SparkSession, sf: str) -> DataFrame:
    compared = scoring.compare_all(_test(spark, sf), _all_models(spark, sf), ("msg_id", "truth"))
    enriched = evaluation.enrich_metrics(_evaluated(compared), schemas.registry(spark))
    return evaluation.leaderboard(enriched)


@query
def eval_v1_v2(spark: SparkSession, sf: str) -> DataFrame:
    """Each version with its own normaliser, vocabulary and length."""
    models = classifiers.fit_models(
        _weighted(spark, sf),
        {
            "xgb_v1": classifiers.gbt_pipeline(key="xgb_v1"),
            "xgb_v2": classifiers.gbt_v2_pipeline(),
            "tf_v1": classifiers.embed_pipeline(key="tf_v1"),
            "tf_v2": classifiers.embed_pipeline(dim=64, version=2, key="tf_v2"),
        },
        balanced={"tf_v2"},
    )
    compared = scoring.compare_all(_test(spark, sf), models, ("msg_id", "truth"))
    known = schemas.versioned_registry(spark)
    return _evaluated(compared).join(F.broadcast(known), "model_key")


@query
def eval_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Quality labels of documents: the same pipeline on long texts."""
    docs = derived.table(spark, sf, "documents").select(F.col("doc_id").alias("msg_id"), "text")
    labels = derived.table(spark, sf, "labels").select(
        F.col("doc_id").alias("msg_id"), (1 - F.col("quality")).alias("label")
    )
    rows = splits.assign_split(docs.join(labels, "msg_id"))
    models = classifiers.fit_models(rows.where("split = 'train'"), {"lr": classifiers.lr_pipeline()})
    test = rows.where("split = 'test'").withColumnRenamed("label", "truth")
    scored = scoring.predict(test, models["lr"], "lr", ("msg_id", "truth"))
    return evaluation.metrics_from_confusion(evaluation.confusion(scored))
