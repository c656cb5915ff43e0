"""Splits, vocabularies, sequences, requests, evaluation on small tables."""

import hashlib
import json
import math
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidings import fixed, schemas
from tidings.functions import tokens
from tidings.operators import evaluation, features, labelled, scoring, splits, vocabulary
from tidings.sources import artifacts, derived, messages, metrics, replies
from tidings.streaming import history


# ------------------------------------------------------------------------- labels
def test_drop_missing(spark):
    df = spark.createDataFrame(
        [("", 1), ("nan", 1), ("null", 1), (None, 1), ("ok", 1), ("ok", None), ("none", 0), ("na", 0)],
        "text STRING, label INT",
    )
    assert sorted(r["text"] for r in labelled.drop_missing(df).collect()) == ["na", "none", "ok"]


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2 + [(None,)], "label INT")
    rows = {r["label"]: r for r in labelled.class_weights(df).collect()}
    assert (rows[1]["scale_pos"], rows[0]["scale_pos"]) == (3.0, 1.0)
    assert (rows[1]["balanced"], rows[0]["balanced"]) == (8 / 4, 8 / 12)
    weighted = labelled.with_weights(df, "balanced").where("label = 1").first()
    assert weighted["w"] == 2.0


# ------------------------------------------------------------------------- splits
def assert_partition(df, names):
    """Every row in exactly one split."""
    ids = {n: {r["msg_id"] for r in df.where(F.col("split") == n).collect()} for n in names}
    assert sum(len(i) for i in ids.values()) == df.count() == len(set().union(*ids.values()))


@pytest.mark.parametrize("n", [1, 7, 100, 2003])
def test_exact_split_matches_sorting_by_hash(spark, n):
    df = spark.range(n).select((F.col("id") * 7 + 3).alias("msg_id"))
    out = splits.assign_split_exact(df)
    assert_partition(out, ["train", "val", "test"])
    by_hash = sorted(
        (hashlib.md5(f"42:{i * 7 + 3}".encode()).hexdigest(), i * 7 + 3) for i in range(n)
    )
    n_test = math.ceil(0.15 * n)
    n_val = math.ceil(0.176 * (n - n_test))
    got = {r["msg_id"]: r["split"] for r in out.collect()}
    for place, (_, key) in enumerate(by_hash):
        expected = "test" if place < n_test else "val" if place < n_test + n_val else "train"
        assert got[key] == expected


def test_hash_split_ignores_other_columns(spark):
    df = spark.range(500).select(F.col("id").alias("msg_id"))
    assert_partition(splits.assign_split(df), ["train", "val", "test"])
    other = splits.assign_split(df.withColumn("x", F.lit("y"))).drop("x")
    assert other.exceptAll(splits.assign_split(df)).isEmpty()


# ------------------------------------------------------------- vocabulary, sequences
DOCS = [["b", "a", "b"], ["a", "c"], ["c", "b", "d", "b"], []]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(
        list(enumerate(DOCS)), "msg_id LONG, tokens ARRAY<STRING>"
    ).withColumn("words", F.col("tokens"))


def test_vocabulary(docs):
    rows = vocabulary.fit_vocab(docs, 3).orderBy("idx").collect()
    assert [(r["term"], r["idx"], r["tf"], r["df"]) for r in rows] == [
        ("a", 0, 2, 2), ("b", 1, 4, 2), ("c", 2, 2, 2),
    ]
    rows = vocabulary.fit_vocab(docs, 10, min_df=2, max_df=0.5).collect()
    assert sorted(r["term"] for r in rows) == ["a", "b", "c"]
    assert vocabulary.fit_vocab(docs, 10, max_df=0.4).collect()[0]["term"] == "d"


def test_word_index_breaks_ties_by_first_use(docs):
    rows = vocabulary.fit_word_index(docs, 5).orderBy("idx").collect()
    assert [(r["word"], r["idx"]) for r in rows] == [("b", 1), ("a", 2), ("c", 3), ("d", 4)]
    rows = vocabulary.fit_word_index(docs, 4, oov=True).orderBy("idx").collect()
    assert [(r["word"], r["idx"]) for r in rows] == [("b", 2), ("a", 3)]


def test_hot_word_counts(spark):
    """One word makes up most of the corpus and repeats inside messages."""
    rows = [(i, ["hot"] * 50 + [f"w{i % 7}"]) for i in range(400)]
    df = spark.createDataFrame(rows, "msg_id LONG, tokens ARRAY<STRING>").repartition(6)
    got = {r["term"]: (r["tf"], r["df"]) for r in vocabulary.term_counts(df).collect()}
    assert got["hot"] == (20_000, 400)
    assert got["w0"] == (58, 58)


@pytest.mark.parametrize("oov", [None, 1])
def test_ids_by_lookup_and_by_join_agree(spark, docs, oov):
    index = vocabulary.fit_word_index(docs, 3, oov=oov is not None)
    near = features.to_ids(docs, index, oov).select("msg_id", "ids")
    far = features.to_ids(docs, index, oov, join=True).select("msg_id", "ids")
    assert {r["msg_id"]: r["ids"] for r in near.collect()} == {
        r["msg_id"]: r["ids"] for r in far.collect()
    }


def test_lookup_of_many_entries(spark):
    from tidings.functions.lookup import literal_lookup

    index = {f"w{i}": i for i in range(30_000)}
    df = spark.createDataFrame([("w29999",), ("x",), (None,)], "w string")
    found = [r[0] for r in df.select(literal_lookup(index, "int")(F.col("w"))).collect()]
    assert found == [29_999, None, None]


def test_tfidf_against_plain_arithmetic(docs):
    model = features.TfidfVectorizer(maxFeatures=3).fit(docs)
    got = {
        (r["msg_id"], r["idx"]): r["weight"]
        for r in features.vector_entries(model.transform(docs), "features").collect()
    }
    df = {"a": 2, "b": 2, "c": 2}
    for i, doc in enumerate(DOCS):
        weights = {
            t: n * (math.log((1 + len(DOCS)) / (1 + df[t])) + 1)
            for t, n in Counter(doc).items()
            if t in df
        }
        norm = math.sqrt(sum(w * w for w in weights.values()))
        for t, w in weights.items():
            assert got.pop((i, "abc".index(t))) == pytest.approx(w / norm, abs=1e-12)
    assert not got


def test_applying_features_never_shuffles(docs):
    model = features.TfidfVectorizer(maxFeatures=3).fit(docs)
    plan = model.transform(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_sequence_stage_persists(spark, tmp_path):
    df = spark.createDataFrame([(0, "b a b"), (1, "a c"), (2, "zz b")], "msg_id LONG, clean STRING")
    model = features.SequenceVectorizer(numWords=3, maxLen=4).fit(df.where("msg_id < 2"))
    model.write().overwrite().save(str(tmp_path / "m"))
    again = features.SequenceModel.load(str(tmp_path / "m"))
    rows = again.transform(df).orderBy("msg_id").collect()
    assert [r["ids"] for r in rows] == [[0, 1, 2, 1], [0, 0, 0, 2], [0, 0, 0, 1]]


def test_batch_scorer_equals_native_expression(spark):
    from tidings.plans.queries import _fill_rate

    df = spark.range(100).select(
        F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: ((i * F.col("id")) % 3).cast("int")).alias("ids")
    )
    score = scoring.batch_score(_fill_rate, batch_size=16)
    native = F.size(F.filter("ids", lambda i: i != 0)) / 50
    rows = df.select(score("ids").alias("s"), native.alias("n")).collect()
    assert all(r["s"] == pytest.approx(r["n"], abs=1e-6) for r in rows)


# ----------------------------------------------------------------------- evaluation
GOLDEN = [
    ("xgb_v1", 724, 5, 17, 90, 97.37, 94.74, 84.11, 89.11),
    ("xgb_v2", 728, 1, 11, 96, 98.56, 98.97, 89.72, 94.12),
    ("tf_v1", 726, 3, 8, 99, 98.68, 97.06, 92.52, 94.74),
    ("tf_v2", 721, 8, 6, 101, 98.33, 92.66, 94.39, 93.52),
    ("all_ham", 10, 0, 2, 0, 83.33, 0.0, 0.0, 0.0),
]


def test_golden_metrics(spark):
    counts = spark.createDataFrame(
        [g[:5] for g in GOLDEN], "model_key STRING, tn LONG, fp LONG, fn LONG, tp LONG"
    )
    rows = {r["model_key"]: r for r in evaluation.metrics_from_confusion(counts).collect()}
    for key, *_, accuracy, precision, recall, f1 in GOLDEN:
        r = rows[key]
        assert (r["accuracy"], r["precision"], r["recall"], r["f1"]) == (accuracy, precision, recall, f1)


def test_confusion_counts_one_hot_model(spark):
    rows = [("hot", i % 2, (i // 2) % 2) for i in range(4000)] + [("cold", 1, 1)]
    df = spark.createDataFrame(rows, "model_key STRING, truth INT, prediction INT")
    got = {r["model_key"]: r.asDict() for r in evaluation.confusion(df).collect()}
    assert got["hot"] == {"model_key": "hot", "tn": 1000, "fp": 1000, "fn": 1000, "tp": 1000}


def test_ties_go_to_the_first_key(spark):
    df = spark.createDataFrame(
        [("rf", "Random Forest", 90.0, 80.0), ("lr", "Logistic", 70.0, 80.0), ("xgb", "X", 95.0, 10.0)],
        "model_key STRING, name STRING, accuracy DOUBLE, f1 DOUBLE",
    )
    best = evaluation.best_models(df).first()
    assert (best["best_accuracy"], best["best_f1"], best["best_model"]) == (95.0, 80.0, "Logistic")
    ranked = evaluation.leaderboard(df).orderBy("rank").collect()
    assert [r["model_key"] for r in ranked] == ["lr", "rf", "xgb"]
    zero = evaluation.best_models(df.withColumn("f1", F.lit(0.0))).first()
    assert (zero["best_key"], zero["best_model"]) == ("lr", "")


def test_best_of_compare(spark):
    rows = [(0, "lr", 90.0, 1), (0, "rf", 90.0, 2), (0, "xgb", 80.0, 3), (1, "rf", 60.0, 2)]
    df = spark.createDataFrame(rows, "msg_id LONG, model_key STRING, confidence DOUBLE, `order` INT")
    best = scoring.best_only(scoring.mark_best(df)).orderBy("msg_id").collect()
    assert [(r["msg_id"], r["model_key"], r["display_idx"]) for r in best] == [(0, "lr", 1), (1, "rf", 1)]


# ------------------------------------------------------------------ requests, replies
def test_requests(spark):
    bodies = [
        '{"text": " "}', '{"text": "hi", "model": "zz"}', '{"text": "hi", "model": null}',
        '{"text": "hi", "model": " RF "}', '{"text": 5}', '{"text": 0}', "[1]", "no json",
        '{"text": "hi", "model": {"a": 1}}', '{"text": "hi", "model": "   "}', '{"text": [1.5], "model": false}',
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "i INT, value STRING")
    out = scoring.validate_requests(scoring.parse_requests(df), ["lr"]).orderBy("i").collect()
    assert [r["status"] for r in out] == [400, 400, 200, 503, 500, 400, 500, 500, 500, 400, 500]
    assert out[2]["model"] == "lr"
    assert out[3]["error"].startswith('Model "rf" is not loaded.')
    assert out[4]["error"] == "'int' object has no attribute 'strip'"
    assert out[8]["error"] == "'dict' object has no attribute 'strip'"
    assert out[9]["error"] == "Unknown model key: "
    assert out[10]["error"] == "'list' object has no attribute 'strip'"


def test_length_check(spark):
    df = spark.createDataFrame([(0, "  "), (1, " ab "), (2, "abc"), (3, "x" * 501)], "i INT, t STRING")
    rows = df.select("i", scoring.check_length(F.col("t")).alias("e")).orderBy("i").collect()
    assert [r["e"] is None for r in rows] == [False, False, True, False]


def test_response_json(spark, sf):
    from tidings.plans.rules import rule_results

    df = rule_results(derived.labelled(spark, sf), keep=("text",)).limit(5)
    marked = df.withColumn("results", scoring.number_results(F.col("results")))
    for row in replies.to_response(marked).collect():
        body = json.loads(row["value"])
        assert body["text"] == row["text"]
        assert [r["model_key"] for r in body["results"]] == ["lr", "rf", "xgb", "cnn", "transformer"]
        assert sum("is_best" in r for r in body["results"]) == 1
    one = replies.prediction_reply(df.select(F.inline_outer("results"))).first()
    assert set(json.loads(one["value"])) == set(scoring.RECORD)
    empty = marked.select("text", F.filter("results", lambda r: F.lit(False)).alias("results"))
    assert "error" in json.loads(replies.to_response(empty).first()["value"])


# --------------------------------------------------------------------------- files
def test_quoted_tsv(spark, tmp_path):
    path = tmp_path / "sms.tsv"
    path.write_text('ham\tplain text\nspam\t"with ""quotes"" and\ttab"\n', encoding="utf-8")
    rows = messages.read_messages(spark, str(path)).orderBy("label").collect()
    assert [(r["label"], r["text"]) for r in rows] == [
        ("ham", "plain text"), ("spam", 'with "quotes" and\ttab'),
    ]


def test_ids_outlast_changes_of_files(spark, tmp_path):
    lines = [f"ham\tmessage {i % 150}" for i in range(200)] + ["spam\tsame"] * 100
    for name, parts in (("old", 1), ("new", 5)):
        (tmp_path / name).mkdir()
        for i in range(parts):
            (tmp_path / name / f"{name}{i}.tsv").write_text("\n".join(lines[i::parts]), encoding="utf-8")
    (tmp_path / "new" / "added.tsv").write_text("ham\tmessage 7\nham\tanother", encoding="utf-8")
    old, new = (
        splits.assign_split(messages.read_messages(spark, str(tmp_path / n))) for n in ("old", "new")
    )
    assert old.select("msg_id").distinct().count() == 300
    assert old.exceptAll(new).isEmpty()
    assert new.select("msg_id").distinct().count() == 302


def test_weights_need_both_classes(spark):
    with pytest.raises(ValueError):
        labelled.with_weights(spark.createDataFrame([(1,)], "label INT"), "scale_pos")


def test_compare_requests(spark):
    bodies = ['{"text": " "}', '{"text": "hi", "model": "zz"}', '{"text": "hi", "model": 5}', '{"text": 5}', "[1]"]
    df = spark.createDataFrame(list(enumerate(bodies)), "i INT, value STRING")
    parsed = scoring.parse_requests(df, for_model=False)
    for loaded, wanted in ((["rf"], [400, 200, 200, 500, 500]), ([], [400, 503, 503, 500, 500])):
        rows = scoring.validate_compare(parsed, loaded).orderBy("i").collect()
        assert [r["status"] for r in rows] == wanted


def test_pooling(spark):
    df = spark.createDataFrame([(1, [1.0, 5.0]), (1, [3.0, -1.0]), (2, None), (2, [0.0, 0.0])], "k INT, v ARRAY<DOUBLE>")
    for how, wanted in (("max", [3.0, 5.0, 0.0, 0.0]), ("mean", [2.0, 2.0, 0.0, 0.0])):
        rows = features.pool(df, "v", "k", how).orderBy("k", "dim").collect()
        assert [r["value"] for r in rows] == wanted


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_splits_on_disk(spark, tmp_path, fmt):
    df = spark.createDataFrame(
        [(0, 'a "b"\nc, d', 1, "test"), (1, "nan", 0, "test"), (2, "x", 0, "train")],
        "msg_id LONG, text STRING, label INT, split STRING",
    )
    path = str(tmp_path / "s")
    messages.write_splits(df, path, fmt)
    assert {"split=test", "split=train"} <= set(os.listdir(path))
    rows = messages.read_split(spark, path, "test", fmt).collect()
    assert [(r["msg_id"], r["text"], r["label"]) for r in rows] == [(0, 'a "b"\nc, d', 1)]


def test_first_existing_source(spark, tmp_path):
    clean = tmp_path / "test.csv"
    clean.write_text("text,label\nhello,0\nnan,1\n", encoding="utf-8")
    wanted = [(str(tmp_path / "raw.csv"), {"raw_text": "text"}), (str(clean), {})]
    assert [r["text"] for r in messages.read_first_existing(spark, wanted).collect()] == ["hello"]
    (tmp_path / "raw.csv").write_text("raw_text,label\nHello!,0\n", encoding="utf-8")
    assert [r["text"] for r in messages.read_first_existing(spark, wanted).collect()] == ["Hello!"]
    with pytest.raises(FileNotFoundError):
        messages.read_first_existing(spark, wanted[:0])


def test_metric_documents(spark, tmp_path):
    path = str(tmp_path / "m")
    default = spark.createDataFrame([], f"model_key STRING, {schemas.METRICS}")
    assert metrics.read_metrics(spark, path, default).count() == 0
    with pytest.raises(FileNotFoundError):
        metrics.read_metrics(spark, path)
    row = lambda key, f1: (key, key, key, "ML", 1, 1.0, 2.0, 3.0, f1, "#fff")
    schema = f"model_key STRING, {schemas.METRICS}"
    metrics.update_metrics(spark, spark.createDataFrame([row("a", 1.0), row("b", 2.0)], schema), path)
    metrics.update_metrics(spark, spark.createDataFrame([row("b", 9.0)], schema), path)
    got = {r["model_key"]: r["f1"] for r in metrics.read_metrics(spark, path).collect()}
    assert got == {"a": 1.0, "b": 9.0}
    files = [f for f in os.listdir(path) if f.startswith("part-")]
    document = json.loads("".join(open(os.path.join(path, f)).read() for f in files))
    assert set(document) == {"a", "b"}


def test_registry_and_artifacts(spark):
    status = scoring.model_status(schemas.registry(spark), artifacts.available(spark, {"lr": None, "rf": None}))
    states = {r["model_key"]: r["state"] for r in status.collect()}
    assert states == {k: "Ready" if k in ("lr", "rf") else "Missing" for k in fixed.COMPARE_ORDER}
    assert scoring.health(status).first()["loaded_models"] == ["lr", "rf"]
    assert artifacts.load_models(spark, {"lr": "/nowhere"}) == {}


# -------------------------------------------------------------------------- history
def _entries(spark, ids):
    return spark.createDataFrame(
        [(i, i % 2 == 0, 50.0, "LR", "m" * 200) for i in ids],
        "id LONG, is_spam BOOLEAN, confidence DOUBLE, model_name STRING, message STRING",
    ).withColumn("ts", F.timestamp_seconds("id"))


def test_history_is_bounded_and_idempotent(spark, tmp_path):
    path = str(tmp_path / "h")
    read = lambda i: sorted(r["id"] for r in spark.read.parquet(f"{path}/batch_id={i}").collect())
    history.update_history(_entries(spark, range(15)), 0, path)
    history.update_history(_entries(spark, range(15, 25)), 1, path)
    assert read(1) == list(range(5, 25))
    history.update_history(_entries(spark, range(15, 25)), 1, path)
    assert read(1) == list(range(5, 25))
    shown = history.render_history(spark.read.parquet(f"{path}/batch_id=1")).first()
    assert len(shown["message"]) == 120 and shown["shown"] == "m" * 70 + "…"


def test_padding_is_constant_length(spark, sf):
    from tidings.plans.queries import QUERIES

    widths = QUERIES["seq_v1"](spark, sf).select(F.size(F.split("ids", " ")).alias("n")).distinct().collect()
    assert [r["n"] for r in widths] == [fixed.MAXLEN]
    assert tokens.token_pattern(2).endswith("{2,}")


def test_history_over_batches(spark, tmp_path):
    from tidings.streaming import history

    path = str(tmp_path / "h")
    for i in range(4):
        batch = spark.range(i * 15, i * 15 + 15).selectExpr(
            "id", "timestamp_seconds(id) AS ts", "true AS is_spam", "1.0 AS confidence", "'lr' AS model_name", "'m' AS message"
        )
        history.update_history(batch, i, path)
    history.update_history(batch, 3, path)
    assert sorted(r.id for r in history.read_history(spark, path).collect()) == list(range(40, 60))
    assert len(list((tmp_path / "h").glob("batch_id=*"))) == 2
    with pytest.raises(FileNotFoundError):
        history.update_history(batch, 9, path)


def test_history_rows_are_cut_before_verdicts(spark, tmp_path):
    """A batch of a stream gives at most its newest rows on, so verdicts are worked out for these alone."""
    from tidings.streaming import history

    rows = spark.range(5000).selectExpr("id AS msg_id", "timestamp_seconds(id % 700) AS ts", "'x' AS text").coalesce(1)
    cut = history.cut_newest(rows, 20, id_col="msg_id")
    assert cut.schema == rows.schema and cut.count() == 20
    want = rows.orderBy(F.desc("ts"), F.desc("msg_id")).limit(20).collect()
    assert cut.orderBy(F.desc("ts"), F.desc("msg_id")).collect() == want
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    assert history.cut_newest(stream, 20, id_col="msg_id").isStreaming
