"""Learners, persistence and streams; models are fitted once."""

import pytest
from pyspark.sql import functions as F

from tidings.operators import classifiers, evaluation, features, labelled, scoring, splits
from tidings.plans.queries import _requests, _turn_stream
from tidings.sources import artifacts, derived
from tidings.streaming.scoring import score_stream

LARGER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def parts(spark):
    df = splits.assign_split(derived.labelled(spark, LARGER)).persist()
    yield {p: df.where(F.col("split") == p) for p in ("train", "val", "test")}
    df.unpersist()


@pytest.fixture(scope="module")
def models(parts):
    train = labelled.with_weights(parts["train"], "scale_pos")
    return classifiers.fit_models(
        train,
        {
            "lr": classifiers.lr_pipeline(),
            "rf": classifiers.rf_pipeline(),
            "xgb": classifiers.gbt_pipeline(5),
            "xgb_v2": classifiers.gbt_v2_pipeline(5),
            "cnn": classifiers.ngram_pipeline(),
            "lstm": classifiers.sequence_pipeline(),
            "transformer": classifiers.embed_pipeline(),
        },
    )


@pytest.fixture(scope="module")
def compared(parts, models):
    test = parts["test"].withColumnRenamed("label", "truth")
    return scoring.compare_all(test, models, ("msg_id", "truth", "text")).persist()


def test_models_beat_the_class_prior(compared):
    rows = scoring.long_results(compared, ("msg_id", "truth"))
    measured = {
        r["model_key"]: r
        for r in evaluation.metrics_from_confusion(evaluation.confusion(rows)).collect()
    }
    prior = 100 * (measured["lr"]["tn"] + measured["lr"]["fp"]) / 770
    for key in ("lr", "rf", "xgb", "xgb_v2", "cnn"):
        assert measured[key]["accuracy"] > prior, key
        assert measured[key]["f1"] > 0, key


def test_one_best_reply_per_message(compared):
    best = compared.select(F.size(F.filter("results", lambda r: r["is_best"])).alias("n"))
    assert [r["n"] for r in best.distinct().collect()] == [1]


def test_comparing_equals_scoring_one_by_one(parts, models, compared):
    for key in ("lr", "cnn", "transformer"):
        alone = scoring.predict(parts["test"], models[key], key)
        together = scoring.long_results(compared).where(F.col("model_key") == key)
        assert alone.exceptAll(together.select(alone.columns)).isEmpty()


def test_comparing_applies_each_stage_once(parts, models):
    plan = scoring.compare_all(parts["test"], models)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("AS clean_v1") == 1
    assert plan.count("AS ids_v1") <= 2  # looked up, then padded


def test_comparing_reads_messages_once_without_shuffle(spark, parts, models, tmp_path):
    parts["test"].write.parquet(str(tmp_path / "t"))
    out = scoring.compare_all(spark.read.parquet(str(tmp_path / "t")), models)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert "Exchange" not in plan


def test_shared_stages_are_fitted_once(models):
    stages = {k: [s.uid for s in m.stages[:-1]] for k, m in models.items()}
    assert stages["lr"] == stages["rf"] == stages["xgb"]


def test_artifacts_round_trip(spark, parts, models, tmp_path):
    paths = {}
    for key in ("lr", "cnn", "transformer"):
        paths[key] = str(tmp_path / key)
        artifacts.save_model(models[key], paths[key])
    loaded = artifacts.load_models(spark, {**paths, "lstm": str(tmp_path / "lstm")})
    assert set(loaded) == set(paths)
    for key, model in loaded.items():
        before = scoring.predict(parts["val"], models[key], key)
        after = scoring.predict(parts["val"], model, key)
        assert before.exceptAll(after).isEmpty()


def test_early_stopping(parts):
    flagged = parts["train"].unionByName(parts["val"]).withColumn("held_out", F.col("split") == "val")
    flagged = labelled.with_weights(flagged, "scale_pos")
    pipeline = classifiers.gbt_v2_pipeline(12, validation_col="held_out", patience=2)
    model = classifiers.fit_models(flagged, {"xgb_v2": pipeline})["xgb_v2"].stages[-1]
    assert 1 <= model.getNumTrees <= 12


def test_balancing_repeats_the_smaller_class(parts):
    counts = {
        r["label"]: r["count"]
        for r in classifiers.balance(parts["train"]).groupBy("label").count().collect()
    }
    assert abs(counts[1] - counts[0]) < 0.05 * counts[0]
    before = parts["train"].where("label = 0").count()
    assert counts[0] == before


def test_balancing_leaves_vocabularies_alone(parts):
    train = parts["train"].where("label = 1 OR msg_id % 2 = 0")
    words = []
    for balanced in ((), ("tf_v2",)):
        classifiers.sequence_stages.cache_clear()
        model = classifiers.fit_models(
            train, {"tf_v2": classifiers.embed_pipeline(dim=4, version=2, max_iter=2, key="tf_v2")}, balanced
        )["tf_v2"]
        words.append(model.stages[1].getOrDefault("words"))
    assert words[0] == words[1]


def test_logistic_penalty_counts_rows(parts, models):
    weights = models["lr"].stages[-1]
    assert weights.getRegParam() == pytest.approx(1 / parts["train"].count())


def test_tfidf_vectors_have_unit_length(parts, models):
    feats = parts["val"]
    for stage in models["lr"].stages[:-1]:
        feats = stage.transform(feats)
    norms = features.vector_entries(feats, "tfidf_v1").groupBy("msg_id").agg(F.sum(F.col("weight") ** 2).alias("n"))
    low, high = norms.agg(F.min("n"), F.max("n")).first()
    assert low == pytest.approx(1) and high == pytest.approx(1)


def test_stream_equals_batch_and_replays(spark, sf, models, tmp_path):
    loaded = {k: models[k] for k in ("lr", "rf")}
    out = {n: str(tmp_path / n) for n in ("ok", "bad", "check1", "check2")}
    for check in ("check1", "check2"):
        score_stream(
            _requests(_turn_stream(spark, sf)), loaded, out["ok"], out["bad"], out[check]
        ).awaitTermination()
        scored = spark.read.parquet(out["ok"]).drop("batch_id")
        rejected = spark.read.parquet(out["bad"]).drop("batch_id")
        batch = scoring.validate_requests(
            scoring.parse_requests(_requests(derived.sms(spark, sf))), list(loaded)
        )
        expected = scoring.predict_requests(batch.where("status = 200"), loaded)
        assert scored.exceptAll(expected).isEmpty() and scored.count() == expected.count()
        refused = batch.where("status <> 200").select("msg_id", "status", "error")
        assert rejected.exceptAll(refused).isEmpty() and rejected.count() == refused.count()


def test_word_vectors_train_on_all_partitions(spark):
    vectors = [x for x in classifiers.embed_pipeline().getStages() if hasattr(x, "getNumPartitions")]
    assert [x.getNumPartitions() for x in vectors] == [max(2, spark.sparkContext.defaultParallelism)]


def test_pipelines_are_fitted_side_by_side_and_share_stages(spark, monkeypatch):
    from threading import Barrier

    rows = spark.createDataFrame([(i, "win cash now" if i % 2 else "see you soon", i % 2) for i in range(40)], "msg_id long, text string, label int")
    both, fits = Barrier(2, timeout=60), []
    vectorizer = classifiers.TfidfVectorizer
    once = vectorizer._fit
    monkeypatch.setattr(vectorizer, "_fit", lambda self, df: fits.append(self.uid) or both.wait() and None or once(self, df))
    stages = [classifiers.normalizer(1), classifiers.WordTokenizer(inputCol="clean_v1", outputCol="t")]
    made = [vectorizer(inputCol="t", outputCol=f"f{i}") for i in range(2)]
    learner = classifiers.RegularizedLogistic
    pipelines = {
        key: classifiers.Pipeline(stages=[*stages, made[i], learner(featuresCol=f"f{i}", prefix=key)])
        for key, i in (("a", 0), ("b", 1), ("c", 0))
    }
    # a stage waits until another pipeline's stage is being fitted too
    models = classifiers.fit_models(rows, pipelines)
    assert sorted(fits) == sorted(x.uid for x in made) and set(models) == {"a", "b", "c"}
    assert models["a"].stages[2] is models["c"].stages[2]


def test_many_rows_of_one_split_are_dealt(spark, monkeypatch):
    rows = spark.range(600).select(F.col("id").alias("msg_id")).coalesce(1)
    assert classifiers._dealt(rows)[0] is rows
    monkeypatch.setattr(classifiers, "DEAL_ROWS", 300)
    got, dealt = classifiers._dealt(rows)
    assert dealt and got.rdd.getNumPartitions() == 2 and got.distinct().count() == 600
    got.unpersist()
