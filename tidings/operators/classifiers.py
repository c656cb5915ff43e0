"""Classifiers as ML pipelines that start from raw text."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from concurrent.futures import Future, ThreadPoolExecutor
from functools import cache
from threading import Lock

from pyspark import inheritable_thread_target, keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tidings import fixed
from tidings.operators.boosting import HistogramBoosting
from tidings.operators.features import (
    IdsToWords,
    PhraseVectorizer,
    SequenceVectorizer,
    TextNormalizer,
    TfidfVectorizer,
    WordTokenizer,
)
from tidings.operators.labelled import class_weights
from tidings.operators.transitions import TransitionClassifier, TransitionFeatures
from tidings.operators.wordvectors import WordVectors
from tidings.session import enable_checkpoints

# Phrases of the n-gram detector, and how often one must be used to become one.
PHRASES = 20_000
PHRASE_USES = 2
# Fewer rows than these are not worth a task of their own.
DEAL_ROWS = 16_384


class RegularizedLogistic(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Logistic regression with an L2 penalty given as inverse strength C.

    The penalty per row is ``1 / (C n)``, so n is counted when fitting.
    """

    C = Param(Params._dummy(), "C", "inverse penalty", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "iterations", TypeConverters.toInt)
    featuresCol = Param(Params._dummy(), "featuresCol", "features", TypeConverters.toString)
    prefix = Param(Params._dummy(), "prefix", "output column prefix", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol="features", prefix="", C=1.0, maxIter=200):
        super().__init__()
        self._setDefault(featuresCol="features", prefix="", C=1.0, maxIter=200)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        rows = df.count()
        learner = LogisticRegression(
            maxIter=self.getOrDefault(self.maxIter),
            regParam=1.0 / (self.getOrDefault(self.C) * max(rows, 1)),
            elasticNetParam=0.0,
            standardization=False,
            featuresCol=self.getOrDefault(self.featuresCol),
            **_outputs(self.getOrDefault(self.prefix)),
        )
        return learner.fit(df)


def _outputs(prefix: str) -> dict[str, str]:
    start = f"{prefix}_" if prefix else ""
    return {
        "predictionCol": f"{start}prediction",
        "probabilityCol": f"{start}probability",
        "rawPredictionCol": f"{start}raw",
    }


@cache
def normalizer(version: int) -> TextNormalizer:
    """The stage that all pipelines of a version start with."""
    return TextNormalizer(outputCol=f"clean_v{version}", version=version)


@cache
def tfidf_stages(version: int = 1) -> tuple:
    """Raw text to TF-IDF rows.  Pipelines share these very stages."""
    clean, words, out = f"clean_v{version}", f"tokens_v{version}", f"tfidf_v{version}"
    v2 = version == 2
    return (
        normalizer(version),
        WordTokenizer(
            inputCol=clean, outputCol=words, minChars=1 if v2 else 2, maxN=2 if v2 else 1
        ),
        TfidfVectorizer(
            inputCol=words,
            outputCol=out,
            maxFeatures=fixed.TFIDF_FEATURES_V2 if v2 else fixed.TFIDF_FEATURES,
            minDf=fixed.MIN_DF_V2 if v2 else 1,
            maxDf=fixed.MAX_DF_V2 if v2 else 1.0,
        ),
    )


@cache
def sequence_stages(version: int = 1) -> tuple:
    """Raw text to padded word ids."""
    clean, out = f"clean_v{version}", f"ids_v{version}"
    if version == 2:
        ids = SequenceVectorizer(
            inputCol=clean, outputCol=out, maxLen=fixed.MAXLEN_V2, side="post",
            filters=fixed.SEQUENCE_FILTERS_V2, oov=1,
        )
    else:
        ids = SequenceVectorizer(inputCol=clean, outputCol=out)
    return normalizer(version), ids


def lr_pipeline(max_iter: int = 200, key: str = "lr") -> Pipeline:
    """Logistic regression on TF-IDF."""
    learner = RegularizedLogistic(featuresCol="tfidf_v1", prefix=key, maxIter=max_iter)
    return Pipeline(stages=[*tfidf_stages(1), learner])


def rf_pipeline(trees: int = 50, depth: int = 30, seed: int = 42, key: str = "rf") -> Pipeline:
    """Random forest on TF-IDF; 30 is the greatest depth the engine allows.

    Bagging is seeded per partition, so another partitioning gives another forest.
    """
    learner = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt",
        featuresCol="tfidf_v1", **_outputs(key),
    )
    return Pipeline(stages=[*tfidf_stages(1), learner])


def gbt_pipeline(max_iter: int = 100, key: str = "xgb") -> Pipeline:
    """Boosted trees on TF-IDF."""
    learner = HistogramBoosting(featuresCol="tfidf_v1", prefix=key, rounds=max_iter, depth=6, rate=0.3)
    return Pipeline(stages=[*tfidf_stages(1), learner])


def gbt_v2_pipeline(
    max_iter: int = 250,
    weight_col: str | None = "w",
    validation_col: str | None = None,
    patience: int = 20,
    key: str = "xgb_v2",
) -> Pipeline:
    """Boosted trees on signal-keeping uni- and bigrams, positives weighted.

    With a validation column, boosting ends when the loss of rows flagged there has
    not fallen for ``patience`` rounds, and the rounds up to the best one stay.
    """
    learner = HistogramBoosting(
        featuresCol="tfidf_v2", prefix=key, rounds=max_iter, depth=5, rate=0.06, rowShare=0.85,
        columnShare=0.85, weightCol=weight_col or "", heldCol=validation_col or "", patience=patience,
    )
    return Pipeline(stages=[*tfidf_stages(2), learner])


def ngram_pipeline(n: int = 5, key: str = "cnn") -> Pipeline:
    """Detector of phrases of up to n words inside the padded window, from a mined vocabulary."""
    return Pipeline(
        stages=[
            *sequence_stages(1),
            IdsToWords(inputCol="ids_v1", outputCol="words_v1"),
            PhraseVectorizer(inputCol="words_v1", outputCol="phrases_seen", longest=n),
            RegularizedLogistic(featuresCol="phrases_seen", prefix=key),
        ]
    )


def sequence_pipeline(key: str = "lstm", pairs: int = 50_000) -> Pipeline:
    """Which word follows which, in each class, inside the padded window."""
    return Pipeline(
        stages=[
            *sequence_stages(1),
            IdsToWords(inputCol="ids_v1", outputCol="words_v1"),
            TransitionFeatures(inputCol="words_v1", outputCol="transitions"),
            TransitionClassifier(featuresCol="transitions", prefix=key, maxPairs=pairs),
        ]
    )


#: Word vectors take so many passes; they train on all partitions at once and are averaged
#: after each pass.
VECTOR_PASSES = 10


def embed_pipeline(
    dim: int = 32,
    hidden: int = 32,
    version: int = 1,
    max_iter: int = 100,
    key: str = "transformer",
    passes: int = VECTOR_PASSES,
    partitions: int | None = None,
) -> Pipeline:
    """Word vectors, mean pooling over words that are not padding, dense head.

    Word vectors take ``passes`` over the messages on ``partitions`` partitions, all of
    which train at once; by default as many as the cluster runs tasks.
    """
    partitions = partitions or max(2, SparkSession.active().sparkContext.defaultParallelism)
    words, vector = f"words_v{version}", f"embedding_v{version}"
    return Pipeline(
        stages=[
            *sequence_stages(version),
            IdsToWords(inputCol=f"ids_v{version}", outputCol=words),
            WordVectors(
                inputCol=words, outputCol=vector, vectorSize=dim, minCount=1,
                seed=fixed.SPLIT_SEED, numPartitions=partitions, maxIter=passes,
            ),
            MultilayerPerceptronClassifier(
                layers=[dim, hidden, 2], seed=42, maxIter=max_iter, featuresCol=vector,
                **_outputs(key),
            ),
        ]
    )


def balance(df: DataFrame, label: str = "label", id_col: str = "msg_id") -> DataFrame:
    """Repeat rows of the smaller class, for learners without a weight column.

    A row is repeated by its class weight against the largest class; the
    fraction is settled by a hash of the id, so the result is reproducible.
    """
    weights = {r["label"]: r["n"] for r in class_weights(df, label).collect()}
    if not weights:
        raise ValueError("no labelled row to balance")
    largest = max(weights.values())
    times = F.lit(1.0)
    for cls, n in weights.items():
        times = F.when(F.col(label) == cls, F.lit(largest / n)).otherwise(times)
    chance = F.pmod(F.xxhash64(id_col), F.lit(10_000)) / 10_000
    whole = F.floor(times).cast("int")
    copies = whole + (chance < times - whole).cast("int")
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_copy")


def _stages(model: Model) -> list:
    """A fitted learner's stages; most have one."""
    return model.stages if isinstance(model, PipelineModel) else [model]


def fit_models(
    train: DataFrame,
    pipelines: Mapping[str, Pipeline],
    balanced: Iterable[str] = (),
    parallelism: int = 8,
    partitions: int | None = None,
) -> dict[str, PipelineModel]:
    """Fit several pipelines, each shared feature stage only once.

    Learners named in ``balanced`` see rows of the smaller class repeated; their
    vocabularies are still those of the table as it is.

    Normalised texts, which stages and learners read again and again, and the featurised
    rows are kept on executors while they run, and recomputed from the table if an executor is lost.  Pipelines do not
    depend on each other but for the stages they share, so several run at a time; one that
    needs a stage waits for the first to fit it.  Many rows in few splits are dealt
    to the cluster's tasks by id before anything is fitted.  ``partitions`` merges the
    featurised rows to at most so many, which suits small tables; by default they
    stay as they are read or dealt.
    """
    enable_checkpoints(train.sparkSession)
    stages: dict[str, Future] = {}
    frames: dict[tuple[str, ...], DataFrame] = {}
    texts: dict[tuple[str, bool], DataFrame] = {}
    lock = Lock()

    def fitted(stage, df: DataFrame):
        with lock:
            first = stage.uid not in stages
            found = stages.setdefault(stage.uid, Future())
        if first:
            try:
                found.set_result(stage.fit(df) if isinstance(stage, Estimator) else stage)
            except BaseException as error:
                found.set_exception(error)
        return found.result()

    def fit(key: str, pipeline: Pipeline) -> PipelineModel:
        df, done = train, []
        *features, learner = pipeline.getStages()
        for at, stage in enumerate(features):
            done.append(fitted(stage, df))
            df = done[-1].transform(df)
            if isinstance(stage, TextNormalizer):
                raw = any("text" == s.getOrDefault("inputCol") for s in features[at + 1 :] if s.hasParam("inputCol"))
                with lock:
                    kept = df if raw else df.drop("text")
                    df = texts.setdefault((stage.uid, raw), kept)
                    if df is kept:
                        df.persist(StorageLevel.MEMORY_AND_DISK)
        path = tuple(s.uid for s in features)
        with lock:
            if path not in frames:
                needed = [*train.columns, learner.getOrDefault("featuresCol")]
                frames[path] = df.select(
                    *[c for c in needed if c not in ("text", "split")]
                ).persist(StorageLevel.MEMORY_AND_DISK)
        rows = frames[path].coalesce(partitions) if partitions else frames[path]
        return PipelineModel([*done, *_stages(learner.fit(balance(rows) if key in balanced else rows))])

    train, dealt = _dealt(train)
    try:
        in_session = inheritable_thread_target(train.sparkSession)
        with ThreadPoolExecutor(max_workers=parallelism) as pool:
            running = {key: pool.submit(in_session(fit), key, pipeline) for key, pipeline in pipelines.items()}
            return {k: run.result() for k, run in running.items()}
    finally:
        for frame in [*frames.values(), *texts.values()]:
            frame.unpersist()
        if dealt:
            train.unpersist()


def _dealt(df: DataFrame, id_col: str = "msg_id") -> tuple[DataFrame, bool]:
    """Rows of few splits on as many partitions as the cluster runs tasks, but ``DEAL_ROWS`` or more on each.

    Learners read their rows hundreds of times; the splits of a small file would leave most of the cluster idle.
    """
    # a file has more splits than parts that can be read apart
    sizes = [n for _, n in df.groupBy(F.spark_partition_id()).count().collect()]
    tasks = min(df.sparkSession.sparkContext.defaultParallelism, sum(sizes) // DEAL_ROWS)
    if tasks <= len(sizes):
        return df, False
    by = [id_col] if id_col in df.columns else []
    return df.repartition(tasks, *by).persist(StorageLevel.MEMORY_AND_DISK), True
