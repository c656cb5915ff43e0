"""An order-aware learner: which word follows which, in each class.

For each class the chance of a word after another one is how often the pair was seen,
smoothed by ``PAIR_PRIOR`` uses in proportion to the word's own chance in the class; that
is smoothed by ``WORD_PRIOR`` uses in proportion to its share in both.  So a word or pair
that says little about the class weighs little, whichever class has more rows.  A message's score is the logarithm of the ratio of
both classes' chances, plus that of their priors.

This score is a sum over words and over neighbouring pairs, so the fitted model is a
count vector and a linear model, both of the JVM: scoring a message is a projection.
"""

from __future__ import annotations

import math
import uuid

from pyspark import keyword_only
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Marks a word as one that something follows; words are numbers here.
AFTER = ">"
WORD_PRIOR = 1000.0
PAIR_PRIOR = 1000.0


def transition_counts(df: DataFrame, words: str = "words", label: str = "label") -> DataFrame:
    """``prev, word, n0, n1``: pairs of neighbours in messages of both classes, by one aggregate.

    The first word of a message follows the empty word.  Counts combine on the
    map side, so a pair of every message is one row a task.
    """
    w = F.col(words)
    pairs = F.transform(w, lambda x, i: F.struct(F.when(i > 0, F.get(w, i - 1)).otherwise("").alias("prev"), x.alias("word")))
    rows = df.select(F.col(label).alias("label"), F.inline(pairs))
    return rows.groupBy("prev", "word").agg(
        F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1")
    )


def transition_features(words: Column) -> Column:
    """The words, the words that are followed, and the pairs."""
    n = F.size(words)
    followed = F.transform(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), lambda x: F.concat(x, F.lit(AFTER)))
    pairs = F.zip_with(
        F.slice(words, 1, F.greatest(n - 1, F.lit(0))),
        F.slice(words, 2, F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.concat_ws(AFTER, a, b),
    )
    return F.concat(words, followed, pairs)


class TransitionFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Words of a message to what the linear model counts."""

    @keyword_only
    def __init__(self, *, inputCol="words", outputCol="transitions"):
        super().__init__()
        self._setDefault(inputCol="words", outputCol="transitions")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOutputCol(), transition_features(F.col(self.getInputCol())))


class TransitionClassifier(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Fits the count vector and the linear model from counts of both classes.

    All words and the ``maxPairs`` most used pairs become entries; a pair beyond
    them scores as one that was never seen.
    """

    featuresCol = Param(Params._dummy(), "featuresCol", "transition features", TypeConverters.toString)
    prefix = Param(Params._dummy(), "prefix", "output column prefix", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label", TypeConverters.toString)
    maxPairs = Param(Params._dummy(), "maxPairs", "pairs kept", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="transitions", labelCol="label", prefix="lstm", maxPairs=50_000):
        super().__init__()
        self._setDefault(featuresCol="transitions", labelCol="label", prefix="lstm", maxPairs=50_000)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> PipelineModel:
        source, label, prefix = (self.getOrDefault(p) for p in (self.featuresCol, self.labelCol, self.prefix))
        of = [F.count_if(F.col("label") == c).alias(f"n{c}") for c in (0, 1)]
        terms = df.select(F.col(label).alias("label"), F.explode(source).alias("t")).groupBy("t").agg(*of).persist()
        try:
            counts, followed = _bounded(terms, self.getOrDefault(self.maxPairs))
        finally:
            terms.unpersist()
        classes = df.select(F.col(label).alias("label")).agg(*of).first()
        names = sorted(counts)
        weights, intercept = linear_weights(names, counts, followed, (classes["n0"], classes["n1"]))
        vector = f"{prefix}_counts"
        counter = CountVectorizerModel.from_vocabulary(names, inputCol=source, outputCol=vector)
        return PipelineModel([counter, linear_model(weights, intercept, vector, prefix)])


def _bounded(terms: DataFrame, most: int) -> tuple[dict[str, tuple], dict[str, tuple]]:
    """Counts of all words and the most used pairs, and how often each word is followed, by class.

    The word index bounds the words, and with them all but the pairs.
    """
    is_pair = F.col("t").contains(AFTER) & ~F.col("t").endswith(AFTER)
    pairs = terms.where(is_pair)
    first = F.substring_index("t", AFTER, 1).alias("w")
    after = pairs.groupBy(first).agg(F.sum("n0"), F.sum("n1"))
    kept = pairs.orderBy(F.desc(F.col("n0") + F.col("n1")), "t").limit(most)
    counts = {r["t"]: (r["n0"], r["n1"]) for r in terms.where(~is_pair).union(kept).collect()}
    return counts, {r[0]: (r[1], r[2]) for r in after.collect()}


def linear_weights(
    names: list[str], counts: dict[str, tuple], followed: dict[str, tuple], classes: tuple[int, int]
) -> tuple[list[float], float]:
    """A weight for every entry, and the intercept.

    With u the logarithm of the ratio of the words' own chances and b that of what
    the pairs after a word leave, a word weighs u, a word that is followed b, and a
    pair what it says beyond both.
    """
    words = [x for x in names if AFTER not in x]
    total = [sum(counts[w][c] for w in words) for c in (0, 1)]

    def own(word: str, c: int) -> float:
        share = sum(counts[word]) / max(sum(total), 1)
        return (counts[word][c] + WORD_PRIOR * share) / (total[c] + WORD_PRIOR)

    def left(word: str, c: int) -> float:
        return PAIR_PRIOR / (followed.get(word, (0, 0))[c] + PAIR_PRIOR)

    def weight(name: str) -> float:
        first, mark, second = name.partition(AFTER)
        if not mark:
            return math.log(own(name, 1) / own(name, 0))
        if not second:
            return math.log(left(first, 1) / left(first, 0))
        beyond = [1 + counts[name][c] / (PAIR_PRIOR * own(second, c)) for c in (0, 1)]
        return math.log(beyond[1] / beyond[0])

    return [weight(x) for x in names], math.log((classes[1] + 1) / (classes[0] + 1))


def linear_model(weights: list[float], intercept: float, features: str, prefix: str) -> LogisticRegressionModel:
    """A logistic model of the JVM with given weights."""
    spark = SparkSession.active()
    vector = _py2java(spark.sparkContext, Vectors.sparse(len(weights), {i: w for i, w in enumerate(weights) if w}))
    uid = f"LinearWeights_{uuid.uuid4().hex[:12]}"
    model = LogisticRegressionModel(
        spark._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(uid, vector, float(intercept))
    )
    return model._set(
        featuresCol=features,
        predictionCol=f"{prefix}_prediction",
        probabilityCol=f"{prefix}_probability",
        rawPredictionCol=f"{prefix}_raw",
    )
