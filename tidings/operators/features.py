"""Feature stages: fitted on the training part, applied row by row.

Estimators here fit with DataFrame jobs and return models made of built-in
stages where those exist, so the fitted pipelines run and persist in the JVM.
Applying them never shuffles: the bounded vocabulary travels with the plan.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings import fixed
from tidings.functions.lookup import literal_lookup
from tidings.functions.text import clean_v1, preprocess_v2
from tidings.functions.tokens import ngrams, pad, sequence_words, tokens
from tidings.operators.vocabulary import fit_vocab, fit_word_index, frequent_phrases


# Parts a word's uses are spread over when they meet a large word index.
SALTS = 16
# Words of an index that may travel with a plan.
MOST_INLINE = 100_000


class _Stage(HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Input and output column plus default persistence."""


def _int_param(name: str, doc: str) -> Param:
    return Param(Params._dummy(), name, doc, TypeConverters.toInt)


class TextNormalizer(Transformer, _Stage):
    """Raw text to normalised text of version 1 or 2."""

    version = _int_param("version", "1 deletes symbols, 2 keeps signals as words")

    @keyword_only
    def __init__(self, *, inputCol: str = "text", outputCol: str = "clean", version: int = 1):
        super().__init__()
        self._setDefault(inputCol="text", outputCol="clean", version=1)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        normal = clean_v1 if self.getOrDefault(self.version) == 1 else preprocess_v2
        return df.withColumn(self.getOutputCol(), normal(F.col(self.getInputCol())))


class WordTokenizer(Transformer, _Stage):
    """Words of at least ``minChars`` characters, optionally joined to n-grams."""

    minChars = _int_param("minChars", "shortest word kept")
    maxN = _int_param("maxN", "longest run of words")

    @keyword_only
    def __init__(self, *, inputCol="clean", outputCol="tokens", minChars=2, maxN=1):
        super().__init__()
        self._setDefault(inputCol="clean", outputCol="tokens", minChars=2, maxN=1)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        out = self.getOutputCol()
        df = df.withColumn(out, tokens(F.col(self.getInputCol()), self.getOrDefault(self.minChars)))
        if self.getOrDefault(self.maxN) > 1:
            df = df.withColumn(out, ngrams(F.col(out), 1, self.getOrDefault(self.maxN)))
        return df


class TfidfVectorizer(Estimator, _Stage):
    """Capped vocabulary, smoothed idf plus one, unit rows.

    The fitted model chains three built-in stages, with terms indexed
    alphabetically.
    """

    maxFeatures = _int_param("maxFeatures", "number of terms kept")
    minDf = _int_param("minDf", "fewest messages a term occurs in")
    maxDf = Param(Params._dummy(), "maxDf", "largest share of messages", TypeConverters.toFloat)

    @keyword_only
    def __init__(
        self,
        *,
        inputCol="tokens",
        outputCol="features",
        maxFeatures=fixed.TFIDF_FEATURES,
        minDf=1,
        maxDf=1.0,
    ):
        super().__init__()
        self._setDefault(
            inputCol="tokens", outputCol="features", maxFeatures=fixed.TFIDF_FEATURES,
            minDf=1, maxDf=1.0,
        )
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> PipelineModel:
        source, out = self.getInputCol(), self.getOutputCol()
        words = df.select(F.lit(0).alias("msg_id"), F.col(source).alias("tokens"))
        vocab = fit_vocab(
            words,
            self.getOrDefault(self.maxFeatures),
            self.getOrDefault(self.minDf),
            self.getOrDefault(self.maxDf),
        )
        n = df.agg(F.count("*")).scalar()
        idf = F.log((n + 1) / (F.col("df") + 1)) + 1
        rows = vocab.select("term", "idx", idf.alias("idf")).orderBy("idx").collect()
        counter = CountVectorizerModel.from_vocabulary(
            [r["term"] for r in rows], inputCol=source, outputCol=f"{out}_counts"
        )
        scaler = ElementwiseProduct(
            scalingVec=Vectors.dense([r["idf"] for r in rows]),
            inputCol=f"{out}_counts",
            outputCol=f"{out}_scaled",
        )
        unit = Normalizer(p=2.0, inputCol=f"{out}_scaled", outputCol=out)
        return PipelineModel([counter, scaler, unit])


class _SequenceParams(_Stage):
    numWords = _int_param("numWords", "ids stay below this number")
    maxLen = _int_param("maxLen", "length of every id array")
    oov = _int_param("oov", "1 when unknown words map to id 1, 0 when they are dropped")
    side = Param(Params._dummy(), "side", "side cut and padded", TypeConverters.toString)
    filters = Param(Params._dummy(), "filters", "punctuation", TypeConverters.toString)


class SequenceVectorizer(Estimator, _SequenceParams):
    """Text to padded word ids; ids follow use in the training part.

    ``idCol`` orders messages for ties between words of equal use.
    """

    idCol = Param(Params._dummy(), "idCol", "message order", TypeConverters.toString)

    @keyword_only
    def __init__(
        self,
        *,
        inputCol="clean",
        outputCol="ids",
        idCol="msg_id",
        numWords=fixed.NUM_WORDS,
        maxLen=fixed.MAXLEN,
        side="pre",
        filters=fixed.SEQUENCE_FILTERS,
        oov=0,
    ):
        super().__init__()
        self._setDefault(
            inputCol="clean", outputCol="ids", idCol="msg_id", numWords=fixed.NUM_WORDS, maxLen=fixed.MAXLEN, side="pre",
            filters=fixed.SEQUENCE_FILTERS, oov=0,
        )
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> SequenceModel:
        words = df.select(
            F.col(self.getOrDefault(self.idCol)).alias("msg_id"),
            sequence_words(F.col(self.getInputCol()), self.getOrDefault(self.filters)).alias("words"),
        )
        index = fit_word_index(
            words, self.getOrDefault(self.numWords), bool(self.getOrDefault(self.oov))
        )
        model = SequenceModel()
        self._copyValues(model)
        return model._set(words=[r["word"] for r in index.orderBy("idx").collect()])


class SequenceModel(Model, _SequenceParams):
    """Fitted word index; the n-th word has id n, or n + 1 with an OOV id."""

    words = Param(Params._dummy(), "words", "words in id order", TypeConverters.toListString)

    def __init__(self) -> None:
        super().__init__()

    def _transform(self, df: DataFrame) -> DataFrame:
        oov = self.getOrDefault(self.oov)
        index = {w: i for i, w in enumerate(self.getOrDefault(self.words), start=1 + oov)}
        words = sequence_words(F.col(self.getInputCol()), self.getOrDefault(self.filters))
        out = self.getOutputCol()
        df = df.withColumn(out, known_ids(words, index, 1 if oov else None))
        return df.withColumn(
            out, pad(F.col(out), self.getOrDefault(self.maxLen), self.getOrDefault(self.side))
        )


class IdsToWords(Transformer, _Stage):
    """Non-padding ids as words, for learners that read word arrays."""

    maxN = _int_param("maxN", "longest run of words")

    @keyword_only
    def __init__(self, *, inputCol="ids", outputCol="words", maxN=1):
        super().__init__()
        self._setDefault(inputCol="ids", outputCol="words", maxN=1)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        out = self.getOutputCol()
        kept = F.array_remove(F.col(self.getInputCol()), 0).cast("array<string>")
        df = df.withColumn(out, kept)
        if self.getOrDefault(self.maxN) > 1:
            df = df.withColumn(out, ngrams(F.col(out), 1, self.getOrDefault(self.maxN)))
        return df


class PhraseVectorizer(Estimator, _Stage):
    """Which of the frequent phrases of the training part a message has.

    Phrases are mined level by level; the ``maxPhrases`` most used ones are kept,
    ties going to the alphabetically first.
    """

    longest = _int_param("longest", "words of the longest phrase")
    least = _int_param("least", "fewest uses of a phrase")
    maxPhrases = _int_param("maxPhrases", "phrases kept")

    @keyword_only
    def __init__(self, *, inputCol="words", outputCol="phrases_seen", longest=5, least=2, maxPhrases=20_000):
        super().__init__()
        self._setDefault(inputCol="words", outputCol="phrases_seen", longest=5, least=2, maxPhrases=20_000)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> PipelineModel:
        source, out, longest = self.getInputCol(), self.getOutputCol(), self.getOrDefault(self.longest)
        found = frequent_phrases(df, longest, self.getOrDefault(self.least), source)
        kept = found.orderBy(F.desc("n"), "phrase").limit(self.getOrDefault(self.maxPhrases))
        names = sorted(r["phrase"] for r in kept.select("phrase").collect())
        runs = WordRuns(inputCol=source, outputCol=f"{out}_runs", maxN=longest)
        counter = CountVectorizerModel.from_vocabulary(names or [""], inputCol=f"{out}_runs", outputCol=out)
        return PipelineModel([runs, counter.setBinary(True)])


class WordRuns(Transformer, _Stage):
    """Words to runs of 1 to ``maxN`` words."""

    maxN = _int_param("maxN", "longest run of words")

    @keyword_only
    def __init__(self, *, inputCol="words", outputCol="runs", maxN=1):
        super().__init__()
        self._setDefault(inputCol="words", outputCol="runs", maxN=1)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOutputCol(), ngrams(F.col(self.getInputCol()), 1, self.getOrDefault(self.maxN)))


def known_ids(words: Column, index: dict[str, int], oov: int | None) -> Column:
    """Ids of a word array, in order, inside the row."""
    look_up = literal_lookup(index, "int")
    if oov is None:
        return F.array_compact(F.transform(words, look_up))
    return F.transform(words, lambda w: F.coalesce(look_up(w), F.lit(oov)))


def to_ids(
    df: DataFrame,
    word_index: DataFrame,
    oov: int | None = None,
    words: str = "words",
    id_col: str = "msg_id",
    join: bool = False,
    most: int = MOST_INLINE,
) -> DataFrame:
    """Word arrays to id arrays in word order: the input plus ``ids``.

    The word index is looked up inside each row, or joined on request, for an
    index too large for a plan: one of more than ``most`` words is refused without it.
    Both give the same ids, and null for null words.
    The join is salted, since a few words make up much of any text.
    """
    if not join:
        rows = word_index.select("word", "idx").limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"the word index has more than {most} words: join it")
        index = {r["word"]: r["idx"] for r in rows}
        return df.withColumn("ids", known_ids(F.col(words), index, oov))
    placed = df.select(id_col, F.posexplode(words).alias("pos", "word"))
    salt = F.pmod(F.xxhash64(id_col, "pos"), F.lit(SALTS))
    copies = word_index.select("word", "idx", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    joined = placed.withColumn("salt", salt).join(
        copies.withColumn("salt", F.col("salt").cast("long")), ["word", "salt"], "left"
    )
    if oov is None:
        joined = joined.where(F.col("idx").isNotNull())
    ids = joined.groupBy(id_col).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", F.coalesce("idx", F.lit(oov)).alias("idx")))),
            lambda p: p["idx"],
        ).alias("ids")
    )
    empty = F.array().cast("array<int>")
    return df.join(ids, id_col, "left").withColumn(
        "ids", F.when(F.col(words).isNotNull(), F.coalesce("ids", empty))
    )


def pool(df: DataFrame, vector: str, by: str, how: str = "max") -> DataFrame:
    """Largest (``max``) or average (``mean``) value of each dimension over a group's vectors.

    ``by, dim, value``.  Values combine on the map side, so a group with most of
    the vectors is one row a dimension and task.
    """
    combine = {"max": F.max, "mean": F.avg}[how]
    values = df.select(by, F.posexplode(vector).alias("dim", "value"))
    return values.groupBy(by, F.col("dim").cast("long").alias("dim")).agg(
        combine(F.col("value").cast("double")).alias("value")
    )


def vector_entries(df: DataFrame, vector: str, id_col: str = "msg_id") -> DataFrame:
    """Non-zero entries of a sparse vector column: msg_id, idx, weight."""
    parts = F.unwrap_udt(F.col(vector))
    pairs = F.arrays_zip(parts["indices"].alias("idx"), parts["values"].alias("weight"))
    return df.select(F.col(id_col).alias("msg_id"), F.inline(pairs))
