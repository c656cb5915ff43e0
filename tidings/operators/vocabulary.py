"""Vocabularies: one shuffle with map-side combining, then a bounded top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidings import fixed
from tidings.functions.tokens import ngrams
from tidings.session import enable_checkpoints


def _exploded(df: DataFrame, id_col: str, tokens: str) -> DataFrame:
    """Every use of a word, followed by each distinct word once more.

    The distinct part keeps the order of first use.  Both parts share one shuffle,
    whose map side already combines equal words, so frequent words cost no more
    than rare ones.
    """
    words = df.select(F.col(id_col).alias("msg_id"), F.col(tokens).alias("words"))
    return words.select(
        "msg_id",
        F.size("words").alias("used"),
        F.posexplode(F.concat("words", F.array_distinct("words"))).alias("pos", "term"),
    ).select("msg_id", "term", "pos", (F.col("pos") >= F.col("used")).alias("first"))


def term_counts(df: DataFrame, tokens: str = "tokens", id_col: str = "msg_id") -> DataFrame:
    """Uses of each term and the number of messages it occurs in."""
    return (
        _exploded(df, id_col, tokens)
        .groupBy("term")
        .agg(F.count_if(~F.col("first")).alias("tf"), F.count_if("first").alias("df"))
    )


def fit_vocab(
    df: DataFrame,
    max_features: int,
    min_df: int = 1,
    max_df: float = 1.0,
    tokens: str = "tokens",
    id_col: str = "msg_id",
) -> DataFrame:
    """The most frequent terms, indexed alphabetically: term, idx, tf, df.

    Document frequency filters apply before the cap; ties at the cap go to the
    alphabetically first term.
    """
    counts = term_counts(df, tokens, id_col)
    if min_df > 1:
        counts = counts.where(F.col("df") >= min_df)
    if max_df < 1.0:
        messages = df.agg(F.count("*")).scalar()
        counts = counts.where(F.col("df") <= F.lit(max_df) * messages)
    kept = counts.orderBy(F.desc("tf"), "term").limit(max_features)
    place = F.row_number().over(Window.orderBy("term"))
    return kept.select("term", (place - 1).alias("idx"), "tf", "df")


def fit_word_index(
    df: DataFrame,
    num_words: int = fixed.NUM_WORDS,
    oov: bool = False,
    words: str = "words",
    id_col: str = "msg_id",
) -> DataFrame:
    """Word ids by falling use, ties by first appearance: word, idx, n.

    Ids start at 1 and stay below ``num_words``; with an out-of-vocabulary word
    that one takes id 1 and is not listed.
    """
    first_id = 2 if oov else 1
    # min_by over the first use in each message keeps the aggregate hash-based.
    counts = (
        _exploded(df, id_col, words)
        .groupBy("term")
        .agg(
            F.count_if(~F.col("first")).alias("n"),
            F.min(F.when(F.col("first"), F.col("msg_id"))).alias("seen_in"),
            F.min_by("pos", F.when(F.col("first"), F.col("msg_id"))).alias("seen_at"),
        )
    )
    by_use = [F.desc("n"), F.asc("seen_in"), F.asc("seen_at")]
    kept = counts.orderBy(*by_use).limit(num_words - first_id)
    place = F.row_number().over(Window.orderBy(*by_use))
    return kept.select(F.col("term").alias("word"), (place + (first_id - 1)).alias("idx"), "n")


def frequent_phrases(df: DataFrame, longest: int, least: int, words: str = "words") -> DataFrame:
    """Runs of 1 to ``longest`` words that are used at least ``least`` times: phrase, length, n.

    Mined level by level: a run only counts if both runs a word shorter, without
    its first and without its last word, are frequent.  What cannot be frequent is
    left out before the shuffle, where equal runs combine on the map side.  Words
    must not hold blanks.
    """
    enable_checkpoints(df.sparkSession)
    rows = df.select(words).persist()
    found = level = None
    try:
        for n in range(1, longest + 1):
            runs = rows.select(F.explode(ngrams(F.col(words), n, n)).alias("phrase"))
            if level is not None:
                known = level.select(F.col("phrase").alias("shorter"))
                head = F.substring_index("phrase", " ", n - 1)
                tail = F.substring_index("phrase", " ", 1 - n)
                runs = runs.join(known, head == F.col("shorter"), "left_semi")
                runs = runs.join(known, tail == F.col("shorter"), "left_semi")
            # the next level reads this one twice
            level = runs.groupBy("phrase").agg(F.count("*").alias("n")).where(F.col("n") >= least).checkpoint()
            found = level if found is None else found.union(level)
    finally:
        rows.unpersist()
    return found.select("phrase", F.size(F.split("phrase", " ")).alias("length"), "n")
