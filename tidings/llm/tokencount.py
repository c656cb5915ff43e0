"""Token counts with a unigram vocabulary, shared over common prefixes.

Texts are cut into pre-tokens (words behind a word mark).  The distinct pre-tokens
that a task has not met yet are put in order, which is a depth-first walk of their
trie: the best score of each prefix is computed once and kept while the walk stays
below it.  Each word's node stores its token count (and score); a document's count is
the sum over its words.

The vocabulary is a SentencePiece file.  Its pieces are in order of rank, and a piece
gets the logarithm of Zipf's probability for its rank, so nothing is trained.  Best
means the highest total, of equal totals the fewest tokens; a character that no piece
covers costs one token a byte, each at ``BYTE_SCORE``.

Defined results: a null or blank text has no tokens; repeated rows and null ids are
counted each by itself; an empty table gives an empty result.  There is no shuffle;
the table of words is bounded and starts anew when full.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidings.llm.common import Numbers, documents, narrow, small_batches

MARK = "▁"
BYTE_SCORE = -25.0
MOST_WORDS = 300_000


def piece_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def zipf_scores(path: str) -> dict[str, float]:
    """Score of each ordinary piece: Zipf's law over the ranks in the file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]
    total = math.log(sum(1 / (rank + 2) for rank in range(len(pieces))))
    return {piece: -math.log(rank + 2) - total for rank, piece in enumerate(pieces)}


class PrefixCounts:
    """Token counts of words by forward scores over a vocabulary."""

    def __init__(self, scores: dict[str, float], most: int = MOST_WORDS) -> None:
        self.most, self.numbers = most, Numbers()
        # trie of the vocabulary: children and score of each node
        self.children: list[dict[str, int]] = [{}]
        self.scores: list[float | None] = [None]
        for piece, score in scores.items():
            node = 0
            for c in piece:
                below = self.children[node].setdefault(c, len(self.children))
                if below == len(self.children):
                    self.children.append({})
                    self.scores.append(None)
                node = below
            self.scores[node] = score
        self._clear()

    def _clear(self) -> None:
        self.numbers.forget()
        self.tokens, self.totals = np.zeros(0, np.int64), np.zeros(0)

    def learn(self, words: list[str]) -> tuple[list[int], list[float]]:
        """Token counts and scores of words; prefixes they share are computed once."""
        children, scores = self.children, self.scores
        tokens_of, score_of = [0] * len(words), [0.0] * len(words)
        # of each prefix of the word in hand: best score, minus its tokens, and
        # the vocabulary nodes that pieces begun before lead to, with their starts
        best: list[tuple[float, int]] = [(0.0, 0)]
        active: list[list[tuple[int, int]]] = [[]]
        before = ""
        for word, number in sorted(zip(words, range(len(words)))):
            text = MARK + word
            shared = len(commonprefix((text, before)))
            del best[shared + 1 :], active[shared + 1 :]
            for at in range(shared, len(text)):
                c = text[at]
                top, single, reached = None, False, []
                for node, start in [*active[at], (0, at)]:
                    node = children[node].get(c)
                    if node is not None:
                        reached.append((node, start))
                        value = scores[node]
                        if value is not None:
                            score, tokens = best[start]
                            found = (score + value, tokens - 1)
                            if top is None or found > top:
                                top = found
                            single = single or start == at
                if not single:  # no piece for this character: its bytes
                    score, tokens = best[at]
                    width = len(c.encode("utf-8", "replace"))
                    found = (score + BYTE_SCORE * width, tokens - width)
                    if top is None or found > top:
                        top = found
                best.append(top)
                active.append(reached)
            before = text
            score_of[number], tokens = best[-1]
            tokens_of[number] = -tokens
        return tokens_of, score_of

    def count(self, texts: list[bytes]) -> tuple[list[int], list[int], list[float]]:
        """Pre-tokens, tokens and score of each text."""
        if len(self.numbers) > self.most:
            self._clear()
        at = [self.numbers.of(t.split()) for t in texts]
        if new := self.numbers.new:
            tokens, scores = self.learn([w.decode("utf-8", "replace") for w in new])
            self.tokens, self.totals = np.r_[self.tokens, tokens], np.r_[self.totals, scores]
            self.numbers.new = []
        return (
            [len(x) for x in at],
            [int(self.tokens[x].sum()) for x in at],
            [math.fsum(self.totals[x]) for x in at],
        )


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None
) -> DataFrame:
    """``id, n_words, n_tokens, score`` for every row."""
    rows, path = narrow(docs, id_col, text_col), vocabulary or piece_vocabulary()
    schema = T.StructType(
        [
            T.StructField("id", rows.schema["id"].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = PrefixCounts(zipf_scores(path))
        for batch in small_batches(batches, 512):
            words, tokens, scores = counts.count(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array(scores, pa.float64())],
                names=schema.names,
            )

    return rows.mapInArrow(run, schema)


def op5_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
