"""Tokens, n-grams, padded id arrays, masks and positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidings import fixed


def token_pattern(min_chars: int) -> str:
    """Maximal runs of word characters of at least the given length."""
    return f"[{fixed.WORD}]{{{min_chars},}}"


def tokens(text: Column, min_chars: int = 2) -> Column:
    """Lower-cased words, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(token_pattern(min_chars)), F.lit(0))


def sequence_words(text: Column, filters: str = fixed.SEQUENCE_FILTERS) -> Column:
    """Lower case, listed punctuation to spaces, cut at single spaces."""
    spaced = F.translate(F.lower(text), filters, " " * len(filters))
    return F.array_remove(F.split(spaced, " "), "")


def ngrams(words: Column, lo: int, hi: int) -> Column:
    """Space-joined runs of lo..hi words, shorter runs first.

    Give it a materialised column: the words are read once per run.
    """

    def runs(n: int) -> Column:
        if n == 1:
            return words
        starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
        joined = F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, joined).otherwise(F.array().cast("array<string>"))

    return F.concat(*[runs(n) for n in range(lo, hi + 1)])


def pad(ids: Column, maxlen: int, side: str = "pre") -> Column:
    """Cut and zero-fill to one length, both on the same side."""
    zeros = F.array_repeat(F.lit(0), F.greatest(F.lit(maxlen) - F.size(ids), F.lit(0)))
    if side == "pre":
        kept = F.slice(ids, F.greatest(F.size(ids) - (maxlen - 1), F.lit(1)), maxlen)
        return F.concat(zeros, kept)
    return F.concat(F.slice(ids, 1, maxlen), zeros)


def pad_mask(ids: Column) -> Column:
    """True where an id is not padding."""
    return F.transform(ids, lambda i: i != 0)


def positions(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))
