"""Indicator rules and keyword highlighting for flagged messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidings import fixed
from tidings.functions.text import escape_html


def _initials(words: list[str]) -> str:
    first = "".join(sorted({w[0] for w in words}))
    return first + first.upper()


def _rule(spec: list[str] | str) -> str:
    """Whole words in any case; the lookahead skips positions no word starts with."""
    if isinstance(spec, str):
        return spec
    return (
        f"(?=[{_initials(spec)}]){fixed.ASCII_START}(?i:{'|'.join(spec)}){fixed.ASCII_END}"
    )


def matched_indicators(text: Column) -> Column:
    """Labels of the rules that match, in rule order."""
    rules = [F.when(text.rlike(_rule(r)), F.lit(label)) for label, r in fixed.INDICATORS]
    return F.array_compact(F.array(*rules))


def indicator_count(text: Column) -> Column:
    hits = [text.rlike(_rule(r)).cast("int") for _, r in fixed.INDICATORS]
    return sum(hits[1:], hits[0])


def indicator_chips(text: Column, is_spam: Column) -> Column:
    """Explanation of a verdict: null for ham, a fallback when no rule matches."""
    chips = matched_indicators(text)
    fallback = F.array(F.lit(fixed.NO_INDICATOR))
    return F.when(is_spam, F.when(F.size(chips) == 0, fallback).otherwise(chips))


def highlight(text: Column) -> Column:
    """Escape, then wrap currency signs, long numbers and keywords.

    The three kinds cannot overlap, so one pass does what one pass per keyword
    would do.  A phrase whose last word is a keyword of its own never gets its
    chance, because that word has been wrapped before.
    """
    words = [w for w in fixed.HIGHLIGHTED if w.split()[-1] == w]
    pattern = (
        rf"(?=[£$0-9{_initials(words)}])([£$]|{fixed.ASCII_START}"
        rf"(?:[0-9]{{4,}}|(?i:{'|'.join(words)})){fixed.ASCII_END})"
    )
    wrapped = f"{fixed.HIGHLIGHT_OPEN}$1{fixed.HIGHLIGHT_CLOSE}"
    return F.regexp_replace(escape_html(text), pattern, wrapped)
