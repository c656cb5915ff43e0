"""Text normalisation: Column to Column, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidings import fixed
from tidings.functions.entities import html_unescape
from tidings.functions.scores import round2

__all__ = [
    "clean_v1", "preprocess_v2", "html_unescape", "strip", "coerce_text", "blank_guard",
    "collapse_space", "replace_urls", "replace_money", "replace_phones",
    "replace_punctuation", "replace_numbers", "blank_symbols", "escape_html",
    "preview", "utf16_length", "length_tier", "model_key", "percent", "clock",
]


def coerce_text(text: Column) -> Column:
    """Missing text becomes the word ``nan``."""
    return F.coalesce(text.cast("string"), F.lit("nan"))


def clean_v1(text: Column) -> Column:
    """Lower case, then delete everything but a-z, 0-9 and white space."""
    return F.regexp_replace(F.lower(coerce_text(text)), fixed.V1_DROPPED, "")


def strip(text: Column) -> Column:
    """Trim Unicode white space on both sides."""
    return F.btrim(text, F.lit(fixed.SPACE_CHARS))


def blank_guard(text: Column) -> Column:
    """Null and blank text become the empty string."""
    return F.coalesce(text.cast("string"), F.lit(""))


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"[{fixed.SPACE}]+", " "))


def replace_urls(text: Column) -> Column:
    return F.regexp_replace(text, fixed.URL, fixed.TOKENS["url"])


def replace_money(text: Column) -> Column:
    return F.regexp_replace(text, fixed.MONEY, fixed.TOKENS["money"])


def replace_phones(text: Column) -> Column:
    return F.regexp_replace(text, fixed.PHONE, fixed.TOKENS["phone"])


def replace_punctuation(text: Column) -> Column:
    """Bursts of ``!`` first, then each single one, then bursts of ``?``."""
    text = F.regexp_replace(text, fixed.MULTI_EXCLAM, fixed.TOKENS["multi_exclam"])
    text = F.replace(text, F.lit(fixed.EXCLAM), F.lit(fixed.TOKENS["exclam"]))
    return F.regexp_replace(text, fixed.MULTI_QUESTION, fixed.TOKENS["multi_question"])


def replace_numbers(text: Column) -> Column:
    return F.regexp_replace(text, fixed.NUMBER, fixed.TOKENS["number"])


def blank_symbols(text: Column) -> Column:
    """Lower case; symbols and white space between words become one space."""
    return F.trim(F.regexp_replace(F.lower(text), fixed.V2_BLANKED, " "))


def preprocess_v2(text: Column) -> Column:
    """Normalise while keeping signals as ``tok_*`` words; the order matters."""
    text = collapse_space(html_unescape(blank_guard(text)))
    text = replace_phones(replace_money(replace_urls(text)))
    return blank_symbols(replace_numbers(replace_punctuation(text)))


def escape_html(text: Column) -> Column:
    for raw, escaped in fixed.HTML_ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def preview(text: Column, n: int, ellipsis: bool = True) -> Column:
    """The first n UTF-16 units, marked when something was cut; no pair is parted."""
    units = F.encode(text, "UTF-16BE")
    parted = F.hex(F.substring(units, 2 * n - 1, 1)).between("D8", "DB")
    head = F.when(parted, F.substring(units, 1, 2 * n - 2)).otherwise(F.substring(units, 1, 2 * n))
    cut = F.when(utf16_length(text) > n, F.decode(head, "UTF-16BE")).otherwise(text)
    if ellipsis:
        cut = F.when(utf16_length(text) > n, F.concat(cut, F.lit(fixed.ELLIPSIS))).otherwise(cut)
    return cut


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, the way a browser counts characters."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def length_tier(text: Column) -> Column:
    tier = F.lit(fixed.LENGTH_TIER_DEFAULT)
    for limit, name in reversed(fixed.LENGTH_TIERS):
        tier = F.when(utf16_length(text) > limit, F.lit(name)).otherwise(tier)
    return tier


def model_key(model: Column) -> Column:
    """Requested model, the default when missing, trimmed and lower-cased."""
    chosen = F.coalesce(F.nullif(model, F.lit("")), F.lit(fixed.DEFAULT_MODEL))
    return F.lower(strip(chosen))


def percent(value: Column) -> Column:
    return F.format_string("%.2f%%", round2(value))


def clock(ts: Column) -> Column:
    return F.date_format(ts, fixed.CLOCK)
