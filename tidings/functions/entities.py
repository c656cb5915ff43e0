"""HTML character references, decoded with the HTML5 rules by native expressions."""

from __future__ import annotations

import html
import json
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidings.functions.lookup import literal_lookup

REPLACEMENT = chr(0xFFFD)
# Code points whose reference does not stand for itself all lie below this one,
# apart from surrogates and noncharacters.
_FIRST_REGULAR = 160
_DECIMAL = "&#([0-9]+);?"
_HEX = "&#[xX]([0-9a-fA-F]+);?"
_NAMED = r"&([^\t\n\f <&#;]{1,32};?)"
_PIECE = f"{_DECIMAL}|{_HEX}|{_NAMED}|[^&]+|&"


@cache
def _legacy_prefix() -> str:
    """Names that may stand without a semicolon, longest first."""
    names = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)
    return f"^(?:{'|'.join(names)})"


def _code_point(piece: Column) -> Column:
    """Digits to a code point; anything out of range becomes one past the last."""

    def number(pattern: str, base: int, too_long: int) -> Column:
        significant = F.ltrim(F.regexp_extract(piece, pattern, 1), F.lit("0"))
        value = F.conv(F.concat(F.lit("0"), significant), base, 10).cast("long")
        return F.when(F.length(significant) >= too_long, F.lit(0x110000)).otherwise(value)

    is_hex = piece.rlike("^&#[xX]")
    return F.when(is_hex, number(_HEX, 16, 7)).otherwise(number(_DECIMAL, 10, 8))


def _character(point: Column) -> Column:
    spellings = [html.unescape(f"&#{i};") for i in range(_FIRST_REGULAR)]
    low = F.from_json(F.lit(json.dumps(spellings)), "array<string>")
    spelled = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
    nonchar = point.between(0xFDD0, 0xFDEF) | (point.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    return (
        F.when(point < _FIRST_REGULAR, F.get(low, point.cast("int")))
        .when(point.between(0xD800, 0xDFFF) | (point > 0x10FFFF), F.lit(REPLACEMENT))
        .when(nonchar, F.lit(""))
        .otherwise(spelled)
    )


def html_unescape(text: Column) -> Column:
    """Replace named and numeric character references.

    Text without an ampersand is passed through.  Other text is cut into
    references and the stretches between them; a name that is not in the table
    is tried by its longest legacy prefix.
    """
    names = literal_lookup(html5, "string")

    def piece_value(piece: Column) -> Column:
        name = F.substring(piece, 2, 40)
        prefix = F.regexp_extract(name, _legacy_prefix(), 0)
        named = F.coalesce(
            names(name),
            F.when(
                prefix != "",
                F.concat(names(prefix), F.substr(name, F.length(prefix) + 1)),
            ),
            piece,
        )
        return (
            F.when(~piece.startswith("&") | (piece == "&"), piece)
            .when(piece.rlike("^&#[0-9xX]"), _character(_code_point(piece)))
            .otherwise(named)
        )

    pieces = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))
    decoded = F.array_join(F.transform(pieces, piece_value), "")
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)
