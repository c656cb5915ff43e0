"""Main text of a page by the distribution of text over line blocks.

Markup is stripped to lines: every block element starts a line, scripts, styles,
comments and the head leave nothing.  Lines inside menus, headers, footers,
sidebars, forms, notices, adverts and reader comments (by element, role, class or
id) carry text of length zero, as does the text of links that make up most of a
line.  The length of a block is the sum over ``BLOCK`` successive lines.  A segment ends
where that falls to zero, and where a marked container (article, main) starts or ends.
A segment where it surges to the threshold is main text, all of its lines, short ones too.
A container is a hint: lines inside count ``HINT`` times.  Where no segment surges, in
containers or on a page without them, the longest is kept.  Segments too short to surge
go with a kept neighbour in the same parent element or container.

Defined results: a null or empty page gives an empty text; broken markup is read as
far as it goes, unclosed elements end with their parent; repeated rows are extracted
each by itself; an empty table gives an empty result; pages are read whole.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidings.llm.common import small_batches, text_or_empty

BLOCK = 3
SURGE = 80
HINT = 2

TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL
)
#: elements whose content is raw text up to their end tag
RAW = set("script style textarea title iframe".split())
#: elements with content that is not shown
HIDDEN = set("head noscript template svg foreignobject select object".split())
#: what a head may hold; anything else ends it
IN_HEAD = set("base basefont bgsound link meta noscript script style template title".split())
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.IGNORECASE)
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table"
    " tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = set("nav aside footer form menu dialog button select".split())
ASIDE_ROLES = set("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
# whole words of class and id values
ASIDE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar"
    " navigation breadcrumb breadcrumbs sidebar aside widget footer header masthead cookie cookies consent notice"
    " alert popup modal newsletter subscribe signup login share sharing social related recommended comment comments"
    " disqus reply replies respond pagination pager toolbar search form disclaimer".split()
)
MAIN = {"article", "main"}
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE)


_BODY = re.compile(r"<body(?=[\s/>])", re.IGNORECASE)
_RAW_END = {x: _end_of(x) for x in RAW}
_RAW_START = {x: re.compile(rf"<{x}(?=[\s/>])", re.IGNORECASE) for x in RAW}


def _is_aside(name: str, attributes: str, in_main: bool) -> bool:
    if name in ASIDE or (name == "header" and not in_main):
        return True
    if not attributes:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if key == "role" and value in ASIDE_ROLES:
            return True
        if key in ("class", "id") and name not in MAIN and name not in ("body", "html"):
            if ASIDE_WORDS & set(_WORDS.findall(value)):
                return True
    return False


def lines(page: str) -> list[tuple[str, int, int, set[int]]]:
    """``(text, weight, main, homes)`` of each line; weight zero for boilerplate.

    Homes are the numbers of the parent element and of the containers around it.
    """
    found: list[tuple[str, int, int, set[int]]] = []
    stack: list[tuple[str, int, int, int]] = []  # name; aside, main and hidden depth before
    numbers: list[int] = []  # of the elements in the stack
    n_elements = 0
    aside = main = hidden = 0
    words: list[str] = []
    linked = 0
    in_link = 0
    at = 0

    def close() -> None:
        nonlocal words, linked
        text = _SPACE.sub(" ", entities.unescape("".join(words))).strip()
        if text:
            weight = 0 if aside or (linked * 2 > len(text) and not main) else len(text)
            homes = set(numbers[-2:-1])
            for i in range(len(stack) if main else 0):
                if (stack[i + 1][2] if i + 1 < len(stack) else main) > stack[i][2]:
                    homes.add(numbers[i])
            found.append((text, weight, main, homes))
        words, linked = [], 0

    def push(name: str) -> None:
        nonlocal n_elements
        n_elements += 1
        stack.append((name, aside, main, hidden))
        numbers.append(n_elements)

    def pop(i: int = -1) -> None:
        nonlocal aside, main, hidden
        _, aside, main, hidden = stack[i]
        del stack[i:], numbers[i:]

    def add(text: str) -> None:
        nonlocal linked
        if stack and stack[-1][0] == "head" and not text.isspace():
            pop()
        if not hidden:
            words.append(text)
            if in_link:
                linked += len(text)

    def after_raw(name: str, closed: bool) -> int:
        """Where a raw element ends: at its end tag, else with its parent."""
        end = _RAW_END[name].search(page, at)
        if closed:  # taken at its word unless an end tag follows that is its own
            again = _RAW_START[name].search(page, at)
            if not end or (again and again.start() < end.start()):
                return at
        if end:
            return end.end()
        for parent, *_ in reversed(stack):
            if end := _end_of(parent).search(page, at):
                return end.start()
        body = _BODY.search(page, at) if stack and stack[-1][0] == "head" else None
        return body.start() if body else len(page)

    while m := TAG.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if not m[1] and stack:
            over = stack[-1][0]
            # flow content ends a head; blocks end a drawing and an open choice
            if (over == "head" and name not in IN_HEAD) or (over in ("svg", "select") and name in BLOCKS and name != "hr"):
                pop()
        if name in RAW:
            if not m[1]:
                at = after_raw(name, m[3].endswith("/"))
                if not hidden:
                    words.append(" ")
            continue
        if name == "br":
            add(" ")
            continue
        if name == "a":
            in_link = 0 if m[1] else 1
            continue
        if name in BLOCKS and not hidden:
            close()
        elif name in HIDDEN and not hidden:
            words.append(" ")
        if name in VOID or m[3].endswith("/"):
            continue
        if not m[1]:
            if name in BLOCKS:
                if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and stack and stack[-1][0] == name:
                    pop()
                push(name)
                aside += _is_aside(name, m[3], main > 0)
                main += name in MAIN or 'role="main"' in m[3]
            elif name in HIDDEN:
                push(name)
                hidden += 1
        elif name in BLOCKS or name in HIDDEN:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if hidden and not stack[i][3] and name in BLOCKS:
                        close()
                    pop(i)
                    break
            if name in BLOCKS:
                in_link = 0
    if at < len(page):
        add(page[at:])
    close()
    return found


def segments(rows: list[tuple[str, int, int, set[int]]]) -> list[list[int]]:
    """Lines with text of each segment: up to a dive or to a container's border."""
    found: list[list[int]] = []
    for i, (_, weight, main, _) in enumerate(rows):
        if not weight:
            continue
        if not found or i - found[-1][-1] > BLOCK or (main > 0) != (rows[found[-1][-1]][2] > 0):
            found.append([])
        found[-1].append(i)
    return found


def main_text(page: str) -> str:
    rows = lines(page)
    parts = segments(rows)
    weights = [w * (HINT if m else 1) for _, w, m, _ in rows]
    inside = [rows[part[0]][2] > 0 for part in parts]
    homes = [set().union(*(rows[i][3] for i in part)) for part in parts]
    kept = [
        any(sum(weights[k] for k in part[j : j + BLOCK] if k < i + BLOCK) >= SURGE for j, i in enumerate(part))
        for part in parts
    ]
    # something of a container and of a page is always main text
    for those in ([k for k, x in enumerate(inside) if x], range(len(parts))):
        if those and not any(kept[k] for k in those):
            kept[max(those, key=lambda k: sum(weights[i] for i in parts[k]))] = True
    for order in (range(1, len(parts)), range(len(parts) - 2, -1, -1)):
        back = 1 if order.step < 0 else -1
        for k in order:
            if kept[k + back] and inside[k] == inside[k + back] and homes[k] & homes[k + back]:
                kept[k] = True
    return "\n".join(rows[i][0] for part, keep in zip(parts, kept) if keep for i in part)


def extracted(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """``id, url, text`` for every row; no shuffle."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), text_or_empty(html_col).alias("body"))
    schema = T.StructType([rows.schema["id"], rows.schema["url"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = [main_text(x).encode("utf-8", "replace").decode() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def op7_line_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return rows.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
