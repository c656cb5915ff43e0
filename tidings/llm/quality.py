"""Quality rules: divergence of a document's histograms from its language's reference.

Everything is column expressions: no Python runs on the executors.

A document has two histograms: its characters by class, and its words, as written, by the
common words of its language (all others in one bin).  The reference of a language
holds the same histograms summed over the corpus' documents of at least
``MIN_WORDS`` words.  Documents whose Jensen-Shannon distance (base 2, 0 to 1) from
the reference is too large are rejected; the word histogram only counts from
``MIN_WORDS_FOR_COMMON`` words on.

Defined results: a null or blank text has no words, fails the base rules and is not
kept; null and unlisted languages share one reference of character classes and have no
common words; very long texts are measured whole; repeated rows are judged
each by itself; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.llm.common import BLANKS, WORD, documents, stored, text_or_empty

MIN_WORDS = 50
MAX_REPEATED = 50  # percent of the words
MIN_WORDS_FOR_COMMON = 100
MAX_CLASS_DISTANCE = 0.3
MAX_COMMON_DISTANCE = 0.265

#: Frequent function words of each language; every list has the same length.
COMMON = {
    "en": (
        "the of and to in is that it for on with be was as are this by at from or have an not you but his they which"
        " he she her we all their there been has will would more one if about when who what so can"
    ).split(),
    "de": (
        "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat"
        " dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder kann"
    ).split(),
    "fr": (
        "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou mais"
        " comme cette ces ses elle son aux nous vous été leur on même tout fait être deux dont sans"
    ).split(),
    "es": (
        "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin"
        " sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta desde"
    ).split(),
}
OTHER = "other"
_WIDTH = len(COMMON["en"])
SYMBOLS = "#*$%&|<>"
_CLASSES = ["lower", "upper", "digit", "blank", "symbol", "rest"]


def _removed(text: str, pattern: str) -> Column:
    """Characters that the pattern takes away."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def _histograms(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``df`` with ``_n_words``, ``_lang``, ``_classes`` and ``_common`` (arrays of long)."""
    df = df.withColumn("_text", text_or_empty(text_col))
    lang = F.col(lang_col).cast("string")
    # what is no small letter is short
    df = df.withColumns(
        {
            "_words": F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)),
            "_few": F.regexp_replace("_text", r"\p{Ll}+", ""),
            "_lang": F.when(lang.isin(*COMMON), lang).otherwise(F.lit(OTHER)),
        }
    )
    df = df.withColumns(
        {
            "_n_words": F.size("_words").cast("long"),
            "_n_symbols": (F.length("_few") - F.length(F.translate("_few", SYMBOLS, ""))).cast("long"),
            "_blank": _removed("_few", BLANKS + "+"),
            "_upper": _removed("_few", r"\p{Lu}+"),
            "_digits": _removed("_few", r"\p{N}+"),
            "_size": F.length("_text").cast("long"),
        }
    )
    df = df.withColumn("_word_chars", F.col("_size") - F.col("_blank"))
    lists = reduce(
        lambda rest, item: F.when(F.col("_lang") == item[0], F.lit(",".join(item[1]))).otherwise(rest),
        COMMON.items(),
        F.lit(None).cast("string"),
    )
    df = df.withColumn("_list", lists)
    # each word's place in the list, 0 for others; words are taken as they are written
    df = df.withColumn("_places", F.transform("_words", lambda w: F.find_in_set(w, F.col("_list"))))
    times = [(F.size("_places") - F.size(F.array_remove("_places", i))).cast("long") for i in range(1, _WIDTH + 1)]

    known = [F.col("_size") - F.length("_few"), *map(F.col, ("_upper", "_digits", "_blank", "_n_symbols"))]
    counts = [*known, F.col("_size") - reduce(add, known)]
    return df.withColumns(
        {
            "_classes": F.array(*[c.cast("long") for c in counts]),
            "_common": F.when(
                F.col("_lang") != OTHER, F.array(*times, (F.size("_places") - F.size(F.array_remove("_places", 0))).cast("long"))
            ),
        }
    )


def references(measures: DataFrame) -> DataFrame:
    """``_lang, _class_ref, _common_ref``: summed histograms, a row per listed language and one for others.

    Sums combine on the map side, so a language that makes up most rows is one row a task.
    """
    rows = measures.where(F.col("_n_words") >= MIN_WORDS)

    def sums(column: str, width: int) -> Column:
        return F.array(*[F.sum(F.get(column, F.lit(i))) for i in range(width)])

    return rows.groupBy("_lang").agg(
        sums("_classes", len(_CLASSES)).alias("_class_ref"), sums("_common", _WIDTH + 1).alias("_common_ref")
    )


def _total(x: str) -> Column:
    return F.aggregate(x, F.lit(0).cast("long"), add)


def with_js_distance(df: DataFrame, name: str, p: str, q: str) -> DataFrame:
    """``df`` with the square root of the Jensen-Shannon divergence (base 2) of two count arrays; null if one is empty."""

    def terms(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    # totals as columns of their own, so that they are not added up again for every bin
    df = df.withColumns({"_p_total": _total(p), "_q_total": _total(q)})
    pairs = F.zip_with(
        p,
        q,
        lambda x, y: (terms(x / F.col("_p_total"), y / F.col("_q_total")) + terms(y / F.col("_q_total"), x / F.col("_p_total"))) / 2,
    )
    found = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)
    some = (F.col("_p_total") > 0) & (F.col("_q_total") > 0)
    return df.withColumn(name, F.when(some, F.sqrt(F.greatest(found, F.lit(0.0))))).drop("_p_total", "_q_total")


_MEASURES = [
    "_lang", "_n_words", "_word_chars", "_n_symbols", "_n_dup_lines", "_n_repeat_words", "_base_failed", "_classes", "_common",
]


def measured(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """``_row`` with the columns ``keep`` (all) of ``docs``, and its measures.

    The measures leave a generator of one row as one value, so no filter on them
    is pushed below and repeats their expressions.
    """
    row = F.struct(*[F.col(c) for c in (docs.columns if keep is None else keep)])
    df = docs.select(row.alias("_row"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    df = _histograms(df, "text", "lang")
    n = F.col("_n_words")
    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    window = F.transform(
        "_words", lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2))
    )
    df = df.withColumns({"_lines": lines, "_windows": F.slice(window, F.lit(1), F.greatest(n - 2, F.lit(0)).cast("int"))})
    df = df.withColumns(
        {
            "_n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_repeats": F.size("_windows") > F.size(F.array_distinct("_windows")),
        }
    )
    # windows in order of value; those that equal a neighbour occur twice or more
    df = df.withColumn(
        "_sorted",
        F.when(
            F.col("_repeats"),
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )

    def at(k: Column) -> Column:
        return F.get("_sorted", k)["h"]

    twice = F.filter("_sorted", lambda s, k: (s["h"] == at(k - 1)).eqNullSafe(True) | (s["h"] == at(k + 1)).eqNullSafe(True))
    df = df.withColumn("_twice", F.transform(twice, lambda s: s["i"]))
    covered = F.array_distinct(F.flatten(F.transform("_twice", lambda i: F.array(i, i + 1, i + 2))))
    df = df.withColumn("_n_repeat_words", F.coalesce(F.size(covered), F.lit(0)).cast("long"))
    df = df.withColumn("_n_repeat_words", F.when(F.col("_repeats"), F.col("_n_repeat_words")).otherwise(F.lit(0).cast("long")))
    df = df.withColumn("_base_failed", (n < MIN_WORDS) | (100 * F.col("_n_repeat_words") > MAX_REPEATED * n))
    return df.select("_row", F.inline_outer(F.array(F.struct(*_MEASURES))))


def judged(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    reference: DataFrame | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` (all) of ``docs`` with ``_``-prefixed measures and ``_kept``.

    No row is lost and texts are not shuffled.  Measures are computed once: rows
    and measures are stored in the shared folder, the reference is learned from
    there unless one is given.  A column with the name of a measure gives way to it.
    """
    df = measured(docs, text_col, lang_col, keep)
    if reference is None:
        df = stored(df, "measures")
        reference = references(df)
    # one row for each listed language and one for the others: safe to broadcast
    df = df.join(F.broadcast(reference), "_lang", "left")
    df = with_js_distance(df, "_class_distance", "_classes", "_class_ref")
    df = with_js_distance(df, "_common_distance", "_common", "_common_ref")
    df = df.withColumn(
        "_common_distance", F.when(F.col("_n_words") >= MIN_WORDS_FOR_COMMON, F.col("_common_distance"))
    )
    near = (F.coalesce("_class_distance", F.lit(0.0)) <= MAX_CLASS_DISTANCE) & (
        F.coalesce("_common_distance", F.lit(0.0)) <= MAX_COMMON_DISTANCE
    )
    made = [*_MEASURES, "_class_distance", "_common_distance", "_kept"]
    names = [c for c in (docs.columns if keep is None else keep) if c not in made]
    df = df.withColumn("_kept", ~F.col("_base_failed") & near)
    return df.select(*[F.col("_row").getField(c).alias(c) for c in names], *made)


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its columns."""
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return judged(rows, keep=["row"]).where("_kept").select("row.*")


def op8_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(documents(spark, sf_dir), keep=["doc_id"])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return rows.select("doc_id", *[F.col(f"_{x}").alias(x) for x in names])


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _sql_js(p: str, q: str) -> str:
    pairs = f"list_zip({p}, {q})"
    a, b = f"(x[1] / list_sum({p}))", f"(x[2] / list_sum({q}))"
    term = (
        f"(CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"
        f" + CASE WHEN {b} > 0 THEN {b} * log2(2 * {b} / ({a} + {b})) ELSE 0 END) / 2"
    )
    return f"sqrt(greatest(list_sum(list_transform({pairs}, lambda x: {term})), 0))"


_W = r"[^\x20\x09-\x0D]+"
OP8_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text,
             CASE WHEN lang IN ({", ".join(f"'{x}'" for x in COMMON)}) THEN lang ELSE '{OTHER}' END AS lang
           FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{_W}') AS words, row_number() OVER () AS rid FROM t),
m AS (SELECT *, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
        length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols,
        length(text) - length(regexp_replace(text, '\\p{{Lu}}+', '', 'g')) AS up,
        length(text) - length(regexp_replace(text, '\\p{{Ll}}+', '', 'g')) AS low_letters,
        length(text) - length(regexp_replace(text, '\\p{{N}}+', '', 'g')) AS digits,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
        words AS low,
        CASE lang {" ".join(f"WHEN '{k}' THEN {_sql_list(v)}" for k, v in COMMON.items())}
             ELSE NULL END AS common
      FROM w),
pos AS (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM m),
win AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i], words[i + 1], words[i + 2]) AS c FROM pos),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM win, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY rid),
h AS (SELECT m.*, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
        [low_letters, up, digits, length(text) - word_chars, n_symbols,
         word_chars - low_letters - up - digits - n_symbols] AS classes,
        list_transform(common, lambda c: len(list_filter(low, lambda x: x = c))) AS found
      FROM m LEFT JOIN cov USING (rid)),
g AS (SELECT *, list_append(found, n_words - list_sum(found)) AS commons FROM h),
r AS (SELECT lang,
        [{", ".join(f"sum(classes[{i + 1}])" for i in range(len(_CLASSES)))}] AS class_ref,
        [{", ".join(f"sum(commons[{i + 1}])" for i in range(_WIDTH + 1))}] AS common_ref
      FROM g WHERE n_words >= {MIN_WORDS} GROUP BY lang),
d AS (SELECT g.*, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
        CASE WHEN n_words > 0 AND class_ref IS NOT NULL THEN {_sql_js("classes", "class_ref")} ELSE 0 END AS dc,
        CASE WHEN n_words >= {MIN_WORDS_FOR_COMMON} AND lang <> '{OTHER}' THEN {_sql_js("commons", "common_ref")} ELSE 0 END AS dw
      FROM g LEFT JOIN r USING (lang))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND dc <= {MAX_CLASS_DISTANCE} AND dw <= {MAX_COMMON_DISTANCE} AS kept
FROM d
"""
