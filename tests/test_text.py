import html
import random
import re
from html.entities import html5

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidings import fixed
from tidings.functions import explain, scores, text, tokens

MESSAGES = [
    (
        "JACKPOT!! Our draw picked your ticket, so a £450 gift card bonus waits! To apply call 08001234567 within 24 hours.",
        "jackpot our draw picked your ticket so a 450 gift card bonus waits to apply call 08001234567 within 24 hours",
        "jackpot tok_multiexclam our draw picked your ticket so a tok_money gift card bonus waits tok_exclam to apply call tok_phone within tok_num hours",
        ["Financial Bait", "Call to Action", "Currency / Money", "Shortcode / Phone Number", "ALL CAPS"],
    ),
    (
        "Alert! The lucky winner gets a 750 pound coupon. Reply 08451112223 from any phone. Limited offer. Ends 6pm.",
        "alert the lucky winner gets a 750 pound coupon reply 08451112223 from any phone limited offer ends 6pm",
        "alert tok_exclam the lucky winner gets a tok_money coupon reply tok_phone from any phone limited offer ends 6pm",
        ["Winning Claim", "Financial Bait", "Urgency / Pressure", "Call to Action", "Currency / Money", "Shortcode / Phone Number"],
    ),
    (
        "Hi, will the train be late tonight? Tell me soon and I will wait at the station.",
        "hi will the train be late tonight tell me soon and i will wait at the station",
        "hi will the train be late tonight tell me soon and i will wait at the station",
        [],
    ),
    (
        "Could we bake some bread for the picnic? That would be great!",
        "could we bake some bread for the picnic that would be great",
        "could we bake some bread for the picnic that would be great tok_exclam",
        [],
    ),
    (
        "FREE entry!!! Text WIN to 80086 or visit www.example.com/x?y=1 now?? Only 50p",
        "free entry text win to 80086 or visit wwwexamplecomxy1 now only 50p",
        "free entry tok_multiexclam text win to tok_phone or visit tok_url now tok_multiquestion only tok_money",
        ["Winning Claim", "Financial Bait", "Urgency / Pressure", "Call to Action", "Shortcode / Phone Number", "ALL CAPS"],
    ),
    (
        "£1,000,000 on 2024-01-15 at bare.com or bare.com/a, 12 34 5 & 7",
        "1000000 on 20240115 at barecom or barecoma 12 34 5  7",
        "tok_money tok_num on tok_phone at bare com or tok_url tok_phone tok_num",
        ["Currency / Money", "Shortcode / Phone Number"],
    ),
]


def run(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, t STRING")
    rows = df.select("i", fn(F.col("t")).alias("o")).collect()
    return [r["o"] for r in sorted(rows, key=lambda r: r["i"])]


def test_golden_messages(spark):
    raw, v1, v2, chips = zip(*MESSAGES)
    assert run(spark, raw, text.clean_v1) == list(v1)
    assert run(spark, raw, text.preprocess_v2) == list(v2)
    assert run(spark, raw, explain.matched_indicators) == list(chips)
    assert run(spark, raw, explain.indicator_count) == [len(c) for c in chips]


def test_missing_text(spark):
    assert run(spark, [None, "", " \t"], text.clean_v1) == ["nan", "", " \t"]
    assert run(spark, [None, "", " \t\x1c "], text.preprocess_v2) == ["", "", ""]


def _random_references(n, seed=7):
    rnd, names = random.Random(seed), list(html5)

    def one():
        kind = rnd.randrange(6)
        if kind == 0:
            return "&" + rnd.choice(names)
        if kind == 1:
            return "&" + rnd.choice(names) + rnd.choice(["x", "foo", ";;", "&", "#", "1"])
        number = rnd.choice(
            [rnd.randint(0, 300), rnd.randint(0, 0x110010), 10 ** rnd.randint(1, 30), 0xFFFE, 0xD800, 0xFDD0]
        )
        if kind == 2:
            return f"&#{number}" + rnd.choice(["", ";", "a"])
        if kind == 3:
            return f"&#{rnd.choice('xX')}{number:x}" + rnd.choice(["", ";", "g"])
        if kind == 4:
            return rnd.choice(["&", "&;", "&#", "&#x;", "& ", "a\n", "\t&x", "&" + "q" * 40])
        return "text "

    return ["".join(one() for _ in range(rnd.randint(1, 8))) for _ in range(n)]


def test_html_unescape_equals_the_standard_library(spark):
    values = ["a &amp; b &pound;5 &#8364;6 &lt;x&gt;", *_random_references(3000)]
    assert run(spark, values, text.html_unescape) == [html.unescape(v) for v in values]


def test_lookup_tables_are_folded_into_the_plan(spark):
    df = spark.range(1).select(text.html_unescape(F.col("id").cast("string")).alias("o"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan


ALPHABET = st.text(alphabet="aZé9ſК !?.,-+()/£$&_'\"<>\n\t\xa0\x1c😀wcom", max_size=60)


@settings(max_examples=15, deadline=None)
@given(st.lists(ALPHABET, min_size=20, max_size=40))
def test_normaliser_properties(spark, values):
    t = F.col("t")
    df = spark.createDataFrame(list(enumerate(values)), "i INT, t STRING")
    rows = (
        df.select(
            "i",
            text.clean_v1(t).alias("v1"),
            text.clean_v1(text.clean_v1(t)).alias("twice"),
            text.preprocess_v2(t).alias("v2"),
            text.collapse_space(t).alias("collapsed"),
            text.strip(t).alias("stripped"),
            tokens.tokens(t, 1).alias("one"),
            tokens.tokens(t, 2).alias("two"),
            text.replace_numbers(t).alias("numbers"),
        )
        .orderBy("i")
        .collect()
    )
    for v, r in zip(values, rows, strict=True):
        assert r["v1"] == r["twice"] == re.sub(r"[^a-z0-9\s]", "", v.lower())
        assert re.fullmatch(r"([a-z0-9_]+( [a-z0-9_]+)*)?", r["v2"])
        assert r["collapsed"] == re.sub(r"\s+", " ", v).strip()
        assert r["stripped"] == v.strip()
        assert r["one"] == re.findall(r"\b\w+\b", v.lower())
        assert r["two"] == re.findall(r"\b\w\w+\b", v.lower())
        assert r["numbers"] == re.sub(r"\b\d+\b", " tok_num ", v)


@pytest.mark.parametrize(
    ("fn", "value", "expected"),
    [
        (text.replace_urls, "see HTTP://x.y/z or a.co.uk/b.", "see  tok_url  or  tok_url "),
        (text.replace_urls, "no bare.com here", "no bare.com here"),
        (text.replace_money, "20 quid, $5.50, 3 Dollars, 3p", " tok_money ,  tok_money ,  tok_money ,  tok_money "),
        (text.replace_money, "12 pandas", "12 pandas"),
        (text.replace_phones, "12345 and 1234", " tok_phone  and 1234"),
        (text.replace_numbers, "12h 12 x9", "12h  tok_num  x9"),
        (text.replace_punctuation, "a!! b! c?? d?", "a tok_multiexclam  b tok_exclam  c tok_multiquestion  d?"),
        (text.escape_html, "<a href=\"x\">&</a>", "&lt;a href=&quot;x&quot;&gt;&amp;&lt;/a&gt;"),
    ],
)
def test_single_steps(spark, fn, value, expected):
    assert run(spark, [value], fn) == [expected]


def test_highlight(spark):
    mark = lambda w: f"{fixed.HIGHLIGHT_OPEN}{w}{fixed.HIGHLIGHT_CLOSE}"
    values = ["Win £5000 & text now", "winners expire, Expires 12345x"]
    assert run(spark, values, explain.highlight) == [
        f"{mark('Win')} {mark('£')}{mark('5000')} &amp; text {mark('now')}",
        f"winners {mark('expire')}, {mark('Expires')} 12345x",
    ]


def test_chips_only_for_spam(spark):
    df = spark.createDataFrame(
        [("win", True), ("hello", True), ("win", False)], "t STRING, s BOOLEAN"
    )
    rows = df.select(explain.indicator_chips(F.col("t"), F.col("s")).alias("c")).collect()
    assert [r["c"] for r in rows] == [["Winning Claim"], [fixed.NO_INDICATOR], None]


def test_length_tiers_count_utf16_units(spark):
    values = ["x" * 350, "x" * 351, "x" * 450, "x" * 451, "😀" * 176]
    assert run(spark, values, text.length_tier) == ["normal", "amber", "amber", "red", "amber"]


def test_previews(spark):
    assert run(spark, ["abcd", "abc"], lambda c: text.preview(c, 3)) == ["abc…", "abc"]
    assert run(spark, ["abcd"], lambda c: text.preview(c, 3, ellipsis=False)) == ["abc"]


def test_model_key(spark):
    values = [None, "", "  ", " RF ", "lstm"]
    assert run(spark, values, text.model_key) == ["lr", "lr", "", "rf", "lstm"]


def test_labels_and_rounding(spark):
    assert run(spark, ["ham", "spam", "other", None], scores.encode_label) == [0, 1, None, None]
    values = ["3.125", "9.375", "0.125", "97.374"]
    rounded = run(spark, values, lambda c: scores.round2(c.cast("double")))
    assert rounded == [round(float(v), 2) for v in values]
    assert run(spark, ["97.374"], lambda c: text.percent(c.cast("double"))) == ["97.37%"]


def test_decisions(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 0.51), (2, 0.2)], "i INT, p DOUBLE")
    rows = df.select("i", scores.decide(F.col("p")).alias("d")).orderBy("i").collect()
    assert [(r["d"]["label"], r["d"]["confidence"]) for r in rows] == [
        ("ham", 50.0), ("spam", 51.0), ("ham", 80.0),
    ]


@pytest.mark.parametrize(
    ("side", "expected"),
    [("pre", [[2, 3, 4], [0, 0, 7], [0, 0, 0]]), ("post", [[1, 2, 3], [7, 0, 0], [0, 0, 0]])],
)
def test_padding(spark, side, expected):
    df = spark.createDataFrame([(0, [1, 2, 3, 4]), (1, [7]), (2, [])], "i INT, ids ARRAY<INT>")
    rows = df.select("i", tokens.pad(F.col("ids"), 3, side).alias("p")).orderBy("i").collect()
    assert [r["p"] for r in rows] == expected


def test_ngrams_and_masks(spark):
    df = spark.createDataFrame([(0, ["a", "b", "c"]), (1, ["a"]), (2, [])], "i INT, w ARRAY<STRING>")
    rows = df.select(tokens.ngrams(F.col("w"), 1, 3).alias("n")).collect()
    assert [r["n"] for r in rows] == [["a", "b", "c", "a b", "b c", "a b c"], ["a"], []]
    row = spark.range(1).select(
        tokens.pad_mask(F.array(F.lit(0), F.lit(3))).alias("m"), tokens.positions(3).alias("p")
    ).first()
    assert (row["m"], row["p"]) == ([False, True], [0, 1, 2])


def test_sequence_words_keep_apostrophes_and_signal_words(spark):
    values = ["Don't  stop, tok_url!"]
    assert run(spark, values, tokens.sequence_words) == [["don't", "stop", "tok", "url"]]
    v2 = lambda c: tokens.sequence_words(c, fixed.SEQUENCE_FILTERS_V2)
    assert run(spark, values, v2) == [["don't", "stop", "tok_url"]]


def test_previews_count_utf16_units(spark):
    rows = spark.createDataFrame([("😀" * 71,), ("a" + "😀" * 40,), ("b" * 70,), (None,)], "t string")
    got = [r[0] for r in rows.select(text.preview(F.col("t"), 70)).collect()]
    assert got[0] == "😀" * 35 + fixed.ELLIPSIS  # 70 units
    assert got[1] == "a" + "😀" * 34 + fixed.ELLIPSIS  # the 70th unit would part a pair
    assert got[2:] == ["b" * 70, None]


def test_values_that_twins_share():
    """SQL twins take these from the library, so they are pinned here (fixed values)."""
    assert fixed.HTML_ESCAPES == [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]
    assert fixed.SEQUENCE_FILTERS == '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n'
    assert set(fixed.SEQUENCE_FILTERS) - set(fixed.SEQUENCE_FILTERS_V2) == {"_"}
    assert ", ".join(fixed.HIGHLIGHTED) == (
        "win, winner, won, free, prize, reward, gift, cash, bonus, urgent, now, limited, offer, text now, reply, "
        "claim, exclusive, alert, apply, contact, call, expire, expires, selected, congratulations"
    )
    # what the CSV reader of pandas takes for missing, besides the empty field
    import io

    import pandas as pd

    words = ["", *fixed.NA_WORDS, "null ", "none", "na", "Null", "nil", "-", "x"]
    table = pd.read_csv(io.StringIO("t,i\n" + "\n".join(f'"{w}",1' for w in words)))
    assert [w for w, gone in zip(words, table["t"].isna()) if gone] == ["", *fixed.NA_WORDS]
