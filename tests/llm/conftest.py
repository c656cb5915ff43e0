import pytest

ROWS = [
    (None, "a b c", "en", "x", 5),
    (1, None, "en", "x", None),
    (2, "", None, "x", 0),
    (3, " \t\n", "xx", "x", 3),
    (4, "one two three four five six", "en", "x", 27),
    (4, "one two three four five six", "en", "x", 27),
    (5, "one two three four five six", "fr", "y", 27),
    (6, "wörd " * 30_000, "de", "y", 150_000),
    (7, " ".join(f"w{i}" for i in range(400)), "en", "y", 1),
    (8, " ".join(f"w{i}" for i in range(399)) + " changed", "en", "y", 1),
    (9, "é\x00 x <|endoftext|> ퟿ 😀.", "fr", None, 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# names that the operators use inside
CLASH = ["id", "body", "fp", "key", "chunk", "place", "cell", "bits", "node", "_words", "_kept", "row", "conv"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, columns with clashing names."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(c) for c in CLASH})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
