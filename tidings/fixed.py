"""FIXED VALUES: patterns, word lists, lookup tables and formats.

Every literal in this module is part of the results; nothing here is tunable.
Python-origin patterns use explicit Unicode classes and boundaries, browser-origin
patterns use ASCII ones, so neither depends on the regex defaults of the JVM.
"""

from __future__ import annotations

# ---------------------------------------------------------------- labels, splits
LABELS = {"ham": 0, "spam": 1}
SPLIT_SEED = 42
TEST_FRACTION = 0.15
VALIDATION_FRACTION_OF_REST = 0.176

# Words a pandas CSV reader takes for a missing value.
NA_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# ------------------------------------------------- character classes (Java syntax)
# Unicode white space including the four separators U+001C..U+001F.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"\p{IsWhite_Space}\x1c-\x1f"
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
WORD_START = rf"(?<![{WORD}])"
WORD_END = rf"(?![{WORD}])"
BOUNDARY = rf"(?:(?<![{WORD}])(?=[{WORD}])|(?<=[{WORD}])(?![{WORD}]))"
# Word boundary, digits and white space as a browser understands them.
ASCII_START = "(?<![A-Za-z0-9_])"
ASCII_END = "(?![A-Za-z0-9_])"
JS_SPACE = r"\x09-\x0d\x20\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

# ------------------------------------------------------------ text normalisation
# A leading lookahead changes no match: it lets the matcher give up on a position
# after one character.
V1_DROPPED = rf"[^a-z0-9{SPACE}]"
# Runs of anything but a-z, 0-9 and _, spelled as the ranges around them.
V2_BLANKED = r"[\x00-/:-\^`{-\x{10FFFF}]+"
# Letters of a host name, with those that equal them when case is ignored.
HOST = r"[a-zA-Z0-9.\-\u0130\u0131\u017f\u212a]"
HOST_STARTS = rf"(?<![a-zA-Z0-9](?=[a-zA-Z0-9]))(?={HOST}++/){BOUNDARY}"
URL = (
    rf"(?=[hHwW])(?iu:https?://[^{SPACE}]+|www\.[^{SPACE}]+)"
    rf"|{HOST_STARTS}{HOST}+\.(?iu:com|co\.uk|org|net|me|info|biz|cc|tv)/[^{SPACE}]*"
)
MONEY = (
    rf"(?=[£$€¥₹{DIGIT}])(?:[£$€¥₹][{SPACE}]*{DIGIT}+(?:[.,]{DIGIT}+)?"
    rf"|{WORD_START}{DIGIT}+(?:[.,]{DIGIT}+)?[{SPACE}]*"
    rf"(?iu:pounds?|dollars?|euros?|p|quid|cash|prize){WORD_END})"
)
PHONE = (
    rf"(?=[+{DIGIT}])(?:\+?{DIGIT}{{1,4}}?[-.{SPACE}]?\(?{DIGIT}{{1,3}}?\)?[-.{SPACE}]?"
    rf"{DIGIT}{{1,4}}[-.{SPACE}]?{DIGIT}{{1,4}}[-.{SPACE}]?{DIGIT}{{1,9}}"
    rf"|{WORD_START}{DIGIT}{{5,6}}{WORD_END})"
)
MULTI_EXCLAM = "!{2,}"
EXCLAM = "!"
MULTI_QUESTION = r"\?{2,}"
NUMBER = rf"(?={DIGIT}){WORD_START}{DIGIT}+{WORD_END}"
TOKENS = {
    "url": " tok_url ",
    "money": " tok_money ",
    "phone": " tok_phone ",
    "multi_exclam": " tok_multiexclam ",
    "exclam": " tok_exclam ",
    "multi_question": " tok_multiquestion ",
    "number": " tok_num ",
}

# ----------------------------------------------------------------- featurisation
SEQUENCE_FILTERS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n'
SEQUENCE_FILTERS_V2 = '!"#$%&()*+,-./:;<=>?@[\\]^`{|}~\t\n'
OOV_WORD = "<OOV>"
TFIDF_FEATURES = 3000
TFIDF_FEATURES_V2 = 5000
MIN_DF_V2 = 2
MAX_DF_V2 = 0.85
NUM_WORDS = 5000
MAXLEN = 50
MAXLEN_V2 = 60
THRESHOLD = 0.5

# ------------------------------------------------------- explanation of a verdict
# Label, and the words (any case) or else the pattern that earns it.
INDICATORS = [
    ("Winning Claim", ["win", "winner", "won"]),
    (
        "Financial Bait",
        ["free", "prize", "reward", "gift", "cash", "bonus", "promo", "coupon"],
    ),
    (
        "Urgency / Pressure",
        ["urgent", "now", "limited", "alert", "expire", "action required"],
    ),
    ("Call to Action", ["claim", "call", "text", "reply", "contact", "apply"]),
    (
        "Currency / Money",
        rf"(?=[£$0-9])(?i:£|\$|[0-9]+[{JS_SPACE}]*pound|[0-9]+[{JS_SPACE}]*dollar)",
    ),
    ("Shortcode / Phone Number", rf"(?=[0-9]){ASCII_START}[0-9]{{4,}}{ASCII_END}"),
    ("ALL CAPS", rf"(?=[A-Z]){ASCII_START}[A-Z]{{3,}}{ASCII_END}"),
]
NO_INDICATOR = "Length / Cap Ratio"
HIGHLIGHTED = [
    "win", "winner", "won", "free", "prize", "reward", "gift", "cash", "bonus",
    "urgent", "now", "limited", "offer", "text now", "reply", "claim", "exclusive",
    "alert", "apply", "contact", "call", "expire", "expires", "selected",
    "congratulations",
]
HIGHLIGHT_OPEN = '<span class="highlight-word">'
HIGHLIGHT_CLOSE = "</span>"
HTML_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]

# ------------------------------------------------------------- messages, previews
MIN_CHARS = 3
MAX_CHARS = 500
LENGTH_TIERS = [(450, "red"), (350, "amber")]
LENGTH_TIER_DEFAULT = "normal"
PREVIEW_RESULT = 80
PREVIEW_STORED = 120
PREVIEW_HISTORY = 70
HISTORY_SIZE = 20
ELLIPSIS = "…"
CLOCK = "HH:mm"

# -------------------------------------------------------------- requests, replies
DEFAULT_MODEL = "lr"
ERROR_TEXT_MISSING = "text field is required"
ERROR_UNKNOWN_KEY = "Unknown model key: %s"
ERROR_NOT_LOADED = 'Model "%s" is not loaded. Please run the training scripts first.'
ERROR_NO_MODELS = "No models are loaded. Run training scripts first."
ERROR_BAD_TYPE = "'%s' object has no attribute 'strip'"
ERROR_TOO_SHORT = "Message is too short. Please enter at least 3 characters."

# ---------------------------------------------------------------- model registry
# key, name, type, member, short name, colour, name in the status list
REGISTRY = [
    ("lr", "Logistic Regression", "ml", 1, "LR", "#3b82f6", "Logistic Reg."),
    ("cnn", "1D CNN", "dl", 1, "CNN", "#8b5cf6", "1D CNN"),
    ("rf", "Random Forest", "ml", 2, "RF", "#06b6d4", "Random Forest"),
    ("lstm", "LSTM", "dl", 2, "LSTM", "#ec4899", "LSTM"),
    ("xgb", "XGBoost", "ml", 3, "XGB", "#f59e0b", "XGBoost"),
    ("transformer", "Transformer", "dl", 3, "TF", "#10b981", "Transformer"),
]
COMPARE_ORDER = ["lr", "rf", "xgb", "cnn", "lstm", "transformer"]
DEFAULT_COLOR = "#a855f7"
# id, name, family, version, type
VERSIONED_MODELS = [
    ("xgb_v1", "XGBoost V1 (Baseline)", "XGBoost", "V1", "ML"),
    ("xgb_v2", "XGBoost V2 (Enhanced)", "XGBoost", "V2", "ML"),
    ("tf_v1", "Transformer V1 (Baseline)", "Transformer", "V1", "DL"),
    ("tf_v2", "Transformer V2 (Corrected)", "Transformer", "V2", "DL"),
]
RANK_CLASSES = ["rank-1", "rank-2", "rank-3"]
RANK_CLASS_OTHER = "rank-other"
CHARTS = ["accuracy", "f1", "precision", "recall"]
