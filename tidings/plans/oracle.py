"""SQL twins of the registered queries, for DuckDB.

They are written apart from the Spark code: plain RE2 patterns, joins and windows
over whole tables.
"""

from __future__ import annotations

from tidings import fixed
from tidings.sources.derived import SMS_SQL


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_CODES = [ord(c) for c in fixed.SPACE_CHARS]
_WS = "".join(f"\\x{{{c:x}}}" for c in _CODES)
_TRIM = _q(fixed.SPACE_CHARS)
_W = r"[\p{L}\p{N}_]"

SMS = f"sms AS ({SMS_SQL.replace('{conversations}', 'conversations')})"
LABELLED = f"""{SMS}, labelled AS (
  SELECT msg_id, text, CASE label WHEN 'ham' THEN 0 WHEN 'spam' THEN 1 END AS label FROM sms)"""


def _bucket(id_col: str) -> str:
    return f"('0x' || substr(md5('42:' || {id_col}::VARCHAR), 1, 8))::BIGINT % 1000"


SPLIT = f"""{LABELLED}, split AS (
  SELECT *, CASE WHEN {_bucket('msg_id')} < 150 THEN 'test'
                 WHEN {_bucket('msg_id')} < 300 THEN 'val' ELSE 'train' END AS split
  FROM labelled)"""


def _v1(c: str) -> str:
    return f"regexp_replace(lower(coalesce({c}, 'nan')), '[^a-z0-9{_WS}]', '', 'g')"


def _collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '[{_WS}]+', ' ', 'g'))"


def _url(c: str) -> str:
    return (
        rf"regexp_replace({c}, '(https?://[^{_WS}]+|www\.[^{_WS}]+|\b[a-zA-Z0-9.-]+\."
        rf"(?:com|co\.uk|org|net|me|info|biz|cc|tv)/[^{_WS}]*)', ' tok_url ', 'gi')"
    )


def _money(c: str) -> str:
    return (
        rf"regexp_replace({c}, '([£$€¥₹][{_WS}]*\d+(?:[.,]\d+)?|\b\d+(?:[.,]\d+)?[{_WS}]*"
        r"(?:pounds?|dollars?|euros?|p|quid|cash|prize)\b)', ' tok_money ', 'gi')"
    )


def _phone(c: str) -> str:
    s = rf"[-.{_WS}]?"
    return (
        rf"regexp_replace({c}, '(\+?\d{{1,4}}?{s}\(?\d{{1,3}}?\)?{s}\d{{1,4}}{s}\d{{1,4}}{s}\d{{1,9}}"
        r"|\b\d{5,6}\b)', ' tok_phone ', 'g')"
    )


def _punct(c: str) -> str:
    c = f"regexp_replace({c}, '!{{2,}}', ' tok_multiexclam ', 'g')"
    c = f"replace({c}, '!', ' tok_exclam ')"
    return f"regexp_replace({c}, '\\?{{2,}}', ' tok_multiquestion ', 'g')"


def _num(c: str) -> str:
    return rf"regexp_replace({c}, '\b\d+\b', ' tok_num ', 'g')"


def _blank(c: str) -> str:
    return _collapse(f"regexp_replace(lower({c}), '[^a-z0-9_{_WS}]', ' ', 'g')")


def _entities(c: str) -> str:
    """The character references that occur in the tables; the ampersand last."""
    for name, value in (("quot", '"'), ("middot", "·"), ("copy", "©"), ("lt", "<"), ("gt", ">")):
        c = f"replace({c}, '&{name};', {_q(value)})"
    return f"regexp_replace({c}, '&amp;?', '&', 'g')"


def _v2(c: str) -> str:
    return _blank(_num(_punct(_phone(_money(_url(_collapse(_entities(f"coalesce({c}, '')"))))))))


def _escape(c: str) -> str:
    for raw, escaped in fixed.HTML_ESCAPES:
        c = f"replace({c}, {_q(raw)}, {_q(escaped)})"
    return c


def _utf16(c: str) -> str:
    return rf"(length({c}) + length(regexp_replace({c}, '[\x{{0}}-\x{{ffff}}]', '', 'g')))"


def _preview(c: str, n: int) -> str:
    return f"CASE WHEN length({c}) > {n} THEN substr({c}, 1, {n}) || '…' ELSE {c} END"


# RE2 has ASCII word boundaries, which is what a browser uses.
_RULES = [
    ("Winning Claim", r"(?i)\b(win|winner|won)\b"),
    ("Financial Bait", r"(?i)\b(free|prize|reward|gift|cash|bonus|promo|coupon)\b"),
    ("Urgency / Pressure", r"(?i)\b(urgent|now|limited|alert|expire|action required)\b"),
    ("Call to Action", r"(?i)\b(claim|call|text|reply|contact|apply)\b"),
    ("Currency / Money", r"(?i)£|\$|\d+\s*pound|\d+\s*dollar"),
    ("Shortcode / Phone Number", r"\b\d{4,}\b"),
    ("ALL CAPS", r"\b[A-Z]{3,}\b"),
]
_HITS = " + ".join(f"regexp_matches(text, {_q(p)})::INT" for _, p in _RULES)


def _highlight(c: str) -> str:
    def wrap(s: str, pattern: str, flags: str) -> str:
        return (
            f"regexp_replace({s}, {_q(pattern)}, "
            f"'<span class=\"highlight-word\">\\1</span>', '{flags}')"
        )

    c = wrap(_escape(c), "([£$])", "g")
    c = wrap(c, r"(\b\d{4,}\b)", "g")
    for word in fixed.HIGHLIGHTED:
        c = wrap(c, rf"\b({word})\b", "gi")
    return c


def _project(source: str, id_col: str, expr: str) -> str:
    return f"WITH {SMS} SELECT {id_col}, {expr} AS out FROM {source}"


ORACLE: dict[str, str] = {
    "clean_v1": _project("sms", "msg_id", _v1("text")),
    "clean_v1_documents": _project("documents", "doc_id", _v1("text")),
    "pre_v2": _project("sms", "msg_id", _v2("text")),
    "pre_v2_documents": _project("documents", "doc_id", _v2("text")),
    "pre_v2_pages": _project("pages", "page_id", _v2("html")),
    "pre_v2_url": _project("sms", "msg_id", _url("text")),
    "pre_v2_money": _project("sms", "msg_id", _money("text")),
    "pre_v2_phone": _project("sms", "msg_id", _phone("text")),
    "pre_v2_punctuation": _project("sms", "msg_id", _punct("text")),
    "pre_v2_num": _project("sms", "msg_id", _num("text")),
    "html_unescape": _project("pages", "page_id", _entities("html")),
    "highlight": _project("sms", "msg_id", _highlight("text")),
    "length_tier": _project(
        "sms",
        "msg_id",
        f"CASE WHEN {_utf16('text')} > 450 THEN 'red' WHEN {_utf16('text')} > 350 THEN 'amber' ELSE 'normal' END",
    ),
    "length_check": _project(
        "sms",
        "msg_id",
        f"""CASE WHEN {_utf16(f'trim(text, {_TRIM})')} = 0 THEN 'text field is required'
        WHEN {_utf16(f'trim(text, {_TRIM})')} < 3
          THEN 'Message is too short. Please enter at least 3 characters.'
        WHEN {_utf16(f'trim(text, {_TRIM})')} > 500 THEN 'more than 500 characters' END""",
    ),
}

_CHIPS = ", ".join(f"CASE WHEN regexp_matches(text, {_q(p)}) THEN {_q(n)} END" for n, p in _RULES)
ORACLE["indicator_chips"] = f"""
WITH {LABELLED}, hit AS (
  SELECT msg_id, label, list_filter([{_CHIPS}], lambda x: x IS NOT NULL) AS chips FROM labelled)
SELECT msg_id, CASE WHEN label = 1 THEN
         CASE WHEN len(chips) = 0 THEN 'Length / Cap Ratio' ELSE array_to_string(chips, ', ') END
       END AS chips
FROM hit"""

ORACLE["previews"] = f"""
WITH {SMS}
SELECT msg_id, {_preview('text', 80)} AS result_preview, substr(text, 1, 120) AS stored,
       {_escape('(' + _preview('text', 70) + ')')} AS history_preview
FROM sms"""

# ----------------------------------------------------------- labels and their rows
ORACLE["label_encode"] = f"""
WITH {SMS}, both_kinds AS (
  SELECT msg_id, label FROM sms
  UNION ALL SELECT conv_id * 1000 + turn, role FROM conversations)
SELECT msg_id, label, CASE label WHEN 'ham' THEN '0' WHEN 'spam' THEN '1' END AS code
FROM both_kinds"""

_NA = ", ".join(_q(w) for w in fixed.NA_WORDS)
ORACLE["drop_missing"] = f"""
WITH {SMS}, raw AS (
  SELECT msg_id,
         CASE msg_id % 7 WHEN 1 THEN '' WHEN 2 THEN 'NULL' WHEN 3 THEN NULL WHEN 4 THEN '?!'
                         WHEN 5 THEN 'none' ELSE text END AS text,
         CASE WHEN msg_id % 5 = 4 THEN 'other' ELSE label END AS label
  FROM sms), cleaned AS (
  SELECT msg_id, {_v1('text')} AS text,
         CASE label WHEN 'ham' THEN 0 WHEN 'spam' THEN 1 END AS label FROM raw)
SELECT msg_id, text, label FROM cleaned WHERE label IS NOT NULL AND text NOT IN ({_NA})"""


def _distribution(group: str) -> str:
    def pct(n: str) -> str:
        return f"round_even({n}::DOUBLE / total * 100 * 10, 0) / 10"

    return f"""{group} total, spam, total - spam AS ham,
       {pct('spam')} AS spam_pct, {pct('(total - spam)')} AS ham_pct"""


ORACLE["class_distribution"] = f"""
WITH {SPLIT}, n AS (
  SELECT split, count(*) AS total, count(*) FILTER (label = 1) AS spam FROM split GROUP BY split)
SELECT {_distribution('split,')} FROM n"""
ORACLE["class_distribution_documents"] = f"""
WITH n AS (SELECT count(*) AS total, count(*) FILTER (quality = 0) AS spam FROM labels)
SELECT {_distribution('')} FROM n"""
ORACLE["class_weights"] = f"""
WITH {SPLIT}, n AS (SELECT label, count(*) AS n FROM split WHERE split = 'train' GROUP BY label)
SELECT label, n,
       CASE WHEN label = 1 THEN round((SELECT n FROM n WHERE label = 0)::DOUBLE / n, 6) ELSE 1.0::DOUBLE END AS scale_pos,
       round((SELECT sum(n) FROM n)::DOUBLE / ((SELECT count(*) FROM n) * n), 6) AS balanced
FROM n"""
ORACLE["split_assign"] = f"WITH {SPLIT} SELECT msg_id, split FROM split"
ORACLE["split_sizes"] = f"WITH {SPLIT} SELECT split, count(*) AS n FROM split GROUP BY split"


def _exact(source: str, id_col: str, ctes: str) -> str:
    return f"""
WITH {ctes} placed AS (
  SELECT {id_col}, row_number() OVER (ORDER BY md5('42:' || {id_col}::VARCHAR), {id_col}) AS place,
         count(*) OVER () AS n FROM {source}),
sized AS (SELECT *, ceil(n * 0.15::DOUBLE) AS n_test FROM placed)
SELECT {id_col}, CASE WHEN place <= n_test THEN 'test'
                  WHEN place <= n_test + ceil((n - n_test) * 0.176::DOUBLE) THEN 'val'
                  ELSE 'train' END AS split
FROM sized"""


ORACLE["split_exact"] = _exact("sms", "msg_id", SMS + ",")
ORACLE["split_exact_documents"] = _exact("documents", "doc_id", "")
ORACLE["split_raw_and_clean"] = f"""
WITH {SPLIT} SELECT msg_id, text AS raw_text, {_v2('text')} AS text FROM split WHERE split = 'test'"""

# ------------------------------------------------------------------------ features
_TOK1 = rf"regexp_extract_all({_v1('text')}, '{_W}{{2,}}')"
_TOK2 = rf"regexp_extract_all({_v2('text')}, '{_W}+')"
TOKENS1 = f"{SPLIT}, toks AS (SELECT msg_id, split, {_TOK1} AS t FROM split)"
TOKENS2 = f"{SPLIT}, uni AS (SELECT msg_id, split, {_TOK2} AS t FROM split)"
NGRAMS2 = f"""{TOKENS2}, toks AS (
  SELECT msg_id, split,
         list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS t
  FROM uni)"""

ORACLE["tokens_v1"] = f"WITH {TOKENS1} SELECT msg_id, array_to_string(t, ' ') AS tokens FROM toks"
ORACLE["tokens_v1_documents"] = (
    rf"SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '{_W}{{2,}}'), ' ') AS tokens FROM documents"
)
ORACLE["tokens_v2"] = f"WITH {TOKENS2} SELECT msg_id, array_to_string(t, ' ') AS tokens FROM uni"
ORACLE["ngrams_v2"] = f"WITH {NGRAMS2} SELECT msg_id, array_to_string(t, '|') AS ngrams FROM toks"


def _vocab(source: str, k: int, where: str = "true") -> str:
    return f"""used AS (
  SELECT msg_id, unnest(t) AS term FROM {source}),
counted AS (
  SELECT term, count(*) AS tf, count(DISTINCT msg_id) AS df FROM used GROUP BY term),
kept AS (SELECT * FROM counted WHERE {where} ORDER BY tf DESC, term LIMIT {k}),
vocab AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx, tf, df FROM kept)"""


_TRAIN = "(SELECT * FROM toks WHERE split = 'train')"
VOCAB1 = f"{TOKENS1}, {_vocab(_TRAIN, 3000)}"
ORACLE["vocab_tfidf"] = f"WITH {VOCAB1} SELECT term, idx, tf, df FROM vocab"
_DOC_TOKENS = f"(SELECT doc_id AS msg_id, {_TOK1} AS t FROM documents)"
ORACLE["vocab_documents"] = (
    f"WITH {_vocab(_DOC_TOKENS, 3000)} SELECT term, idx, tf, df FROM vocab"
)
_V2_DF = "df >= 2 AND df <= 0.85::DOUBLE * (SELECT count(*) FROM toks WHERE split = 'train')"
ORACLE["vocab_tfidf_v2"] = (
    f"WITH {NGRAMS2}, {_vocab(_TRAIN, 5000, _V2_DF)} SELECT term, idx, tf, df FROM vocab"
)


def _weights(part: str) -> str:
    return f"""
WITH {VOCAB1}, tf AS (
  SELECT msg_id, term, count(*) AS n
  FROM (SELECT msg_id, unnest(t) AS term FROM toks WHERE split = '{part}') GROUP BY ALL),
w AS (
  SELECT msg_id, idx, n * (ln((1.0::DOUBLE + (SELECT count(*) FROM toks WHERE split = 'train')) / (1 + df)) + 1) AS w
  FROM tf JOIN vocab USING (term))
SELECT msg_id, idx, round(w / sqrt(sum(w * w) OVER (PARTITION BY msg_id)), 4) AS weight FROM w"""


ORACLE["tfidf_weights"] = _weights("train")
ORACLE["tfidf_transform"] = _weights("test")


def _words(clean: str, filters: str) -> str:
    spaced = f"translate(lower({clean}), {_q(filters)}, {_q(' ' * len(filters))})"
    return f"""{SPLIT}, seqs AS (
  SELECT msg_id, split, list_filter(string_split({spaced}, ' '), lambda x: x <> '') AS t FROM split),
places AS (
  SELECT msg_id, split, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM seqs)"""


def _index(first: int) -> str:
    return f"""counted AS (
  SELECT word, count(*) AS n, min(msg_id * 1000000 + pos) AS seen
  FROM places WHERE split = 'train' GROUP BY word),
word_index AS (
  SELECT word, row_number() OVER (ORDER BY n DESC, seen) + {first - 1} AS idx, n
  FROM counted QUALIFY row_number() OVER (ORDER BY n DESC, seen) <= {5000 - first})"""


WORDS1 = f"{_words(_v1('text'), fixed.SEQUENCE_FILTERS)}, {_index(1)}"
WORDS2 = f"{_words(_v2('text'), fixed.SEQUENCE_FILTERS_V2)}, {_index(2)}"
ORACLE["vocab_tokenizer"] = f"WITH {WORDS1} SELECT word, idx, n FROM word_index"
ORACLE["vocab_tokenizer_v2"] = f"WITH {WORDS2} SELECT word, idx, n FROM word_index"
IDS1 = f"""{WORDS1}, ids AS (
  SELECT m.msg_id, coalesce(list(w.idx ORDER BY p.pos) FILTER (w.idx IS NOT NULL), []) AS ids
  FROM seqs m LEFT JOIN places p USING (msg_id) LEFT JOIN word_index w USING (word) GROUP BY m.msg_id),
padded AS (
  SELECT msg_id, len(ids) AS known,
         list_concat(list_transform(range(greatest(50 - len(ids), 0)), lambda i: 0),
                     ids[greatest(len(ids) - 49, 1):]) AS ids
  FROM ids)"""
IDS2 = f"""{WORDS2}, ids AS (
  SELECT m.msg_id, coalesce(list(coalesce(w.idx, 1) ORDER BY p.pos) FILTER (p.pos IS NOT NULL), []) AS ids
  FROM seqs m LEFT JOIN places p USING (msg_id) LEFT JOIN word_index w USING (word) GROUP BY m.msg_id),
padded AS (
  SELECT msg_id, len(ids) AS known,
         list_concat(ids[1:60], list_transform(range(greatest(60 - len(ids), 0)), lambda i: 0)) AS ids
  FROM ids)"""
ORACLE["seq_v1"] = f"WITH {IDS1} SELECT msg_id, array_to_string(ids, ' ') AS ids FROM padded"
ORACLE["seq_v2"] = f"WITH {IDS2} SELECT msg_id, array_to_string(ids, ' ') AS ids FROM padded"
ORACLE["pad_mask"] = f"""
WITH {IDS2}
SELECT msg_id,
       array_to_string(list_transform(ids, lambda x: CASE WHEN x <> 0 THEN 'true' ELSE 'false' END), ' ') AS mask,
       array_to_string(range(least(known, 60)), ' ') AS positions
FROM padded"""
ORACLE["predict_batch"] = f"""
WITH {IDS1} SELECT msg_id, round(least(known, 50) / 50.0::DOUBLE, 4) AS score FROM padded"""

# ------------------------------------------------------------- vectors and positions
_DIM = 8
_CODES_2 = ", ".join(f"(((id * {2 * d + 3} + {7 * d * d}) % 1001 - 500) / 1000.0::DOUBLE)" for d in range(_DIM))
VECTORS = f"""{IDS2}, placed AS (
  SELECT msg_id, unnest(ids) AS id, generate_subscripts(ids, 1) - 1 AS pos FROM padded),
tv AS (SELECT msg_id, pos, id, [{_CODES_2}] AS v FROM placed WHERE id <> 0),
dims AS (SELECT msg_id, unnest(range({_DIM})) AS dim FROM padded)"""
for _name, _how in (("max", "max"), ("mean", "avg")):
    ORACLE[f"pool_positions_{_name}"] = f"""
WITH {VECTORS}
SELECT d.msg_id, d.dim, round(coalesce({_how}(v[d.dim + 1]), 0.0::DOUBLE), 9) AS value
FROM dims d LEFT JOIN tv USING (msg_id) GROUP BY d.msg_id, d.dim"""
_CODE = (
    f"CASE WHEN d % 2 = 0 THEN sin(pos / pow(10000.0::DOUBLE, d / {_DIM}.0::DOUBLE))"
    f" ELSE cos(pos / pow(10000.0::DOUBLE, (d - 1) / {_DIM}.0::DOUBLE)) END"
)
ORACLE["attention_pool"] = f"""
WITH {VECTORS}, coded AS (
  SELECT msg_id, pos, list_transform(range({_DIM}), lambda d: v[d + 1] + {_CODE}) AS x FROM tv),
scored AS (
  SELECT *, list_sum(list_transform(range({_DIM}), lambda d:
           x[d + 1] * CASE WHEN d % 2 = 0 THEN 1 ELSE -1 END * (d + 1) / 2.0::DOUBLE)) / sqrt({_DIM}.0::DOUBLE) AS s FROM coded),
shares AS (
  SELECT *, exp(s - max(s) OVER (PARTITION BY msg_id)) AS e FROM scored),
weighted AS (SELECT *, e / sum(e) OVER (PARTITION BY msg_id) AS w FROM shares)
SELECT d.msg_id, d.dim, round(coalesce(sum(w * x[d.dim + 1]), 0.0::DOUBLE), 9) AS value
FROM dims d LEFT JOIN weighted USING (msg_id) GROUP BY d.msg_id, d.dim"""
TRAIN_IDS = f"""{IDS1}, trained AS (
  SELECT msg_id, split.label, list_filter(padded.ids, lambda x: x <> 0) AS w
  FROM padded JOIN split USING (msg_id) WHERE split.split = 'train')"""
ORACLE["vocab_phrases"] = f"""
WITH {TRAIN_IDS}, lens AS (SELECT w, unnest(range(1, 6)) AS length FROM trained),
runs AS (SELECT w, length, unnest(range(1, len(w) - length + 2)) AS i FROM lens WHERE len(w) >= length)
SELECT array_to_string(w[i:i + length - 1], ' ') AS phrase, length, count(*) AS n
FROM runs GROUP BY ALL HAVING count(*) >= 3"""
ORACLE["transition_counts"] = f"""
WITH {TRAIN_IDS}, steps AS (SELECT label, w, unnest(range(1, len(w) + 1)) AS i FROM trained)
SELECT CASE WHEN i > 1 THEN w[i - 1]::VARCHAR ELSE '' END AS prev, w[i]::VARCHAR AS word,
       count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1
FROM steps GROUP BY ALL"""
ORACLE["shuffle_position"] = """
SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) - 1 AS position FROM documents"""
_ROW = "concat_ws(chr(31), coalesce('=' || msg_id, '-'), coalesce('=' || text, '-'), coalesce('=' || label, '-'))"
ORACLE["split_complete"] = f"""
WITH {SPLIT}, h AS (SELECT split, ('0x' || substr(md5({_ROW}), 1, 15))::BIGINT AS h FROM split),
d AS (
  SELECT split AS part, count(*) AS n, sum(h)::VARCHAR AS total, bit_xor(h) AS mix FROM h GROUP BY split
  UNION ALL SELECT 'all', count(*), sum(h)::VARCHAR, bit_xor(h) FROM h)
SELECT *, true AS complete FROM d"""
ORACLE["gbt_histogram"] = f"""
WITH {VOCAB1}, has AS (
  SELECT DISTINCT msg_id, term FROM (SELECT msg_id, unnest(t) AS term FROM toks WHERE split = 'train')),
f AS (SELECT idx AS feature, label FROM has JOIN vocab USING (term) JOIN split USING (msg_id)
      UNION ALL SELECT -1, label FROM split WHERE split = 'train')
SELECT feature, sum(0.5::DOUBLE - label) AS g, 0.25::DOUBLE * count(*) AS h FROM f GROUP BY feature"""

# ----------------------------------------------------- decisions, requests, replies
# key, name, type, member, compare order, points per hit, base points
_MODELS = """m(model_key, model_name, model_type, member, ord, per_hit, base) AS (VALUES
  ('lr', 'Logistic Regression', 'ML', 1, 1, 15, 10), ('rf', 'Random Forest', 'ML', 2, 2, 15, 20),
  ('xgb', 'XGBoost', 'ML', 3, 3, 20, 5), ('cnn', '1D CNN', 'DL', 1, 4, 10, 30),
  ('transformer', 'Transformer', 'DL', 3, 6, 15, 20))"""
_VERSIONED = """m(model_key, family, version, ord, per_hit, base) AS (VALUES
  ('xgb_v1', 'XGBoost', 'V1', 1, 15, 5), ('xgb_v2', 'XGBoost', 'V2', 2, 20, 5),
  ('tf_v1', 'Transformer', 'V1', 3, 15, 10), ('tf_v2', 'Transformer', 'V2', 4, 25, 0))"""


def _scored(models: str) -> str:
    return f"""{SPLIT}, {models}, hits AS (SELECT *, {_HITS} AS hits FROM split),
scored AS (
  SELECT *, least(100, hits * per_hit + base)::DOUBLE / 100 AS s FROM hits, m),
decided AS (
  SELECT *, (s > 0.5)::INT AS prediction,
         round_even(CASE WHEN s > 0.5 THEN s ELSE 1 - s END * 100 * 100, 0) / 100 AS confidence
  FROM scored)"""


SCORED = _scored(_MODELS)
ORACLE["threshold_confidence"] = f"""
WITH {SCORED}
SELECT msg_id, model_key, model_name, model_type, member, prediction,
       CASE WHEN prediction = 1 THEN 'spam' ELSE 'ham' END AS label, confidence FROM decided"""
_BEST = f"""
WITH {SCORED}
SELECT msg_id, model_key, confidence,
       row_number() OVER (PARTITION BY msg_id ORDER BY ord) AS display_idx,
       row_number() OVER (PARTITION BY msg_id ORDER BY confidence DESC, ord) = 1 AS is_best
FROM decided"""
ORACLE["compare_best"] = _BEST
ORACLE["compare_rules"] = _BEST
ORACLE["compare_json"] = f"""
WITH {SCORED}
SELECT msg_id, length(text) AS n_text, model_key,
       CASE WHEN prediction = 1 THEN 'spam' ELSE 'ham' END AS label, confidence,
       row_number() OVER (PARTITION BY msg_id ORDER BY confidence DESC, ord) = 1 AS is_best
FROM decided"""

REQUESTS = f"""{SMS}, asked AS (
  SELECT msg_id,
         CASE WHEN msg_id % 17 = 2 OR msg_id % 11 = 3 OR msg_id % 13 = 5 THEN ''
              ELSE trim(text, {_TRIM}) END AS text,
         CASE WHEN msg_id % 17 = 2 THEN 'lr'
              ELSE CASE msg_id % 7 WHEN 2 THEN 'rf' WHEN 3 THEN 'zz' WHEN 4 THEN 'lstm'
                                   WHEN 5 THEN 'xgb' ELSE 'lr' END END AS model,
         CASE WHEN msg_id % 17 = 2 THEN '''int'' object has no attribute ''strip''' END AS fault
  FROM sms)"""


def _checked(available: str) -> str:
    return f"""{REQUESTS}, checked AS (
  SELECT msg_id, text, model,
         CASE WHEN fault IS NOT NULL THEN 500
              WHEN text = '' OR model NOT IN ('lr', 'rf', 'xgb', 'cnn', 'lstm', 'transformer') THEN 400
              WHEN model NOT IN ({available}) THEN 503 ELSE 200 END AS status,
         CASE WHEN fault IS NOT NULL THEN fault
              WHEN text = '' THEN 'text field is required'
              WHEN model NOT IN ('lr', 'rf', 'xgb', 'cnn', 'lstm', 'transformer')
                THEN 'Unknown model key: ' || model
              WHEN model NOT IN ({available})
                THEN 'Model "' || model || '" is not loaded. Please run the training scripts first.'
         END AS error
  FROM asked)"""


ORACLE["request_parse"] = f"WITH {REQUESTS} SELECT msg_id, text, model, fault FROM asked"
ORACLE["request_validate"] = (
    f"WITH {_checked(_q('lr') + ', ' + _q('rf'))} SELECT msg_id, model, status, error FROM checked"
)
ORACLE["compare_validate"] = f"""
WITH {REQUESTS}
SELECT msg_id,
       CASE WHEN fault IS NOT NULL THEN 500 WHEN text = '' THEN 400 WHEN msg_id % 19 = 4 THEN 503 ELSE 200 END AS status,
       CASE WHEN fault IS NOT NULL THEN fault WHEN text = '' THEN 'text field is required'
            WHEN msg_id % 19 = 4 THEN 'No models are loaded. Run training scripts first.' END AS error
FROM asked"""
_SOUND = "true AS label_agrees, true AS confident"
_FITTED = _MODELS.replace("('transformer'", "('lstm', 'LSTM', 'DL', 2, 5, 0, 0), ('transformer'")
ORACLE["predict_batch_contract"] = f"WITH {SPLIT} SELECT msg_id, true AS agree FROM split WHERE split.split = 'test'"
ORACLE["compare_contract"] = f"""
WITH {SPLIT}, {_FITTED}
SELECT msg_id, model_key, model_name, model_type, member,
       row_number() OVER (PARTITION BY msg_id ORDER BY ord) AS display_idx, true AS one_best, {_SOUND}
FROM split, m WHERE split.split = 'test'"""
_TOTALS = "count(*) FILTER (label = 0) AS negatives, count(*) FILTER (label = 1) AS positives"
ORACLE["eval_contract"] = f"""
WITH {SPLIT}, {_FITTED} SELECT model_key, {_TOTALS} FROM split, m WHERE split.split = 'test' GROUP BY model_key"""
ORACLE["versions_contract"] = f"""
WITH {SPLIT}, {_VERSIONED}
SELECT model_key, family, version, {_TOTALS} FROM split, m WHERE split.split = 'test' GROUP BY ALL"""
ORACLE["stream_contract"] = f"""
WITH {_checked(_q('lr'))}
SELECT msg_id, 'lr' AS model_key, 'Logistic Regression' AS model_name, 'ML' AS model_type, 1 AS member, {_SOUND}
FROM checked WHERE status = 200"""
ORACLE["pool_max"] = """
WITH v AS (
  SELECT label, unnest(embedding) AS value, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)
SELECT label, dim, max(value)::DOUBLE AS value FROM v GROUP BY label, dim"""
ORACLE["stream_rejects"] = (
    f"WITH {_checked(_q('lr'))} SELECT msg_id, status, error FROM checked WHERE status <> 200"
)

_KNOWN = """known(model_key, status_name, name, short, color, reg, ord) AS (VALUES
  ('lr', 'Logistic Reg.', 'Logistic Regression', 'LR', '#3b82f6', 1, 1),
  ('cnn', '1D CNN', '1D CNN', 'CNN', '#8b5cf6', 2, 4),
  ('rf', 'Random Forest', 'Random Forest', 'RF', '#06b6d4', 3, 2),
  ('lstm', 'LSTM', 'LSTM', 'LSTM', '#ec4899', 4, 5),
  ('xgb', 'XGBoost', 'XGBoost', 'XGB', '#f59e0b', 5, 3),
  ('transformer', 'Transformer', 'Transformer', 'TF', '#10b981', 6, 6))"""
_READY = f"{_KNOWN}, ready(model_key) AS (VALUES ('lr'))"
ORACLE["model_status"] = f"""
WITH {_READY}
SELECT model_key, status_name,
       CASE WHEN model_key IN (SELECT model_key FROM ready) THEN 'Ready' ELSE 'Missing' END AS state
FROM known"""
ORACLE["model_health"] = f"""
WITH {_READY}
SELECT string_agg(model_key, ',' ORDER BY reg) AS loaded_models, count(*) AS total_loaded
FROM known SEMI JOIN ready USING (model_key)"""
ORACLE["model_skipped"] = f"""
WITH {_READY} SELECT model_key, name AS model_name FROM known ANTI JOIN ready USING (model_key)"""


# ---------------------------------------------------------------------- evaluation
def _measured(name: str, where: str = "true") -> str:
    def pct(top: str, bottom: str) -> str:
        return f"coalesce(round_even(({top})::DOUBLE / nullif({bottom}, 0) * 100 * 100, 0) / 100, 0.0::DOUBLE)"

    return f"""{name}_c AS (
  SELECT model_key, count(*) FILTER (label = 0 AND prediction = 0) AS tn,
         count(*) FILTER (label = 0 AND prediction = 1) AS fp,
         count(*) FILTER (label = 1 AND prediction = 0) AS fn,
         count(*) FILTER (label = 1 AND prediction = 1) AS tp
  FROM decided WHERE {where} GROUP BY model_key),
{name} AS (
  SELECT *, {pct('tp + tn', 'tn + fp + fn + tp')} AS accuracy, {pct('tp', 'tp + fp')} AS precision,
         {pct('tp', 'tp + fn')} AS recall, {pct('2 * tp', '2 * tp + fp + fn')} AS f1
  FROM {name}_c)"""


EVAL = f"{SCORED}, {_KNOWN}, {_measured('e')}"
_ALL = "accuracy, precision, recall, f1"
ORACLE["confusion_matrix"] = f"WITH {EVAL} SELECT model_key, tn, fp, fn, tp FROM e"
ORACLE["eval_metrics"] = f"WITH {EVAL} SELECT model_key, tn, fp, fn, tp, {_ALL} FROM e"
ORACLE["metrics_enrich"] = f"""
WITH {EVAL}
SELECT model_key, {_ALL}, name, short, model_type AS type, member, color
FROM e JOIN known USING (model_key) JOIN m USING (model_key)"""
_PCT = ", ".join(f"printf('%.2f%%', {c}) AS {c}" for c in ("accuracy", "precision", "recall", "f1"))
ORACLE["eval_report"] = f"""
WITH {EVAL} SELECT model_name AS name, model_type AS type, {_PCT}, fp, fn FROM e JOIN m USING (model_key)"""
ORACLE["leaderboard"] = f"""
WITH {EVAL}, r AS (
  SELECT row_number() OVER (ORDER BY f1 DESC, model_key) AS rank, model_key, model_name AS name, f1
  FROM e JOIN m USING (model_key))
SELECT rank, CASE WHEN rank <= 3 THEN 'rank-' || rank ELSE 'rank-other' END AS rank_class,
       model_key, name, f1 FROM r"""
ORACLE["kpi_best"] = f"""
WITH {EVAL}, b AS (SELECT model_key, model_name, f1 FROM e JOIN m USING (model_key) ORDER BY f1 DESC, model_key LIMIT 1)
SELECT (SELECT max(accuracy) FROM e) AS best_accuracy, f1 AS best_f1, model_key AS best_key,
       CASE WHEN f1 > 0 THEN model_name ELSE '' END AS best_model FROM b"""
ORACLE["chart_matrix"] = f"""
WITH {EVAL}, v AS (
  SELECT model_key, unnest(['accuracy', 'f1', 'precision', 'recall']) AS metric,
         unnest([accuracy, f1, precision, recall]) AS value FROM e),
cells AS (
  SELECT k.*, c.metric FROM known k,
         (SELECT unnest(['accuracy', 'f1', 'precision', 'recall']) AS metric) c)
SELECT ord AS place, model_key,
       CASE WHEN v.value IS NULL THEN upper(model_key) ELSE short END AS label,
       CASE WHEN v.value IS NULL THEN '#a855f7' ELSE color END AS color,
       metric, coalesce(v.value, 0.0::DOUBLE) AS value
FROM cells LEFT JOIN v USING (model_key, metric)"""
_TWO = f"{SCORED}, {_KNOWN}, {_measured('old', _q('val') + ' = split')}, {_measured('new', _q('test') + ' = split')}"
ORACLE["metrics_upsert"] = f"""
WITH {_TWO}
SELECT model_key, {_ALL} FROM old WHERE model_key NOT IN ('lr', 'rf', 'xgb')
UNION ALL SELECT model_key, {_ALL} FROM new WHERE model_key IN ('lr', 'rf', 'xgb')"""
ORACLE["metrics_roundtrip"] = f"""
WITH {_TWO}, merged AS (
  SELECT model_key, f1 FROM old WHERE model_key NOT IN ('lr', 'rf')
  UNION ALL SELECT model_key, f1 FROM new WHERE model_key IN ('lr', 'rf'))
SELECT model_key, short, f1 FROM merged JOIN known USING (model_key)"""
VERSIONED = f"{_scored(_VERSIONED)}, {_measured('e')}"
ORACLE["v1_v2_pivot"] = f"""
WITH {VERSIONED}, f AS (
  SELECT family, max(f1) FILTER (version = 'V1') AS f1_v1, max(f1) FILTER (version = 'V2') AS f1_v2
  FROM e JOIN m USING (model_key) GROUP BY family)
SELECT *, round_even((f1_v2 - f1_v1) * 100, 0) / 100 AS gain FROM f"""
ORACLE["comparison_roundtrip"] = f"""
WITH {VERSIONED}
SELECT model_key, family, version, f1, tn AS "TN", fp AS "FP", fn AS "FN", tp AS "TP"
FROM e JOIN m USING (model_key)"""

# ------------------------------------------------------------------ files and back
ORACLE["src_first_existing"] = f"""
WITH {SPLIT} SELECT text, label, count(*) AS n FROM split WHERE split.split = 'test' AND text NOT IN ({_NA}) GROUP BY ALL"""
ORACLE["src_tsv_roundtrip"] = f"""
WITH {SMS}, lines AS (SELECT label, {_collapse('text')} AS text FROM sms),
keyed AS (SELECT *, row_number() OVER (PARTITION BY label, text) - 1 AS ordinal FROM lines),
given AS (
  SELECT label, text,
         ('0x' || substr(md5(md5(label || chr(9) || text) || ':' || ordinal::VARCHAR), 1, 15))::BIGINT AS msg_id
  FROM keyed)
SELECT msg_id, label, text, CASE WHEN {_bucket('msg_id')} < 150 THEN 'test'
       WHEN {_bucket('msg_id')} < 300 THEN 'val' ELSE 'train' END AS split
FROM given"""
ORACLE["splits_roundtrip"] = f"""
WITH {SPLIT} SELECT msg_id, text, label, split FROM split WHERE text NOT IN ({_NA})"""

# ------------------------------------------------------------------------- history
_NEWEST = f"""
WITH {SCORED}, newest AS (
  SELECT d.*, e.ts FROM decided d JOIN events e ON e.event_id = msg_id // 1000 * 10 + msg_id % 1000
  WHERE model_key = 'lr' ORDER BY e.ts DESC, msg_id DESC LIMIT 20)
SELECT msg_id AS id, CASE WHEN prediction = 1 THEN 'SPAM' ELSE 'HAM' END AS verdict,
       {_escape('(' + _preview('substr(text, 1, 120)', 70) + ')')} AS shown,
       strftime(ts, '%H:%M') AS time"""
ORACLE["stream_history"] = f"{_NEWEST} FROM newest"
ORACLE["stream_history_state"] = ORACLE["stream_history"]
ORACLE["history_top20"] = f"{_NEWEST}, confidence, model_name FROM newest"
