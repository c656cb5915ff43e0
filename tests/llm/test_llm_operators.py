"""Every operator against brute force, round trips, and odd rows."""

import base64
import dataclasses
import hashlib
import json
import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidings.llm import chat, decontaminate, html, packing, ppm, quality, secrets, sharding, simhash, tokencount
from tidings.llm.common import documents, give_back
from tidings.llm.queries import ORACLE, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in documents(spark, sf).collect()}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    ours = sorted(map(tuple, df.select(*columns).collect()), key=repr)
    result = duck.sql(ORACLE[name])
    theirs = sorted((tuple(r[result.columns.index(c)] for c in columns) for r in result.fetchall()), key=repr)
    assert ours == theirs and ours


# ------------------------------------------------------------------ 1
QUESTION = "A farmer named Tom Brown has 12 sheep and sells 5 of them to Tom Brown at 30 dollars each on monday"


def test_templates_find_copies_and_new_parameters(spark):
    other = QUESTION.replace("Tom Brown", "Ann Smith").replace("12", "40").replace("30", "7")
    mixed = QUESTION.replace("Tom Brown has", "Ann Smith has").replace("12", "40")
    docs = spark.createDataFrame(
        [
            (1, f"words before. {QUESTION} and words behind"), (2, f"x y z\n{other}"), (3, f"x y z\n{mixed}"),
            (4, "nothing of the kind at all in these few words of text"), (None, QUESTION), (5, None),
        ],
        "doc_id long, text string",
    )
    items = spark.createDataFrame([(10, QUESTION), (11, None), (12, "short item"), (13, QUESTION)], "item_id long, text string")
    found = {(r.id, r.item): r for r in decontaminate.matches(docs, items).collect()}
    assert set(found) == {(d, i) for d in (1, 2, None) for i in (10, 13)}
    assert found[1, 10].copied and not found[2, 10].copied and found[2, 10].changed > 0
    assert [r.doc_id for r in decontaminate.decontaminate(docs, items).orderBy("doc_id").collect()] == [3, 4, 5]


def test_templates_find_copies_in_other_letters(spark):
    item = "Élan Óscar says that Žofie met Tom Brown near the old école of Zürich and paid 12 euros"
    short = "Which river flows through Élan town"
    cries = "!! ".join(item.upper().split())
    docs = spark.createDataFrame(
        [
            (1, f"so they {cries} he said"), (2, item.lower()), (3, f"well, as asked before {item} indeed"),
            (4, f"we ask {short} again"), (5, short.upper()), (6, "Which river flows through some other town"),
        ],
        "doc_id long, text string",
    )
    items = spark.createDataFrame([(1, item), (2, short)], "item_id long, text string")
    found = {(r.id, r.item) for r in decontaminate.matches(docs, items).collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (4, 2), (5, 2)}


def test_one_conflicting_slot_drops_its_windows_only(spark):
    words = "the old mill by the river grinds corn for all people who live there and bakes"
    item = f"{words} 12 loaves while {words.replace('mill', 'barn')} 12 cakes and 3 pies and 5 buns before the sun goes down"
    texts = [
        item.replace("12 cakes", "13 cakes"), item.replace("12 cakes", "twelve cakes"),
        item.replace("3 pies and 5", "4 pies and 4"), item,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = {r.id: r for r in decontaminate.matches(docs, items).collect()}
    assert {d: r.copied for d, r in found.items()} == {0: False, 1: True, 2: False, 3: True}
    n = found[3].item_windows
    assert found[3].windows == found[1].windows == n and n - 8 <= found[0].windows < n and n / 2 < found[2].windows < n


def test_names_at_the_start_of_sentences_are_slots(spark):
    question = "Alice has 5 apples. Alice buys 3 more. How many apples does Alice have?"
    plain = "Alice has 5 red apples. Alice gives 3 of them away.\nAlice wants to know what is left"
    initials = "we know that J. MILLER has a new house with a garden and trees"
    new = [
        question.replace("Alice", "Bob").replace("5", "7").replace("3", "2"),
        plain.replace("Alice", "Bob").replace("5", "7").replace("3", "2"),
        initials.replace("J. MILLER", "K. JONES"), "it costs 17 or 12 cm", "a cut of 42 is 12 mm",
    ]
    docs = spark.createDataFrame(list(enumerate(new)), "doc_id long, text string")
    items = [question, plain, initials, "12 cm", "42"]
    items = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.id, r.item): r for r in decontaminate.matches(docs, items).collect()}
    assert set(found) == {(i, i) for i in range(3)} | {(3, 3), (4, 4)}
    assert [found[i, i].copied for i in range(5)] == [False, False, False, True, True]


def test_templates_find_every_planted_passage(spark, sf, texts):
    items = {r.item_id: WORD.findall(r.text.lower()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = {
        (d, i) for d, t in texts.items() for i, w in items.items() if " ".join(w) in " ".join(WORD.findall(t.lower()))
    }
    found = {(r.doc_id, r.item_id) for r in QUERIES["op1_template_decontamination"](spark, sf).collect()}
    assert want <= found
    clean = {(d, i) for d, i in found if not set(zip(*(items[i][k:] for k in range(5)))) & set(
        zip(*(WORD.findall(texts[d].lower())[k:] for k in range(5))))}
    assert not clean


# ------------------------------------------------------------------ 2
def _model(bodies, order):
    levels = [defaultdict(Counter) for _ in range(order + 1)]
    for b in bodies:
        b = ppm.END * order + b
        for k in range(order, len(b)):
            levels[order][b[k - order : k]][b[k]] += 1
    for n in range(order - 1, -1, -1):
        for context, symbols in levels[n + 1].items():
            for s in symbols:
                levels[n][context[1:]][s] += 1
    model = ppm.Adaptive(order)
    model.nodes = {c: dict(s) for level in levels for c, s in level.items()}
    return model


@pytest.mark.parametrize("order", [2, 5])
def test_ppm_is_the_trie_model(spark, texts, order):
    some = sorted(texts)[:25]
    docs = spark.createDataFrame([(i, texts[i]) for i in some], "doc_id long, text string").repartition(3)
    learn = [i for i in some if i % 3]
    rows = {r.id: r for r in ppm.scores(docs, F.col("doc_id") % 3 != 0, order=order, chunk_bytes=4000).collect()}
    model = _model([ppm.coded_bytes(texts[i].encode()) for i in learn], order)
    words = Counter(w for i in learn for w in [*texts[i].encode().lower().split(), b"\n"])
    n, v = sum(words.values()), len(words)
    assert set(rows) == set(some)
    for i in some:
        b = ppm.END * order + ppm.coded_bytes(texts[i].encode())
        want = sum(model.code(b[k - order : k], b[k], learn=False) for k in range(order, len(b)))
        assert rows[i].score == pytest.approx(want, abs=1e-6)
        tokens = [*texts[i].encode().lower().split(), b"\n"]
        assert rows[i].base_score == pytest.approx(sum(math.log10((words[t] + 1) / (n + v + 1)) for t in tokens))
        assert (rows[i].n_tokens, rows[i].n_known) == (len(tokens), sum(words[t] > 0 for t in tokens))
        assert rows[i].train_tokens == n


def test_ppm_words_of_a_slice_stay_in_arrow():
    """Different words are no Python objects, of which a chunk's would fill an executor."""
    bodies = [b" ".join(b"w%d" % (i % 100_000) for i in range(k, k + 100_000)) for k in (0, 50_000)]
    ppm._different(bodies[:1])  # imports
    tracemalloc.start()
    different, at, sizes = ppm._different(bodies)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(different) == 100_000 and sizes.tolist() == [100_000, 100_000]
    assert different[int(at[100_000])].as_py() == b"w50000"
    assert peak < 8 << 20


def test_ppm_windows_of_slices_are_summed_as_they_come():
    """What slices share waits but once; and memory that a task has freed goes back."""
    r = np.random.default_rng(2)
    body = b" ".join(b"w%d" % i for i in r.integers(0, 20_000, 150_000)) + ppm.END
    bodies = [body] * 24  # a slice each
    ppm._gram_counts(bodies[:1], [True], 5)
    tracemalloc.start()
    one, n_one = ppm._gram_counts(bodies[:1], [True], 5)
    tracemalloc.reset_peak()
    keys, n = ppm._gram_counts(bodies, [True] * 23 + [False], 5)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (keys == one).all() and (n == 23 * n_one).all()
    assert held < 90 << 20, held >> 20
    give_back()


def test_ppm_probabilities_sum_to_one():
    model = _model([b"abracadabra\n", b"abra cad\n"], 2)
    for context in (b"ab", b"zz", b"ra", b"\n\n"):
        assert sum(10 ** model.code(context, s, learn=False) for s in range(256)) == pytest.approx(1)


def test_adaptive_model_learns(spark):
    rows = spark.createDataFrame([(1, "abc " * 50), (2, None)], "doc_id long, text string")
    got = {r.id: r.score for r in ppm.adaptive_scores(rows).collect()}
    assert got[1] > -200 * math.log10(256) / 4 and got[2] == pytest.approx(-math.log10(256))


# ------------------------------------------------------------------ 3
def test_packing_keeps_every_id_once(spark, odd, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.word_vocabulary())
    whole = spark.createDataFrame(list(texts.items()), "doc_id long, text string").union(odd.select("doc_id", "text"))
    whole = whole.withColumn("doc_id", F.monotonically_increasing_id()).persist()
    source = {r.doc_id: r.text or "" for r in whole.collect()}
    rows = packing.packed(whole.coalesce(2), round_tokens=20_000).collect()
    pieces, windows, steps = defaultdict(list), defaultdict(list), Counter()
    for r in rows:
        pieces[r.id].append((r.start, r.ids, r.doc_tokens, r.length))
        windows[r.sequence_id].append(r)
        steps[r.step_id] += r.length
    for i, text in source.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        mine = sorted(pieces[i])
        assert b"".join(p[1] for p in mine) == ids.tobytes()
        assert all(p[2] == len(ids) and len(p[1]) == 4 * p[3] for p in mine)
    for window in windows.values():
        at = 0
        for r in sorted(window, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == window[0].capacity and at & (at - 1) == 0 and at <= 2048
    # step groups of a task are equal, but for its last one
    last = {}
    for k in steps:
        last[k >> 40] = max(k, last.get(k >> 40, 0))
    assert all(n == packing.STEP_TOKENS for k, n in steps.items() if k != last[k >> 40])
    assert max(steps.values()) <= packing.STEP_TOKENS and len(steps) > 2 * len(last)


@pytest.mark.parametrize("most", [40, 2000, 10**6])
def test_word_table_of_any_size_gives_the_tokenizer_ids(texts, most):
    import pyarrow as pa
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.word_vocabulary())
    table = packing.WordTokens(packing.word_vocabulary(), most)
    some = [texts[i] for i in sorted(texts)[:60]] + ["", " \x0b ", "İstanbul's <|endoftext|>x don't e\u0301", "ǅ 12½"]
    for at in range(0, len(some), 7):
        part = some[at : at + 7]
        found = table.ids(pa.array([x.encode() for x in part], pa.binary()))
        assert [x.tolist() for x in found] == [tokenizer.encode(x, add_special_tokens=False).ids for x in part]


# ------------------------------------------------------------------ 4
def _groups(rows, scheme):
    forest = simhash._Forest()
    fps = np.array([np.frombuffer(simhash.fingerprint(t.encode(), scheme), np.uint64) for _, t in rows])
    for i in range(len(rows)):
        for j in np.flatnonzero(simhash._near(fps, fps[i], scheme.distance)):
            forest.union(i, int(j))
    lowest = {}
    for i, (d, _) in enumerate(rows):
        lowest[forest.find(i)] = min(lowest.get(forest.find(i), d), d)
    return {d: lowest[forest.find(i)] for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize("bucket", [50_000, 20])
def test_simhash_components(spark, texts, bucket):
    base = [f"a{i} b{i % 7} c{i % 3}" for i in range(300)]
    near = {10_000 + k: " ".join(base[:k] + ["other"] + base[k + 1 :]) for k in range(0, 300, 4)}
    rows = sorted({**texts, **near}.items())
    scheme = dataclasses.replace(simhash.EXACT, bucket_rows=bucket)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.id: r.component_id for r in simhash.grouped(df, scheme).collect()} == _groups(rows, scheme)


def test_oversized_buckets_of_wide_fingerprints_lose_no_pair(spark):
    rng = np.random.default_rng(5)
    bits = rng.integers(0, 2, (160, 512), np.uint8)
    bits[:, :16] = 1  # one common block
    for k in range(0, 120, 2):  # 80 differing bits, some in each of the other 31 blocks
        bits[k + 1] = bits[k]
        for block in range(1, 32):
            bits[k + 1, block * 16 + rng.permutation(16)[: 2 + (block < 19)]] ^= 1
    fps = [x.tobytes() for x in np.packbits(bits, axis=1)]
    df = spark.createDataFrame([(i + 1, bytearray(x)) for i, x in enumerate(fps)], "node long, fp binary")
    seen = []
    for bucket in (100_000, 10):
        scheme = dataclasses.replace(simhash.SIMILAR, bucket_rows=bucket)
        forest = simhash._Forest()
        for r in simhash.links(df, scheme).collect():
            forest.union(r.u, r.v)
        seen.append([forest.find(i + 1) for i in range(160)])
    assert seen[0] == seen[1] == [i - (i % 2 == 0 and i <= 120) for i in range(1, 161)]


def test_fingerprint_by_hand():
    import xxhash

    words = "The quick brown fox jumps over the quick brown fox".lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), seed=42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(b"The quick brown fox  jumps over the\tquick brown fox") == want.to_bytes(8, "big")
    assert simhash.fingerprint(b" \n") == bytes(8)


def test_one_of_each_group_stays(spark, odd):
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == [1, 4, 6, 7, 9]  # 1, 2, 3 are blank; 4, 4, 5 equal; 7 and 8 near


# ------------------------------------------------------------------ 5
def test_token_counts_are_the_best_segmentation(spark, odd):
    scores = tokencount.zipf_scores(tokencount.piece_vocabulary())

    def best(word):
        text, top = tokencount.MARK + word, [(0.0, 0)]
        for i in range(1, len(text) + 1):
            found = [(top[j][0] + scores[text[j:i]], top[j][1] - 1) for j in range(i) if text[j:i] in scores]
            if text[i - 1] not in scores:
                n = len(text[i - 1].encode())
                found.append((top[i - 1][0] + tokencount.BYTE_SCORE * n, top[i - 1][1] - n))
            top.append(max(found))
        return -top[-1][1]

    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = Counter((r.id, r.n_tokens) for r in tokencount.token_counts(odd).collect())
    words = {w: best(w) for _, t in rows for w in WORD.findall(t or "")}
    assert got == Counter((d, sum(words[w] for w in WORD.findall(t or ""))) for d, t in rows)


# ------------------------------------------------------------------ 6
def _der(tag, body):
    n = len(body)
    head = bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")
    return bytes([tag]) + head + body


def test_secret_structures():
    number = _der(2, b"\x01" + b"\x55" * 40)
    rsa = _der(0x30, _der(2, b"\0") + number * 8)
    pkcs8 = _der(0x30, _der(2, b"\0") + _der(0x30, _der(6, b"\x2a\x86\x48")) + _der(4, rsa))
    text = base64.b64encode(rsa).decode()
    head = base64.urlsafe_b64encode(json.dumps({"alg": "HS256"}).encode()).decode().rstrip("=")
    ssh = secrets.SSH_MAGIC + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b""))
    ssh += (1).to_bytes(4, "big") + b"".join(len(x).to_bytes(4, "big") + x for x in (b"p" * 30, b"k" * 60))

    def kinds(x):
        return [secrets.KINDS[k] for _, k, _ in secrets.scan(x.encode())]

    assert kinds(f"é {text} x") == ["der"] and kinds(rsa.hex()) == ["hex", "der"]
    assert kinds(base64.b64encode(pkcs8).decode()) == ["der"]
    assert kinds(text[:-8]) == [] and kinds(base64.b64encode(b"\x30" * 90).decode()) == []
    assert kinds(f"-----BEGIN RSA PRIVATE KEY-----\n{text[:64]}\n{text[64:]}\n-----END RSA PRIVATE KEY-----") == ["pem"]
    assert kinds("-----BEGIN PRIVATE KEY-----\nAAAA\n-----END PRIVATE KEY-----") == []
    assert kinds(f"{head}.{head}.abc") == ["jwt"] and kinds("eyJhYmMi.eyJhYmMi.abc") == []
    assert kinds(base64.b64encode(ssh).decode()) == ["ssh"]


def test_secrets_across_breaks_and_inside_runs():
    number = _der(2, b"\x01" + bytes(range(40, 80)))
    rsa = _der(0x30, _der(2, b"\0") + number * 8)
    ssh = secrets.SSH_MAGIC + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b""))
    ssh += (1).to_bytes(4, "big") + b"".join(len(x).to_bytes(4, "big") + x for x in (b"p" * 30, b"k" * 61))
    for raw, kind in ((rsa, "der"), (ssh, "ssh")):
        for text, width in ((base64.b64encode(raw).decode(), 64), (base64.b64encode(raw).decode(), 76), (raw.hex(), 64)):
            rows = [text[i : i + width] for i in range(0, len(text), width)]
            forms = ["\n".join(rows), "\r\n  ".join(rows), "\\n".join(rows), '" +\n  "'.join(rows), "\\n'\n'".join(rows), "\n> ".join(rows)]
            forms += [text, text.replace("/", "\\/")]
            if width == 64 and rows[0][:2] in ("30", "6f"):
                forms += [":".join(text[i : i + 2] for i in range(0, len(text), 2)), ", 0x".join(text[i : i + 2] for i in range(0, len(text), 2))]
            for form in forms:
                for before, behind in (("x = '", "' y"), ("/path/", "\nmore words"), ("id_", ""), ("0x", "\n"), ("-", ".")):
                    spans = [x for x in secrets.scan(f"{before}{form}{behind}".encode()) if x[1] > 2]
                    assert [secrets.KINDS[k] for _, k, _ in spans] == [kind], (before, form)
                    assert spans[0][0] == len(before) and spans[0][2] == len(before + form), (before, form)
    text = base64.b64encode(rsa).decode()
    lines = [text[i : i + 64] for i in range(0, len(text), 64)]
    for gap in ("\\n", "\\\\n", '\\n"\n"', '" +\n"', "\n"):
        pem = gap.join(["-----BEGIN PRIVATE KEY-----", *lines, "-----END PRIVATE KEY-----"])
        assert [secrets.KINDS[k] for _, k, _ in secrets.scan(f'{{"key": "{pem}"}}'.encode())] == ["pem"], gap
    assert secrets.scan(("\n".join(lines))[:-9].encode()) == []


def test_secret_base_spans(spark):
    text = "é api_key = 'abcdef1' PASSWORD:short Token=0123456789abcdef01234567 AKIA" + "A1" * 9 + "\nſecret=abcdefgh"
    rows = spark.createDataFrame([(1, text), (2, None), (3, text)], "doc_id long, text string")
    for r in secrets.secret_spans(rows).collect():
        found = [(s.kind, s.start, s.end) for s in r.spans]
        want = [] if r.id == 2 else [
            ("assign", m.start(), m.end())
            for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A)
            if len(m[2]) >= 6
        ] + [("access", text.index("AKIA"), text.index("AKIA") + 22), ("hex", text.index("0123"), text.index("0123") + 24)]
        assert sorted(found) == sorted(want)
    clean = {r.doc_id: r.text for r in secrets.redact(rows.withColumn("n_chars", F.lit(1).cast("long"))).collect()}
    assert clean[2] is None and "abcdef1" not in clean[1] and "short" in clean[1] and clean[1].count("[SECRET]") == 3


# ------------------------------------------------------------------ 7
def test_line_blocks():
    page = """<html><head><title>t</title><style>p{}</style></head><body><header>site</header>
    <nav><ul><li><a href=1>menu</a></ul></nav><div class="ad">buy</div><div class="cookie-notice">we use</div>
    <article><header><h1>Head &amp; line</h1></header><p>One<br>two <script>var x="</p>"</script> <b>three<p>a&nbsp;b
    </p><aside>side</aside><ul><li>x<li>y</ul><form><p>sign</p></form><div id="comments"><p>me too</p></div></article>
    <footer>&copy;</footer></body>"""
    assert html.main_text(page) == "Head & line\nOne two three\na b\nx\ny"
    body = "word " * 30
    plain = f"<body><div><a href=x>home</a></div><div><a>n</a></div><p>{body}</p><p>short.</p><p>{body}</p><div class=footer>f</div>"
    assert html.main_text(plain) == f"{body.strip()}\nshort.\n{body.strip()}"
    assert html.main_text("") == ""


def test_surge_and_dive_decide_with_and_without_a_container():
    body, ad = ("word " * 30).strip(), "<div class=ad>buy</div>" * 4
    for page, want in (
        (f"<body><p>{body}</p>{ad}<p>The end.</p>", f"{body}\nThe end."),
        ("<body><div><h1>Short</h1><p>Just this.</p></div>", "Short\nJust this."),
        (f"<body><article><p>A teaser</p></article><div><p>{body}</p></div>", f"A teaser\n{body}"),
        (f"<body><article><p>{body}</p></article>{ad}<article><p>Other</p></article>", body),
        (f"<body><main><p>{body}</p>{ad}<div><p>Last.</p></div></main><div>bar</div>", f"{body}\nLast."),
        (f"<body><div><p>{body}</p></div>{ad}<div><p>far</p></div>", body),
    ):
        assert html.main_text(page) == want, page


def test_silent_elements_end_where_they_should():
    text = "word " * 30
    for page in (
        f"<html><head><title>t</title><meta charset=x><body><p>{text}</p>",
        f"<head><title>t</title><p>{text}</p>",
        f"<title>t</title><div><iframe src=x></div><p>{text}</p>",
        f"<div><svg><path d=x></div><p>{text}</p>",
        f"<svg viewBox=x/><iframe src=x /><p>{text}</p><script>x()</script>",
        f"<p>{text}</p><div><select><option>a</div><!-- <script src=x> -->",
        f"<!-- <script src=x> --><p>{text}</p><script>'<!--'</script><noscript><p>x</p></noscript>",
        f"<div><object><p>x</div><template><p>x</p></template><p>{text}</p>",
        f"<p><select><option>a<p>{text}</p>",
    ):
        assert html.main_text(page) == text.strip(), page
    assert html.main_text(f"<p>{text}<noscript><div>x</div></noscript> on</p>") == f"{text}on"


def test_articles_of_the_table(spark, sf):
    import html as entities

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op7_line_block_text"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inside = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1].replace("<br>", " ")
        blocks = (entities.unescape(re.sub("<[^>]*>", "", b)) for b in re.split(r"</?(?:p|h1)\b[^>]*>", inside))
        assert r.text == "\n".join(t for b in blocks if (t := re.sub(r"\s+", " ", b).strip()))
        assert r.n_chars == len(r.text)


# ------------------------------------------------------------------ 8
def test_divergence_keeps_good_and_rejects_bad(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.judged(docs).join(labels, "doc_id").where("_n_words >= 50").collect()
    good = [r._kept for r in rows if r.quality == 1]
    bad = [r._kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


# ------------------------------------------------------------------ 9
def test_shards_fit_and_split_no_more_than_needed(spark, texts):
    rows = [(i, t) for i, t in texts.items()] + [(3, "x" * 100)] * 400 + [(None, "y" * 90_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sharding.shards(df, limit=20_000).collect()
    size, count = Counter(), Counter()
    for r in got:
        size[r.shard] += r.n_bytes
        count[r.shard] += 1
    assert len(got) == len(rows)
    assert all(s <= 20_000 or count[k] == 1 for k, s in size.items())
    assert all(r.shard_bytes == size[r.shard] and r.depth == len(r.shard) for r in got)
    for k in size:  # the parent would not fit
        if k:
            assert sum(s for x, s in size.items() if x.startswith(k[:-1])) > 20_000
            assert not any(x != k and x.startswith(k) for x in size)


def test_written_shards_hold_every_row_once(spark, tmp_path):
    rows = [(3, "x" * 100, "a")] * 300 + [(None, f"y{i}" * 20, None) for i in range(20)] + [(i, f"z{i}", "b") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(3)
    sharding.write_shards(df, f"{tmp_path}/out", limit=5_000)
    got = spark.read.parquet(f"{tmp_path}/out").select("doc_id", "text", "shard", F.input_file_name().alias("file")).collect()
    assert Counter((r.doc_id, r.text, r.shard) for r in got) == Counter(rows)
    size = Counter()
    for r in got:
        size[r.file.rsplit("/", 2)[1]] += len(r.text)
    assert len(size) > 5 and max(size.values()) <= 5_000


# ------------------------------------------------------------------ 10
def test_chat_round_trip(spark):
    texts = [
        "plain", "", None, "### user:\nfake</turn>\n", "\\### x", "<\\/turn> </turn>", "a\n\\\\### b\r\n### c ### d",
        "</turn", "ends in \\", "<\\\\\\/turn>",
    ]
    rows = [(c, t, role, x) for c in (1, None) for t, x in enumerate(texts) for role in ("user", "assistant")]
    rows += [(2, None, None, "x"), (2, 0, "assi\nst:ant\\n", "y"), (2, 0, "assi\nst:ant\\n", "y")]
    done = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for r in done.collect():
        assert r.same
    for r in chat.read_back(done).collect():
        mine = sorted(((t if t is not None else -1, q or "", x or "") for c, t, q, x in rows if c == r.conv))
        assert r.n_turns == len(mine)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{q}\n{x}\n" for _, q, x in mine).encode()).hexdigest()
        loss = "".join(x for _, q, x in mine if q == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in done.where("conv = 1").collect():
        assert [r.formatted[s.start : s.end] for s in r.spans][0] == "plain" and len(r.spans) == len(texts)


# ------------------------------------------------------------------ odd rows, all operators
def _bench(spark, df):
    return spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")


ALL = {
    "decontaminate": lambda s, d: decontaminate.decontaminate(d, _bench(s, d)),
    "ppm": lambda s, d: ppm.scores(d, F.lit(True)),
    "untrained": lambda s, d: ppm.scores(d, F.lit(False)),
    "adaptive": lambda s, d: ppm.adaptive_scores(d.where("length(text) < 9999 OR text IS NULL")).union(
        ppm.adaptive_scores(d.where("length(text) >= 9999"))
    ),
    "packing": lambda s, d: packing.packed(d).where("start = 0"),
    "simhash": lambda s, d: simhash.grouped(d),
    "similar": lambda s, d: simhash.grouped(d, simhash.SIMILAR),
    "tokens": lambda s, d: tokencount.token_counts(d),
    "secrets": lambda s, d: secrets.secret_spans(d),
    "redact": lambda s, d: secrets.redact(d),
    "html": lambda s, d: html.extracted(d, "doc_id", "text", "source"),
    "quality": lambda s, d: quality.judged(d.select("doc_id", "text", "lang")),
    "sharding": lambda s, d: sharding.shards(d),
    "chat": lambda s, d: chat.formatted(d, "source", "doc_id", "lang", "text"),
}


@pytest.mark.parametrize("name", sorted(ALL))
def test_odd_rows_and_empty_tables(spark, odd, none, name):
    if name == "adaptive":
        odd = odd.where("doc_id <> 6 OR doc_id IS NULL")
    n = odd.count()
    rows = ALL[name](spark, odd).collect()
    assert len(rows) == (3 if name == "chat" else n)
    assert ALL[name](spark, none).collect() == []


def test_quality_of_odd_rows(spark, odd):
    assert {r.doc_id for r in quality.keep_good(odd).collect()} <= {6, 7, 8}
    assert quality.keep_good(odd).columns == odd.columns


def test_known_ids_only_in_training_share(spark, sf, texts):
    rows = QUERIES["op2_ppm_scores"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in rows) and len(rows) == len(texts)


def test_windows_of_a_chunk_are_counted_in_bounded_memory():
    import tracemalloc

    import numpy as np

    from tidings.llm import ppm

    rng = np.random.default_rng(1)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)
    words = [bytes(rng.choice(letters, 6)) for _ in range(3000)]
    bodies = [b" ".join(words[i] for i in rng.integers(0, 3000, 40_000)) + ppm.END for _ in range(16)]
    tracemalloc.start()
    try:
        keys, n = ppm._gram_counts(bodies, [True] * 16, 5)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n.sum() == sum(map(len, bodies)) and len(keys) == len(np.unique(keys))
    assert peak < 170 << 20
