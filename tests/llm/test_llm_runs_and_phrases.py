"""Repeated substrings, periodic runs and collocations against brute force, and odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidings.llm import collocations, periods, substrings
from tidings.llm.common import documents
from tidings.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ------------------------------------------------------------------ 11
@pytest.mark.parametrize("period", sorted(substrings.COVERS))
def test_covers_have_every_difference(period):
    cover = substrings.COVERS[period]
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def _repeats(docs, window):
    """Words that stay, by looking at every window in order of (id, row, start)."""
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0, i))
    seen, kept = set(), [None] * len(docs)
    for i in order:
        words = WORD.findall(docs[i][1] or "")
        gone = set()
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            if w in seen:
                gone.update(range(s, s + window))
            seen.add(w)
        kept[i] = (docs[i][0], len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone))
    return Counter(kept)


@pytest.mark.parametrize("window,chunk_words", [(20, 1 << 20), (20, 300), (3, 50), (7, 120), (50, 400)])
def test_substrings_are_those_of_brute_force(spark, window, chunk_words):
    r = random.Random(window)
    common = [f"c{i}" for i in range(90)]
    docs = []
    for i in range(60):
        words = [f"w{r.randrange(4 if i % 7 == 0 else 500)}" for _ in range(r.randrange(0, 120))]
        if i % 2:
            at, a = r.randrange(len(words) + 1), r.randrange(40)
            words[at:at] = common[a : a + r.randrange(5, 60)]
        docs.append((r.choice([i, i, 7, None]), " \t\n"[i % 3].join(words)))
    docs += [(3, docs[5][1]), (-1, docs[9][1]), (None, None), (90, ""), (91, " ".join(common * 3))]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    found = substrings.deduplicate_substrings(df, window=window, chunk_words=chunk_words).collect()
    assert Counter((x.id, x.n_words, x.n_removed, x.kept) for x in found) == _repeats(docs, window)


# ------------------------------------------------------------------ 12
def _runs(words, power=4, least=6):
    """All runs by trying every period at every place."""
    n, found = len(words), []
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, power * q) and not any(
                q % d == 0 and all(words[k] == words[k + d] for k in range(i, i + length - d)) for d in range(1, q)
            ):
                found.append((i, length, q))
            i = j + 1
    return sorted(found)


def _found(texts, **how):
    numbers = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
    sizes = np.array([len(t) for t in texts], np.int64)
    names = np.array([numbers[w] for t in texts for w in t], np.int32)
    ends = np.cumsum(sizes)
    out = [[] for _ in texts]
    for s, n, p in zip(*periods.runs(names, sizes, **how)):
        i = int(np.searchsorted(ends, s, "right"))
        out[i].append((int(s - ends[i] + sizes[i]), int(n), int(p)))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60) | st.lists(st.sampled_from("abcd"), max_size=40), max_size=5))
def test_runs_of_few_letters(texts):
    assert _found(texts) == [_runs(t) for t in texts]
    assert _found(texts, power=3, least=3) == [_runs(t, 3, 3) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=9), st.integers(1, 9)), max_size=6))
def test_runs_of_repeated_blocks(blocks):
    text = "".join(b * n for b, n in blocks)
    assert _found([text]) == [_runs(text)]


def _planted(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    return words


def test_run_query_is_that_of_brute_force(spark, sf, tmp_path):
    r = random.Random(5)
    some = [(x.doc_id, x.text) for x in documents(spark, sf).collect() if len(x.text or "") < 4000]
    docs = some + [(1000 + i, " ".join(r.choices("abc", k=r.randrange(90)))) for i in range(150)] + [(5000, None), (5001, " ")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {x.doc_id: x for x in QUERIES["op12_basic_factor_runs"](spark, str(tmp_path)).collect()}
    assert len(rows) == len(docs)
    chosen = 0
    for doc_id, text in docs:
        words, x = _planted(doc_id, text), rows[doc_id]
        chosen += words != WORD.findall(text or "")
        want = _runs(words)
        gone = {k for s, n, q in want for k in range(s + q, s + n)}
        best = min(want, key=lambda y: (-y[1], y[0], y[2]), default=(None,) * 3)
        assert (x.n_runs, x.start, x.length, x.period) == (len(want), *best)
        assert x.exponent_milli == (1000 * best[1] // best[2] if want else None)
        assert x.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in want).encode()).hexdigest()
        left = " ".join(w for k, w in enumerate(words) if k not in gone)
        assert x.collapsed_sha256 == hashlib.sha256(left.encode()).hexdigest()
    assert chosen > 10 and sum(x.n_runs > 0 for x in rows.values()) > 20


# ------------------------------------------------------------------ 13
def _phrases(docs, least, share=80, longest=4):
    count, total = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        total[lang] += 0
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    key = (lang, tuple(words[i : i + k]))
                    count[key] = count.get(key, 0) + 1
    chosen = {x: a for x, a in count.items() if a >= least and len(x[1]) > 1}
    found = set()
    for (lang, ph), a in chosen.items():
        inside = any(
            x == lang and len(q) > len(ph) and 100 * b >= share * a
            and any(q[i : i + len(ph)] == ph for i in range(len(q) - len(ph) + 1))
            for (x, q), b in chosen.items()
        )
        if not inside:
            cuts = [(count[lang, ph[:k]], count[lang, ph[k:]]) for k in range(1, len(ph))]
            score, _, left, right = min((2_000_000 * a // (x + y), k, x, y) for k, (x, y) in enumerate(cuts))
            found.add((lang, " ".join(ph), a, left, right, total[lang], score))
    return found


@pytest.mark.parametrize("least,chunk_words", [(3, 1 << 20), (5, 200), (2, 1)])
def test_collocations_are_those_of_brute_force(spark, least, chunk_words):
    r = random.Random(least)
    words = ["The", "of", "new", "york", "CITY", "é", "x y", " ", "a\x00b", "ÀB"]
    fixed = ["new York city hall", "The old, mill", "of the new.york"]
    docs = []
    for i in range(80):
        parts = [r.choice(fixed) if r.random() < 0.3 else r.choice(words) for _ in range(r.randrange(30))]
        docs.append((r.choice(["en", "de", None, "und", ""]), "".join(p + r.choice([" ", "  ", "\t", "! ", "\v", " \n"]) for p in parts)))
    docs += [("en", None), (None, ""), ("fr", "one two"), docs[0], docs[0]]
    df = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    rows = collocations.collocations(df, least=least, chunk_words=chunk_words)
    assert {tuple(x) for x in rows.collect()} == _phrases(docs, least)


@pytest.mark.parametrize("longest", [2, 3, 4, 6])
def test_windows_of_a_relation_are_those_of_brute_force(longest):
    r = random.Random(longest)
    for n in [0, 1, 2, *range(3, 60)]:
        place = np.cumsum([r.choice([1, 1, 1, 2]) for _ in range(n)]).astype(np.int64)
        name = np.array([r.randrange(3) for _ in range(n)], np.int32)
        pairs, windows = Counter(), Counter()
        for i in range(n):
            end = i + 1
            while end < n and end - i < longest and place[end] == place[end - 1] + 1:
                end += 1
            pairs[tuple(name[i : min(end, i + 2)].tolist())] += end - i > 1
            windows[tuple(name[i:end].tolist())] += end - i > 2
        found = Counter()
        for at, words, counts in collocations._different(place, name, longest):
            for i, place_, n_ in zip(range(len(at)), at, counts):
                found[(int(name[place_]), *(int(w[i]) for w in words if w[i] >= 0))] += int(n_)
        assert found == +(pairs + windows)


def test_windows_are_shuffled_once_whatever_is_frequent(spark):
    df = spark.createDataFrame([("en", "a b c d a b c d. a b c")] * 40, "lang string, text string").coalesce(1)
    docs = collocations.stored(collocations._occurrences(df, "text", "lang", 1 << 22), "occurrences")
    known = collocations._chunk_words(docs).withColumn("id", F.col("number").cast("long"))
    relation = collocations._first_relation(docs, known.select("chunk", "number", "id"))
    windows = collocations._windows(relation, 4, 3)
    size = lambda r: len(collocations._unpack_bytes(r["n"]))
    assert sum(map(size, windows.collect())) == 4 + 6  # ab bc cd da, abc abcd bcd bcda cdab dabc
    for least, n in ((1, 4 + 4 + 4), (81, 3), (1000, 0)):  # 81: ab bc abc
        found = collocations._frequent(windows, 4, least)
        assert found.count() == n
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(bucket") == 1


def test_ranks_order_by_score_count_and_bytes(spark):
    rows = [("a", p, n, 1, 1, 9, s) for p, n, s in [("é b", 3, 5), ("z b", 3, 5), ("q q", 9, 5), ("x y", 1, 7), ("m", 1, 1)]]
    df = spark.createDataFrame(rows + [("b", "k k", 1, 1, 1, 2, 0)], "lang string, phrase string, a long, l long, r long, n long, score long")
    found = [(x.lang, x["rank"], x.phrase) for x in collocations.ranked(df, top=4, salts=3).orderBy("lang", "rank").collect()]
    assert found == [("a", 1, "x y"), ("a", 2, "q q"), ("a", 3, "z b"), ("a", 4, "é b"), ("b", 1, "k k")]


def test_scores_are_exact_beyond_64_bits(spark):
    big = 4_000_000_000_000_000
    rows = [(big, [big + 1, big], [2 * big + 5, 2 * big + 6]), (big, [big, 3 * big], [3 * big + 9, big + 9])]
    df = spark.createDataFrame(rows, "a long, heads array<long>, tails array<long>")
    found = [tuple(r.cut)[:4] for r in df.select(F.expr(collocations.LOWEST_CUT).alias("cut")).collect()]
    low = 2_000_000 * big // (3 * big + 6)
    assert found == [(low, 0, big + 1, 2 * big + 5), (2_000_000 * big // (4 * big + 9), 0, big, 3 * big + 9)]


# ------------------------------------------------------------------ odd rows
@pytest.mark.parametrize("name", ["substrings", "periods", "collocations"])
def test_odd_rows_and_empty_tables(spark, odd, none, name):
    n = odd.count()
    if name == "substrings":
        rows = substrings.deduplicate_substrings(odd).collect()
        assert len(rows) == n and {r.n_words for r in rows if r.id in (1, 2, 3)} == {0}
        # every window of one repeated word but the first is a repeat
        assert [r.kept for r in rows if r.id == 6] == ["wörd"]
        assert substrings.deduplicate_substrings(none).collect() == []
    elif name == "periods":
        rows = {r.id: r for r in periods.periodic_runs(odd).collect()}
        assert [tuple(x) for x in rows[6].runs] == [(0, 30_000, 1)] and rows[6].collapsed == "wörd"
        assert sum(1 for _ in periods.periodic_runs(odd).collect()) == n and rows[1].runs == []
        assert periods.periodic_runs(none).collect() == []
    else:
        rows = collocations.collocations(odd).collect()
        assert {r.phrase for r in rows} == {"wörd wörd wörd wörd"}
        assert collocations.collocations(none).collect() == []
