"""The pipeline, stage by stage, on planted rows."""

import re
import time
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from tidings.llm import quality
from tidings.llm.common import documents


def test_stages_take_effect(spark, sf, tmp_path):
    import shutil

    docs = documents(spark, sf)
    good = docs.join(quality.judged(docs).where("_kept").select("doc_id"), "doc_id", "left_semi")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    one = good.orderBy(F.length("text").desc()).first()
    words = one.text.split(" ")
    extra = spark.createDataFrame(
        [
            (90_001, one.text, one.lang, "x", one.n_chars),
            (90_002, " ".join(["Changed", *words[1:]]), one.lang, "x", one.n_chars),
            (90_003, " ".join(reversed(words)) + " " + item, one.lang, "x", 1),
            (90_004, " ".join(sorted(words)) + ' token = "0123456789abcdef0123"', one.lang, "x", 1),
            (None, None, None, None, None),
        ],
        docs.schema,
    )
    folder = str(tmp_path)
    docs.union(extra).write.parquet(f"{folder}/documents.parquet")
    shutil.copy(f"{sf}/benchmark.parquet", f"{folder}/benchmark.parquet")
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [rows]
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, seen[-1], folder).persist()
        assert out.columns == rows.columns
        seen.append(out)
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in seen]
    assert None not in ids[1] and {90_001, 90_002, 90_003} <= ids[1]
    assert not {90_001, 90_002} & ids[2] and one.doc_id in ids[2] | {min(ids[2])}
    assert 90_003 in ids[2] and 90_003 not in ids[3]
    assert ids[3] == ids[4]
    assert all("0123456789abcdef0123" not in r.text for r in seen[4].collect())
    # brute force over the same rows, without the operators
    text = [{r.doc_id: r.text or "" for r in df.collect()} for df in seen]
    assert all(_passes_base(t) for t in text[1].values())
    shingles = {d: _runs(t, 5) for d, t in text[1].items()}
    for d in ids[2]:  # no two that stay are near, and what goes is near something
        assert all(_jaccard(shingles[d], shingles[e]) < 0.9 for e in ids[2] if e < d)
    for d in ids[1] - ids[2]:
        assert max(_jaccard(shingles[d], shingles[e]) for e in ids[1] if e != d) >= 0.6
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    whole = {d for d, t in text[2].items() if any(_words(i) and f" {_words(i)} " in f" {_words(t)} " for i in items)}
    parts = set().union(*(_runs(i, 5) for i in items))
    assert whole <= ids[2] - ids[3]
    assert all(_runs(text[2][d], 5) & parts for d in ids[2] - ids[3])
    assert not any(re.search(r"AKIA[A-Z0-9]{16}", t) for t in text[4].values())


def _words(text):
    return " ".join(re.findall(r"[^\x20\x09-\x0D]+", text.lower()))


def _runs(text, n):
    w = _words(text).split(" ")
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def _jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def _passes_base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(zip(w, w[1:], w[2:]))
    twice = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w) >= 50 and 100 * len(twice) <= 50 * len(w)


def test_judged_rows_can_be_filtered(spark):
    """A filter on the verdict stays above the measures, which appear once."""
    rows = quality.judged(documents(spark, "/root/testdata/sf0.01"))
    plan = quality.measured(documents(spark, "/root/testdata/sf0.01")).where("NOT _base_failed")
    plan = plan._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count("xxhash64") == 1
    start = time.time()
    assert 500 < rows.where("_kept").count() < 1000
    assert time.time() - start < 60


def test_run_packs_what_is_left(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    ends = rows.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all"))
    assert ends.where("n <> all").count() == 0 and ends.count() > 50
