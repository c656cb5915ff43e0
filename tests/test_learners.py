"""Boosting, transitions, pooling, digests, shuffles, keyed state and staged writes by themselves."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tidings.operators import boosting, classifiers, features, scoring, sequences, splits, transitions, vocabulary
from tidings.plans.queries import _split, _train
from tidings.sources import artifacts, metrics

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    made = []
    for i in range(600):
        x = rng.random(6) * (rng.random(6) < 0.6)
        y = int(x[0] + 2 * x[1] * (x[2] > 0.3) + 0.3 * rng.standard_normal() > 0.9)
        at = [k for k in range(6) if x[k]]
        made.append((i, y, i % 4 == 0, 1.0 + y, Vectors.sparse(6, at, [float(x[k]) for k in at])))
    return spark.createDataFrame(made, ["i", "label", "held", "w", "features"]).repartition(3).persist()


PARAMS = {
    "featuresCol": "features", "labelCol": "label", "weightCol": "", "heldCol": "", "rounds": 8, "depth": 3, "bins": 8,
    "patience": 3, "rate": 0.3, "penalty": 1.0, "least": 1.0, "rowShare": 1.0, "columnShare": 1.0,
}


def _dense_boost(x, y, edges, rounds, depth, rate, penalty, least):
    """The same trees from dense bins, split by split."""
    bins = np.where(x == 0, 0, 1 + (x[:, :, None] > edges[None]).sum(axis=2))
    margin = np.zeros(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)

        def grow(mine, level):
            whole = -g[mine].sum() / (h[mine].sum() + penalty)
            best = (1e-9, None)
            if level < depth:
                for f in range(x.shape[1]):
                    for b in range(bins.max()):
                        right = mine & (bins[:, f] > b)
                        left = mine & ~right
                        if min(h[right].sum(), h[left].sum()) < least:
                            continue
                        gain = sum(g[m].sum() ** 2 / (h[m].sum() + penalty) for m in (left, right))
                        gain -= g[mine].sum() ** 2 / (h[mine].sum() + penalty)
                        if gain > best[0] + 1e-12:
                            best = (gain, (left, right))
            if best[1] is None:
                margin_new[mine] += rate * whole
            else:
                for part in best[1]:
                    grow(part, level + 1)

        margin_new = margin.copy()
        grow(np.ones(len(y), bool), 0)
        margin = margin_new
    return margin


def test_boosting_is_that_of_dense_arrays(rows):
    trees, width, _ = boosting.boost(rows, **PARAMS)
    edges = boosting.quantile_edges(rows, "features", 8)
    model = boosting.jvm_model(trees, width, 0.3, "features", "")
    found = model.transform(rows).select("label", "features", "probability").collect()
    x = np.array([r.features.toArray() for r in found])
    want = _dense_boost(x, np.array([r.label for r in found]), edges, 8, 3, 0.3, 1.0, 1.0)
    got = np.array([r.probability[1] for r in found])
    assert np.allclose(got, 1 / (1 + np.exp(-want)), atol=1e-9)


def test_round_curve_is_the_model_cut_after_each_round(rows):
    trees, width, losses = boosting.boost(rows, **{**PARAMS, "rounds": 40, "heldCol": "held", "weightCol": "w", "rowShare": 0.8, "columnShare": 0.7})
    assert len(trees) == int(np.argmin(losses)) + 1 and len(losses) <= 40
    held = rows.where("held")
    model = boosting.jvm_model(trees, width, 0.3, "features", "")
    curve = {r["round"]: r for r in boosting.round_curve(held, model).collect()}
    assert sorted(curve) == list(range(1, len(trees) + 1)) and curve[1].n == held.count()
    for k in (1, len(trees)):
        cut = boosting.jvm_model(trees[:k], width, 0.3, "features", "")
        p = [(r.label, r.probability[1]) for r in cut.transform(held).collect()]
        loss = -sum(math.log(q if y else 1 - q) for y, q in p) / len(p)
        assert curve[k].loss == pytest.approx(loss) == pytest.approx(losses[k - 1])
        assert curve[k].accuracy == pytest.approx(sum((q > 0.5) == y for y, q in p) / len(p))


def test_boosting_takes_a_job_a_level(spark, rows):
    sc = spark.sparkContext
    made = {}
    for rounds in (4, 10):
        sc.setJobGroup(f"boost-{rounds}", "boosting")
        trees, _, _ = boosting.boost(rows, **{**PARAMS, "rounds": rounds})
        made[rounds] = len(sc.statusTracker().getJobIdsForGroup(f"boost-{rounds}"))
        assert len(trees) == rounds
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert made[10] - made[4] <= 6 * PARAMS["depth"]


def test_rows_of_one_task_grow_all_trees_in_one_job(spark, rows, monkeypatch):
    sc = spark.sparkContext
    made, found = {}, {}
    for rounds in (2, 9):
        sc.setJobGroup(f"alone-{rounds}", "boosting")
        found[rounds] = boosting.boost(rows, **{**PARAMS, "rounds": rounds, "heldCol": "held"})
        made[rounds] = len(sc.statusTracker().getJobIdsForGroup(f"alone-{rounds}"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert made[9] == made[2]
    # the same trees as by a job a level
    monkeypatch.setattr(boosting, "TASK_ROWS", 100)
    trees, _, losses = boosting.boost(rows, **{**PARAMS, "rounds": 9, "heldCol": "held"})
    assert losses == pytest.approx(found[9][2])
    for one, two in zip(trees, found[9][0], strict=True):
        assert (one.feature == two.feature).all() and one.value == pytest.approx(two.value)


def test_one_task_sums_the_smaller_siblings(rows, monkeypatch):
    params = {**PARAMS, "rounds": 6, "heldCol": "held", "weightCol": "w", "rowShare": 0.8, "columnShare": 0.7}
    edges = boosting.quantile_edges(rows, "features", params["bins"])
    names = {"featuresCol", "labelCol", "weightCol", "heldCol"}
    growth = boosting._Growth(edges=edges, held=True, seed=42, **{k: v for k, v in params.items() if k not in names})
    blocks = boosting.blocks(rows, "features", edges, weight="w", held="held").collect()
    placed = []
    summed = boosting._Task.summed
    monkeypatch.setattr(boosting._Task, "summed", lambda self, place, n: placed.append((n, place)) or summed(self, place, n))
    trees, losses = next(growth.in_task(iter(blocks)))
    task = boosting._Task([boosting._Rows(x) for x in blocks], growth)
    for _, place in placed:
        # below the root at most half of the rows drawn
        assert (place >= 0).all() or 2 * (place >= 0).sum() <= (~task.rows.held).sum()
    # sums of every level as they come row by row
    level = boosting.Level(boosting.Tree(*trees[0]), 1, [1, 2], growth.width, growth.bins, number=0, share=0.8)
    (_, whole, _, cells), = level.added(level.sums(iter(blocks)))
    task.start(boosting.Level(level.tree, 0, [0], growth.width, growth.bins, number=0, share=0.8))
    task.descend(level.tree, 1)
    place = np.where(task.live, task.node - 1, -1)
    assert np.allclose(task.summed(place, 2), cells) and np.allclose(whole.sum(axis=1), [x.sum() for x in task.slopes])


def test_splits_that_differ_by_rounding_are_equal():
    # feature 4 gains more by the last digit only
    a, b = np.array([[3.0, 3.0], [3.0 + 4e-16, 1.0]]), np.array([[5.0, 5.0], [5.0, 2.0]])
    for features in ([2, 4], [4, 2]):
        gain, border, feature, *_ = boosting._best(np.array(features), a, b, 1.0, 10.0, 1.0, 1.0)
        assert (border, feature) == (0, -2) and gain > 0


def test_boosting_sums_are_the_same_in_chunks_and_by_block(rows, monkeypatch):
    params = {**PARAMS, "heldCol": "held", "weightCol": "w", "rowShare": 0.8, "columnShare": 0.7}
    want = None
    for block_rows, task_rows, chunk_cells, dense_cells in ((64, 10**6, 1, 1 << 22), (64, 10**6, 1, 7), (64, 10**6, 1 << 22, 1 << 22)):
        monkeypatch.setattr(boosting, "BLOCK_ROWS", block_rows)
        monkeypatch.setattr(boosting, "TASK_ROWS", task_rows)
        monkeypatch.setattr(boosting, "CHUNK_CELLS", chunk_cells)
        monkeypatch.setattr(boosting, "DENSE_CELLS", dense_cells)
        trees, _, losses = boosting.boost(rows, **params)
        want = want or (trees, losses)
        assert losses == pytest.approx(want[1])
        for one, two in zip(trees, want[0], strict=True):
            assert (one.feature == two.feature).all() and np.allclose(one.value, two.value)
    # several tasks, summed by a shuffle, chunks apart
    monkeypatch.setattr(boosting, "TASK_ROWS", 100)
    for chunk_cells, dense_cells in ((1, 1 << 22), (1, 7)):
        monkeypatch.setattr(boosting, "CHUNK_CELLS", chunk_cells)
        monkeypatch.setattr(boosting, "DENSE_CELLS", dense_cells)
        test_boosting_is_that_of_dense_arrays(rows)


def test_boosted_model_round_trips(spark, rows, tmp_path):
    from pyspark.ml import PipelineModel

    model = boosting.HistogramBoosting(rounds=3, prefix="xgb").fit(rows)
    artifacts.save_model(PipelineModel([model]), f"{tmp_path}/m")
    again = artifacts.load_models(spark, {"xgb": f"{tmp_path}/m"})["xgb"]
    one, two = (m.transform(rows).select("i", F.col("xgb_probability").cast("string")) for m in (model, again))
    assert one.exceptAll(two).isEmpty()


# ------------------------------------------------------------------ transitions
def test_transitions_weigh_words_and_pairs(spark):
    texts = [(0, "1 2 3"), (0, "1 2 4"), (0, "2 2"), (1, "3 1"), (1, "4 1 2"), (1, "3"), (0, "")]
    df = spark.createDataFrame(texts, "label int, text string")
    df = df.select("label", F.filter(F.split("text", " "), lambda w: w != "").alias("words"))
    counted = {(r.prev, r.word): (r.n0, r.n1) for r in transitions.transition_counts(df).collect()}
    want = Counter()
    for y, t in texts:
        w = t.split()
        want.update((a, b, y) for a, b in zip(["", *w], w))
    assert counted == {k: (want[(*k, 0)], want[(*k, 1)]) for k in {x[:2] for x in want}}

    rows = transitions.TransitionFeatures(inputCol="words", outputCol="transitions").transform(df)
    model = transitions.TransitionClassifier(featuresCol="transitions").fit(rows)
    unigram = [Counter(w for y, t in texts if y == c for w in t.split()) for c in (0, 1)]
    pairs = [Counter(p for y, t in texts if y == c for p in zip(t.split(), t.split()[1:])) for c in (0, 1)]

    whole = unigram[0] + unigram[1]

    def chance(c, prev, word):
        share = transitions.WORD_PRIOR * whole[word] / whole.total()
        own = (unigram[c][word] + share) / (unigram[c].total() + transitions.WORD_PRIOR)
        if prev is None:
            return own
        n = sum(v for (a, _), v in pairs[c].items() if a == prev)
        return (pairs[c][prev, word] + transitions.PAIR_PRIOR * own) / (n + transitions.PAIR_PRIOR)

    for r in model.transform(rows).collect():
        odds = math.log(4 / 5)
        for prev, word in zip([None, *r.words], r.words):
            odds += math.log(chance(1, prev, word) / chance(0, prev, word))
        assert r.lstm_probability[1] == pytest.approx(1 / (1 + math.exp(-odds)))


def test_learned_order_beats_the_class_prior_and_is_saved(spark, tmp_path):
    models = classifiers.fit_models(_train(spark, SMALL), {"lstm": classifiers.sequence_pipeline()})
    test = _split(spark, SMALL, "test")
    hits = models["lstm"].transform(test).where("label = 1 AND lstm_prediction = 1")
    assert hits.count() > 0  # the prior alone finds none
    artifacts.save_model(models["lstm"], f"{tmp_path}/lstm")
    loaded = artifacts.load_models(spark, {"lstm": f"{tmp_path}/lstm"})["lstm"]
    a, b = (scoring.predict(test, m, "lstm") for m in (models["lstm"], loaded))
    assert a.exceptAll(b).isEmpty()


# ------------------------------------------------------------------ vectors of words
def test_pooling_leaves_padding_out(spark):
    vectors = spark.createDataFrame([(1, [1.0, -2.0]), (2, [3.0, -4.0])], "id int, vector array<double>")
    df = spark.createDataFrame([(10, [1, 2, 0]), (11, [0, 0, 0]), (12, [9, 1, 1])], "msg_id long, ids array<int>")
    tokens = sequences.token_vectors(df, vectors)
    high = {r.msg_id: (r.n, r.vector) for r in sequences.pool_positions(tokens, 2, "max").collect()}
    mean = {r.msg_id: r.vector for r in sequences.pool_positions(tokens, 2, "mean").collect()}
    assert high == {10: (2, [3.0, -2.0]), 11: (0, [0.0, 0.0]), 12: (2, [1.0, -2.0])}
    assert mean == {10: [2.0, -3.0], 11: [0.0, 0.0], 12: [1.0, -2.0]}


def test_attention_is_a_softmax_over_positions(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.5]), (2, [500.0, -4.0])], "id int, vector array<double>")
    df = spark.createDataFrame([(10, [1, 2, 1, 0]), (11, [0] * 4)], "msg_id long, ids array<int>")
    tokens = sequences.with_positions(sequences.token_vectors(df, vectors), 2)
    got = {r.msg_id: r.vector for r in sequences.attend(tokens, [2.0, -1.0]).collect()}
    table = {1: [1.0, 0.5], 2: [500.0, -4.0]}
    x = np.array([np.array(table[i]) + [math.sin(p), math.cos(p)] for p, i in enumerate([1, 2, 1])])
    s = x @ [2.0, -1.0] / math.sqrt(2)
    w = np.exp(s - s.max())
    assert got[10] == pytest.approx(w @ x / w.sum()) and got[11] == [0.0, 0.0]


def test_forward_pass_is_the_fitted_pipeline(spark):
    pipeline = classifiers.embed_pipeline(dim=6, hidden=5, max_iter=5, passes=2, partitions=2)
    model = classifiers.fit_models(_train(spark, SMALL), {"transformer": pipeline})["transformer"]
    forward = scoring.dense_predictor(*scoring.exported(model))()
    rows = model.transform(_split(spark, SMALL, "test")).select("ids_v1", "transformer_probability").collect()
    got = forward(np.array([r.ids_v1 for r in rows]))
    assert np.allclose(got, [r.transformer_probability[1] for r in rows], atol=1e-9)


# ------------------------------------------------------------------ phrases, indexes
def test_phrases_are_all_frequent_runs(spark):
    texts = ["a b c", "a b c d", "b c d", "a b", "x", ""] * 2
    df = spark.createDataFrame([(t.split(),) for t in texts], "words array<string>")
    found = {r.phrase: r.n for r in vocabulary.frequent_phrases(df, 3, 4).collect()}
    runs = Counter(" ".join(t.split()[i : i + n]) for t in texts for n in (1, 2, 3) for i in range(len(t.split()) - n + 1))
    assert found == {p: n for p, n in runs.items() if n >= 4}
    model = features.PhraseVectorizer(longest=3, maxPhrases=4).fit(df)
    counter = next(s for s in model.stages if isinstance(s, CountVectorizerModel))
    assert counter.vocabulary == sorted(sorted(found, key=lambda p: (-found[p], p))[:4])


def test_large_indexes_are_refused_inside_a_plan(spark):
    index = spark.range(1, 12).select(F.col("id").cast("string").alias("word"), F.col("id").cast("int").alias("idx"))
    df = spark.createDataFrame([(1, ["3", "x", "11"])], "msg_id long, words array<string>")
    with pytest.raises(ValueError):
        features.to_ids(df, index, most=10)
    joined = features.to_ids(df, index, most=10, join=True).first()
    assert joined.ids == features.to_ids(df, index, most=11).first().ids == [3, 11]


# ------------------------------------------------------------------ splits
def test_digests_notice_lost_and_doubled_rows(spark):
    df = spark.createDataFrame([(i, f"t{i % 3}", None if i % 4 else 1) for i in range(50)], "msg_id long, text string, label int")
    parts = df.withColumn("split", F.when(F.col("msg_id") % 2 == 0, "a").otherwise("b"))
    columns = ["msg_id", "text", "label"]

    def whole(table):
        return {r.complete for r in splits.complete(table, df, columns).collect()} == {True}

    assert whole(parts.orderBy(F.rand(1)))
    assert not whole(parts.where("msg_id <> 7"))
    assert not whole(parts.union(parts.where("msg_id = 7")))
    assert not whole(parts.withColumn("text", F.when(F.col("msg_id") == 7, "t9").otherwise(F.col("text"))))


def test_shuffle_positions_are_a_permutation(spark, tmp_path):
    df = spark.range(1000).withColumnRenamed("id", "msg_id").repartition(7)
    found = {r.msg_id: r.position for r in splits.shuffle_positions(df, f"{tmp_path}/s").collect()}
    again = {r.msg_id: r.position for r in splits.shuffle_positions(df.coalesce(1), f"{tmp_path}/t").collect()}
    assert found == again and sorted(found.values()) == list(range(1000))
    assert found != {i: i for i in range(1000)}


# ------------------------------------------------------------------ staged documents
def test_a_failed_update_leaves_the_old_document(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/metrics"
    schema = "model_key string, name string, short string, type string, member int, accuracy double, precision double, recall double, f1 double, color string"

    def one(key, f1):
        return spark.createDataFrame([(key, key, key, "ML", 1, 1.0, 1.0, 1.0, f1, "#0")], schema)

    metrics.update_metrics(spark, one("a", 1.0), path)
    metrics.update_metrics(spark, one("b", 2.0), path)

    def read():
        return {r.model_key: r.f1 for r in metrics.read_metrics(spark, path).collect()}

    def fail(*_):
        raise OSError("no space left")

    for step in ("write_metrics", "swap"):
        with monkeypatch.context() as patch:
            patch.setattr(metrics, step, fail)
            with pytest.raises(OSError):
                metrics.update_metrics(spark, one("a", 9.0), path)
        assert read() == {"a": 1.0, "b": 2.0}
    metrics.update_metrics(spark, one("a", 9.0), path)
    assert read() == {"a": 9.0, "b": 2.0}
