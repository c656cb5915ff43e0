"""Word vectors against sums pair by pair, and what fitting reads again."""

import heapq

import numpy as np
import pytest
from pyspark.ml.feature import Word2VecModel
from pyspark.sql import functions as F

from tidings.operators import classifiers, wordvectors


def _paths(counts):
    """Nodes, as the words below them, and sides of each word's path in a Huffman tree."""
    names = sorted(counts, key=lambda w: (-counts[w], w))
    heap = [(counts[w], i, frozenset([w])) for i, w in enumerate(names)]
    heapq.heapify(heap)
    paths, made = {w: [] for w in counts}, len(names)
    while len(heap) > 1:
        (a, _, left), (b, _, right) = heapq.heappop(heap), heapq.heappop(heap)
        for w in left | right:
            paths[w].append((left | right, w in right))
        heapq.heappush(heap, (a + b, made, left | right))
        made += 1
    return paths


def _nodes(words, tree):
    """The words below each node, by its number."""
    below = {int(n): frozenset(w for w, g in zip(words, tree.group) if a <= g < b) for n, a, b in zip(tree.common, tree.low, tree.high)}
    for i, w in enumerate(words):
        for n in tree.rare[tree.starts[i] : tree.starts[i + 1]].tolist():
            below[n] = below.get(n, frozenset()) | {w}
    return below


@pytest.mark.parametrize("common", [0, 4, 10**9])  # all nodes rare, some, none
def test_gradients_are_sums_over_pairs(monkeypatch, common):
    monkeypatch.setattr(wordvectors, "COMMON", common or 1e-9)
    monkeypatch.setattr(wordvectors, "CELLS", 24)
    random = np.random.default_rng(1)
    counts = {f"w{i}": int(n) for i, n in enumerate(random.integers(1, 60, 19))}
    words, tree = wordvectors.Tree.of(counts)
    paths, nodes = _paths(counts), _nodes(words, tree)
    assert len(nodes) == 18 and set(nodes.values()) == {x for path in paths.values() for x, _ in path}
    inner, outer = (random.normal(size=(n, 3)).astype(np.float32) for n in (19, 18))
    centers, contexts = random.integers(0, 19, (2, 200))
    expected, uses = [np.zeros((19, 3)), np.zeros((18, 3))], [np.zeros(19), np.zeros(18)]
    number = {below: n for n, below in nodes.items()}
    for center, context in zip(centers, contexts):
        uses[0][context] += 1
        for below, right in paths[words[center]]:
            n = number[below]
            slope = 1 - right - 1 / (1 + np.exp(-inner[context] @ outer[n]))
            expected[0][context] += slope * outer[n]
            expected[1][n] += slope * inner[context]
            uses[1][n] += 1
    for (at, n, slopes), all_slopes, all_uses in zip(wordvectors.gradients(inner, outer, tree, centers, contexts), expected, uses):
        assert at.tolist() == np.flatnonzero(all_uses).tolist() and n.tolist() == all_uses[at].tolist()
        assert slopes == pytest.approx(all_slopes[at], abs=1e-4)


def test_pairs_stay_inside_messages_and_reach():
    words, message, reach = np.arange(5), np.array([0, 0, 0, 1, 1]), np.array([2, 1, 1, 2, 1])
    found = {(int(a), int(b)) for a, b in zip(*wordvectors.pairs(words, message, reach, 2))}
    assert found == {(0, 1), (0, 2), (1, 0), (1, 2), (2, 1), (3, 4), (4, 3)}


def test_words_used_alike_get_like_vectors(spark):
    rows = [(f"the {a} eats {b} now".split(),) for a in ("cat", "dog") for b in ("fish", "meat")] * 60
    rows += [(f"my {a} drives {b} away".split(),) for a in ("car", "bus") for b in ("far", "fast")] * 60
    df = spark.createDataFrame([*rows, ([],), (None,), (["rare"],)], "words array<string>")
    vectors = wordvectors.WordVectors(inputCol="words", outputCol="v", vectorSize=8, minCount=2, numPartitions=3, maxIter=20, seed=1)
    assert vectors.getNumPartitions() == 3
    model = vectors.fit(df)
    assert isinstance(model, Word2VecModel)
    table = {r.word: r.vector.toArray() for r in model.getVectors().collect()}
    assert set(table) == {w for (x,) in rows for w in x}

    def near(a, b):
        return table[a] @ table[b] / np.linalg.norm(table[a]) / np.linalg.norm(table[b])

    assert near("cat", "dog") > near("cat", "car") and near("car", "bus") > near("dog", "bus")
    mean = model.transform(spark.createDataFrame([(["cat", "dog"],)], "words array<string>")).first().v.toArray()
    assert mean == pytest.approx((table["cat"] + table["dog"]) / 2)
    with pytest.raises(ValueError):
        vectors._set(minCount=10**6).fit(df)


def test_texts_are_normalised_once(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "win cash now" if i % 2 else "see you soon", i % 2) for i in range(40)], "msg_id long, text string, label int")
    plans = []
    once = classifiers.TfidfVectorizer._fit

    def fit(self, df):
        plans.append(df.select(F.col(self.getInputCol()))._jdf.queryExecution().optimizedPlan().toString())
        return once(self, df)

    monkeypatch.setattr(classifiers.TfidfVectorizer, "_fit", fit)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    classifiers.fit_models(rows, {"lr": classifiers.lr_pipeline(5)})
    assert plans and all("InMemoryRelation" in x for x in plans)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
