"""Word vectors: skip-grams with hierarchical softmax, trained on all partitions and averaged after each pass.

Every pass is one job over all messages.  A task starts from the vectors of the pass before, learns from its
partition and gives the rows it changed; a shuffle by chunks of words averages these over the tasks that changed them.
A task's vectors are its own: threads of one executor that learn on shared ones wait for each other's cache lines.

Inside a task, messages are taken in batches, in which equal pairs of words count once, with their number.  Near the root of
the tree almost every context meets every node, so gradients are products of matrices there; below they are sums
over the pairs' nodes.  A batch's gradients are taken at one point; a word or node that occurs more than ``MOST_USES`` times in it
moves as if it had occurred so often, as more steps from there would go too far.
"""

from __future__ import annotations

import heapq
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle, keyword_only
from pyspark.ml import Estimator
from pyspark.ml.feature import Word2VecModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

# Executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCHES = 64  # of a task's words in a pass
BATCH_WORDS = (256, 1 << 16)  # the fewest and most words of a batch, but for whole messages
MOST_USES = 64.0
COMMON = 512  # a node above this share of all uses, as one in so many, is common
CELLS = 1 << 17  # of the matrices at hand, which then stay in the cache
CHUNK_WORDS = 1024  # words that are averaged together
SEPARATOR = "\x1f"


@dataclass
class Tree:
    """A Huffman tree over words.  Words and nodes are numbered; the words below a node are a stretch.

    Nodes that lie above many uses are common, the others rare.  What a rare node has below it has one common parent,
    so words fall in groups that common nodes do not tell apart.
    """

    group: np.ndarray  # of each word, from left to right
    common: np.ndarray  # nodes
    low: np.ndarray  # of each common node the first group on its left,
    middle: np.ndarray  # the first on its right,
    high: np.ndarray  # and the first beyond
    starts: np.ndarray  # of each word's rare nodes in the next two
    rare: np.ndarray
    right: np.ndarray  # whether the word is on the right

    @classmethod
    def of(cls, counts: dict[str, int]) -> tuple[list[str], Tree]:
        """The words from left to right, and the tree."""
        names = sorted(counts, key=lambda w: (-counts[w], w))
        n = len(names)
        uses = [counts[w] for w in names]
        heap = [(x, i) for i, x in enumerate(uses)]
        heapq.heapify(heap)
        size, children = [1] * n, {}
        while len(heap) > 1:
            (a, left), (b, right) = heapq.heappop(heap), heapq.heappop(heap)
            children[len(size)] = left, right
            heapq.heappush(heap, (a + b, len(size)))
            size.append(size[left] + size[right])
            uses.append(a + b)
        # from the root: parents come first, and get the first numbers
        start, path = [0] * len(size), {len(size) - 1: ()}
        least = uses[-1] / COMMON
        cuts, common = [0] * n, []
        for node in range(len(size) - 1, n - 1, -1):
            left, right = children[node]
            start[left], start[right] = start[node], start[node] + size[left]
            number = len(size) - 1 - node
            often = uses[node] >= least
            if often:
                common.append((number, start[node], start[right], start[node] + size[node]))
                cuts[start[node]] = cuts[start[right]] = 1
            for child, side in ((left, False), (right, True)):
                path[child] = () if often else (*path[node], (number, side))
        group = np.cumsum(cuts) - 1 if common else np.zeros(n, np.int64)
        upto = np.r_[group, group[-1] + 1]
        number, *bounds = np.array(common, np.int64).reshape(-1, 4).T
        order = sorted(range(n), key=start.__getitem__)
        below = [x for i in order for x in path[i]]
        return [names[i] for i in order], cls(
            group, number, *(upto[x] for x in bounds), np.cumsum([0, *(len(path[i]) for i in order)]),
            np.array([x for x, _ in below], np.int64), np.array([x for _, x in below], bool),
        )


def pairs(words: np.ndarray, message: np.ndarray, reach: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and their contexts: all words of the same message up to ``reach`` places away."""
    centers, contexts = [], []
    for d in range(1, window + 1):
        same = message[d:] == message[:-d]
        for own, other, far in ((words[:-d], words[d:], reach[:-d]), (words[d:], words[:-d], reach[d:])):
            use = same & (far >= d)
            centers.append(own[use])
            contexts.append(other[use])
    return np.concatenate(centers), np.concatenate(contexts)


def gradients(
    inner: np.ndarray, outer: np.ndarray, tree: Tree, centers: np.ndarray, contexts: np.ndarray
) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Contexts, how often they occur and their gradients; the same of nodes; all at the given vectors."""
    # equal pairs once, by context
    pair, times = np.unique(contexts.astype(np.int64) * len(inner) + centers, return_counts=True)
    column, center, times = pair // len(inner), pair % len(inner), times.astype(np.float32)
    context, column = np.unique(column, return_inverse=True)
    own = inner[context]
    slopes = np.zeros_like(own)
    node_uses, node_slopes = np.zeros(len(outer), np.float32), np.zeros_like(outer)
    _common(tree, outer, own, column, tree.group[center], times, slopes, node_uses, node_slopes)
    # a cell for each pair and rare node
    sizes = tree.starts[center + 1] - tree.starts[center]
    ends = np.cumsum(sizes)
    at = np.repeat(tree.starts[center] - ends + sizes, sizes) + np.arange(sizes.sum())
    of = np.repeat(np.arange(len(pair)), sizes)
    rows = max(1, CELLS // own.shape[1])
    for cut in range(0, len(at), rows):
        part, mine = at[cut : cut + rows], of[cut : cut + rows]
        node, mine, weight = tree.rare[part], column[mine], times[mine]
        theirs, ours = outer[node], own[mine]
        slope = np.einsum("ij,ij->i", theirs, ours)
        slope = weight * (~tree.right[part] - _chance(slope))
        first = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
        theirs *= slope[:, None]
        slopes[mine[first]] += np.add.reduceat(theirs, first)
        order = np.argsort(node.astype(np.uint16) if len(outer) < 1 << 16 else node, kind="stable")
        node = node[order]
        first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        ours *= slope[:, None]
        node_slopes[node[first]] += np.add.reduceat(ours[order], first)
        node_uses[node[first]] += np.add.reduceat(weight[order], first)
    node = np.flatnonzero(node_uses)
    return (context, np.bincount(column, times), slopes), (node, node_uses[node], node_slopes[node])


def _chance(odds: np.ndarray) -> np.ndarray:
    """The logistic function, in place."""
    np.clip(odds, -30, 30, out=odds)
    np.negative(odds, out=odds)
    np.exp(odds, out=odds)
    odds += 1
    return np.reciprocal(odds, out=odds)


def _common(
    tree: Tree, outer: np.ndarray, own: np.ndarray, column: np.ndarray, group: np.ndarray, times: np.ndarray,
    slopes: np.ndarray, node_uses: np.ndarray, node_slopes: np.ndarray,
) -> None:
    """Adds what the common nodes say, as matrices of nodes and contexts."""
    if not len(tree.common):
        return
    groups = int(tree.high.max())
    nodes = outer[tree.common]
    wide = max(1, CELLS // (groups + 1))
    for at in range(0, len(own), wide):
        end = min(at + wide, len(own))
        of = slice(*np.searchsorted(column, [at, end]))
        # uses of groups up to each place, by context
        upto = np.zeros((groups + 1, end - at), np.float32)
        cells = np.bincount(group[of] * (end - at) + column[of] - at, times[of], groups * (end - at))
        np.cumsum(cells.reshape(groups, -1), axis=0, out=upto[1:])
        lows, middles, highs = upto[tree.low], upto[tree.middle], upto[tree.high]
        highs -= lows  # all below a node
        middles -= lows  # those on its left
        node_uses[tree.common] += highs.sum(axis=1)
        highs *= _chance(nodes @ own[at:end].T)
        middles -= highs
        slopes[at:end] += middles.T @ nodes
        node_slopes[tree.common] += middles @ own[at:end]


def _moved(rate: float, uses: np.ndarray, slopes: np.ndarray) -> np.ndarray:
    return slopes * (rate * np.minimum(1, MOST_USES / np.maximum(uses, 1))).astype(np.float32)[:, None]


@dataclass
class Pass:
    """What the tasks of a pass need."""

    tree: Tree
    inner: np.ndarray  # a row a word
    outer: np.ndarray  # a row a node
    number: int
    passes: int
    total: int  # words of a pass
    partitions: int
    window: int
    rate: float
    seed: int

    def batches(self, blocks: Iterator[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words and the number of their message, in whole messages."""
        least, most = BATCH_WORDS
        size = min(max(self.total // self.partitions // BATCHES, least), most)
        for words, lengths in blocks:
            words, lengths = np.frombuffer(words, np.int32), np.frombuffer(lengths, np.int32)
            ends = np.cumsum(lengths)
            message = np.repeat(np.arange(len(lengths)), lengths)
            parts = max(1, len(words) // size)
            cuts = np.unique(np.r_[0, ends[np.searchsorted(ends, np.arange(1, parts) * len(words) // parts)], len(words)])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                yield words[a:b], message[a:b]

    def learn(self, number: int, blocks: Iterator[tuple]) -> Iterator[tuple]:
        """By table and chunk of its rows, a task's rows where it changed them, else zeros, and which it changed."""
        tables = [self.inner.copy(), self.outer.copy()]
        changed = [np.zeros(len(x), np.float32) for x in tables]
        random = np.random.default_rng([self.seed, self.number, number])
        seen = 0
        for words, message in self.batches(blocks):
            done = (self.number * self.total + self.partitions * seen) / (self.passes * self.total + 1)
            rate = self.rate * max(1 - done, 1e-4)
            reach = self.window - random.integers(0, self.window, len(words))
            centers, contexts = pairs(words, message, reach, self.window)
            seen += len(words)
            if not len(centers) or not len(tables[1]):
                continue
            found = gradients(*tables, self.tree, centers, contexts)
            for table, mark, (at, uses, slopes) in zip(tables, changed, found):
                table[at] += _moved(rate, uses, slopes)
                mark[at] = 1
        if seen:
            for i, (table, mark) in enumerate(zip(tables, changed)):
                for at in range(0, len(table), CHUNK_WORDS):
                    part = slice(at, at + CHUNK_WORDS)
                    yield (i, at), (table[part] * mark[part, None], mark[part])


def _both(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], a[1] + b[1]


_BLOCK = pa.schema([("words", pa.binary()), ("lengths", pa.binary())])


def _numbered(df: DataFrame, known: list[str], longest: int) -> DataFrame:
    """The words' numbers and the lengths of messages, in blocks; other words are left out, long messages cut in parts."""
    known = pa.array(known, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            numbers = pc.index_in(lists.flatten().cast(pa.string()), known)
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            message = np.repeat(np.arange(len(lengths)), lengths)
            use = numbers.is_valid().to_numpy(zero_copy_only=False)
            words = numbers.drop_null().to_numpy().astype(np.int32)
            lengths = np.bincount(message[use], minlength=len(lengths))
            lengths = lengths[lengths > 0]
            parts = -(-lengths // longest)
            cut = np.full(parts.sum(), longest, np.int32)
            cut[np.cumsum(parts) - 1] = lengths - (parts - 1) * longest
            yield pa.RecordBatch.from_pylist([{"words": words.tobytes(), "lengths": cut.tobytes()}], _BLOCK)

    return df.mapInArrow(run, "words binary, lengths binary")


class WordVectors(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Vectors of words and, as a feature, the mean of a message's words; see the module.

    Parameters are those of the engine's own ``Word2Vec``, whose model is fitted.
    """

    vectorSize = Param(Params._dummy(), "vectorSize", "dimensions", TypeConverters.toInt)
    minCount = Param(Params._dummy(), "minCount", "fewest uses of a word", TypeConverters.toInt)
    numPartitions = Param(Params._dummy(), "numPartitions", "partitions that train at once", TypeConverters.toInt)
    maxIter = Param(Params._dummy(), "maxIter", "passes", TypeConverters.toInt)
    windowSize = Param(Params._dummy(), "windowSize", "words of context on a side", TypeConverters.toInt)
    maxSentenceLength = Param(Params._dummy(), "maxSentenceLength", "words of a part of a message", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "first learning rate", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)

    _DEFAULTS = {
        "vectorSize": 100, "minCount": 5, "numPartitions": 1, "maxIter": 1, "windowSize": 5, "maxSentenceLength": 1000,
        "stepSize": 0.025, "seed": 42,
    }

    @keyword_only
    def __init__(
        self, *, inputCol="words", outputCol="vector", vectorSize=100, minCount=5, numPartitions=1, maxIter=1,
        windowSize=5, maxSentenceLength=1000, stepSize=0.025, seed=42,
    ):
        super().__init__()
        self._setDefault(inputCol="words", outputCol="vector", **self._DEFAULTS)
        self._set(**self._input_kwargs)

    def getNumPartitions(self) -> int:
        return self.getOrDefault(self.numPartitions)

    def _fit(self, df: DataFrame) -> Word2VecModel:
        p = {name: self.getOrDefault(name) for name in self._DEFAULTS}
        rows = df.select(F.col(self.getInputCol()).cast("array<string>").alias("words"))
        rows = rows.repartition(p["numPartitions"]).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            uses = rows.select(F.explode("words").alias("word")).groupBy("word").count()
            uses = uses.where((F.col("count") >= p["minCount"]) & F.col("word").isNotNull())
            counts = {r["word"]: r["count"] for r in uses.collect()}
            if not counts:
                raise ValueError("no word is used often enough for a vector")
            vectors = self._vectors(rows, counts, p)
        finally:
            rows.unpersist()
        return jvm_model(vectors, p["vectorSize"], self.getInputCol(), self.getOutputCol())

    def _vectors(self, rows: DataFrame, counts: dict[str, int], p: dict) -> dict[str, np.ndarray]:
        words, tree = Tree.of(counts)
        n, dim, total, context = len(words), p["vectorSize"], sum(counts.values()), rows.sparkSession.sparkContext
        inner = ((np.random.default_rng(p["seed"]).random((n, dim)) - 0.5) / dim).astype(np.float32)
        tables = [inner, np.zeros((n - 1, dim), np.float32)]
        blocks = _numbered(rows, words, p["maxSentenceLength"]).rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for k in range(p["maxIter"]):
                # executors read a broadcast without this package
                now = context.broadcast((tuple(vars(tree).values()), *tables))
                how = k, p["maxIter"], total, p["numPartitions"], p["windowSize"], p["stepSize"], p["seed"]
                changed = blocks.mapPartitionsWithIndex(lambda i, x: Pass(Tree(*now.value[0]), *now.value[1:], *how).learn(i, x))
                found = changed.reduceByKey(_both, min(p["numPartitions"], -(-2 * n // CHUNK_WORDS))).collect()
                for (i, at), (rows_sum, times) in found:
                    some = np.flatnonzero(times)
                    tables[i][at + some] = rows_sum[some] / times[some, None]
                now.destroy()
        finally:
            blocks.unpersist()
        return dict(zip(words, tables[0]))


def jvm_model(vectors: dict[str, np.ndarray], size: int, source: str, out: str) -> Word2VecModel:
    """The vectors as the JVM's model, so that applying it is a projection."""
    spark = SparkSession.active()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    # one array crosses to the JVM
    flat = np.ascontiguousarray([vectors[w] for w in vectors], ">f4").tobytes()
    values = gateway.new_array(jvm.float, len(vectors) * size)
    jvm.java.nio.ByteBuffer.wrap(flat).asFloatBuffer().get(values)
    # and so do the words, unless they can't be told apart there
    if any(not word or SEPARATOR in word for word in vectors):
        words = list(vectors)
    else:
        words = jvm.java.util.regex.Pattern.compile(SEPARATOR).splitAsStream(SEPARATOR.join(vectors)).toList()
    listed = jvm.org.apache.spark.api.python.PythonUtils.toSeq(words)
    places = getattr(jvm.scala.collection.immutable.HashMap, "from")(listed.zipWithIndex())
    made = jvm.org.apache.spark.mllib.feature.Word2VecModel(places, values)
    model = Word2VecModel(jvm.org.apache.spark.ml.feature.Word2VecModel(f"words_{uuid.uuid4().hex[:12]}", made))
    return model._set(inputCol=source, outputCol=out, vectorSize=size)
