"""Second-order boosting on gradient and Hessian histograms.

Features are counts or weights that are not negative; what a sparse vector leaves out is
zero and bin 0, other values go to at most ``bins`` quantile bins of their feature.
Rows are kept in blocks with their margins, sorted by feature and bin.  Rows that are one
task's work grow all trees in it, since starting a job takes longer than a level of them.  Beyond
that a level of a tree is one job: every task adds up its rows' gradients and Hessians by node, feature and
bin, a shuffle by chunks of features sums these, and the best splits of every node, at most
``2 ** depth`` a chunk, reach the driver.  A tree's first level also adds the tree before to the margins.  Split gains and leaves carry an L2 penalty.  Rows are drawn
anew for each tree by a seeded hash, features by a seeded choice.

Rows flagged as held out have no part in a tree, but their loss is known after every
round; boosting ends when it has not fallen for ``patience`` rounds, and the rounds
up to the best one stay.

The fitted model is a boosted model of the JVM, so scoring is a projection and saving
works as for any other.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, cloudpickle, keyword_only
from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from tidings.session import enable_checkpoints

# Executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 16_384  # numbers of rows have 16 bits
TASK_ROWS = 1 << 17  # a level of fewer takes less time than a job takes to start
CHUNK_CELLS = 1 << 16  # likewise for a task that sums
DENSE_CELLS = 1 << 22  # sums that a task may hold; more are sent by block
CUT_EVERY = 25  # rounds between cuts of the lineage


@dataclass
class Tree:
    """Nodes in heap order: children of i are 2 i + 1 and 2 i + 2; a leaf has feature -1."""

    feature: np.ndarray
    bin: np.ndarray  # greatest bin of the left side
    threshold: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n), np.zeros(n))


def quantile_edges(df: DataFrame, features: str, bins: int) -> np.ndarray:
    """Upper edges of all bins but the last, a row a feature; unused ones are infinite.

    One aggregate over the non-zero entries; features and bins bound the result.
    """
    size = df.select(F.unwrap_udt(F.col(features))["size"].alias("n")).agg(F.max("n")).scalar()
    n = df.select(size.alias("n")).first()
    edges = np.full((int(n[0]) if n and n[0] else 0, max(bins - 1, 0)), np.inf)
    if bins > 1:
        shares = [k / bins for k in range(1, bins)]
        cuts = _entries(df, features).groupBy("i").agg(F.percentile_approx("v", shares, 1000).alias("cuts"))
        for row in cuts.collect():
            distinct = sorted(set(row["cuts"]))
            edges[row["i"], : len(distinct)] = distinct
    return edges


def _entries(df: DataFrame, features: str, *keep: str) -> DataFrame:
    parts = F.unwrap_udt(F.col(features))
    pairs = F.arrays_zip(parts["indices"].alias("i"), parts["values"].alias("v"))
    return df.select(*keep, F.inline(pairs)).where("v <> 0")


_KINDS = {"y": np.float64, "w": np.float64, "held": np.bool_, "row": np.uint16, "slot": np.uint32, "margin": np.float64}
_BLOCK = T.StructType([T.StructField("number", T.LongType())] + [T.StructField(x, T.BinaryType()) for x in _KINDS])


class _Rows:
    """The rows of a block.  Entries lie in order of their slots: features one after another, their bins in order."""

    def __init__(self, block: tuple) -> None:
        self.number = block[0]
        for (name, kind), part in zip(_KINDS.items(), block[1:]):
            setattr(self, name, np.frombuffer(part, kind))

    def packed(self) -> tuple:
        return (self.number, *(getattr(self, x).tobytes() for x in _KINDS))

    def slopes(self) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and Hessian of the log loss; zero for rows that are held out."""
        p = 1 / (1 + np.exp(-self.margin))
        w = np.where(self.held, 0.0, self.w)
        return w * (p - self.y), np.maximum(w * p * (1 - p), 1e-16 * (w > 0))

    def bins_of(self, feature: int, bins: int) -> np.ndarray:
        """Each row's bin of one feature."""
        found = np.zeros(len(self.y), np.int64)
        at = slice(*np.searchsorted(self.slot, np.array([feature * bins, (feature + 1) * bins], np.uint32)))
        found[self.row[at]] = self.slot[at].astype(np.int64) - feature * bins + 1
        return found

    def nodes(self, tree: Tree, levels: int, bins: int) -> np.ndarray:
        """Where each row is after so many levels; rows stop at leaves."""
        node = np.zeros(len(self.y), np.int64)
        for _ in range(levels):
            split = np.flatnonzero(tree.feature[node] >= 0)
            if not len(split):
                break
            features = tree.feature[node[split]]
            for f in np.unique(features).tolist():
                mine = split[features == f]
                right = self.bins_of(f, bins)[mine] > tree.bin[node[mine]]
                node[mine] = 2 * node[mine] + 1 + right
        return node

    def drawn(self, seed: int, tree: int, share: float) -> np.ndarray:
        if share >= 1:
            return np.ones(len(self.y), bool)
        return np.random.default_rng([seed, tree, self.number % 2**31]).random(len(self.y)) < share

    def loss(self) -> tuple[float, float]:
        """Loss of the rows held out, and how many they are."""
        # log(1 + exp(-m)) without overflow
        m = np.where(self.y > 0, self.margin, -self.margin)[self.held]
        return float(np.logaddexp(0, -m).sum()), float(len(m))


def blocks(
    df: DataFrame,
    features: str,
    edges: np.ndarray,
    label: str = "label",
    weight: str | None = None,
    held: str | None = None,
) -> RDD:
    """Rows in blocks, margins zero, dealt evenly to the cluster's tasks; few rows take fewer tasks."""
    width, bins = len(edges), edges.shape[1] + 1
    if width * bins >= 2**32:
        raise ValueError(f"{width} features of {bins} bins are too many")
    tasks = min(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS)) or 1
    parts = F.unwrap_udt(F.col(features))
    rows = df.select(
        F.col(label).cast("double").alias("y"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
        (F.coalesce(F.col(held), F.lit(False)) if held else F.lit(False)).alias("held"),
        parts["indices"].alias("feature"),
        parts["values"].alias("value"),
    ).repartition(tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                lists = part.column("feature")
                feature = lists.flatten().to_numpy().astype(np.int64)
                value = part.column("value").flatten().to_numpy()
                row = np.repeat(np.arange(len(lists), dtype=np.uint16), np.diff(lists.offsets.to_numpy()))[value != 0]
                feature, value = feature[value != 0], value[value != 0]
                slot = (feature * bins + (value[:, None] > edges[feature]).sum(axis=1)).astype(np.uint32)
                order = np.argsort(slot, kind="stable")
                one = _Rows.__new__(_Rows)
                one.number, number = number, number + 1
                one.y, one.w = part.column("y").to_numpy(), part.column("w").to_numpy()
                one.held = part.column("held").to_numpy(zero_copy_only=False)
                one.row, one.slot = row[order], slot[order]
                one.margin = np.zeros(len(lists))
                yield pa.RecordBatch.from_pylist([dict(zip(_BLOCK.names, one.packed()))], _ARROW)

    return rows.mapInArrow(run, _BLOCK).rdd.map(tuple)


_ARROW = pa.schema([("number", pa.int64())] + [(x, pa.binary()) for x in _KINDS])


def _right(cells: np.ndarray) -> np.ndarray:
    """Sums right of each border: bins above it."""
    return np.cumsum(cells[:, ::-1], axis=1)[:, ::-1]


def _best(
    features: np.ndarray, a: np.ndarray, b: np.ndarray, g: float, h: float, penalty: float, least: float
) -> tuple | None:
    """The best split by sums right of each feature's borders: gain, border and feature (negative), right sums.

    Sums are rounded, so splits that gain the same to a billionth are equal: the one at the lowest border wins, then
    that of the first feature.
    """
    least *= 1 - 1e-9
    at, border = np.nonzero((b >= least) & (h - b >= least))
    a, b = a[at, border], b[at, border]
    with np.errstate(all="ignore"):
        gain = a * a / (b + penalty) + (g - a) ** 2 / (h - b + penalty) - g * g / (h + penalty)
    top = np.fmax.reduce(gain, initial=0.0)
    if top <= 1e-9:
        return None
    equal = np.flatnonzero(gain >= top - 1e-9 * (1 + top))
    k = min(equal.tolist(), key=lambda x: (border[x], features[at[x]]))
    return float(gain[k]), -int(border[k]), -int(features[at[k]]), float(a[k]), float(b[k])


@dataclass
class Level:
    """What the tasks of a level need: the nodes to split, and the features in chunks that are summed apart."""

    tree: Tree
    level: int
    active: list[int]
    width: int
    bins: int
    chunks: int = 1
    number: int = 0  # of the tree
    seed: int = 42
    share: float = 1.0
    chosen: np.ndarray | None = None

    @property
    def bounds(self) -> np.ndarray:
        """First features of the chunks, and the end."""
        return np.arange(self.chunks + 1) * self.width // self.chunks

    def sums(self, rows: Iterator[tuple]) -> Iterator[tuple[int, tuple]]:
        """By chunk, a task's gradients and Hessians: of each node, then by node, feature and bin, bin 0 left out.

        The last are cells of ``node, feature, bin`` or, with many zeros, the others' places and values.  The
        loss of the rows held out goes along.
        """
        nodes, slots = len(self.active), self.width * self.bins
        place = np.full(2 ** (self.level + 1) - 1, -1)
        place[self.active] = np.arange(nodes)
        chosen = None if self.chosen is None else np.repeat(self.chosen, self.bins)
        whole, loss = np.zeros((2, nodes)), np.zeros(2)
        dense = np.zeros((2, nodes * slots)) if nodes * slots <= DENSE_CELLS else None
        bounds = self.bounds
        waiting: list[tuple] = []

        def add() -> None:
            key, *slopes = waiting[0] if len(waiting) == 1 else (np.concatenate(x) for x in zip(*waiting))
            waiting.clear()
            for i, x in enumerate(slopes):
                dense[i] += np.bincount(key, x, nodes * slots)

        for block in rows:
            one = _Rows(block)
            loss += one.loss()
            node = place[one.nodes(self.tree, self.level, self.bins)]
            live = one.drawn(self.seed, self.number, self.share) & (node >= 0) & ~one.held
            slopes = one.slopes()
            row, slot = one.row, one.slot
            if chosen is not None or not live.all():
                use = live[row] if chosen is None else live[row] & chosen[slot]
                row, slot = row[use], slot[use]
            key = node[row] * slots + slot
            if dense is None:
                key, at = np.unique(key, return_inverse=True)
                cells = np.array([np.bincount(at, x[row], len(key)) for x in slopes])
                of = np.searchsorted(bounds * self.bins, key % slots, "right") - 1
                for c in np.unique(of).tolist():
                    low, high = bounds[c] * self.bins, bounds[c + 1] * self.bins
                    mine = key[of == c]
                    yield c, (None, None, mine // slots * (high - low) + mine % slots - low, cells[:, of == c])
            for i, x in enumerate(slopes):
                whole[i] += np.bincount(node[live], x[live], nodes)
            if dense is not None:
                # small blocks wait for others
                waiting.append((key, *(x[row] for x in slopes)))
                if 4 * sum(len(x[0]) for x in waiting) >= nodes * slots:
                    add()
        if waiting:
            add()
        for c in range(self.chunks):
            at, cells = None, None
            if dense is not None:
                part = slice(bounds[c] * self.bins, bounds[c + 1] * self.bins)
                cells = dense.reshape(2, nodes, slots)[:, :, part].reshape(2, -1)
                some = np.flatnonzero(cells[1])
                if 3 * len(some) < 2 * cells.shape[1]:
                    at, cells = some, cells[:, some]
            yield c, (whole, loss, at, cells)

    def added(self, found: Iterator[tuple[int, tuple]]) -> Iterator[tuple]:
        """Chunk, sums by node, loss, and ``2, node, feature, bin`` cells of all tasks."""
        chunks: dict[int, list] = {}
        bounds = self.bounds
        for c, (whole, loss, at, cells) in found:
            if c not in chunks:
                shape = (2, len(self.active) * int(bounds[c + 1] - bounds[c]) * self.bins)
                chunks[c] = [np.zeros((2, len(self.active))), np.zeros(2), np.zeros(shape)]
            mine = chunks[c]
            if whole is not None:
                mine[0] += whole
                mine[1] += loss
            if at is not None:
                mine[2][:, at] += cells
            elif cells is not None:
                mine[2] += cells
        for c, (whole, loss, cells) in chunks.items():
            yield c, whole, loss, cells.reshape(2, len(self.active), -1, self.bins)

    def best(self, found: Iterator[tuple], penalty: float, least: float) -> Iterator[tuple]:
        """Sums by node, loss, and each node's best split among a chunk's features: gain, feature, bin, right sums."""
        for c, whole, loss, cells in found:
            splits = {}
            # features without a row of the node in a bin but 0 split nothing
            used = cells[1].any(axis=-1)
            for i, (g, h) in enumerate(whole.T.tolist()):
                features = np.flatnonzero(used[i])
                a, b = (_right(x[i, features]) for x in cells)
                split = _best(features + self.bounds[c], a, b, g, h, penalty, least)
                if split:
                    splits[self.active[i]] = split
            yield whole, loss, splits


def histograms(rows: RDD, level: Level) -> RDD:
    """Chunks of the features with the sums of all tasks; a shuffle brings a chunk's parts together."""
    parts = rows.mapPartitions(level.sums)
    if rows.getNumPartitions() > 1 or level.chunks > 1:
        parts = parts.partitionBy(level.chunks, int)
    return parts.mapPartitions(level.added)


def histogram_table(rows: RDD, level: Level) -> DataFrame:
    """The same as ``node, feature, bin, g, h``; feature -1 has the sums over all rows of a node."""

    def run(found: Iterator[tuple]) -> Iterator[tuple]:
        for c, whole, _, cells in found:
            if c == 0:
                yield from ((n, -1, 0, float(g), float(h)) for n, g, h in zip(level.active, *whole))
            for i, f, b in zip(*(x.tolist() for x in np.nonzero(cells[1]))):
                yield level.active[i], int(level.bounds[c]) + f, b + 1, float(cells[0, i, f, b]), float(cells[1, i, f, b])

    return histograms(rows, level).mapPartitions(run).toDF("node long, feature long, bin long, g double, h double")


def _grown(block: tuple, tree: Tree, rate: float, bins: int) -> tuple:
    """A block with the tree's values added to its margins."""
    one = _Rows(block)
    one.margin = one.margin + rate * tree.value[one.nodes(tree, int(np.log2(len(tree.feature) + 1)) - 1, bins)]
    return one.packed()


class HistogramBoosting(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees; see the module."""

    featuresCol = Param(Params._dummy(), "featuresCol", "features", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label", TypeConverters.toString)
    weightCol = Param(Params._dummy(), "weightCol", "row weight", TypeConverters.toString)
    heldCol = Param(Params._dummy(), "heldCol", "true for rows to validate on", TypeConverters.toString)
    prefix = Param(Params._dummy(), "prefix", "output column prefix", TypeConverters.toString)
    rounds = Param(Params._dummy(), "rounds", "trees", TypeConverters.toInt)
    depth = Param(Params._dummy(), "depth", "levels of splits", TypeConverters.toInt)
    bins = Param(Params._dummy(), "bins", "bins of values that are not zero", TypeConverters.toInt)
    patience = Param(Params._dummy(), "patience", "rounds without a lower loss", TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "share of each tree", TypeConverters.toFloat)
    penalty = Param(Params._dummy(), "penalty", "L2 penalty of leaves", TypeConverters.toFloat)
    least = Param(Params._dummy(), "least", "smallest Hessian of a child", TypeConverters.toFloat)
    rowShare = Param(Params._dummy(), "rowShare", "rows drawn for a tree", TypeConverters.toFloat)
    columnShare = Param(Params._dummy(), "columnShare", "features drawn for a tree", TypeConverters.toFloat)

    _DEFAULTS = {
        "featuresCol": "features", "labelCol": "label", "weightCol": "", "heldCol": "", "prefix": "", "rounds": 100,
        "depth": 6, "bins": 16, "patience": 10, "rate": 0.3, "penalty": 1.0, "least": 1.0, "rowShare": 1.0,
        "columnShare": 1.0,
    }

    @keyword_only
    def __init__(
        self, *, featuresCol="features", labelCol="label", weightCol="", heldCol="", prefix="", rounds=100, depth=6,
        bins=16, patience=10, rate=0.3, penalty=1.0, least=1.0, rowShare=1.0, columnShare=1.0,
    ):
        super().__init__()
        self._setDefault(**self._DEFAULTS)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> GBTClassificationModel:
        p = {name: self.getOrDefault(name) for name in self._DEFAULTS}
        trees, width, _ = boost(df, **{k: v for k, v in p.items() if k != "prefix"})
        return jvm_model(trees, width, p["rate"], p["featuresCol"], p["prefix"])


@dataclass
class _Growth:
    """How trees are grown, wherever the rows are."""

    edges: np.ndarray
    held: bool
    rounds: int
    depth: int
    bins: int
    patience: int
    rate: float
    penalty: float
    least: float
    rowShare: float
    columnShare: float
    seed: int

    @property
    def width(self) -> int:
        return len(self.edges)

    @property
    def cells(self) -> int:
        """Sums of the widest level."""
        return 2 ** max(self.depth - 1, 0) * self.width * self.bins

    def trees(
        self, grow: Callable[[Level], tuple[np.ndarray, np.ndarray, dict[int, tuple]]], settle: Callable[[Tree, int], None]
    ) -> tuple[list[Tree], list[float]]:
        """The trees kept, and the held-out loss of every round made.

        ``grow`` gives a level's sums of the nodes, held-out loss and best splits, ``settle`` adds a
        tree to the margins.
        """
        trees: list[Tree] = []
        losses: list[float] = []
        for number in range(self.rounds + 1):
            chosen = None
            if self.columnShare < 1:
                chosen = np.zeros(self.width, bool)
                order = np.random.default_rng([self.seed, number]).permutation(self.width)
                chosen[order[: max(1, round(self.columnShare * self.width))]] = True
            tree = Tree.empty(self.depth)
            if number == self.rounds and not self.held:
                break

            def at(level: int, active: list[int]) -> Level:
                return Level(tree, level, active, self.width, self.bins, 1, number, self.seed, self.rowShare, chosen)

            # the first level also learns the loss of the tree before
            whole, loss, best = grow(at(0, [0]))
            if self.held and trees and loss[1]:
                losses.append(float(loss[0] / loss[1]))
                if len(losses) - 1 - int(np.argmin(losses)) >= self.patience:
                    break
            if number == self.rounds:
                break
            g, h = whole[:, 0].tolist()
            totals = {0: (g, h)}
            tree.value[0] = -g / (h + self.penalty)
            for level in range(self.depth):
                below: dict[int, tuple[float, float]] = {}
                for node, (_, b, f, gr, hr) in best.items():
                    f, b = -f, -b
                    tree.feature[node], tree.bin[node] = f, b
                    tree.threshold[node] = 0.0 if b == 0 else self.edges[f][b - 1]
                    below[2 * node + 1] = (totals[node][0] - gr, totals[node][1] - hr)
                    below[2 * node + 2] = (gr, hr)
                for child, (g, h) in below.items():
                    tree.value[child] = -g / (h + self.penalty)
                totals = below
                # a node below twice the least Hessian has no split
                active = sorted(x for x, (_, h) in below.items() if h >= 2 * self.least * (1 - 1e-9))
                if not active or level == self.depth - 1:
                    break
                best = grow(at(level + 1, active))[2]
            trees.append(tree)
            settle(tree, number)
        if losses:
            trees = trees[: int(np.argmin(losses)) + 1]
        return trees, losses

    def in_task(self, rows: Iterator[tuple]) -> Iterator[tuple]:
        """All trees, as their arrays, from the rows of one task; then the losses."""
        task = _Task(list(map(_Rows, rows)), self)
        trees, losses = self.trees(task.grow, task.settle)
        yield [(t.feature, t.bin, t.threshold, t.value) for t in trees], losses


class _Task:
    """The rows of a task that grows all trees, numbered through its blocks.

    Of two sibling nodes the one with fewer rows is summed, the other is what that leaves of their parent.  A
    feature with too few Hessians in a node for a child of it is not looked at in the nodes below.
    """

    def __init__(self, blocks: list[_Rows], growth: _Growth) -> None:
        self.blocks, self.growth = blocks, growth
        starts = np.cumsum([0, *(len(x.y) for x in blocks)])
        slot = np.concatenate([np.zeros(0, np.uint32), *(x.slot for x in blocks)])
        row = np.concatenate([np.zeros(0, np.int32), *(x.row + np.int32(at) for x, at in zip(blocks, starts.tolist()))])
        # entries by row, and rows by slot
        self.slot = slot[np.argsort(row, kind="stable")].astype(np.int64)
        self.ends = np.cumsum(np.r_[0, np.bincount(row, minlength=int(starts[-1]))])
        self.row = row[np.argsort(slot, kind="stable")]
        self.slot_ends = np.cumsum(np.r_[0, np.bincount(slot, minlength=growth.width * growth.bins)])
        self.rows = _Rows.__new__(_Rows)
        for name in ("y", "w", "held", "margin"):
            setattr(self.rows, name, np.concatenate([np.zeros(0, _KINDS[name]), *(getattr(x, name) for x in blocks)]))

    def start(self, level: Level) -> None:
        """A new tree: the rows drawn for it and their slopes, all at the root."""
        drawn = [x.drawn(level.seed, level.number, level.share) for x in self.blocks]
        self.live = np.concatenate([np.zeros(0, bool), *drawn]) & ~self.rows.held
        self.slopes = [np.where(self.live, x, 0.0) for x in self.rows.slopes()]
        self.node, self.depth = np.zeros(len(self.live), np.int64), 0
        self.features = {0: np.arange(level.width) if level.chosen is None else np.flatnonzero(level.chosen)}

    def descend(self, tree: Tree, depth: int) -> None:
        """Rows go on to the nodes of a level, or stop at leaves."""
        bins = self.growth.bins
        for level in range(self.depth, depth):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                f = int(tree.feature[node])
                if f >= 0:
                    right = np.zeros(len(self.node), bool)
                    right[self.row[self.slot_ends[f * bins + int(tree.bin[node])] : self.slot_ends[(f + 1) * bins]]] = True
                    mine = np.flatnonzero(self.node == node)
                    self.node[mine] = 2 * node + 1 + right[mine]
        self.depth = depth

    def summed(self, place: np.ndarray, nodes: int) -> np.ndarray:
        """Gradients and Hessians by node, feature and bin of the rows with a place among so many nodes."""
        slots = self.growth.width * self.growth.bins
        rows = np.flatnonzero(place >= 0)
        sizes = self.ends[rows + 1] - self.ends[rows]
        if len(rows) == len(place):
            slot = self.slot
        else:
            slot = self.slot[np.repeat(self.ends[rows] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
        if nodes > 1:
            slot = slot + np.repeat(place[rows] * slots, sizes)
        sums = [np.bincount(slot, np.repeat(x[rows], sizes), nodes * slots) for x in self.slopes]
        return np.array(sums).reshape(2, nodes, self.growth.width, self.growth.bins)

    def grow(self, level: Level) -> tuple[np.ndarray, np.ndarray, dict[int, tuple]]:
        if level.level == 0:
            self.start(level)
        self.descend(level.tree, level.level)
        size = 2 ** (level.level + 1) - 1
        whole = np.array([np.bincount(self.node, x, size) for x in self.slopes])
        if level.level == 0:
            self.sums = {0: self.summed(self.node, 1)[:, 0]}
        else:
            rows = np.bincount(self.node[self.live], minlength=size).tolist()
            # the right child of a node has an even number
            pairs = {(x - 1) // 2: (x - 1 + x % 2, x + x % 2) for x in level.active}
            fewer = [min(pair, key=rows.__getitem__) for pair in pairs.values()]
            place = np.full(size, -1)
            place[fewer] = np.arange(len(fewer))
            found = self.summed(np.where(self.live, place[self.node], -1), len(fewer))
            sums = {}
            for i, (parent, pair) in enumerate(pairs.items()):
                for x in pair:
                    if x in level.active:
                        sums[x] = found[:, i] if x == fewer[i] else self.sums[parent] - found[:, i]
            self.sums = sums
        best: dict[int, tuple] = {}
        features = {}
        for x in level.active:
            features[x], split = self.best(self.features[(x - 1) // 2 if x else 0], *self.sums[x], *whole[:, x].tolist())
            if split:
                best[x] = split
        self.features = features
        return whole[:, level.active], np.array(self.rows.loss()), best

    def best(self, features: np.ndarray, a: np.ndarray, b: np.ndarray, g: float, h: float) -> tuple[np.ndarray, tuple | None]:
        """The features with Hessians enough for a child, and the best split."""
        least = self.growth.least
        b = _right(b[features])
        enough = b[:, 0] >= least * (1 - 1e-9)
        features = features[enough]
        return features, _best(features, _right(a[features]), b[enough], g, h, self.growth.penalty, least)

    def settle(self, tree: Tree, number: int) -> None:
        self.descend(tree, self.growth.depth)
        self.rows.margin = self.rows.margin + self.growth.rate * tree.value[self.node]


def boost(
    df: DataFrame, featuresCol: str, labelCol: str, weightCol: str, heldCol: str, rounds: int, depth: int, bins: int,
    patience: int, rate: float, penalty: float, least: float, rowShare: float, columnShare: float, seed: int = 42,
) -> tuple[list[Tree], int, list[float]]:
    """The trees kept, the number of features, and the held-out loss of every round made."""
    enable_checkpoints(df.sparkSession)
    edges = quantile_edges(df, featuresCol, bins)
    growth = _Growth(edges, bool(heldCol), rounds, depth, bins, patience, rate, penalty, least, rowShare, columnShare, seed)
    rows = blocks(df, featuresCol, edges, labelCol, weightCol or None, heldCol or None)
    tasks = rows.getNumPartitions()
    if tasks == 1 and growth.cells <= DENSE_CELLS:
        found, losses = rows.mapPartitions(growth.in_task).collect()[0]
        return [Tree(*arrays) for arrays in found], len(edges), losses
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    old = None

    def grow(level: Level) -> tuple[np.ndarray, np.ndarray, dict[int, tuple]]:
        """The first level of a tree also stores the new margins."""
        nonlocal old
        cells = len(level.active) * level.width * bins
        level.chunks = max(1, min(level.width, max(min(tasks, -(-cells // CHUNK_CELLS)), -(-cells // DENSE_CELLS))))
        best: dict[int, tuple] = {}
        for whole, loss, splits in histograms(rows, level).mapPartitions(lambda x: level.best(x, penalty, least)).collect():
            for node, one in splits.items():
                best[node] = max(best.get(node, one), one)
        if old is not None:
            old.unpersist()
            old = None
        return whole, loss, best

    def settle(tree: Tree, number: int) -> None:
        nonlocal rows, old
        old, rows = rows, rows.map(lambda block: _grown(block, tree, rate, bins)).persist(StorageLevel.MEMORY_AND_DISK)
        if number % CUT_EVERY == CUT_EVERY - 1:
            rows.checkpoint()

    try:
        trees, losses = growth.trees(grow, settle)
        return trees, len(edges), losses
    finally:
        rows.unpersist()
        if old is not None:
            old.unpersist()


def jvm_model(trees: list[Tree], width: int, rate: float, features: str, prefix: str) -> GBTClassificationModel:
    """The same trees as a model of the JVM, whose margins count half as much."""
    spark = SparkSession.active()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    nodes = jvm.org.apache.spark.ml.tree
    leaf, inner, border = nodes.LeafNode, nodes.InternalNode, nodes.ContinuousSplit
    stats = gateway.new_array(jvm.double, 3)
    nothing = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator(stats, 0)

    def node(tree: Tree, i: int):
        value = float(rate * tree.value[i] / 2)
        if tree.feature[i] < 0:
            return leaf(value, 0.0, nothing)
        split = border(int(tree.feature[i]), float(tree.threshold[i]))
        return inner(value, 0.0, 0.0, node(tree, 2 * i + 1), node(tree, 2 * i + 2), split, nothing)

    kind = jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    made = gateway.new_array(kind, len(trees))
    weights = gateway.new_array(jvm.double, len(trees))
    for i, tree in enumerate(trees):
        made[i] = kind(f"tree_{uuid.uuid4().hex[:12]}", node(tree, 0), width)
        weights[i] = 1.0
    model = GBTClassificationModel(
        jvm.org.apache.spark.ml.classification.GBTClassificationModel(f"boosted_{uuid.uuid4().hex[:12]}", made, weights, width, 2)
    )
    start = f"{prefix}_" if prefix else ""
    return model._set(
        featuresCol=features, predictionCol=f"{start}prediction", probabilityCol=f"{start}probability",
        rawPredictionCol=f"{start}raw",
    )


def round_curve(df: DataFrame, model: GBTClassificationModel, label: str = "label") -> DataFrame:
    """``round, n, loss, accuracy`` of a boosted model cut after every round, in one pass over the rows.

    Each row's trees are evaluated once; their running sums are the margins of all rounds.
    """
    trees = [_flat(t) for t in model.trees]
    parts = F.unwrap_udt(F.col(model.getOrDefault("featuresCol")))
    rows = df.select(F.col(label).cast("double").alias("y"), parts["indices"].alias("i"), parts["values"].alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                y = part.column(0).to_numpy()
                sizes = np.diff(part.column(1).offsets.to_numpy())
                row = np.repeat(np.arange(len(y)), sizes)
                feature, value = part.column(1).flatten().to_numpy(), part.column(2).flatten().to_numpy()
                order = np.argsort(feature, kind="stable")
                row, feature, value = row[order], feature[order], value[order]
                margin = np.zeros(len(y))
                losses, right = [], []
                for tree in trees:
                    margin = margin + 2 * _evaluated(tree, row, feature, value, len(y))
                    losses.append(np.logaddexp(0, np.where(y > 0, -margin, margin)).sum())
                    right.append(((margin > 0) == (y > 0)).sum())
                n = len(trees)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(1, n + 1)), pa.array(np.full(n, len(y))), pa.array(np.array(losses)), pa.array(np.array(right, np.int64))],
                    names=["round", "n", "loss", "hits"],
                )

    found = rows.mapInArrow(run, "round long, n long, loss double, hits long")
    return found.groupBy("round").agg(
        F.sum("n").alias("n"), (F.sum("loss") / F.sum("n")).alias("loss"), (F.sum("hits") / F.sum("n")).alias("accuracy")
    )


def _flat(tree) -> list[tuple]:
    """Nodes of a JVM tree: feature, threshold, left, right, value."""
    made: list[tuple] = []

    def add(node) -> int:
        at = len(made)
        made.append(())
        if node.subtreeDepth() == 0:
            made[at] = (-1, 0.0, 0, 0, node.prediction())
        else:
            split = node.split()
            made[at] = (split.featureIndex(), split.threshold(), add(node.leftChild()), add(node.rightChild()), node.prediction())
        return at

    add(tree._java_obj.rootNode())
    return made


def _evaluated(tree: list[tuple], row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Each row's value of a tree; entries lie in order of their features."""
    out = np.zeros(n)
    todo = [(0, np.arange(n))]
    while todo:
        at, mine = todo.pop()
        f, threshold, left, right, result = tree[at]
        if f < 0:
            out[mine] = result
            continue
        dense = np.zeros(n)
        own = slice(*np.searchsorted(feature, [f, f + 1]))
        dense[row[own]] = value[own]
        goes = dense[mine] <= threshold
        todo += [(left, mine[goes]), (right, mine[~goes])]
    return out
