"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check.

Fingerprints
    A document's words (runs of anything but ASCII blanks, A-Z lower-cased) give
    shingles; a bit is set when it is set in over half the shingle hashes,
    repeats included.  Fewer words than a shingle has: the whole sequence is one
    shingle.  No word or a null text: fingerprint zero, linked like any other.
    Repeated ids keep one row per input row; null ids are kept, and a component
    of nothing but null ids has a null ``component_id``.  An empty table gives
    an empty result.

Links
    Equal fingerprints are one node.  Nodes meet in buckets that share a block of
    bits and are compared there.  A bucket beyond ``bucket_rows`` is dealt anew,
    again and again, until every bucket fits one task; no pair that met in it is
    lost.  With more blocks than differing bits that is by blocks of the bits that
    its members need not share yet.  With fewer, another shared block is no
    certainty, so the bucket is cut into tiles and any two tiles meet in one of
    the new buckets (the lines of a projective plane).  Inside a bucket the search walks from node to unvisited nodes, so a dense group of near copies
    costs about one comparison a member, and only the links of a spanning forest
    leave the task.

With 64 bits, a distance d and d + 1 blocks, two fingerprints within d always
share a block (pigeonhole), on every level of the splitting.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidings.llm.common import documents, mix64, narrow, numbered, small_batches, stored
from tidings.llm.components import connected

_HASH = partial(xxhash.xxh64_intdigest, seed=42)


@dataclass(frozen=True)
class Scheme:
    """How texts become fingerprints and which of those link."""

    shingle: int = 3
    lanes: int = 1  # of 64 bits each
    distance: int = 3
    blocks: int = 4  # of the bits not shared yet, on each level
    block_bits: int = 16  # at most
    bucket_rows: int = 50_000

    @property
    def bits(self) -> int:
        return 64 * self.lanes

    @property
    def pigeonhole(self) -> bool:
        return self.blocks > self.distance


#: Exact: 4 blocks of 16 bits, at most 3 bits differ.
EXACT = Scheme()
#: Five-word shingles, similarity 0.8 or more by estimate.  At a Jaccard
#: similarity of 0.8 two sets of equal size have a cosine of 0.89, which is 15 %
#: of differing bits; the estimate's deviation over 512 bits is 1.6 %.
SIMILAR = Scheme(shingle=5, lanes=8, distance=84, blocks=32, bucket_rows=100_000)


def fingerprint(body: bytes, scheme: Scheme = EXACT) -> bytes:
    """Big-endian fingerprint of one text."""
    words, k = body.lower().split(), scheme.shingle
    if not words:
        return bytes(scheme.bits // 8)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k)))) if len(words) > k else [b" ".join(words)]
    n = max(1, len(words) - k + 1)
    hashes = np.fromiter(map(_HASH, shingles), np.uint64, n)
    counts = np.zeros(scheme.bits, np.int64)
    for start in range(0, n, 255):  # so many fit a byte
        part = hashes[start : start + 255]
        if scheme.lanes > 1:
            seeds = np.arange(1, scheme.lanes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            part = mix64(part[:, None] + seeds[None, :]).reshape(-1)
        bits = np.unpackbits(part.astype(">u8").view(np.uint8)).reshape(-1, scheme.bits)
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > n).tobytes()


def fingerprints(
    docs: DataFrame, scheme: Scheme = EXACT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, fp`` for every row, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            fps = [fingerprint(x, scheme) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary())], names=["id", "fp"])

    rows = narrow(docs, id_col, text_col)
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("fp", T.BinaryType())])
    return rows.mapInArrow(run, schema)


def _layout(path: bytes, bits: int, blocks: int, block_bits: int) -> tuple[tuple[int, ...], ...]:
    """Blocks of the bits that are open after the choices in ``path``."""
    open_bits = list(range(bits))
    parts: tuple[tuple[int, ...], ...] = ()
    for step in range(len(path) + 1):
        n = min(blocks, len(open_bits))
        cuts = [len(open_bits) * i // n for i in range(n + 1)]
        parts = tuple(tuple(open_bits[a:b])[:block_bits] for a, b in zip(cuts, cuts[1:]))
        if step < len(path):
            taken = set(parts[path[step]])
            open_bits = [x for x in open_bits if x not in taken]
    return parts


def _deal(fps: np.ndarray, keys: np.ndarray, path: bytes, scheme: Scheme) -> Iterator[tuple[bytes, np.ndarray]]:
    """New path and bucket key of each row, for each block of the open bits."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(len(fps), -1), axis=1)
    for number, block in enumerate(_layout(path, scheme.bits, scheme.blocks, scheme.block_bits)):
        value = np.zeros(len(fps), np.uint64)
        for bit in block:
            value = (value << np.uint64(1)) | bits[:, bit]
        with np.errstate(over="ignore"):
            key = mix64(keys + np.uint64(number + 1) * np.uint64(0x9E3779B97F4A7C15) + mix64(value))
        yield path + bytes([number]), key


#: Tiles and lines of the projective plane of order 3: tile t lies on the lines
#: t - d, and any two of the 13 tiles have one of these lines in common.
TILES = 13
_PLANE = (0, 1, 3, 9)


def _tile(node: np.ndarray, keys: np.ndarray, path: bytes) -> Iterator[tuple[bytes, np.ndarray]]:
    """New path and bucket key of each row, for each line of its tile."""
    with np.errstate(over="ignore"):
        salt = np.uint64(len(path)) * np.uint64(0xD1342543DE82EF95)  # wraps; other tiles on each level
        tile = mix64(node.view(np.uint64) ^ salt) % np.uint64(TILES)
        for step in _PLANE:
            line = (tile + np.uint64(TILES - step)) % np.uint64(TILES)
            yield path + b"\0", mix64(keys + mix64(line + np.uint64(1)))


_DEALT = "key long, node long, path binary, fp binary, other long"


def _batch(key, node, path, fp, other) -> pa.RecordBatch:
    n = len(key)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(key.view(np.int64)),
            pa.array(node),
            pa.array([path] * n, pa.binary()),
            pa.array(fp if fp is not None else [None] * n, pa.binary()),
            pa.array(other if other is not None else [None] * n, pa.int64()),
        ],
        names=["key", "node", "path", "fp", "other"],
    )


def _redeal(node, fps, keys, paths, scheme) -> Iterator[pa.RecordBatch]:
    for path in sorted(set(paths)):
        mine = np.array([p == path for p in paths])
        raw = [x.tobytes() for x in fps[mine]]
        if scheme.pigeonhole:
            dealt = _deal(fps[mine], keys[mine], path, scheme)
        else:
            dealt = _tile(node[mine], keys[mine], path)
        for new, key in dealt:
            yield _batch(key, node[mine], new, raw, None)


class _Forest:
    """Union by smallest member."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up, root = self.up, x
        while up.get(root, root) != root:
            root = up[root]
        while up.get(x, x) != root:
            up[x], x = root, up[x]
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32) <= distance


def _link(keys: np.ndarray, nodes: np.ndarray, fps: np.ndarray, scheme: Scheme, small: int = 48) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest of each bucket; rows come sorted by key."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    size_of = np.repeat(sizes, sizes)
    forest = _Forest()
    few = np.flatnonzero((size_of > 1) & (size_of <= small))
    for step in range(1, small):
        few = few[few + step < len(keys)]
        few = few[keys[few] == keys[few + step]]
        if not len(few):
            break
        for at in np.array_split(few, len(few) // 100_000 + 1):
            hit = at[_near(fps[at], fps[at + step], scheme.distance)]
            for a, b in zip(nodes[hit].tolist(), nodes[hit + step].tolist()):
                forest.union(a, b)
    for start, size in zip(starts[sizes > small], sizes[sizes > small]):
        open_ = np.arange(start, start + size)
        while len(open_):
            queue, open_ = [open_[0]], open_[1:]
            while queue and len(open_):
                at = queue.pop()
                hit = _near(fps[open_], fps[at], scheme.distance)
                if hit.any():
                    found = open_[hit]
                    open_ = open_[~hit]
                    queue.extend(found)
                    for other in nodes[found].tolist():
                        forest.union(int(nodes[at]), other)
    for x in list(forest.up):
        yield x, forest.find(x)


def _buckets(scheme: Scheme):
    """Partition function: sorted dealt rows to links, or to rows dealt anew."""

    def emit(edges: list[tuple[int, int]]) -> pa.RecordBatch:
        pairs = np.array(edges, np.int64).reshape(-1, 2)
        return _batch(np.zeros(len(pairs), np.uint64), pairs[:, 0], b"", None, pairs[:, 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        over = None  # key of the bucket that is being dealt anew
        for batch in batches:
            key = batch.column(0).to_numpy().view(np.uint64)
            node = batch.column(1).to_numpy()
            paths = batch.column(2).to_pylist()
            fps = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64).reshape(len(key), -1)
            if held is not None:
                key, node, fps = (np.concatenate(x) for x in zip(held[:3], (key, node, fps)))
                paths = held[3] + paths
            if not len(key):
                continue
            if over is not None:
                more = int(np.searchsorted(key.view(np.int64), np.uint64(over).view(np.int64), "right"))
                yield from _redeal(node[:more], fps[:more], key[:more], paths[:more], scheme)
                if more < len(key):
                    over = None
                key, node, fps, paths = key[more:], node[more:], fps[more:], paths[more:]
                held = None
                if not len(key):
                    continue
            last = int(np.searchsorted(key.view(np.int64), key.view(np.int64)[-1], "left"))
            # whole buckets beyond the limit inside this batch
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            wide = np.repeat(sizes > scheme.bucket_rows, sizes)
            done = np.arange(len(key)) < last
            if (wide & done).any():
                pick = np.flatnonzero(wide & done)
                yield from _redeal(node[pick], fps[pick], key[pick], [paths[i] for i in pick], scheme)
            pick = np.flatnonzero(~wide & done)
            if edges := list(_link(key[pick], node[pick], fps[pick], scheme)) if len(pick) else []:
                yield emit(edges)
            held = (key[last:], node[last:], fps[last:], paths[last:])
            if len(held[0]) > scheme.bucket_rows:
                over = held[0][0]
                yield from _redeal(held[1], held[2], held[0], held[3], scheme)
                held = None
        if held is not None and len(held[0]):
            if edges := list(_link(held[0], held[1], held[2], scheme)):
                yield emit(edges)

    return run


def links(nodes: DataFrame, scheme: Scheme = EXACT) -> DataFrame:
    """``u, v``: links of a spanning forest over ``node long, fp binary``."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node, raw = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            fps = np.frombuffer(b"".join(raw), np.uint64).reshape(len(raw), -1)
            for path, key in _deal(fps, np.zeros(len(raw), np.uint64), b"", scheme):
                yield _batch(key, node, path, raw, None)

    dealt = nodes.select("node", "fp").mapInArrow(first, _DEALT)
    found = None
    while True:
        rows = dealt.repartition("key").sortWithinPartitions("key")
        out = stored(rows.mapInArrow(_buckets(scheme), _DEALT), "links")
        edges = out.where("other IS NOT NULL").select(F.col("node").alias("u"), F.col("other").alias("v"))
        found = edges if found is None else found.union(edges)
        dealt = out.where("other IS NULL")
        if dealt.isEmpty():
            return found


def grouped(
    docs: DataFrame, scheme: Scheme = EXACT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, fp, component_id`` for every row; the component is its smallest id."""
    rows = stored(fingerprints(docs, scheme, id_col, text_col), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("id").alias("first_id"))
    nodes = nodes.withColumn("node", _node(scheme))
    roots = connected(links(nodes, scheme))
    nodes = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = nodes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = nodes.join(lowest, "root").select("fp", "component_id")
    return rows.join(known, "fp", "left").select("id", "fp", "component_id")


def _node(scheme: Scheme):
    """64 bits are their own number; wider fingerprints take a hash of theirs."""
    if scheme.lanes > 1:
        return F.xxhash64("fp")
    return F.conv(F.hex("fp"), 16, -10).cast("long")


def deduplicate(
    docs: DataFrame, scheme: Scheme = SIMILAR, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs``, one of each group: the smallest id, of equal ids the first row.

    Rows are told apart by their place in the stored table, so equal rows and
    null ids are handled too (a null id is taken only when the group has no
    other).  The smallest row of a group is found by partial minima.
    """
    placed, place = numbered(docs)
    both = placed.select(F.struct(F.col(id_col).alias("id"), F.col(place).alias("at")).alias("who"), text_col)
    rows = grouped(both, scheme, "who", text_col)
    order = F.struct(F.col("id.id").isNull(), F.col("id.id"), F.col("id.at"))
    keep = rows.groupBy("component_id").agg(F.min_by(F.col("id.at"), order).alias(place))
    return placed.join(keep.select(place), place, "left_semi").drop(place)


def op4_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grouped(documents(spark, sf_dir), EXACT)
    return rows.select(
        F.col("id").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), "component_id"
    )
