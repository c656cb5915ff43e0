"""Long repeated substrings, found through difference-cover anchors.

A window is ``WINDOW`` consecutive words of one document.  A window whose words also
start earlier (smaller id, then earlier row, then earlier word) is a repeat, and every
word that a repeat covers is removed; windows are judged on the input.

Anchors are stretches of ``WINDOW - v + 1`` words that start at positions whose
residue modulo a period ``v`` is in a difference cover: any two residues differ by some
pair of the cover.  So two equal windows, wherever they start, have anchors at the
same distance from their starts, and these are equal.  Only cover positions are
hashed and shuffled.  Anchors that occur again are extended: first to all windows that
can hold them.  Where these surroundings are the same, so is each of their windows, and
all but the earliest are repeats.  Only the first of each surroundings of an anchor that
has several, as at the ends of a passage, extends window by window.  Both are compared
by 128-bit hashes.

On Spark: documents become chunks of word numbers of bounded size, one row each, stored
once, in buckets by their number, so what chunks get back comes to them.  A chunk sends each of its different anchors once and gets back those that occur
again; it sends each of their different surroundings once, with the first place, and
gets back which come earlier in another chunk and which anchors have several; then
the same with the windows that are open.  An anchor or passage that a third of
all rows share is thereby one row a chunk, not one an occurrence.

Defined results: a null or blank text has no words and nothing is removed; null ids
come first in the order, equal ids follow the order of their rows, so of repeated rows
the first stays; a very long text is a chunk of its own; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidings.llm.common import Numbers, bucketed, documents, join_words, mix64, narrow, small_batches, split_words, stored

WINDOW = 20
CHUNK_WORDS = 1 << 20
#: Perfect difference sets: every residue but zero is a difference exactly once.
COVERS = {
    3: (0, 1),
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (0, 1, 4, 14, 16),
    31: (0, 1, 3, 8, 12, 18),
}
_STEP = np.uint64(0x9E3779B97F4A7C15)


def cover_of(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest period whose anchors keep a third of the window, and its cover."""
    period = max((v for v in COVERS if 3 * (window - v + 1) >= window), default=3)
    if window < period:
        raise ValueError("a window has at least 3 words")
    return period, COVERS[period]


def rolled(values: np.ndarray, length: int) -> np.ndarray:
    """A hash of every stretch of ``length`` values, by doubling."""
    found, done, power, size = None, 0, values, 1
    with np.errstate(over="ignore"):
        while size <= length:
            if length & size:
                if found is None:
                    found = power
                else:
                    n = max(0, len(values) - done - size + 1)
                    found = mix64(found[:n] * _STEP + power[done : done + n])
                done += size
            n = max(0, len(power) - size)
            power = mix64(power[:n] * _STEP + power[size : size + n])
            size *= 2
    return found


def _row(chunk: int, ids: list, names: list[np.ndarray], words: Numbers, kind: pa.DataType) -> pa.RecordBatch:
    """One chunk: its documents in order of id, their word numbers, the words."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] if ids[i] is not None else 0, i))
    pack = zstandard.ZstdCompressor(level=1).compress
    sizes = np.array([len(names[i]) for i in order], np.int64)
    flat = np.concatenate([names[i] for i in order])
    columns = [
        pa.array([chunk]),
        pa.array([[ids[i] for i in order]], pa.list_(kind)),
        pa.array([sizes.tobytes()], pa.binary()),
        pa.array([pack(flat.tobytes())], pa.binary()),
        pa.array([pack(b" ".join(words))], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["chunk", "ids", "sizes", "names", "words"])


def chunks(docs: DataFrame, id_col: str, text_col: str, chunk_words: int) -> DataFrame:
    """``chunk, ids, sizes, names, words``: word numbers of some documents in a row.

    Chunk numbers follow the order of the rows.
    """
    rows = narrow(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        words, ids, names, held, kind = Numbers(), [], [], 0, None
        for batch in batches:
            kind = batch.schema.field(0).type
            for part in small_batches([batch]):
                flat, sizes = split_words(part.column(1))
                numbers = words.of_array(flat)
                words.new.clear()
                names += np.split(numbers, np.cumsum(sizes)[:-1])
                ids += part.column(0).to_pylist()
                held += len(numbers) + len(sizes)
                if held >= chunk_words:
                    yield _row(chunk, ids, names, words, kind)
                    chunk += 1
                    words, ids, names, held = Numbers(), [], [], 0
        if ids:
            yield _row(chunk, ids, names, words, kind)

    id_type = rows.schema["id"].dataType
    schema = T.StructType(
        [T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(id_type))]
        + [T.StructField(x, T.BinaryType()) for x in ("sizes", "names", "words")]
    )
    return rows.mapInArrow(run, schema)


class _Chunk:
    """A chunk's words behind each other."""

    def __init__(self, row: pa.Table, window: int) -> None:
        unpack = zstandard.ZstdDecompressor().decompress
        chunk, sizes, names, words = (row.column(x)[0].as_py() for x in ("chunk", "sizes", "names", "words"))
        self.chunk, self.window = chunk, window
        self.period, self.cover = cover_of(window)
        self.anchor = window - self.period + 1
        self.sizes = np.frombuffer(sizes, np.int64)
        self.names = np.frombuffer(unpack(names), np.int32)
        self.words = unpack(words).split(b" ")
        ends = np.cumsum(self.sizes)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.start, self.end = (ends - self.sizes)[self.doc], ends[self.doc]
        self.whole = np.arange(len(self.names)) + window <= self.end  # windows that start here
        raw = b"".join(map(xxhash.xxh3_128_digest, self.words))
        self.lanes = [np.ascontiguousarray(x)[self.names] for x in np.frombuffer(raw, np.uint64).reshape(-1, 2).T]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Cover positions that have a whole anchor, and the anchors' hashes."""
        hashes = rolled(self.lanes[0], self.anchor)
        inside = np.zeros(self.period, bool)
        inside[list(self.cover)] = True
        at = np.arange(len(hashes))
        start, end = self.start[: len(hashes)], self.end[: len(hashes)]
        place = np.flatnonzero(inside[(at - start) % self.period] & (at + self.anchor <= end))
        return place, hashes[place]

    def around(self, place: np.ndarray) -> np.ndarray:
        """A hash of the words of all windows that hold the anchor at a place, and of where its document ends."""
        left, length = self.period - 1, self.window + self.period - 1
        gap = length  # what is outside a document is zero
        shifted = np.arange(len(self.names)) + (self.doc + 1) * gap
        lane = np.zeros(len(self.names) + (len(self.sizes) + 1) * gap, np.uint64)
        lane[shifted] = self.lanes[1]
        return rolled(lane, length)[shifted[place] - left]

    def classes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchor places with their hashes, ordered into classes of equal surroundings."""
        place, h = self.anchors()
        g = self.around(place) if len(place) else h
        return place, h, g, *_classes(h, g)

    def judged(self, later: np.ndarray, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows known to be repeats, and those still open.

        ``later`` and ``mixed`` are first places of classes: those that another
        chunk has earlier, and those whose anchor has other surroundings too.
        """
        place, _, _, order, new = self.classes()
        repeat = np.ones(len(place), bool)
        repeat[new] = np.isin(place[order[new]], later)
        first = place[order[new]]
        known = self._holding(place[order[repeat]]) & self.whole
        maybe = self._holding(first[np.isin(first, mixed)]) & self.whole & ~known
        return known, np.flatnonzero(maybe)

    def _holding(self, place: np.ndarray) -> np.ndarray:
        """Starts of windows that hold an anchor at one of the places."""
        total = len(self.names)
        steps = np.bincount(np.maximum(place - self.period + 1, self.start[place]), minlength=total + 1)
        return np.cumsum(steps - np.bincount(place + 1, minlength=total + 1))[:total] > 0

    def hashes(self, at: np.ndarray) -> list[np.ndarray]:
        return [rolled(lane, self.window)[at] for lane in self.lanes] if len(at) else [np.zeros(0, np.uint64)] * 2

    def rows(self, ids: pa.Array, at: np.ndarray, **columns: np.ndarray) -> pa.Table:
        made = {k: x.view(np.int64) for k, x in columns.items()}
        made |= {"chunk": np.full(len(at), self.chunk, np.int64), "at": at, "id": ids.take(pa.array(self.doc[at]))}
        return pa.table(made)


def _classes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of value, and where in it each new value begins; equal ones keep their order."""
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    new = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(x) else np.zeros(0, np.int64)
    return order, new


def _ids(row: pa.Table) -> pa.Array:
    return row.column("ids").combine_chunks().flatten()


def _anchor_rows(rows: DataFrame, window: int) -> DataFrame:
    """``chunk, h, n``: different anchors of each chunk; ``n`` is 2 for those that it has twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = _Chunk(pa.Table.from_batches([batch.slice(i, 1)]), window)
                found, n = np.unique(one.anchors()[1], return_counts=True)
                for at in range(0, len(found), 100_000):
                    some = found[at : at + 100_000].view(np.int64)
                    twice = np.minimum(n[at : at + 100_000], 2).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(some), one.chunk)), pa.array(some), pa.array(twice)],
                        names=["chunk", "h", "n"],
                    )

    return rows.select("chunk", "sizes", "names", "words").mapInArrow(run, "chunk long, h long, n int")


LATER, MIXED, WINDOW_LATER = 1, 2, 3


def deduplicate_substrings(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    chunk_words: int = CHUNK_WORDS,
) -> DataFrame:
    """``id, n_words, n_removed, kept``: every row, ``kept`` being its words that stay, a blank apart."""
    cover_of(window)
    rows = bucketed(chunks(docs, id_col, text_col, chunk_words), "chunk", "chunks")
    by_chunk = rows.groupBy("chunk")
    id_field = T.StructField("id", rows.schema["ids"].dataType.elementType)

    def longs(*names: str) -> T.StructType:
        return T.StructType([T.StructField(x, T.LongType()) for x in names])

    again = (
        _anchor_rows(rows, window)
        .withColumn("n", F.sum("n").over(Window.partitionBy("h")))
        .where("n > 1")
        .select("chunk", "h")
    )

    def surround(left: pa.Table, right: pa.Table) -> pa.Table:
        one = _Chunk(left, window)
        place, h, g, order, new = one.classes()
        first = order[new]
        first = first[np.isin(h[first], right.column("h").to_numpy().view(np.uint64))]
        return one.rows(_ids(left), place[first], h=h[first], g=g[first])

    found = by_chunk.cogroup(again.groupBy("chunk")).applyInArrow(surround, longs("h", "g", "chunk", "at").add(id_field))
    # of the chunks that have a class, all but the earliest; anchors with several classes
    same, anchor = Window.partitionBy("h", "g").orderBy("id", "chunk"), Window.partitionBy("h")
    found = found.withColumns({"n": F.row_number().over(same), "few": F.min("g").over(anchor), "many": F.max("g").over(anchor)})
    state = F.when(F.col("n") > 1, LATER).when(F.col("few") != F.col("many"), MIXED)
    states = stored(found.select("chunk", "at", state.alias("state")).where("state IS NOT NULL"), "states")

    def judge(one: _Chunk, right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        at, state = right.column("at").to_numpy(), right.column("state").to_numpy()
        return one.judged(at[state == LATER], at[state == MIXED])

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        one = _Chunk(left, window)
        at = judge(one, right)[1]
        a, b = one.hashes(at)
        order, new = _classes(a, b)
        first = order[new]
        return one.rows(_ids(left), at[first], a=a[first], b=b[first])

    open_ = by_chunk.cogroup(states.groupBy("chunk")).applyInArrow(extend, longs("a", "b", "chunk", "at").add(id_field))
    order = F.row_number().over(Window.partitionBy("a", "b").orderBy("id", "chunk"))
    later = open_.withColumn("n", order).where("n > 1").select("chunk", "at", F.lit(WINDOW_LATER).alias("state"))

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        one = _Chunk(left, window)
        known, at = judge(one, right)
        order, new = _classes(*one.hashes(at))
        # of equal open windows all but the first place here; that one as the other chunks say
        repeat = np.ones(len(at), bool)
        repeat[order[new]] = False
        mine = right.filter(pa.array(right.column("state").to_numpy() == WINDOW_LATER))
        known[at[repeat]] = True
        known[mine.column("at").to_numpy()] = True
        total = len(one.names)
        marks = np.flatnonzero(known)
        steps = np.bincount(marks, minlength=total + 1) - np.bincount(marks + window, minlength=total + 1)
        stay = np.cumsum(steps)[:total] <= 0
        n_kept = np.bincount(one.doc[stay], minlength=len(one.sizes))
        words = pa.array(one.words, pa.binary()).take(pa.array(one.names[stay]))
        return pa.table(
            {"id": _ids(left), "n_words": one.sizes, "n_removed": one.sizes - n_kept, "kept": join_words(words, n_kept)}
        )

    schema = T.StructType([id_field, *longs("n_words", "n_removed")]).add("kept", T.BinaryType())
    marks = states.union(later)
    out = by_chunk.cogroup(marks.groupBy("chunk")).applyInArrow(remove, schema)
    return out.withColumn("kept", F.col("kept").cast("string"))


def op11_difference_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = deduplicate_substrings(documents(spark, sf_dir))
    return rows.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_W = r"[^\x20\x09-\x0D]+"
OP11_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '{_W}') AS w FROM documents),
s AS (SELECT doc_id, rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d),
r AS (SELECT rid, i, row_number() OVER (
        PARTITION BY array_to_string(w[i:i + {WINDOW - 1}], ' ') ORDER BY doc_id NULLS FIRST, rid, i) AS k FROM s),
c AS (SELECT DISTINCT rid, i + j AS i FROM r, (SELECT unnest(range({WINDOW})) AS j) WHERE k > 1),
p AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
t AS (SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM p ANTI JOIN c USING (rid, i) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t USING (rid)
"""
