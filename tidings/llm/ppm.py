"""Language-model scores by prediction by partial matching over bytes.

A text is coded as its words (A-Z lower-cased) joined by one blank, then an end mark.
The model is a trie of byte contexts up to ``ORDER``.  A byte is predicted in the
longest context that was met in training; when it was not met there, an escape is
paid and the next shorter context is tried, without the bytes that the longer one had
(symbol exclusion).  Escapes are estimated by method D: with n counts and d different
bytes, a byte with count c has (2c - 1) / 2n and the escape d / 2n.  Below the
shortest context all bytes left are equally likely.  Counts follow update exclusion:
the longest context counts occurrences, a shorter one the different longer contexts
in which the byte was met, so the counts of a level are row counts of the one above.

On Spark: texts are dealt into chunks of bounded size and stored once.  Every chunk
gives its distinct byte windows and words with their training counts; these are
summed over all chunks, window codes are computed where all windows with the same
last three context bytes meet, and come back to the chunks that have them.  So the model
is never gathered in one place: only the three lowest levels are broadcast, at most
2 ** 24 windows of three bytes and what they end in.

Defined results: a null or blank text is the end mark alone; null ids count as the
empty text for the split; repeated rows are scored each by itself; a corpus without
training texts gives the uniform model; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidings.llm.common import documents, give_back, small_batches, split_words, stored, text_or_empty
from tidings.session import shared_folder

ORDER = 5
CHUNK_BYTES = 16 << 20
SLICE_BYTES = 1 << 20
END = b"\n"  # never part of a word
_DENSE = 1 << 23
CODED_ROWS = 300_000
MERGED_ROWS = 500_000


# ------------------------------------------------------------------ adaptive form
class Adaptive:
    """The same model learned while coding, byte after byte."""

    def __init__(self, order: int = ORDER) -> None:
        self.order, self.nodes = order, {}

    def code(self, context: bytes, symbol: int, learn: bool = True) -> float:
        """log10 of the byte's probability after ``context``; then learn it."""
        result, out, coded = 0.0, set(), None
        for n in range(min(self.order, len(context)), -1, -1):
            counts = self.nodes.get(context[len(context) - n :], {})
            open_ = {s: c for s, c in counts.items() if s not in out}
            if not open_:
                continue
            total, escapes = sum(open_.values()), len(counts) < 256
            if symbol in open_:
                result += math.log10((2 * open_[symbol] - 1) / (2 * total) if escapes else open_[symbol] / total)
                coded = n
                break
            result += math.log10(len(open_) / (2 * total))
            out |= set(counts)
        if coded is None:
            result -= math.log10(256 - len(out))
        if learn:
            for n in range(min(self.order, len(context)), (coded if coded is not None else 0) - 1, -1):
                counts = self.nodes.setdefault(context[len(context) - n :], {})
                counts[symbol] = counts.get(symbol, 0) + 1
        return result

    def score(self, text: bytes) -> float:
        body = END * self.order + coded_bytes(text)
        return sum(self.code(body[i - self.order : i], body[i]) for i in range(self.order, len(body)))


def coded_bytes(text: bytes) -> bytes:
    return b" ".join(text.lower().split()) + END


def adaptive_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """``id, score``: each text coded by a model that starts empty and learns from it alone."""
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            scores = [Adaptive(order).score(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    return rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("score", T.DoubleType())]))


# ------------------------------------------------------------------ pretrained form
def _windows(body: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte from ``order`` on the number of its window, and the windows (big-endian numbers).

    Windows grow to the right; while the table of possible ones is small it is
    indexed directly, beyond that sorted.
    """
    alphabet = np.flatnonzero(np.bincount(body, minlength=256)).astype(np.uint64)
    to = np.zeros(256, np.int64)
    to[alphabet.astype(np.int64)] = np.arange(len(alphabet))
    small = to[body]
    at, keys, width = small, alphabet, len(alphabet)
    for n in range(1, order + 1):
        grown = at[: len(body) - n] * width + small[n:]
        if len(keys) * width <= _DENSE:
            seen = np.zeros(len(keys) * width, bool)
            seen[grown] = True
            present = np.flatnonzero(seen)
            number = np.zeros(len(seen), np.int32)
            number[present] = np.arange(len(present), dtype=np.int32)
            at = number[grown].astype(np.int64)
        else:
            present, at = np.unique(grown, return_inverse=True)
        keys = (keys[present // width] << np.uint64(8)) | alphabet[present % width]
    return at, keys


def _body(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Coded texts behind each other, each after ``order`` end marks; where each starts."""
    pad = END * order
    parts = [pad + t for t in texts]
    starts = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), starts


def _chunked(docs: DataFrame, id_col: str, text_col: str, train, chunk_bytes: int) -> DataFrame:
    """``chunk, id, body, train``: coded texts, compressed, in chunks of bounded size."""
    rows = docs.select(
        F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("body"), train.alias("train")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, filled = TaskContext.get().partitionId() << 32, 0
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in small_batches(batches):
            bodies = [coded_bytes(x) for x in batch.column(1).to_pylist()]
            chunks = []
            for body in bodies:
                if filled and filled + len(body) > chunk_bytes:
                    chunk, filled = chunk + 1, 0
                filled += len(body)
                chunks.append(chunk)
            packed = [pack(b) for b in bodies]
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunks, pa.int64()), batch.column(0), pa.array(packed, pa.binary()), batch.column(2)],
                names=["chunk", "id", "body", "train"],
            )
        give_back()

    schema = T.StructType(
        [T.StructField("chunk", T.LongType()), rows.schema["id"], T.StructField("body", T.BinaryType()), T.StructField("train", T.BooleanType())]
    )
    return rows.mapInArrow(run, schema)


def _sliced(bodies: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of bounded size."""
    at = 0
    while at < len(bodies):
        end, size = at, 0
        while end < len(bodies) and (end == at or size + len(bodies[end]) <= SLICE_BYTES):
            size += len(bodies[end])
            end += 1
        yield at, end
        at = end


def _different(bodies: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of texts, which of them each word is, and how many words each text has."""
    flat, sizes = split_words(pa.array(bodies, pa.binary()))
    coded = flat.dictionary_encode()
    return coded.dictionary.view(pa.binary()), coded.indices.to_numpy(), sizes


def _summed(keys: list[np.ndarray], n: list[np.ndarray]) -> None:
    """Lists of keys and counts become one of different keys, in place."""
    every, counts = np.concatenate(keys), np.concatenate(n)
    keys.clear()
    n.clear()
    order = np.argsort(every)
    every, counts = every[order], counts[order]
    del order
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1])[: len(every)])
    keys.append(every[first])
    n.append(np.add.reduceat(counts, first) if len(first) else counts)


def _gram_counts(bodies: list[bytes], train: list[bool], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of the texts and their counts in those to learn from."""
    every, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in _sliced(bodies):
        body, starts = _body(bodies[a:b], order)
        at, keys = _windows(body, order)
        own = np.ones(len(at), bool)
        # windows that end in the marks before a text belong to no byte
        for k in range(order):
            inner = starts[1:-1] + k - order
            own[inner[inner >= 0]] = False
        learn = np.repeat(np.array(train[a:b], bool), np.diff(starts))[order:] & own
        used = np.bincount(at[own], minlength=len(keys)) > 0
        every.append(keys[used])
        n.append(np.bincount(at[learn], minlength=len(keys))[used].astype(np.int64))
        # slices share most windows: never more than twice the different ones wait, or a few slices'
        if sum(map(len, every[1:])) >= max(len(every[0]), MERGED_ROWS):
            _summed(every, n)
    _summed(every, n)
    return every[0], n[0]


def _of_chunks(rows: DataFrame, count, schema: str) -> DataFrame:
    """What ``count`` gives for the coded texts of each chunk, and whether to learn from them.

    A chunk may come from several tasks; its counts are then given in parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, bodies, train = None, [], []
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in small_batches(batches):
            for c, body, t in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2))):
                if c != chunk and bodies:
                    yield from count(chunk, bodies, train)
                    bodies, train = [], []
                chunk = c
                bodies.append(unpack(body))
                train.append(t)
        if bodies:
            yield from count(chunk, bodies, train)
        bodies, train = [], []
        give_back()

    return rows.select("chunk", "body", "train").mapInArrow(run, schema)


def _pieces(chunk: int, name: str, keys: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(keys), 100_000):
        some = keys.slice(at, 100_000)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(some), chunk)), some, pa.array(n[at : at + 100_000])], names=["chunk", name, "n"]
        )


def _grams_of(rows: DataFrame, order: int) -> DataFrame:
    """``chunk, gram, n``: distinct windows of each chunk as numbers, with training counts."""

    def count(chunk: int, bodies: list[bytes], train: list[bool]) -> Iterator[pa.RecordBatch]:
        keys, n = _gram_counts(bodies, train, order)
        yield from _pieces(chunk, "gram", pa.array(keys.view(np.int64)), n)

    return _of_chunks(rows, count, "chunk long, gram long, n long")


def _words_of(rows: DataFrame) -> DataFrame:
    """``chunk, word, n``: distinct words and the end mark, with training counts."""

    def count(chunk: int, bodies: list[bytes], train: list[bool]) -> Iterator[pa.RecordBatch]:
        words, n = [pa.array([END], pa.binary())], [np.array([sum(train)])]
        for a, b in _sliced(bodies):
            different, at, sizes = _different(bodies[a:b])
            words.append(different)
            n.append(np.bincount(at[np.repeat(np.array(train[a:b], bool), sizes)], minlength=len(different)))
        found = pa.table([pa.chunked_array(words), pa.array(np.concatenate(n))], names=["word", "n"])
        found = found.group_by("word").aggregate([("n", "sum")]).combine_chunks()
        yield from _pieces(chunk, "word", found["word"].combine_chunks(), found["n_sum"].to_numpy())

    return _of_chunks(rows, count, "chunk long, word binary, n long")


def _by_key(keys: DataFrame, key: str) -> DataFrame:
    """The same rows in buckets of the key, so that later steps need not deal them again."""
    spark = keys.sparkSession
    name = f"llm_keys_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        keys.repartition(parts, key)
        .write.bucketBy(parts, key)
        .option("path", f"{shared_folder(spark)}/{name}")
        .option("compression", "zstd")
        .saveAsTable(name)
    )
    table = spark.table(name)
    table.schema  # resolved: files and buckets are known from here on
    spark.sql(f"DROP TABLE {name}")  # the entry; the files stay
    return table


def _levels_below(grams: DataFrame, order: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Level 0, 1 and, for an order above 2, 2 of the model: windows and in how many longer ones they end.

    The windows of three bytes bound it, at most 2 ** 24 rows.
    """
    top = min(order - 1, 2)
    longer = grams.where("n > 0").select(F.col("gram").bitwiseAND(F.lit((1 << 8 * (top + 2)) - 1)).alias("g")).distinct()
    rows = longer.groupBy(F.col("g").bitwiseAND(F.lit((1 << 8 * (top + 1)) - 1)).alias("g")).count().toArrow()
    keys, n = rows.column(0).to_numpy().astype(np.uint64), rows.column(1).to_numpy()
    sort = np.argsort(keys)
    levels = {top: (keys[sort], n[sort].astype(np.int64))}
    for level in range(top - 1, -1, -1):
        keys, n = np.unique(levels[level + 1][0] & np.uint64((1 << 8 * (level + 1)) - 1), return_counts=True)
        levels[level] = (keys, n)
    return levels


def codes(
    windows: np.ndarray, counts: np.ndarray, below: dict[int, tuple[np.ndarray, np.ndarray]], order: int
) -> np.ndarray:
    """log10 probability of each window's last byte after the bytes before it.

    ``windows`` are distinct and hold all windows that share the last three context
    bytes with one of them; ``below`` has the levels up to two.
    """
    result, done = np.zeros(len(windows)), np.zeros(len(windows), bool)
    out_n, out_d = np.zeros(len(windows), np.int64), np.zeros(len(windows), np.int64)
    trained = counts > 0
    rows, n = windows[trained], counts[trained].astype(np.int64)
    sort = np.argsort(rows)
    rows, n = rows[sort], n[sort]
    levels = {**below, order: (rows, n)}
    for level in range(order - 1, 2, -1):
        rows, n = np.unique(rows & np.uint64((1 << 8 * (level + 1)) - 1), return_counts=True)
        levels[level] = (rows, n)
    for level in range(order, -1, -1):
        rows, n = levels[level]
        contexts, first, d = np.unique(rows >> np.uint64(8), return_index=True, return_counts=True)
        if not len(rows):
            continue
        total = np.add.reduceat(n, first)
        mine = windows & np.uint64((1 << 8 * (level + 1)) - 1)
        node = np.minimum(np.searchsorted(contexts, mine >> np.uint64(8)), len(contexts) - 1)
        known = (contexts[node] == mine >> np.uint64(8)) & ~done
        row = np.minimum(np.searchsorted(rows, mine), len(rows) - 1)
        met = known & (rows[row] == mine)
        open_n, open_d = total[node] - out_n, d[node] - out_d
        escapes = d[node] < 256
        with np.errstate(divide="ignore", invalid="ignore"):
            hit = np.where(escapes, (2 * n[row] - 1) / (2 * open_n), n[row] / open_n)
            result[met] += np.log10(hit[met])
            miss = known & ~met & (open_n > 0)
            result[miss] += np.log10(open_d[miss] / (2 * open_n[miss]))
        done |= met
        # what this level's bytes count one level below
        if level:
            below, n_below = levels[level - 1]
            parent = np.searchsorted(below, rows & np.uint64((1 << 8 * level) - 1))
            gone = np.add.reduceat(n_below[parent], first)
            out_n, out_d = np.where(known, gone[node], 0), np.where(known, d[node], 0)
    left = 256 - len(levels[0][0])
    if left:
        result[~done] -= math.log10(left)
    return result


def _coded(grams: DataFrame, below: dict[int, tuple[np.ndarray, np.ndarray]], order: int) -> DataFrame:
    """``gram, value``: the code of each window.

    Windows with the same last three context bytes meet, at most 2 ** 24 for each;
    a task holds a bounded number of rows and what such a group has beyond them.
    """

    def ready(gram: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        values = codes(gram.view(np.uint64), n, below, order)
        for at in range(0, len(gram), 50_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram[at : at + 50_000]), pa.array(values[at : at + 50_000])], names=["gram", "value"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            gram = np.concatenate([gram, batch.column(0).to_numpy()])
            n = np.concatenate([n, batch.column(1).to_numpy()])
            if len(gram) >= CODED_ROWS:
                context = (gram >> 8) & 0xFFFFFF
                cut = int(np.searchsorted(context, context[-1]))  # rows come sorted by it
                if cut:
                    yield from ready(gram[:cut], n[:cut])
                    gram, n = gram[cut:], n[cut:]
        if len(gram):
            yield from ready(gram, n)
        del gram, n
        give_back()

    context = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFFFF))
    near = grams.select("gram", "n").repartition(context).sortWithinPartitions(context)
    return near.mapInArrow(run, "gram long, value double")


def scores(
    docs: DataFrame,
    train,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = ORDER,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """``id, train, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    ``train`` is a boolean column: texts to learn from.  ``base_score`` is the
    add-one unigram model over words and the end mark.  ``order`` is 2 to 6.
    Texts whose chunk is shared are scored together, a slice at a time.
    """
    spark = docs.sparkSession
    texts = stored(_chunked(docs, id_col, text_col, train, chunk_bytes), "texts")
    grams, words = _by_key(_grams_of(texts, order), "gram"), _by_key(_words_of(texts), "word")
    all_grams = stored(grams.groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    all_words = stored(words.groupBy("word").agg(F.sum("n").alias("n")), "words")
    n_train, n_kinds = all_words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    share = math.log10(n_train + n_kinds + 1)
    values = _coded(all_grams, _levels_below(all_grams, order), order)
    of_grams = grams.select("chunk", "gram").join(values, "gram")
    of_words = words.select("chunk", "word").join(all_words, "word")
    needed = of_grams.select("chunk", "gram", F.lit(None).cast("binary").alias("word"), "value").union(
        of_words.select("chunk", F.lit(None).cast("long"), "word", F.col("n").cast("double"))
    )

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        is_word = right.column("gram").is_null()
        known = right.column("gram").drop_null().to_numpy().view(np.uint64)
        code_of = right.column("value").filter(pc.invert(is_word)).to_numpy()
        words, counts = right.column("word").filter(is_word), right.column("value").filter(is_word).to_numpy()
        del right, is_word
        sort = np.argsort(known)
        known, code_of = known[sort], code_of[sort]
        del sort
        unpack = zstandard.ZstdDecompressor().decompress
        packed = left.column("body").to_pylist()
        n_tokens, n_known, base, sums, used = [], [], [], [], []
        for first in range(0, len(packed), 1000):
            bodies = [unpack(x) for x in packed[first : first + 1000]]
            for a, b in _sliced(bodies):
                used.append(_different(bodies[a:b]))
                body, starts = _body(bodies[a:b], order)
                number, grams_ = _windows(body, order)
                place = np.minimum(np.searchsorted(known, grams_), len(known) - 1)
                total = np.r_[np.zeros(order + 1), np.cumsum(code_of[place][number])]
                # bytes of text i: from its start + order to the next start
                sums.append(total[starts[1:]] - total[starts[:-1] + order])
        del known, code_of, number, place, total
        # all words of the chunk are looked up at once
        logs = np.log10(counts + 1)
        end = pc.index(words, pa.scalar(END, pa.binary())).as_py()
        numbers = pc.index_in(pa.chunked_array([x[0] for x in used]), value_set=words.combine_chunks()).to_numpy()
        first = 0
        for different, at, sizes in used:
            mine = numbers[first : first + len(different)][at]
            first += len(different)
            for at in np.split(mine, np.cumsum(sizes)[:-1]):
                n_tokens.append(len(at) + 1)
                n_known.append(int((counts[at] > 0).sum() + (counts[end] > 0)))
                base.append(math.fsum(logs[at]) + logs[end] - (len(at) + 1) * share)
        n = len(packed)
        del words, used, numbers, packed
        give_back()
        return pa.table(
            [
                left.column("id"), left.column("train"), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()),
                pa.array([n_train] * n, pa.int64()), pa.array(base, pa.float64()), pa.array(np.concatenate(sums)),
            ],
            names=["id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    schema = T.StructType(
        [texts.schema["id"], T.StructField("train", T.BooleanType())]
        + [T.StructField(x, T.LongType()) for x in ("n_tokens", "n_known", "train_tokens")]
        + [T.StructField(x, T.DoubleType()) for x in ("base_score", "score")]
    )
    return texts.groupBy("chunk").cogroup(needed.groupBy("chunk")).applyInArrow(score, schema)


def op2_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    rows = scores(docs, F.crc32(name) % 7 != 2)
    return rows.select(
        F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score",
    )
