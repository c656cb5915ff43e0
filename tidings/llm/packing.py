"""Hierarchical packing into windows of several lengths.

Every document is its token ids and an end id.  Whole windows of the longest size
leave a document at once; what remains is routed to the shortest tier that holds it.
The longest remainders open windows of their tier, top down; the gap of a window is
filled with the longest shorter pieces that fit, and when none fits by cutting the
shortest piece there is.  What a task has left at its end goes to windows of powers
of two, so no window is padded.  Windows join step groups in order of size; a group
that isn't full waits for the next round, so that only the last one of a task is smaller.

Documents are packed where they are read, in rounds of bounded size, so there is no
shuffle and nothing is held beyond a round; a task that runs again reads the same
rows and makes the same windows.  Window numbers carry the partition number.

Defined results: a null or empty text is its end id alone; repeated rows and null ids
are packed like any other; an empty table gives an empty result; very long texts are
cut into as many windows as they need.
"""

from __future__ import annotations

import bisect
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidings.llm.common import Numbers, documents, narrow, small_batches, split_words

WINDOW = 2048
TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 16 * WINDOW
ROUND_TOKENS = 1 << 20
END_ID = 1


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Ids:
    """Ids of numbered strings behind each other, in arrays that grow by doubling."""

    def __init__(self) -> None:
        self.flat, self.filled, self.count = np.zeros(0, np.uint32), 0, 0
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def append(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        end, count = self.filled + len(ids), self.count + len(lengths)
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(end, np.uint32)])
        if count > len(self.starts):
            more = np.zeros(count, np.int64)
            self.starts, self.lengths = np.concatenate([self.starts, more]), np.concatenate([self.lengths, more])
        self.flat[self.filled : end] = ids
        self.lengths[self.count : count] = lengths
        self.starts[self.count : count] = self.filled + np.cumsum(lengths) - lengths
        self.filled, self.count = end, count

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some strings behind each other, and how many each has."""
        lengths = self.lengths[numbers]
        return _gathered(self.flat, self.starts[numbers], lengths), lengths


_MARKS = ".,;:!?"
# Letters whose small form is one letter and which are their own composed form.
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+[.,;:!?]?").fullmatch


class WordTokens:
    """Ids of texts with a tokenizer that drops blanks, through bounded tables of words.

    Such a tokenizer never looks across a blank, so each distinct word is encoded
    once.  One that lowers letters and parts them from marks behind them (which is
    tried out) encodes plain words without their marks and capitals, so
    ``The``, ``the`` and ``the,`` share an entry.  When the table is full, the words that
    were used most stay in it.
    """

    def __init__(self, path: str, most: int = 400_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most, self.used = most, np.zeros(0, np.int64)
        self.known, self.words = pa.array([], pa.binary()), _Ids()
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.parted = self._parts_marks()
        self._clear_plain()

    def _parts_marks(self) -> bool:
        """Whether the ids of a plain word are those of its small letters, closed by a word end, and of its mark."""
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if not suffix:
            return False
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith(suffix)

        def ids(text: str) -> list[int]:
            return self.tokenizer.encode(text, add_special_tokens=False).ids

        marks = {m: ids(m) for m in _MARKS}
        words = ["the", "zq", "internationalisation", "ça", "größeþ"]
        return all(
            len(x) == 1 and all(ids(w.capitalize() + m) == ids(w) + x and self.ends[ids(w)].sum() == 1 for w in words)
            for m, x in marks.items()
        )

    def _clear_plain(self) -> None:
        self.plain, self.letters = Numbers(), _Ids()
        if self.parted:
            self.plain.of(list(_MARKS))
            self.plain.new.clear()
            self.letters.append(*self._encode(list(_MARKS)))

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any words behind each other, and how many each has; they are encoded together, a blank apart."""
        found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        at = np.fromiter((a for a, _ in found.offsets), np.int64, len(found))
        return np.array(found.ids, np.uint32), np.bincount(np.searchsorted(begins, at, "right") - 1, minlength=len(texts))

    def _encode_letters(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of small letters, each of which has one word end."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0].ids, np.uint32)
        return ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)

    def _learn(self, words: list[bytes]) -> None:
        """Each new word's ids."""
        for at in range(0, len(words), 2000):
            some = [w.decode("utf-8", "replace") for w in words[at : at + 2000]]
            plain = np.array([self.parted and _PLAIN(w) is not None for w in some])
            first = np.zeros(len(some), np.int64)
            mark = np.full(len(some), -1)
            if plain.any():
                mine = np.flatnonzero(plain).tolist()
                marked = [some[i][-1] in _MARKS for i in mine]
                first[mine] = self.plain.of([some[i][: -1 if m else None].lower() for i, m in zip(mine, marked)])
                mark[mine] = [_MARKS.index(some[i][-1]) if m else -1 for i, m in zip(mine, marked)]
                if self.plain.new:
                    self.letters.append(*self._encode_letters(self.plain.new))
                    self.plain.new = []
            other = [some[i] for i in np.flatnonzero(~plain).tolist()]
            ids, counts = self._encode(other) if other else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            # two stretches a word: its letters and its mark, or its own ids and nothing
            base = len(self.letters.flat)
            starts, lengths = np.zeros((len(some), 2), np.int64), np.zeros((len(some), 2), np.int64)
            starts[plain, 0], lengths[plain, 0] = self.letters.starts[first[plain]], self.letters.lengths[first[plain]]
            has = mark >= 0
            starts[has, 1], lengths[has, 1] = self.letters.starts[mark[has]], self.letters.lengths[mark[has]]
            starts[~plain, 0], lengths[~plain, 0] = base + np.cumsum(counts) - counts, counts
            flat = np.concatenate([self.letters.flat, ids])
            self.words.append(_gathered(flat, starts.ravel(), lengths.ravel()), lengths.sum(axis=1))

    def _forget(self) -> None:
        """Keep the half of the words that were used most."""
        stay = np.sort(np.argsort(-self.used, kind="stable")[: self.most // 2])
        old, self.words, self.used = self.words, _Ids(), self.used[stay]
        self.known = self.known.take(pa.array(stay))
        self.words.append(*old.of(stay))
        self._clear_plain()

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """Each word's number; new words are learned.  Only these become objects of Python."""
        coded = words.dictionary_encode()
        different = coded.dictionary.view(pa.binary())
        found = pc.index_in(different, value_set=self.known)
        new = different.filter(found.is_null())
        numbers = found.fill_null(-1).to_numpy().astype(np.int64)
        numbers[numbers < 0] = len(self.known) + np.arange(len(new))
        if len(new):
            self._learn(new.to_pylist())
            self.known = pa.concat_arrays([self.known, new])
            self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
        return numbers[coded.indices.to_numpy()]

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each of the texts (binary)."""
        if not len(texts):
            return []
        if len(self.known) > self.most:
            self._forget()
        words, sizes = split_words(texts)
        every = self._numbers(words)
        self.used += np.bincount(every, minlength=len(self.known))
        flat, lengths = self.words.of(every)
        ends = np.r_[0, np.cumsum(lengths)]
        return np.split(flat, ends[np.cumsum(sizes)][:-1])


def _gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Stretches of an array behind each other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


class _Packer:
    """Packs the documents of one task."""

    def __init__(self, partition: int, tiers: tuple[int, ...], end: int) -> None:
        self.tiers, self.window, self.end = sorted(tiers), max(tiers), end
        self.next = self.step = partition << 40
        self.rest: list[tuple] = []  # doc, start, ids, doc_tokens
        self.whole: list[tuple] = []
        self.pending: list[list[tuple]] = []  # windows of a step group that isn't full
        self.held = 0

    def add(self, doc, ids: np.ndarray) -> None:
        ids = np.append(ids, np.uint32(self.end))
        n = len(ids)
        cut = n - n % self.window
        for start in range(0, cut, self.window):
            self.whole.append((doc, start, ids[start : start + self.window], n))
        if cut < n:
            self.rest.append((doc, cut, ids[cut:], n))
        self.held += n

    def _windows(self, last: bool) -> list[list[tuple]]:
        pool = sorted(((len(p[2]), i, p) for i, p in enumerate(self.rest)), key=lambda x: x[:2])
        made: list[list[tuple]] = []
        serial, self.rest = len(pool), []
        while pool:
            length, _, first = pool.pop()
            size = self.tiers[bisect.bisect_left(self.tiers, length)]
            pieces, gap = [first], size - length
            while gap and pool:
                fit = bisect.bisect_right(pool, gap, key=lambda x: x[0]) - 1
                if fit >= 0:
                    length, _, piece = pool.pop(fit)
                    pieces.append(piece)
                    gap -= length
                else:
                    _, _, (doc, start, ids, n) = pool.pop(0)
                    pieces.append((doc, start, ids[:gap], n))
                    bisect.insort(pool, (len(ids) - gap, serial, (doc, start + gap, ids[gap:], n)), key=lambda x: x[:2])
                    serial, gap = serial + 1, 0
            if gap:
                self.rest = pieces  # the pool is empty
            else:
                made.append(pieces)
        if last:
            while self.rest:
                size = 1 << (sum(len(p[2]) for p in self.rest).bit_length() - 1)
                size = min(size, self.window)
                pieces, gap = [], size
                while gap:
                    doc, start, ids, n = self.rest.pop(0)
                    pieces.append((doc, start, ids[:gap], n))
                    if len(ids) > gap:
                        self.rest.insert(0, (doc, start + gap, ids[gap:], n))
                    gap -= len(pieces[-1][2])
                made.append(pieces)
        return made

    def flush(self, last: bool = False) -> list[tuple]:
        """Rows of the pieces of full step groups; at the end of the last, smaller one too."""
        windows = self.pending + [[p] for p in self.whole] + self._windows(last)
        self.whole, self.held = [], sum(len(p[2]) for p in self.rest)
        sized = sorted(((sum(len(p[2]) for p in w), i) for i, w in enumerate(windows)), key=lambda x: (-x[0], x[1]))
        rows, group, filled = [], [], 0
        for size, i in sized:
            if filled + size > STEP_TOKENS:
                rows += self._step(group)
                group, filled = [], 0
            group.append((size, windows[i]))
            filled += size
        if last or filled == STEP_TOKENS:
            rows += self._step(group)
            group = []
        self.pending = [w for _, w in group]
        return rows

    def _step(self, group: list[tuple]) -> list[tuple]:
        rows = []
        for size, window in group:
            offset = 0
            for doc, start, ids, n in window:
                rows.append((doc, start, len(ids), ids.tobytes(), n, self.next, offset, size, self.step))
                offset += len(ids)
            self.next += 1
        self.step += 1
        return rows


def packed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    tiers: tuple[int, ...] = TIERS,
    end: int = END_ID,
    round_tokens: int = ROUND_TOKENS,
) -> DataFrame:
    """One row per piece: ``id, start, length, ids, doc_tokens, sequence_id, offset, capacity, step_id``.

    ``ids`` are little-endian unsigned 32-bit numbers; ``capacity`` is the length
    of the window, ``step_id`` its step group.
    """
    rows = narrow(docs, id_col, text_col)
    path = tokenizer or word_vocabulary()
    id_type = rows.schema["id"].dataType
    schema = T.StructType(
        [T.StructField("id", id_type), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]
        + [T.StructField("ids", T.BinaryType())]
        + [T.StructField(n, T.LongType()) for n in ("doc_tokens", "sequence_id", "offset", "capacity", "step_id")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokens(path)
        packer = _Packer(TaskContext.get().partitionId(), tiers, end)
        kind = None

        def batch_of(made: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*made))
            kinds = [kind, pa.int64(), pa.int64(), pa.binary()] + [pa.int64()] * 5
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=schema.names
            )

        for batch in batches:
            kind = batch.schema.field(0).type
            for part in small_batches([batch], 2048):
                ids = words.ids(part.column(1))
                for doc, one in zip(part.column(0).to_pylist(), ids):
                    packer.add(doc, one)
                    if packer.held >= round_tokens and (made := packer.flush()):
                        yield batch_of(made)
        if made := packer.flush(True):
            yield batch_of(made)

    return rows.mapInArrow(run, schema)


def op3_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset", "capacity", "step_id",
    )
