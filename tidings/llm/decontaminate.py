"""Benchmark decontamination by templates.

Template of a text: its words without punctuation at their ends and lower-cased, with
typed placeholders for numbers, units and names (capitalised words that do not start a
sentence, or that are capitalised in mid-sentence elsewhere in the text).  Windows of ``WINDOW``
template words are hashed; shorter benchmark items are one window of their own length.
What looks like a name depends on case and on the sentence around it, so a window with
names is hashed once more with them as plain words: copies are found in capitals, in
small letters and in the midst of a sentence.  A window with other words that may be
names (capitalised ones at the start of a sentence, words in capitals, initials) is
hashed once more with them as names.  A window with fewer than ``LITERALS`` plain words
says little: it only counts where all slots are equal.  Windows of documents that hit a bitmap of the
benchmark's windows are joined with those by hash.  The bitmap has a fixed size and
only saves work; the join decides.

Hits of a document and an item that lie on one diagonal (equal difference of
positions) are one alignment.  There equal slot values of the item must meet equal slot
values of the document, and different ones different ones.  Where they do not, the
value that more places have wins; of as many places none does, except in an alignment
that is else unchanged, where the unchanged value wins.  Windows over places that lost
are dropped, all others count; a document is contaminated by an item when they cover
``COVERAGE`` of the item's windows or ``RUN`` windows.  It is a copy if all slots agree,
else the question with other parameters.  Number words are numbers: twelve equals 12.

Defined results: null and empty texts and items have no window and never match; items
without a word are left out; repeated documents and null ids give a row each; repeated
items match each under their id; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidings.llm.common import Numbers, documents, mix64, numbered, small_batches, stored, text_or_empty

WINDOW = 8
COVERAGE = 0.5
RUN = 24
LITERALS = 2
MAP_BITS = 24  # the bitmap has 2 ** MAP_BITS bits: 2 MB, whatever the benchmark

_HASH = partial(xxhash.xxh64_intdigest, seed=7)
_EDGE = bytes(set(range(33, 127)) - set(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
_SMALL = frozenset(bytes([x]) for x in b"abcdefghijklmnopqrstuvwxyz0123456789")
_STOPS = (b".", b"!", b"?", b":")
NUMBER = re.compile(rb"[0-9][0-9.,:/x*^%-]*[a-z%]{0,3}")
_DIGITS = [*range(21), *range(30, 100, 10), 100, 1000, 1_000_000]
NUMBER_WORDS = dict(
    zip(
        b"zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
        b" eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split(),
        (b"%d" % x for x in _DIGITS),
    )
)
UNITS = set(
    b"mm cm m km meter meters metre metres inch inches foot feet yard yards mile miles mg g kg gram grams kilogram"
    b" kilograms ton tons ounce ounces pound pounds ml l liter liters litre litres second seconds minute minutes hour"
    b" hours day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees"
    b" kmh mph watt watts volt volts".split()
)
_LITERAL, _NUMBER, _UNIT, _NAME = range(4)
_SLOT_HASH = np.array([0, 0xA11CE5A11CE5A11D, 0xB0B5B0B5B0B5B0B7, 0xC0DEC0DEC0DEC0DF], np.uint64)
_BASE = 0x9E3779B97F4A7C15
#: of a window's words, the first one's last: the powers that its hash takes
_POWERS = np.array([pow(_BASE, k, 1 << 64) for k in range(WINDOW - 1, -1, -1)], np.uint64)


def _lower(word: bytes) -> bytes:
    """All letters in lower case, not just A-Z."""
    if word.isascii():
        return word.lower()
    return word.decode("utf-8", "replace").lower().encode("utf-8", "replace")


class Templates:
    """Template words of texts, through a bounded table of known words."""

    def __init__(self, most: int = 300_000) -> None:
        self.most = most
        self.numbers = Numbers()
        self._clear()

    def _clear(self) -> None:
        self.numbers.forget()
        self.table = np.zeros(1 << 12, [("hash", "u8"), ("kind", "i1"), ("capital", "?"), ("maybe", "?"), ("ends", "?")])

    def _learn(self, first: int, words: list[bytes]) -> None:
        """Facts of new words, numbered from ``first``."""
        rows = []
        for word in words:
            core = word.strip(_EDGE)
            low = core.lower() if core.isascii() else _lower(core)
            kind = _LITERAL
            if low[:1].isdigit() and NUMBER.fullmatch(low) or low in NUMBER_WORDS:
                kind = _NUMBER
            elif low in UNITS:
                kind = _UNIT
            capital = maybe = False
            if core and core[:1] not in _SMALL:
                letters = core.decode("utf-8", "replace")
                capital = len(letters) > 1 and letters[0].isupper() and letters[1:].islower()
                # all in capitals, mixed (McKay), or an initial with its stop
                maybe = letters[0].isupper() and (len(letters) > 1 or word.lstrip(b"\"'([").startswith(core + b"."))
            ends = word.rstrip(b"\"')]").endswith(_STOPS)
            rows.append((_HASH(low or word), kind, capital, maybe, ends))
        while first + len(rows) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[first : first + len(rows)] = rows

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Hash (of the word itself) and kind of each template word, whether a plain one may be a name, the words."""
        if len(self.numbers) > self.most:
            self._clear()
        words: list[bytes] = []
        firsts: list[int] = []
        for line in text.split(b"\n"):
            firsts.append(len(words))
            words += line.split()
        at = self.numbers.of(words)
        if new := self.numbers.new:
            self._learn(len(self.numbers) - len(new), new)
            self.numbers.new = []
        hashes, kinds, capital, maybe, ends = (self.table[x][at] for x in ("hash", "kind", "capital", "maybe", "ends"))
        starts = np.zeros(len(words), bool)
        starts[1:] = ends[:-1]
        starts[[f for f in firsts if f < len(words)]] = True
        maybe &= kinds == _LITERAL
        capital &= maybe
        names = capital & ~starts
        if names.any() and (first := np.flatnonzero(capital & starts)).size:
            names[first[np.isin(hashes[first], hashes[names])]] = True
        return hashes, np.where(names, _NAME, kinds), maybe & ~names, words

    def windows(
        self, text: bytes, lengths: list[int]
    ) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
        """``length, window hashes, their positions, kinds, words`` for each window length.

        A length comes again when there are names, with these as plain words, and when
        there are words that may be names, with these as names too; then only windows
        that hold such a word are given.
        """
        hashes, kinds, maybe, words = self.of(text)
        variants = [(kinds, None)]
        if (named := kinds == _NAME).any():
            variants.append((np.where(named, _LITERAL, kinds), named))
        if maybe.any():
            variants.append((np.where(maybe, _NAME, kinds), maybe))
        for kinds, marked in variants:
            each = np.where(kinds == _LITERAL, hashes, _SLOT_HASH[kinds])
            if marked is not None:
                sums = np.r_[0, np.cumsum(marked)]
            for n in lengths:
                if n > len(words):
                    continue
                total = np.correlate(each, _POWERS[-n:], "valid")
                at = np.arange(len(total)) if marked is None else np.flatnonzero(sums[n:] > sums[:-n])
                yield n, mix64(total[at] ^ np.uint64(n)), at, kinds, words


_HITS = T.StructType(
    [
        T.StructField("place", T.LongType()),
        T.StructField("pos", T.LongType()),
        T.StructField("hash", T.LongType()),
        T.StructField("offsets", T.ArrayType(T.IntegerType())),
        T.StructField("slots", T.ArrayType(T.StringType())),
        T.StructField("length", T.IntegerType()),
    ]
)


def _slot(word: bytes) -> str:
    """What a slot is compared by: the bare word in lower case, numbers in digits."""
    low = _lower(word.strip(_EDGE))
    return NUMBER_WORDS.get(low, low).decode("utf-8", "replace")


def _window_rows(rows: DataFrame, lengths: list[int] | None, bitmap: np.ndarray | None) -> DataFrame:
    """``place, pos, hash, offsets, slots, length`` of the windows of ``place, body``.

    Offsets are the places of the slots in the window.

    Without ``lengths`` a text gives windows of the usual length, or one of its own.
    With a bitmap only windows that hit it are given.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        for batch in small_batches(batches):
            out: list[tuple] = []
            for place, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                mine = lengths or [min(WINDOW, max(1, len(text.split())))]
                for n, hashes, at, kinds, words in templates.windows(text, mine):
                    if bitmap is not None:
                        bit = hashes >> np.uint64(64 - MAP_BITS)
                        hit = np.flatnonzero((bitmap[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1))
                        hashes, at = hashes[hit], at[hit]
                    for i, h in zip(at.tolist(), hashes.view(np.int64).tolist()):
                        offsets = np.flatnonzero(kinds[i : i + n]).tolist()
                        out.append((place, i, h, offsets, [_slot(words[i + k]) for k in offsets], n))
            if out:
                columns = list(zip(*out))
                kinds_ = [pa.int64()] * 3 + [pa.list_(pa.int32()), pa.list_(pa.string()), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds_)], names=_HITS.names)

    return rows.mapInArrow(run, _HITS)


def _bitmap(windows: DataFrame) -> np.ndarray:
    """The benchmark's windows as bits; at most 2 ** (MAP_BITS - 6) rows come to the driver."""
    bit = F.shiftrightunsigned("hash", 64 - MAP_BITS)
    words = windows.groupBy(F.shiftright(bit, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(hash, {64 - MAP_BITS}) & 63 AS INT))")).alias("bits")
    )
    table = np.zeros(1 << (MAP_BITS - 6), np.int64)
    for row in words.collect():
        table[row["word"]] = row["bits"]
    return table.view(np.uint64)


def agreeing(hits: list[dict]) -> tuple[list[int], set[tuple[str, str]]]:
    """Positions of the item's windows that count in one alignment, and its slot pairs (item, document)."""
    at = {h["item_pos"] + k: pair for h in hits for k, pair in zip(h["offsets"], zip(h["item_slots"], h["slots"]))}
    count = Counter(at.values())
    by_item, by_doc = defaultdict(set), defaultdict(set)
    for pair in count:
        by_item[pair[0]].add(pair)
        by_doc[pair[1]].add(pair)
    rivals = {p: r for p in count if (r := (by_item[p[0]] | by_doc[p[1]]) - {p})}
    unchanged = all(a == b for a, b in count if (a, b) not in rivals)

    def wins(pair: tuple[str, str]) -> bool:
        ties = unchanged and pair[0] == pair[1]
        return all(count[pair] > count[r] or (ties and count[pair] == count[r]) for r in rivals[pair])

    lost = {k for k, pair in at.items() if pair in rivals and not wins(pair)}
    kept = {h["item_pos"] for h in hits if lost.isdisjoint(range(h["item_pos"], h["item_pos"] + h["length"]))}
    return sorted(kept), set(count)


_ALIGNED = T.StructType(
    [
        T.StructField("place", T.LongType()),
        T.StructField("item_place", T.LongType()),
        T.StructField("at", T.ArrayType(T.LongType())),
        T.StructField("pairs", T.LongType()),
        T.StructField("changed", T.LongType()),
    ]
)


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Alignments (``place, item_place, hits``) with a window that counts."""
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
    for batch in small_batches(batches):
        out = []
        for place, item, hits in zip(*(c.to_pylist() for c in batch.columns)):
            at, pairs = agreeing(hits)
            if at:
                out.append((place, item, at, len(pairs), sum(a != b for a, b in pairs)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=_ALIGNED.names)


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    place_col: str | None = None,
) -> DataFrame:
    """``id, place, item, windows, item_windows, slots, changed, copied`` of contaminated documents.

    ``place`` is the row's number, in ``place_col`` or else given here.
    """
    items = benchmark.select(
        F.col(item_col).alias("item"), text_or_empty(item_text_col).cast("binary").alias("body"),
        F.monotonically_increasing_id().alias("place"),
    )
    # numbered once and stored, so that places mean the same in both uses
    items = stored(items, "items")
    parts = stored(_window_rows(items.select("place", "body"), None, None), "item-windows")
    lengths = [
        r[0]
        for r in items.select(F.least(F.size(_word_array("body")), F.lit(WINDOW)).alias("n")).where("n > 0").distinct().collect()
    ]  # at most WINDOW values
    if not lengths:
        lengths = [WINDOW]
    bits = _bitmap(parts)
    if place_col is None:
        docs, place_col = numbered(docs.select(*dict.fromkeys([id_col, text_col])))
    rows = docs.select(
        F.col(place_col).alias("place"), text_or_empty(text_col).cast("binary").alias("body"),
        F.col(id_col).alias("id"),
    )
    hits = _window_rows(rows.select("place", "body"), sorted(lengths), bits).drop("offsets", "length")
    mine = parts.select(
        F.col("place").alias("item_place"), F.col("pos").alias("item_pos"), "hash",
        "offsets", F.col("slots").alias("item_slots"), "length",
    )
    equal = F.col("slots") == F.col("item_slots")
    joined = hits.join(mine, "hash").where(
        (F.size("slots") == F.size("item_slots")) & (equal | (F.col("length") - F.size("slots") >= LITERALS))
    )
    # one alignment: at most as many rows as the item has windows
    aligned = joined.groupBy("place", "item_place", (F.col("pos") - F.col("item_pos")).alias("diagonal")).agg(
        F.collect_set(F.struct("item_pos", "length", "offsets", "item_slots", "slots")).alias("hits")
    )
    aligned = aligned.select("place", "item_place", "hits").mapInArrow(_aligned, _ALIGNED)
    found = aligned.groupBy("place", "item_place").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("windows"),
        F.sum("pairs").alias("slots"),
        F.sum("changed").alias("changed"),
    )
    sizes = parts.groupBy(F.col("place").alias("item_place")).agg(F.countDistinct("pos").alias("item_windows"))
    found = found.join(sizes, "item_place").where(
        (F.col("windows") >= COVERAGE * F.col("item_windows")) | (F.col("windows") >= RUN)
    )
    found = found.join(items.select(F.col("place").alias("item_place"), "item"), "item_place")
    # place as a join key: ids may repeat or be null
    return (
        found.join(rows.select("place", "id"), "place")
        .select("id", "place", "item", "windows", "item_windows", "slots", "changed", (F.col("changed") == 0).alias("copied"))
    )


def _word_array(column: str):
    return F.regexp_extract_all(F.col(column).cast("string"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that no benchmark item contaminates, with its columns."""
    rows, place = numbered(docs)
    bad = matches(rows, benchmark, id_col, text_col, place_col=place).select(F.col("place").alias(place)).distinct()
    return rows.join(bad, place, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "windows", "item_windows", "slots", "changed", "copied"
    )
