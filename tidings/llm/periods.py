"""Periodic runs of words, found through a dictionary of basic factors.

A run is a stretch of consecutive words with smallest period q and at least
``MIN_POWER`` times q (and ``MIN_LENGTH``) words that no neighbouring word extends.

The dictionary names all factors (stretches) of length m = 1, 2, 4, ... of a text:
two factors of length 2m are equal if the names of their halves are.  For a run of
period q the level is m with m / 2 < q <= m.  A factor of that length inside the run
holds a whole primitive period, so its next occurrence is exactly q words on, as long as
that also lies inside: the occurrences form arithmetic progressions with step q.  So at
every level the places whose successor is at distance q with m / 2 < q <= m are taken;
neighbouring places with the same distance make one stretch, which extended by q + m
words is the whole run.  A run of four periods or more is longer than q + m, so none is
missed, and a period belongs to one level, so none comes twice.

Places whose factor doesn't occur again in their document can't have a longer factor
that does, and leave the dictionary; in ordinary text few are left after some levels.
Texts of a task are treated together, a bounded number of words at a time.

Defined results: a null or blank text has no words and no runs; ids may be null or
repeated, every row is treated by itself; a very long text is treated alone; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidings.llm.common import WORD, Numbers, documents, join_words, narrow, small_batches, split_words, text_or_empty

MIN_POWER = 4
MIN_LENGTH = 6
SLICE_WORDS = 1 << 19


def runs(
    names: np.ndarray, sizes: np.ndarray, power: int = MIN_POWER, least: int = MIN_LENGTH
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of all runs of texts behind each other, by start, then period.

    ``names`` are word numbers, ``sizes`` the texts' lengths; ``power`` is 3 or more.
    """
    total = len(names)
    ends = np.repeat(np.cumsum(sizes), sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place, name = np.arange(total), names.astype(np.int64)
    found: list[tuple[np.ndarray, ...]] = []
    m = 1
    while len(place):
        order = np.argsort(name, kind="stable")
        here, there = order[:-1], order[1:]
        same = (name[here] == name[there]) & (doc[place[here]] == doc[place[there]])
        here, there = here[same], there[same]
        gap = np.zeros(len(place), np.int64)
        gap[here] = place[there] - place[here]
        at = np.flatnonzero((2 * gap > m) & (gap <= m))
        if len(at):
            start, step = place[at], gap[at]
            new = np.r_[True, (start[1:] != start[:-1] + 1) | (step[1:] != step[:-1])]
            first = np.flatnonzero(new)
            count = np.diff(np.r_[first, len(at)])
            length = count - 1 + step[first] + m
            good = length >= np.maximum(least, power * step[first])
            found.append((start[first][good], length[good], step[first][good]))
        # factors of twice the length: both halves must occur again
        again = np.zeros(len(place), bool)
        again[here] = again[there] = True
        place, name = place[again], name[again]
        index = np.full(total + m, -1)
        index[place] = np.arange(len(place))
        half = index[place + m]
        fits = (half >= 0) & (place + 2 * m <= ends[place])
        pair = name[fits] * (int(name.max(initial=0)) + 1) + name[half[fits]]
        place, m = place[fits], 2 * m
        name = np.unique(pair, return_inverse=True)[1]
    starts, lengths, periods = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((periods, starts))
    return starts[order], lengths[order], periods[order]


def _slices(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """Ids, words and counts of texts, so many words at a time or one text."""
    for batch in small_batches(batches):
        flat, sizes = split_words(batch.column(1))
        ends = np.r_[0, np.cumsum(sizes)]
        a = 0
        while a < len(sizes):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + words, "right")) - 1)
            yield batch.column(0).slice(a, b - a), flat.slice(ends[a], ends[b] - ends[a]), sizes[a:b]
            a = b


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    power: int = MIN_POWER,
    least: int = MIN_LENGTH,
    slice_words: int = SLICE_WORDS,
) -> DataFrame:
    """``id, n_words, runs, collapsed`` for every row, without a shuffle.

    ``runs`` are structs ``start, length, period`` by start, then period;
    ``collapsed`` has the words, a blank apart, that no run holds after its first period.
    """
    if power < 3:
        raise ValueError("runs of less than three periods may hide from their level")
    rows = narrow(docs, id_col, text_col)
    run_type = T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")])
    schema = T.StructType(
        [T.StructField("id", rows.schema["id"].dataType), T.StructField("n_words", T.LongType())]
        + [T.StructField("runs", T.ArrayType(run_type)), T.StructField("collapsed", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, flat, sizes in _slices(batches, slice_words):
            start, length, period = runs(Numbers().of_array(flat), sizes, power, least)
            begins = np.cumsum(sizes) - sizes
            total = int(sizes.sum())
            steps = np.bincount(start + period, minlength=total + 1) - np.bincount(start + length, minlength=total + 1)
            gone = np.cumsum(steps[:-1]) > 0
            doc = np.searchsorted(np.cumsum(sizes), start, "right")
            offsets = np.searchsorted(doc, np.arange(len(ids) + 1)).astype(np.int32)
            structs = pa.StructArray.from_arrays(
                [pa.array(start - begins[doc]), pa.array(length), pa.array(period)], names=["start", "length", "period"]
            )
            left = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[~gone], minlength=len(sizes))
            texts = join_words(flat.filter(pa.array(~gone)), left)
            found = pa.ListArray.from_arrays(pa.array(offsets), structs)
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), found, texts], names=schema.names)

    return rows.mapInArrow(run, schema).withColumn("collapsed", F.col("collapsed").cast("string"))


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: every document's words, a blank apart, some with a periodic tail by their id.

    With h the CRC-32 of the id in decimal and g = floor(h / 10), a tenth of the
    documents (h % 10 = 0) repeat from word a = g % n on with period
    1 + floor((n - a) / (3 + g % 8)).
    """
    text = text_or_empty("text")
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    df = docs.select("doc_id", text.alias("text"), (h % 10 == 0).alias("chosen"), g.alias("g"))
    # only chosen texts are split here
    df = df.withColumn("words", F.when(F.col("chosen"), words))
    n = F.size("words").cast("long")
    df = df.withColumn("a", F.when(n > 0, F.col("g") % n))
    df = df.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))

    def moved(word: Column, i: Column) -> Column:
        source = F.col("a") + F.pmod(i - F.col("a"), F.col("p"))
        return F.when(i >= F.col("a"), F.get("words", source.cast("int"))).otherwise(word)

    tail = F.array_join(F.transform("words", moved), " ")
    return df.select("doc_id", F.when(F.col("a").isNotNull(), tail).otherwise(F.col("text")).alias("text"))


def op12_basic_factor_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs(planted(documents(spark, sf_dir)))
    order = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    )
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = rows.withColumn("_best", order)
    return rows.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_best.s")).alias("start"),
        F.col("_best.n").alias("length"),
        (-F.col("_best.p")).alias("period"),
        F.expr("(1000 * _best.n) div (-_best.p)").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
