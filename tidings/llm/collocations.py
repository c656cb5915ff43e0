"""Phrases that are more than their parts, mined by joining occurrence relations level by level.

The relation R(1) holds the occurrences of all frequent words, sorted by place.  A
phrase of k + 1 words is a phrase of k words and a word at the next place of a piece, so
R(k + 1) is R(k) merge-joined with R(1) there; phrases are counted in groups, and those met
often enough stay.  Infrequent words never get further.

On Spark: a relation has one row for each bounded chunk of texts of a language,
with its places and word numbers as arrays, so the merge-joins need no shuffle.
What is shuffled, once, are the different windows of each chunk with their counts, so a
phrase that makes up a third of a corpus is one row a chunk.  Windows of the greatest length are
dealt by their first three words, and the counts of shorter ones are sums of theirs; pairs have
rows of their own.  So there is at most a window for each word of the input, however many
phrases are frequent.  Word numbers stand for exact words, never for hashes.  The tables of
frequent phrases are joined with each other by these for the scores.

Pieces end at ``. , ; : ! ?`` and line breaks; a place that is no word lies between
two pieces and between two texts, so no phrase spans them.

Defined results: a null text is empty; a null language is ``und``; ids are not looked at;
repeated rows count each; a very long text may make its chunk larger than the bound;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidings.llm.common import Numbers, documents, mix64, small_batches, split_words, stored, text_or_empty

LEAST = 30
LONGEST = 4
TOP = 2000
SHARE = 80  # percent of its occurrences inside a longer candidate that drop a phrase
CHUNK_WORDS = 1 << 22
BUCKET_WORDS = 1 << 21
BREAK = b"."  # never a word
SALTS = 64

_FROM = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\v\f\r"
_TABLE = bytes.maketrans(_FROM, _FROM[:26].lower() + b" " + BREAK * 9)


def pieces(bodies: pa.Array) -> pa.Array:
    """The words of binary texts, with a break between pieces and at the end of a text."""
    spaced = [x.translate(_TABLE).replace(BREAK, b" . ") + b" ." for x in bodies.to_pylist()]
    return split_words(pa.array(spaced, pa.binary()))[0]


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def _unpack(raw: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def _occurrences(docs: DataFrame, text_col: str, lang_col: str, chunk_words: int) -> DataFrame:
    """``chunk, lang, n_words, names, words``: word numbers of texts of a language, breaks being 0."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    rows = docs.select(lang.alias("lang"), text_or_empty(text_col).cast("binary").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        # a chunk in the making for each language
        made: dict[str, tuple[Numbers, list[np.ndarray]]] = {}
        sizes: dict[str, int] = {}

        def emit(lang: str) -> pa.RecordBatch:
            nonlocal chunk
            words, parts = made.pop(lang)
            del sizes[lang]
            names = np.concatenate(parts)
            row = [
                pa.array([chunk]), pa.array([lang]), pa.array([int((names > 0).sum())]),
                pa.array([_pack(names)], pa.binary()),
                pa.array([zstandard.ZstdCompressor(level=1).compress(b" ".join(words))], pa.binary()),
            ]
            chunk += 1
            return pa.RecordBatch.from_arrays(row, names=["chunk", "lang", "n_words", "names", "words"])

        for batch in batches:
            for part in small_batches([batch]):
                langs = part.column(0).dictionary_encode()
                for i, lang in enumerate(langs.dictionary.to_pylist()):
                    if lang not in made:
                        made[lang] = (Numbers(), [])
                        made[lang][0].of([BREAK])
                        sizes[lang] = 0
                    words, parts = made[lang]
                    parts.append(words.of_array(pieces(part.column(1).filter(pc.equal(langs.indices, i)))))
                    words.new.clear()
                    sizes[lang] += len(parts[-1])
                    while sum(sizes.values()) >= chunk_words:
                        yield emit(max(sizes, key=sizes.get))
        for lang in list(made):
            yield emit(lang)

    return rows.mapInArrow(run, "chunk long, lang string, n_words long, names binary, words binary")


def _chunk_words(rows: DataFrame) -> DataFrame:
    """``chunk, number, lang, word, n`` for every different word of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, lang, raw, packed in zip(*(batch.column(i).to_pylist() for i in range(4))):
                names = _unpack(raw, np.int32)
                words = zstandard.ZstdDecompressor().decompress(packed).split(b" ")
                n = np.bincount(names, minlength=len(words))
                for at in range(1, len(words), 50_000):
                    some = words[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(some), chunk)), pa.array(np.arange(at, at + len(some), dtype=np.int32)),
                            pa.array([lang] * len(some)), pa.array(some, pa.binary()), pa.array(n[at : at + 50_000]),
                        ],
                        names=["chunk", "number", "lang", "word", "n"],
                    )

    schema = "chunk long, number int, lang string, word binary, n long"
    return rows.select("chunk", "lang", "names", "words").mapInArrow(run, schema)


_RELATION = "chunk long, place binary, name binary, ids binary"


def _relation(chunk: int, place: np.ndarray, name: np.ndarray, ids: np.ndarray) -> pa.Table:
    """A chunk's occurrences by place; ``ids[name]`` is the phrase's number in its table."""
    steps = np.diff(place, prepend=0).astype(np.int32)
    return pa.table(
        {
            "chunk": pa.array([chunk], pa.int64()), "place": pa.array([_pack(steps)], pa.binary()),
            "name": pa.array([_pack(name.astype(np.int32))], pa.binary()), "ids": pa.array([_pack(ids)], pa.binary()),
        }
    )


def _read(place: bytes, name: bytes, ids: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.cumsum(_unpack(place, np.int32), dtype=np.int64), _unpack(name, np.int32), _unpack(ids, np.int64)


def _first_relation(rows: DataFrame, known: DataFrame) -> DataFrame:
    """R(1): occurrences of frequent words; ``known`` is ``chunk, number, id``."""

    def keep(left: pa.Table, right: pa.Table) -> pa.Table:
        names = _unpack(left.column("names")[0].as_py(), np.int32)
        number, ids = right.column("number").to_numpy(), right.column("id").to_numpy()
        new = np.full(int(names.max(initial=0)) + 1, -1, np.int32)
        new[number] = np.arange(len(number), dtype=np.int32)
        name = new[names]
        place = np.flatnonzero(name >= 0)
        return _relation(left.column("chunk")[0].as_py(), place, name[place], ids)

    left = rows.select("chunk", "names").groupBy("chunk")
    return left.cogroup(known.groupBy("chunk")).applyInArrow(keep, _RELATION)


def _different(place: np.ndarray, name: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
    """Merge-joins of a sorted relation with itself at the next places: windows and their counts.

    First the different pairs, then the different windows of three words or more, which end with
    their piece, before a word that is not in the relation, or after ``longest`` words.  A
    window is given as one place of each, its other words (-1 past its end) and counts.
    """
    near = np.append(place[1:] == place[:-1] + 1, np.zeros(longest, bool))
    del place
    none = int(name.max(initial=0)) + 1
    for words in sorted({2, longest}):
        inner = near[:-1] & near[1:] if words > 2 else near
        at = np.flatnonzero(inner)
        alive = np.ones(len(at), bool)
        code, kinds, steps = name[at].astype(np.int64), none + 1, []
        for k in range(1, words):
            alive &= near[at + k - 1]
            word = np.full(len(at), none, np.int32)
            word[alive] = name[at[alive] + k]
            if kinds * (none + 1) >= 1 << 62:
                different, code = np.unique(code, return_inverse=True)
                kinds = len(different)
            code = code * (none + 1) + word
            kinds *= none + 1
            steps.append(word)
        order = np.argsort(code)
        code = code[order]
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
        n = np.diff(first, append=len(code))
        one = order[first]
        del code, order
        yield at[one], [np.where(w[one] == none, -1, w[one]) for w in steps], n


def _pack_bytes(values: np.ndarray) -> bytes:
    """32-bit numbers, first bytes first, which packs well what is sorted or small."""
    return _pack(values.astype(np.int32).view(np.uint8).reshape(-1, 4).T)


def _unpack_bytes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(_unpack(raw, np.uint8).reshape(4, -1).T).view(np.int32).ravel()


def _windows(relation: DataFrame, longest: int, buckets: int) -> DataFrame:
    """``bucket, words, n``: the different windows of each chunk, in buckets of their first three words.

    ``words`` has an array for each word of a window, 0 past its end.  Rows with two words count all
    places of that pair; longer ones are not contained in them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, *parts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                place, name, ids = _read(*parts)
                ids = np.append(ids, 0).astype(np.int32)  # -1 stands for none
                for at, words, n in _different(place, name, longest):
                    columns = [ids[name[at]], *(ids[w] for w in words)]
                    stem = np.zeros(len(at), np.uint64)
                    for w in columns[:3]:
                        stem = mix64(stem ^ w.astype(np.uint64))
                    bucket = (stem % np.uint64(buckets)).astype(np.int32)
                    order = np.argsort(bucket, kind="stable")
                    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
                    for b in np.flatnonzero(np.diff(edges)):
                        some = order[edges[b] : edges[b + 1]]
                        packed = [_pack_bytes(w[some]) for w in columns]
                        packed += [_pack_bytes(np.zeros(len(some)))] * (longest - len(columns))
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([b], pa.int32()), pa.array([packed], pa.list_(pa.binary())),
                                pa.array([_pack_bytes(n[some])], pa.binary()),
                            ],
                            names=["bucket", "words", "n"],
                        )

    return relation.mapInArrow(run, "bucket int, words array<binary>, n binary")


def _counted(words: list[np.ndarray], n: np.ndarray, least: int) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """Windows met ``least`` times and, for lengths from three on, their first words: length, words, counts."""
    # two words make a number, so that fewer are compared
    keys = [words[i].astype(np.int64) << 32 | (words[i + 1] if i + 1 < len(words) else 0) for i in range(0, len(words), 2)]
    order = np.lexsort(keys[::-1])
    words, n = [w[order] for w in words], n[order].astype(np.int64)
    del keys, order
    for k in range(len(words), min(3, len(words)) - 1, -1):
        new = np.zeros(len(n), bool)
        new[:1] = True
        for w in words[:k]:
            new[1:] |= w[1:] != w[:-1]
        first = np.flatnonzero(new)
        words, n = [w[first] for w in words[:k]], np.add.reduceat(n, first) if len(n) else n
        often = n >= least
        for size in (k, 2) if k == 3 else (k,):
            # three words and none for the third: a pair
            some = often & (words[k - 1] > 0) if size == k else often & (words[2] == 0)
            yield size, [w[some] for w in words[:size]], n[some]


def _frequent(windows: DataFrame, longest: int, least: int) -> DataFrame:
    """``k, w1, w2, ..., a``: phrases of ``k`` words met ``least`` times, 0 past their end.

    Windows are shuffled once; those with the same first three words meet, and longer ones
    give the counts of shorter ones.  The rows of pairs count by themselves.
    """
    names = [f"w{k}" for k in range(1, longest + 1)]

    def count(rows: pa.Table) -> pa.Table:
        words = [np.concatenate([_unpack_bytes(x[i].as_py()) for x in rows.column("words")]) for i in range(longest)]
        n = np.concatenate([_unpack_bytes(x.as_py()) for x in rows.column("n")])
        found = list(_counted(words, n, least))
        columns = [np.concatenate([np.full(len(a), k, np.int32) for k, _, a in found])]
        for i in range(longest):
            columns.append(np.concatenate([w[i] if i < k else np.zeros(len(a), np.int32) for k, w, a in found]))
        columns.append(np.concatenate([a for *_, a in found]))
        return pa.table([pa.array(x) for x in columns], names=["k", *names, "a"])

    schema = ", ".join(["k int", *(f"{x} int" for x in names), "a long"])
    return windows.groupBy("bucket").applyInArrow(count, schema)


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """Stored with a number a row, so that it stays the same from here on."""
    return stored(rows.withColumn("id", F.monotonically_increasing_id()), name)


def _dense(table: DataFrame) -> DataFrame:
    """With ``w1``, a number from 1 on without large gaps; ``id`` counts rows by partition."""
    sizes = table.groupBy(F.shiftright("id", 33).alias("part")).agg(F.max("id").alias("last")).orderBy("part").collect()
    starts, at = [], 1
    for part, last in sizes:
        starts.append((part, at))
        at += last - (part << 33) + 1
    if at >= 1 << 31:
        raise ValueError("more than 2 ** 31 frequent words")
    parts = table.sparkSession.createDataFrame(starts, "part long, start long")
    rows = table.join(F.broadcast(parts), F.shiftright("id", 33) == F.col("part"))
    number = F.col("start") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("w1", number.cast("int")).drop("part", "start")


def phrase_tables(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = LEAST,
    longest: int = LONGEST,
    chunk_words: int = CHUNK_WORDS,
) -> tuple[DataFrame, list[DataFrame]]:
    """``lang, n`` and, for every length, ``id, lang, phrase, a, heads, tails`` of frequent phrases.

    ``heads`` and ``tails`` are the counts of its first and of its other words for every cut; from
    two words on also ``left`` and ``right``, the numbers of the phrases a word shorter, and
    ``w1, w2, ...``, those of its words.
    """
    rows = stored(_occurrences(docs, text_col, lang_col, chunk_words), "occurrences")
    totals = rows.groupBy("lang").agg(F.sum("n_words").alias("n"))
    words = _chunk_words(rows)
    counts = words.groupBy("lang", "word").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    none = F.array().cast("array<long>")
    table = _numbered(
        counts.select("lang", F.col("word").cast("string").alias("phrase"), "word", "a", none.alias("heads"), none.alias("tails")),
        "words",
    )
    tables = [table.drop("word")]
    if longest < 2:
        return totals, tables
    table = _dense(table)
    known = words.select("chunk", "number", "lang", "word").join(table.select("lang", "word", "w1"), ["lang", "word"])
    known = known.select("chunk", "number", F.col("w1").cast("long").alias("id"))
    relation = stored(_first_relation(rows, known), "relation")
    n_words = totals.agg(F.sum("n")).first()[0] or 0
    windows = _windows(relation, longest, n_words // BUCKET_WORDS + 1)
    frequent = stored(_frequent(windows, longest, least), "counts")
    names = [f"w{k}" for k in range(1, longest + 1)]
    for k in range(2, longest + 1):
        counts = frequent.where(F.col("k") == k)
        first = table.select(
            *names[: k - 1], F.col("id").alias("left"), "lang", F.col("phrase").alias("first"), F.col("a").alias("fa"), "heads"
        )
        last = table.select(
            *(F.col(x).alias(y) for x, y in zip(names, names[1:k])), F.col("id").alias("right"),
            F.substring_index("phrase", " ", -1).alias("last"), F.col("a").alias("la"), "tails",
        )
        joined = counts.select(*names[:k], "a").join(first, names[: k - 1]).join(last, names[1:k])
        table = _numbered(
            joined.select(
                "left", "right", *names[:k], "lang", F.concat_ws(" ", "first", "last").alias("phrase"), "a",
                F.concat("heads", F.array("fa")).alias("heads"), F.concat(F.array("la"), "tails").alias("tails"),
            ),
            "phrases",
        )
        tables.append(table)
    return totals, tables


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = LEAST,
    longest: int = LONGEST,
    share: int = SHARE,
    chunk_words: int = CHUNK_WORDS,
) -> DataFrame:
    """``lang, phrase, a, l, r, n, score``: candidates that no longer candidate makes needless.

    A cut of a phrase into first and last words with counts l and r scores
    floor(2,000,000 a / (l + r)); the cut with the lowest score counts, of equal ones
    the first.  Decimals hold the products.  A phrase goes when a candidate one
    word longer has ``share`` percent of its occurrences; one that is two words
    longer then implies one between.
    """
    totals, tables = phrase_tables(docs, text_col, lang_col, least, longest, chunk_words)
    found = None
    for table, longer in zip(tables[1:], [*tables[2:], None]):
        if longer is not None:
            both = longer.select(F.col("left").alias("id"), "a").union(longer.select(F.col("right").alias("id"), "a"))
            most = both.groupBy("id").agg(F.max("a").alias("most"))
            table = table.join(most, "id", "left").where(
                F.col("most").isNull() | (100 * F.col("most").cast("decimal(20,0)") < share * F.col("a").cast("decimal(20,0)"))
            )
        table = table.select("lang", "phrase", "a", "heads", "tails")
        found = table if found is None else found.union(table)
    found = found.withColumn("cut", F.expr(LOWEST_CUT))
    names = F.broadcast(totals) if _few(totals) else totals
    return found.join(names, "lang").select(
        "lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n",
        F.col("cut.score").cast("long").alias("score"),
    )


#: The cut with the lowest score of ``a, heads, tails``: ``score, k, l, r``, exact.
LOWEST_CUT = """
array_min(zip_with(transform(heads, (x, i) -> named_struct('k', i, 'l', x)), tails, (h, t) -> named_struct(
    'score', (2000000BD * cast(a as decimal(20,0))) div (cast(h.l as decimal(20,0)) + cast(t as decimal(20,0))),
    'k', h.k, 'l', h.l, 'r', t)))
"""


def _few(rows: DataFrame, most: int = 10_000) -> bool:
    """Whether a table has at most so many rows."""
    return len(rows.limit(most + 1).select(F.lit(1)).collect()) <= most


def ranked(found: DataFrame, top: int = TOP, salts: int = SALTS) -> DataFrame:
    """``lang, rank, ...``: the first ``top`` of each language by score, count, phrase.

    A language's rows are first cut to their best in ``salts`` parts, so the last
    sort of a language has at most ``top * salts`` rows.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(salts))
    best = F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))
    rows = found.withColumn("rank", best).where(F.col("rank") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    rows = rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_setm_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(collocations(documents(spark, sf_dir)))


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP13_SQL = f"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}') AS x FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(x, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
o AS (SELECT lang, ws, unnest(range(1, {LONGEST + 1})) AS k FROM w),
g AS (SELECT lang, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM o WHERE len(ws) >= k),
f AS (SELECT lang, k, ws[i:i + k - 1] AS ph, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (SELECT lang, k, ph, a, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (SELECT c.lang, c.k, c.ph, c.a, c.cut, x.a AS l, y.a AS r,
        ((2000000::HUGEINT * c.a) // (x.a + y.a))::BIGINT AS score
      FROM c JOIN f x ON x.lang = c.lang AND x.ph = c.ph[1:c.cut] JOIN f y ON y.lang = c.lang AND y.ph = c.ph[c.cut + 1:c.k]),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, cut) = 1),
inner_ AS (SELECT lang, a, unnest(list_distinct(flatten(list_transform(range(2, k),
             lambda z: list_transform(range(1, k - z + 2), lambda i: ph[i:i + z - 1]))))) AS ph FROM f WHERE k > 2),
most AS (SELECT lang, ph, max(a) AS most FROM inner_ GROUP BY ALL),
kept AS (SELECT m.* FROM m LEFT JOIN most USING (lang, ph) WHERE most IS NULL OR 100 * most < {SHARE} * m.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ph, ' ')) AS rank,
       array_to_string(ph, ' ') AS phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= {TOP}
"""
