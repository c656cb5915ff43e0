"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.session import shared_folder

# Words are runs of anything but space and the five ASCII control blanks.  For
# bytes that is what ``split()`` without an argument does.
BLANKS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_ascii(value: Column) -> Column:
    """A-Z to a-z; other letters stay."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(value, upper, upper.lower())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def narrow(df: DataFrame, id_col: str, text_col: str, as_bytes: bool = True) -> DataFrame:
    """Two columns, ``id`` and ``body``, whatever else the table holds."""
    body = text_or_empty(text_col)
    return df.select(
        F.col(id_col).alias("id"), (body.cast("binary") if as_bytes else body).alias("body")
    )


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: later jobs start from there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """Stored with a number a row, and the name of that column.

    Numbers of rows that are only computed may differ between two uses, when a
    lost task runs again; those that are stored don't.
    """
    place = "_tidings_place"
    while place in df.columns:
        place += "_"
    return stored(df.withColumn(place, F.monotonically_increasing_id()), "rows"), place


def bucketed(df: DataFrame, by: str, name: str) -> DataFrame:
    """Stored in buckets of a column where the rows are, so that grouping by it moves none of them."""
    spark = df.sparkSession
    table_name = f"llm_{name}_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        df.write.bucketBy(parts, by)
        .option("path", f"{shared_folder(spark)}/{table_name}")
        .option("compression", "zstd")
        .saveAsTable(table_name)
    )
    table = spark.table(table_name)
    table.schema  # resolved: files and buckets are known from here on
    spark.sql(f"DROP TABLE {table_name}")  # the entry; the files stay
    return table


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many rows, so that a few long texts are held at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts (strings or binary) behind each other, and how many each text has."""
    lists = pc.ascii_split_whitespace(texts.view(pa.string()))
    flat = lists.flatten()
    real = pc.binary_length(flat).to_numpy() > 0
    ends = np.r_[0, np.cumsum(real)][lists.offsets.to_numpy()]
    return flat.filter(pa.array(real)), np.diff(ends)


def join_words(words: pa.Array, sizes: np.ndarray) -> pa.Array:
    """One binary a text from its words, a blank apart."""
    ends = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), words.view(pa.string()))
    return pc.binary_join(lists, " ").view(pa.binary())


def give_back() -> None:
    """Let a worker that stays for other tasks return the memory it has freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


class Numbers(dict):
    """Numbers for words in order of first use; ``new`` lists those not dealt with yet."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def of_array(self, words: pa.Array) -> np.ndarray:
        """The same for an array of words; each different one is looked up once."""
        coded = words.dictionary_encode()
        known = self.of(coded.dictionary.view(pa.binary()).to_pylist())
        return known[coded.indices.to_numpy()]

    def forget(self) -> None:
        self.clear()
        self.new = []


def mix64(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return values ^ (values >> np.uint64(31))
