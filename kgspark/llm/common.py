"""What the training-data operators share: reading tables, settling results, word patterns."""

from __future__ import annotations

import ctypes
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kgspark.plans.lineage import shared_dir, ship_package

#: Words between ASCII white space; used for counting, shingles and language models.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
#: Words of letters and digits; every character outside ASCII counts as a letter.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
_LOWER_TABLE = str.maketrans(_UPPER, _LOWER)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if its counted rows are at most ``max_rows``, else left to a shuffle join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(c, _UPPER, _LOWER)


def ascii_lower(text: str) -> str:
    """A-Z to a-z on a Python string; ``lower()`` does the same on pure ASCII and is faster."""
    return text.lower() if text.isascii() else text.translate(_LOWER_TABLE)


spaced_words = re.compile(SPACED_WORD).findall
alnum_words = re.compile(ALNUM_WORD).findall


#: Bytes of an Arrow batch where the session leaves Spark's default; a longer row comes alone.
BATCH_BYTES, _DEFAULT_BYTES = 8 << 20, "67108864b"
_BYTES_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def ready(spark: SparkSession) -> None:
    """Ship the package, and bound Arrow batches by bytes, so that long texts do not make large ones."""
    ship_package(spark)
    if spark.conf.get(_BYTES_SETTING) == _DEFAULT_BYTES:
        spark.conf.set(_BYTES_SETTING, f"{BATCH_BYTES}b")


def _array(x, kind: pa.DataType) -> pa.Array:
    if not isinstance(x, pa.Array):
        return pa.array(x, kind)
    return x if x.type == kind else x.cast(kind)


def give_back() -> None:
    """Return memory that this worker holds but no longer uses, as it stays for later tasks beside other workers."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what it holds
        pass


def over_batches(df: DataFrame, rows_of, schema: str) -> DataFrame:
    """``rows_of(batch) -> dict of lists`` over each Arrow batch of ``df``, as a DataFrame of ``schema``.

    A list may also be an Arrow array.  Batches are taken one at a time, so memory is that of one batch.
    """
    ready(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            got = rows_of(batch)
            yield pa.RecordBatch.from_arrays([_array(got[f.name], f.type) for f in arrow], schema=arrow)
        got = batch = None
        give_back()

    return df.mapInArrow(run, schema)


def text_bytes(name: str = "text") -> Column:
    """The UTF-8 bytes of a text column, none for null."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


# Byte tables: UTF-8 bytes from 0x80 belong to characters outside ASCII, which the word patterns leave in words.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ALNUM_BYTES = bytes(32 if b < 48 or 57 < b < 65 or 90 < b < 97 or 122 < b < 128 else LOWER_BYTES[b] for b in range(256))


def lower_spaced_words(data: bytes) -> list[bytes]:
    """Words of SPACED_WORD, A-Z lower-cased (bytes.split() parts at exactly these characters)."""
    return data.translate(LOWER_BYTES).split()


def lower_alnum_words(data: bytes) -> list[bytes]:
    """Words of ALNUM_WORD, A-Z lower-cased."""
    return data.translate(ALNUM_BYTES).split()


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        tables = []
        for base in (_MULTIPLIER, _INVERSE):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            tables.append(np.multiply.accumulate(factors))
        _powers[:] = tables
    return _powers


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def spaced_word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of SPACED_WORD in order: differences of a polynomial prefix hash over the bytes."""
    if not data:
        return np.empty(0, np.uint64)
    b = np.frombuffer(data, np.uint8)
    word = np.concatenate(([False], ~_IS_SPACE[b], [False]))
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    powers, inverses = _power_tables(len(b) + 1)
    prefix = np.empty(len(b) + 1, np.uint64)
    prefix[0] = 0
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers[: len(b)], out=prefix[1:])
    raw = (prefix[ends] - prefix[starts]) * inverses[starts]
    return mix64(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n consecutive words; of the whole sequence if it is shorter and not empty."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = mix64(out + words[i : len(words) - n + 1 + i] + np.uint64(i + 1))
    return out


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of the component of each of n nodes, where a[k] and b[k] are linked (union-find).

    Roots are hooked to smaller ones, then paths are halved until every node points to its root; links within a
    component are done with, so rounds are few.
    """
    parent = np.arange(n)
    while len(a):
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    return parent
