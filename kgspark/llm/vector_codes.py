"""Product quantisation of vectors in integers: codebooks by k-means over blocks of columns, then a code for each vector.

A vector's components x become integers floor(scale * x); vectors are cut into equal consecutive parts, each with its
own codebook.  The integers are written once as blocks of columns (a block's dimension d is one stretch of 32-bit
integers).  Each round is one ``treeAggregate`` over the blocks: distances to the entries accumulate dimension by
dimension, ``np.add.at`` adds the parts to sums and counts of fixed size, and these merge through a reduction tree.  The
driver sees one such pair a round, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_batches, ready, settle, small

#: Vectors in a block, which bounds the distances that are held at once.
BLOCK_ROWS = 4096


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of ``book`` (entries, width) to each column of ``part`` (width, n), the lowest of ties, and its squared distance."""
    distance = np.zeros((len(book), part.shape[1]), np.int64)
    for x, entries in zip(part, book.T, strict=True):
        gap = x[None, :] - entries[:, None]
        gap *= gap
        distance += gap
    codes = distance.argmin(axis=0)
    return codes, distance[codes, np.arange(len(codes))]


def largest(dims: int) -> int:
    """Largest integer component for which the squared distances of a vector still add up to less than 63 bits."""
    return math.isqrt((1 << 62) // max(dims, 1)) // 2


def columns_of(vectors, dims: int, scale: int) -> np.ndarray:
    """(dims, n) integers of an Arrow list array; missing components are 0, those out of range the largest or smallest."""
    lengths = np.asarray(vectors.value_lengths()).astype(np.int64)
    values = np.asarray(vectors.flatten(), np.float64)
    x = np.zeros((len(lengths), dims))
    x[np.arange(dims) < lengths[:, None]] = values
    most = largest(dims)
    return np.clip(np.floor(x * scale), -most, most).astype(np.int64).T


def finite_rows(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is neither null nor holds a null, NaN or infinite component, with the vector as doubles."""
    x = df.withColumn(vector, F.col(vector).cast("array<double>"))
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return x.filter(F.col(vector).isNotNull() & ~odd)


def _first_vectors(rows: DataFrame, entries: int) -> list[list[float]]:
    """The vectors of the smallest distinct ids, the smallest vector of each; null ids count as one, after all others."""
    found: dict = {}
    left = rows.filter("id IS NOT NULL")
    while len(found) < entries:
        head = (left.filter(F.col("id") > max(found)) if found else left).orderBy("id", "vector").limit(entries).collect()
        for r in head:
            found.setdefault(r.id, r.vector)
        if len(head) < entries:
            break
    vectors = [found[k] for k in sorted(found)][:entries]
    if len(vectors) < entries:
        vectors += [r.vector for r in rows.filter("id IS NULL").orderBy("vector").limit(1).collect()]
    return vectors


def _trained(blocks: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """``books`` (parts, entries, width) after ``rounds`` of assigning all parts and taking floors of their means."""
    parts, entries, width = books.shape

    def add(total, row):
        sums, counts = total
        x = np.frombuffer(row[0], "<i4").reshape(parts, width, -1).astype(np.int64)
        for part, book, s, n in zip(x, current, sums, counts, strict=True):
            codes, _ = nearest(part, book)
            np.add.at(n, codes, 1)
            for d in range(width):
                np.add.at(s[d], codes, part[d])
        return total

    def merge(a, b):
        return a[0] + b[0], a[1] + b[1]

    rdd = blocks.select("block").rdd
    for _ in range(rounds):
        current = books
        zero = (np.zeros((parts, width, entries), np.int64), np.zeros((parts, entries), np.int64))
        sums, counts = rdd.treeAggregate(zero, add, merge, depth=2)
        means = np.floor_divide(sums.transpose(0, 2, 1), np.maximum(counts, 1)[:, :, None])
        books = np.where(counts[:, :, None] > 0, means, books)
    return books


def codebooks(df: DataFrame, id: str = "vec_id", vector: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> np.ndarray:
    """Codebooks (parts, entries, width) of the vectors of df, started from those of the smallest ids.

    Fewer ids than entries give as many entries as there are ids; no vectors, none.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    spark = df.sparkSession
    rows = finite_rows(df.select(F.col(id).alias("id"), F.col(vector).alias("vector")), "vector")
    longest = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    dims = width * parts

    def rows_of(batch):
        x = columns_of(batch.column("vector"), dims, scale)
        return {"block": [x[:, k : k + BLOCK_ROWS].astype("<i4").tobytes() for k in range(0, x.shape[1], BLOCK_ROWS)]}

    first = _first_vectors(rows, entries)
    start = columns_of(pa.array(first, pa.list_(pa.float64())), dims, scale).reshape(parts, width, -1).transpose(0, 2, 1)
    if not first:
        return start
    blocks = settle(over_batches(rows.select("vector"), rows_of, "block binary"))
    ready(spark)
    return _trained(blocks, np.ascontiguousarray(start), rounds)


def digest(books: np.ndarray) -> str:
    """sha256 of all components in decimal, by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(df: DataFrame, books: np.ndarray, id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 4096) -> DataFrame:
    """id, label, code (two hex digits a part) and error (squared distance to the entries) of every vector."""
    parts, _, width = books.shape
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = finite_rows(df.select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector")), "vector")

    def rows_of(batch):
        x = columns_of(batch.column("vector"), parts * width, scale)
        found = [nearest(x[p * width : (p + 1) * width], books[p]) for p in range(parts)]
        text = np.stack([c for c, _ in found]).T.astype(np.uint8).tobytes().hex()
        return {
            "id": batch.column("id"),
            "label": batch.column("label"),
            "code": [text[k : k + 2 * parts] for k in range(0, len(text), 2 * parts)],
            "error": sum(e for _, e in found),
        }

    return over_batches(rows, rows_of, f"id {kinds[id]}, label {kinds[label]}, code string, error bigint")


def vector_codes(df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """vec_id, code, error, label_error (errors of equal labels added up, nulls together) and codebooks_sha256.

    Rows whose vector is null or holds a null or non-finite component are dropped, all others stay: repeated rows and
    null ids too.  Vectors shorter than the longest, or than the next multiple of ``parts``, have zeros in the missing
    places; components beyond ``largest`` (32,768 for 64 dimensions at this scale) count as that.  Equal
    distances go to the lower entry.  Of a repeated id the smallest vector starts an entry.  A label_error beyond 63 bits
    is null.  No rows in, no rows out; other columns are not read.
    """
    books = codebooks(df, id, vector, parts, entries, rounds, scale)
    coded = settle(encode(df, books, id, vector, label, scale))
    totals = coded.groupBy(F.col("label").alias("__label")).agg(F.try_sum("error").alias("label_error"))
    out = coded.join(small(settle(totals)), F.col("label").eqNullSafe(F.col("__label")))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
