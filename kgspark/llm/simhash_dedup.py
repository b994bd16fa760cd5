"""Near-duplicates by SimHash fingerprints, found by covering locality-sensitive hashing.

Each bit place of a fingerprint has a mark, a vector other than zero of radius + 1 bits; the mask of table v holds the
places whose mark has an odd product with v.  The marks of ``radius`` places span too little to leave no v that has an
even product with all of them, so two fingerprints that differ in at most ``radius`` places agree under that mask: each
pair within the radius meets in some table, for certain.

A bucket with many fingerprints is covered again in the places that its mask leaves free.  What then still shares a
bucket differs in so few places (12 of 64 at radius 2) that 2**12 fingerprints at most can be there, so what a task
holds is bounded by the method and nothing is cut off.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, over_batches, roots, settle, small, text_bytes
from .near_dedup import components

BITS = 64
#: Buckets with more fingerprints are covered again.
LARGE = 512
#: Shingles whose bits are counted at once.
CHUNK = 1 << 14


def masks(radius: int, places: list[int]) -> list[int]:
    """The mask of each table: any two fingerprints that differ in at most ``radius`` of ``places`` agree under one."""
    n = 2 ** (radius + 1)
    marks = [(p, k % (n - 1) + 1) for k, p in enumerate(places)]
    return [sum(1 << p for p, mark in marks if (mark & v).bit_count() % 2) for v in range(1, n)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def shingle_hashes(data: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``words`` words, A-Z lower-cased and joined by spaces; of the whole if it is shorter."""
    from xxhash import xxh64_intdigest

    parts = data.translate(LOWER_BYTES).split()
    if not parts:
        return np.empty(0, np.uint64)
    text = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    n = min(words, len(parts))
    starts = np.concatenate(([0], ends[: len(parts) - n])).tolist()
    return np.array([xxh64_intdigest(text[a:b], 42) for a, b in zip(starts, (ends[n - 1 :] - 1).tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have; 0 without hashes."""
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), CHUNK):
        counts += np.unpackbits(hashes[k : k + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp (64 bits as bigint) of every document; null and wordless texts have 0."""

    def rows_of(batch):
        fps = [_signed(fingerprint(shingle_hashes(x, words))) for x in batch.column("__bytes").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "fp": fps}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return over_batches(docs.select("doc_id", text_bytes().alias("__bytes")), rows_of, f"doc_id {kind}, fp bigint")


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """a, b: links that join the distinct fingerprints of ``fps`` just as all pairs within the radius do.

    Each bucket gives a link from every member to the first of those it is joined with there.
    """
    every = list(range(BITS))
    first = masks(radius, every)
    again = [[m | s for s in masks(radius, [p for p in every if not m >> p & 1])] for m in first]
    key = lambda m: F.col("fp").bitwiseAND(F.lit(_signed(m)))
    keyed = fps.select("fp", F.posexplode(F.array(*map(key, first))).alias("table", "key"))
    shared = settle(keyed.groupBy("table", "key").agg(F.count("*").alias("n")).filter("n > 1"))
    members = keyed.join(small(shared), ["table", "key"])
    finer = F.element_at(F.array(*(F.array(*map(key, ms)) for ms in again)), F.col("table") + 1)
    met = members.select("fp", "table", F.posexplode(F.when(F.col("n") > LARGE, finer).otherwise(F.array("key"))).alias("finer", "key"))
    # at most LARGE members, or as many as there are fingerprints that differ in the places still free
    buckets = met.groupBy("table", "finer", "key").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("fps")

    def rows_of(batch):
        a, b = [], []
        for x in batch.column("fps"):
            x = np.sort(np.asarray(x.values)).view(np.uint64)
            near = [np.nonzero(np.triu(np.bitwise_count(x[k : k + 256, None] ^ x[None, :]) <= radius, k + 1)) for k in range(0, len(x), 256)]
            root = roots(len(x), np.concatenate([i + 256 * k for k, (i, _) in enumerate(near)]), np.concatenate([j for _, j in near]))
            linked = np.flatnonzero(root != np.arange(len(x)))
            a.append(x[linked].view(np.int64))
            b.append(x[root[linked]].view(np.int64))
        return {"a": np.concatenate(a), "b": np.concatenate(b)} if a else {"a": [], "b": []}

    return over_batches(buckets, rows_of, "a bigint, b bigint").distinct()


def simhash_groups(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable by links, its own included).

    docs: doc_id, text; other columns are not read.  Fingerprints link at ``radius`` or fewer differing bits; equal ones
    are one class, so copies cost nothing beyond their own row.  Texts that are null, empty or without words have the
    fingerprint 0 and are linked by it like any other.  Fewer words than ``words`` are one shingle.  A null doc_id joins
    its group but names it only if no other does.  Repeated rows are alike.  No rows in, no rows out.
    """
    if not 0 <= radius <= 4:
        raise ValueError("radius from 0 to 4: the tables grow as 2**(radius + 1)")
    prints = settle(fingerprints(docs, words))
    classes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    joined = settle(components(settle(links(classes.select("fp"), radius)))).withColumnRenamed("node", "fp")
    labelled = classes.join(joined, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = settle(labelled.join(named, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
