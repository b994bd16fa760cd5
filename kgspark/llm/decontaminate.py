"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams, scanned over every text.

The benchmark is held in parts of a bounded number of bytes, long items cut into pieces that share their windows' words;
each part is broadcast and scanned in its own narrow pass, so a benchmark of any size works and only one bounded part is
ever broadcast at a time.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORD, ascii_lower, lower_alnum_words, mix64, over_batches, settle, text_bytes

#: Words of a window.
WINDOW = 10
#: Most bytes of benchmark text that one broadcast holds.
PART_BYTES = 16 << 20


@dataclass
class NGrams:
    """The windows of some benchmark items, by length: sorted hashes, the words of each and its items."""

    vocabulary: dict[bytes, int]
    by_length: dict[int, tuple[np.ndarray, np.ndarray, list[tuple[int, ...]]]]
    item_ids: list[str | None]


def _hash(ids: np.ndarray) -> np.ndarray:
    out = np.zeros(len(ids), np.uint64)
    for column in ids.T:
        out = mix64(out + column.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return out


def build(items: list[tuple[str | None, bytes]], window: int = WINDOW) -> NGrams:
    """Windows of each item; an item of fewer words, but not none, is one window."""
    vocabulary: dict[bytes, int] = {}
    found: dict[int, dict[tuple[int, ...], set[int]]] = {}
    for i, (_, text) in enumerate(items):
        ids = tuple(vocabulary.setdefault(w, len(vocabulary) + 1) for w in lower_alnum_words(text))
        n = min(window, len(ids))
        for k in range(len(ids) - n + 1 if n else 0):
            found.setdefault(n, {}).setdefault(ids[k : k + n], set()).add(i)
    by_length = {}
    for n, windows in found.items():
        words = np.array(list(windows), np.int32).reshape(-1, n)
        hashes = _hash(words)
        order = np.argsort(hashes, kind="stable")
        owners = list(windows.values())
        by_length[n] = (hashes[order], words[order], [tuple(sorted(owners[k])) for k in order])
    return NGrams(vocabulary, by_length, [x for x, _ in items])


def hits(words: list[bytes], grams: NGrams) -> tuple[np.ndarray | None, set[int]]:
    """Which words lie in an occurrence of a window (None: none does), and the items of those windows."""
    get = grams.vocabulary.get
    ids = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
    known = np.concatenate(([0], np.cumsum(ids > 0)))
    mask, items = None, set()
    for n, (hashes, stored, owners) in grams.by_length.items():
        if len(ids) < n:
            continue
        at = np.flatnonzero(known[n:] - known[:-n] == n)
        if not len(at):
            continue
        here = ids[at[:, None] + np.arange(n)]
        h = _hash(here)
        low, high = np.searchsorted(hashes, h), np.searchsorted(hashes, h, "right")
        for k in np.flatnonzero(high > low):
            for j in range(low[k], high[k]):
                if (stored[j] == here[k]).all():
                    mask = np.zeros(len(ids), bool) if mask is None else mask
                    mask[at[k] : at[k] + n] = True
                    items.update(owners[j])
    return mask, items


def pieces(text: bytes, most: int, window: int) -> list[bytes]:
    """A text in pieces of about ``most`` bytes that together hold each of its windows: each begins window - 1 words before
    the last one's end."""
    words = lower_alnum_words(text)
    out, first, size = [], 0, 0
    for k, w in enumerate(words):
        size += len(w) + 1
        if size > most and k - first + 1 >= window:
            out.append(b" ".join(words[first : k + 1]))
            first = k + 2 - window
            size = sum(len(x) + 1 for x in words[first : k + 1])
    if not out or len(words) - first >= window:
        out.append(b" ".join(words[first:]))
    return out


def _parts(benchmark: DataFrame, window: int) -> list[DataFrame]:
    """The items in tables of at most PART_BYTES, one if all fit; long items are cut, repeated rows are taken once."""
    texts = benchmark.select(F.col("item_id").cast("string").alias("item_id"), text_bytes().alias("text")).distinct()
    size = F.length("text") + 64
    if (texts.agg(F.sum(size)).first()[0] or 0) <= PART_BYTES:
        return [texts]

    def rows_of(batch):
        cut = [pieces(t, PART_BYTES // 16, window) for t in batch.column("text").to_pylist()]
        return {"item_id": [i for i, ps in zip(batch.column("item_id").to_pylist(), cut, strict=True) for _ in ps], "text": [p for ps in cut for p in ps]}

    held = settle(over_batches(texts, rows_of, "item_id string, text binary").withColumn("__h", F.xxhash64("item_id", "text")))
    total = held.agg(F.sum(size)).first()[0]
    buckets = 8 * -(-total // PART_BYTES)
    while True:
        sizes = held.groupBy(F.pmod("__h", F.lit(buckets)).alias("b")).agg(F.sum(size).alias("bytes"), F.count("*").alias("n")).orderBy("b").collect()
        if all(r.n == 1 or r.bytes <= PART_BYTES for r in sizes):
            break
        buckets *= 2
    # buckets are put together while they fit
    parts: list[list[int]] = []
    room = 0
    for r in sizes:
        if not parts or r.bytes > room:
            parts.append([])
            room = PART_BYTES
        parts[-1].append(r.b)
        room -= r.bytes
    return [held.filter(F.pmod("__h", F.lit(buckets)).isin(p)).drop("__h") for p in parts]


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds __n_words, __hit_starts, __hit_ends (word spans, end exclusive) and __hit_items (ids as sorted strings).

    docs: text and any other columns, which are kept, but for those named like an added one.
    benchmark: item_id, text.  Null or empty texts have no words and no windows; items of equal text each count,
    rows of one item_id count once, and a null item_id marks words but is in no list.  Empty inputs give no hits or
    no rows.
    """
    spark = docs.sparkSession
    added = {"__n_words": "bigint", "__hit_starts": "array<int>", "__hit_ends": "array<int>", "__hit_items": "array<string>"}
    kept = [c for c in docs.columns if c not in added]
    docs = docs.select(*kept)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"{c} {t}" for c, t in added.items()])
    parts = _parts(benchmark, window)
    out = None
    for part in parts:
        grams = spark.sparkContext.broadcast(build([(r["item_id"], bytes(r["text"])) for r in part.collect()], window))
        out = _scan_part(docs if out is None else settle(out), grams, kept, schema, first=out is None)
    return out


def _scan_part(docs: DataFrame, grams, kept: list[str], schema: str, first: bool) -> DataFrame:
    def rows_of(batch):
        model, n_words, starts, ends, found = grams.value, [], [], [], []
        earlier = None if first else [batch.column(c).to_pylist() for c in ("__hit_starts", "__hit_ends", "__hit_items")]
        for i, text in enumerate(batch.column("text").to_pylist()):
            words = lower_alnum_words((text or "").encode())
            mask, items = hits(words, model)
            names = {x for k in items if (x := model.item_ids[k]) is not None}
            if earlier and earlier[0][i]:
                mask = np.zeros(len(words), bool) if mask is None else mask
                for a, b in zip(earlier[0][i], earlier[1][i], strict=True):
                    mask[a:b] = True
                names.update(earlier[2][i])
            edges = np.empty(0, np.int64) if mask is None else np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
            n_words.append(len(words))
            starts.append(edges[::2].tolist())
            ends.append(edges[1::2].tolist())
            found.append(sorted(names))
        return {c: batch.column(c) for c in kept} | {"__n_words": n_words, "__hit_starts": starts, "__hit_ends": ends, "__hit_items": found}

    return over_batches(docs, rows_of, schema)


def _n_hit():
    return F.aggregate(F.zip_with("__hit_starts", "__hit_ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    scanned = scan(docs.select("doc_id", "text"), benchmark, window)
    digest = F.sha2(F.array_join("__hit_items", ","), 256)
    return scanned.select("doc_id", F.col("__n_words").alias("n_words"), _n_hit().alias("n_hit"), F.size("__hit_items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.size("__hit_starts") > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, remove: str = "documents") -> DataFrame:
    """docs without contaminated documents, or (remove="spans") with their hit words taken out of the text.

    Columns are those of ``docs``.  Cutting a span takes the bytes from its first word's start to its last word's
    end; what stands around it stays.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is documents or spans")
    columns = docs.columns
    scanned = scan(docs, benchmark, window)
    if remove == "documents":
        return scanned.filter(F.size("__hit_starts") == 0).select(*columns)

    def cut(batch):
        spans = zip(*(batch.column(c).to_pylist() for c in ("text", "__hit_starts", "__hit_ends")), strict=True)
        return {c: batch.column(c) for c in columns} | {"text": [without_words(t, a, b) if a else t for t, a, b in spans]}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return over_batches(scanned, cut, schema)


def without_words(text: str, starts: list[int], ends: list[int]) -> str:
    """The text without the words from each start to each end (exclusive)."""
    places = [m.span() for m in re.finditer(ALNUM_WORD, ascii_lower(text))]
    pieces, at = [], 0
    for a, b in zip(starts, ends, strict=True):
        pieces.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*pieces, text[at:]])
