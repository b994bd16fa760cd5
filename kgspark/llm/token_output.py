"""Token ids in a binary format: a stream of range-coded blocks in ascending doc_id order.

A data set is a folder with two tables.  ``segments`` has a row for each run of whole documents of one part: their
doc_ids and numbers of ids, and the coded blocks (see ``range_coder``), which start anew with each segment.
``parts`` has where each part's ids begin.  Concatenated in (part, segment) order the blocks are the ids of all
documents, each ended by the end id.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import range_coder
from .common import _IS_SPACE, mix64, over_batches, shared_dir, small, text_bytes

#: A segment is closed when it has so many ids; a longer document is a segment of its own.
SEGMENT_IDS = 1 << 20
#: Places of the table in which a Python worker remembers the ids of short pieces, and longer pieces it remembers.
PLACES, LONG_PIECES = 1 << 20, 20_000
#: Bytes of text that are cut at once, and pieces that are encoded as one text.
CHUNK_BYTES, JOINED = 1 << 19, 100
#: Most bytes and ids of a piece in the table, and most bytes of a longer one that is remembered.
SHORT_BYTES, SHORT_IDS, LONG_BYTES = 16, 8, 64

# White space outside ASCII (fixed values), and such beside white space of ASCII.
_WIDE_SPACE = "\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WIDE_MARKS = tuple(x.encode() for x in "\u0085\u00a0\u1680\u205f\u3000") + ("\u2000".encode()[:2],)
_WIDE_LEADS = sorted({x[:1] for x in _WIDE_MARKS})
_MIXED_SPACE = re.compile(f"[\t-\r ][{_WIDE_SPACE}]|[{_WIDE_SPACE}][\t-\r ]").search
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)

# Kinds of bytes: others, letters, digits, marks, the apostrophe; and pairs of kinds that are never in one pre-token.
_KIND = np.array([1 if chr(k).isalpha() else 2 if chr(k).isdigit() else 4 if k == 39 else 3 for k in range(128)] + [0] * 128, np.uint8)
_KIND[_IS_SPACE.nonzero()[0]] = 0
_PARTED = np.zeros((5, 5), bool)
_PARTED[[1, 1, 1, 2, 2, 2, 3, 3], [2, 3, 4, 1, 3, 4, 1, 2]] = True
# The same as tables of bytes; a pair is five times the first kind and the second.
_SPACE_BYTES, _KIND_BYTES, _PARTED_BYTES = _IS_SPACE.tobytes(), _KIND.tobytes(), _PARTED.tobytes() + bytes(256 - 25)


def _looked_up(data: bytes, table: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(data.translate(table), kind)


def _piece_starts(data: bytes, starts: np.ndarray) -> np.ndarray:
    """Where pieces begin in the bytes of texts that begin at ``starts``.

    The byte-level pre-tokenizer takes a run of white space before a word apart from its last character, and that on its
    own unless it is a space, which goes with the word; a run at the end of a text stays whole.  It also parts ASCII
    letters, digits and marks, if no apostrophe stands before them.
    """
    b, space = np.frombuffer(data, np.uint8), _looked_up(data, _SPACE_BYTES, bool)
    first = np.zeros(len(b) + 1, bool)
    first[starts] = True
    before = np.concatenate(([True], space[:-1]))
    after = np.concatenate((space[1:], [True]))
    cut = space & (~before | (~after & ~first[1:]))
    cut |= ~space & before & (np.concatenate(([0], b[:-1])) != 32)
    kind = _looked_up(data, _KIND_BYTES, np.uint8)
    cut[1:] |= _looked_up((kind[:-1] * np.uint8(5) + kind[1:]).tobytes(), _PARTED_BYTES, bool)
    return np.flatnonzero(cut | first[:-1])


class TextEncoder:
    """Ids of whole texts by the tokenizers library, remembering those of pieces that it never joins.

    Pieces of up to SHORT_BYTES bytes have two places by hash in a table of fixed size that holds their bytes, so a hit is
    exact; a piece that was found of late is not pushed out by one that is new.  All other ids come from the library, each distinct piece of a chunk once.
    Texts with a special token, or with white space outside ASCII beside such of ASCII, go to the library whole.

    ordinary_specials: whether a special token that stands in a text is encoded as ordinary text; if not, it gets its
    own id, as the library does by default.
    """

    def __init__(self, path: str, ordinary_specials: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary_specials
        self.specials = [] if ordinary_specials else [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        (self.line_break,) = self._ids(["\n"])
        if len(self.line_break) != 2:
            raise ValueError("the tokenizer has no id for a line break")
        self.head, self.tail = np.zeros(PLACES, np.uint64), np.zeros(PLACES, np.uint64)
        self.size, self.n_ids, self.used = np.zeros(PLACES, np.uint8), np.zeros(PLACES, np.uint8), np.zeros(PLACES, bool)
        self.ids = np.zeros(PLACES * SHORT_IDS, np.uint16)
        self.long: dict[bytes, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("H", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _library(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece; those without white space at an end, but for a space before them, are encoded many as one text."""
        texts = [p.decode(errors="replace") for p in pieces]
        apart = [not t[-1].isspace() and "\n" not in t and (t[0] == " " or not t[0].isspace()) for t in texts]
        plain = [t for t, x in zip(texts, apart, strict=True) if x]
        cut = np.frombuffer(self.line_break, np.uint16)[0]
        parts: list[bytes] = []
        for x in self.tokenizer.encode_batch_fast(["\n".join(plain[k : k + JOINED]) for k in range(0, len(plain), JOINED)], add_special_tokens=False):
            ids = np.array(x.ids, np.uint16)
            data, at = ids.tobytes(), 0
            for end in [*np.flatnonzero(ids == cut).tolist(), len(ids)]:
                parts.append(data[2 * at : 2 * end])
                at = end + 1
        joined, single = iter(parts), iter(self._ids([t for t, x in zip(texts, apart, strict=True) if not x]))
        return [next(joined) if x else next(single) for x in apart]

    def _known(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of the distinct pieces among these that are not in the table."""
        got = dict.fromkeys(pieces)
        got.update((p, self.long[p]) for p in self.long.keys() & got.keys())
        asked = [p for p, ids in got.items() if ids is None]
        got.update(zip(asked, self._library(asked), strict=True))
        if len(self.long) > LONG_PIECES:
            self.long.clear()
        self.long.update((p, got[p]) for p in asked if SHORT_BYTES < len(p) <= LONG_BYTES)
        return got

    def _chunk(self, data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts that begin at ``starts`` in data, none empty, and how many each has."""
        at = _piece_starts(data, starts)
        sizes = np.diff(at, append=len(data))
        padded = np.frombuffer(data + b"\0" * SHORT_BYTES, np.uint8)
        eight = np.ndarray(len(data) + 9, "<u8", padded, strides=(1,))
        head = eight[at] & _MASKS[np.minimum(sizes, 8)]
        tail = eight[np.minimum(at + 8, len(data))] & _MASKS[np.clip(sizes - 8, 0, 8)]
        drawn = mix64(head + tail * _ODD + sizes.astype(np.uint64))
        place = (drawn & np.uint64(PLACES - 1)).astype(np.int64)
        hit = (self.size[place] == sizes) & (self.head[place] == head) & (self.tail[place] == tail)
        rest = np.flatnonzero(~hit)
        other = ((drawn[rest] >> np.uint64(32)) & np.uint64(PLACES - 1)).astype(np.int64)
        again = (self.size[other] == sizes[rest]) & (self.head[other] == head[rest]) & (self.tail[other] == tail[rest])
        hit[rest[again]] = True
        place[rest[again]] = other[again]
        self.used[place[hit]] = True
        missing, other = rest[~again], other[~again]
        n_ids = self.n_ids[place].astype(np.int64)
        counts, first = n_ids[hit], place[hit] * SHORT_IDS
        ready = self.ids.take(np.repeat(first + counts - np.cumsum(counts), counts) + np.arange(counts.sum()), mode="clip")
        pieces = [data[a : a + n] for a, n in zip(at[missing].tolist(), sizes[missing].tolist(), strict=True)]
        known = self._known(pieces)
        found = [known[p] for p in pieces]
        n_ids[missing] = [len(x) // 2 for x in found]
        from_hit = np.repeat(hit, n_ids)
        out = np.empty(len(from_hit), np.uint16)
        out[from_hit], out[~from_hit] = ready, np.frombuffer(b"".join(found), np.uint16)
        # a piece takes the first of its places that was not used of late; if both were, they may be taken next time
        one = place[missing]
        where = np.where(self.used[one], other, one)
        busy = self.used[where]
        self.used[one[busy]] = self.used[other[busy]] = False
        short = (sizes[missing] <= SHORT_BYTES) & (n_ids[missing] <= SHORT_IDS) & ~busy
        # a place gets all its columns from one piece, the last one
        last = dict(zip(where[short].tolist(), np.flatnonzero(short).tolist(), strict=True))
        which = np.fromiter(last.values(), np.int64, len(last))
        learn = missing[which]
        where, counts = where[which], n_ids[learn]
        rows = np.zeros((len(learn), SHORT_IDS), np.uint16)
        rows[np.arange(SHORT_IDS) < counts[:, None]] = np.frombuffer(b"".join(found[k] for k in which.tolist()), np.uint16)
        self.head[where], self.tail[where] = head[learn], tail[learn]
        self.size[where], self.n_ids[where] = sizes[learn], counts
        self.ids.reshape(PLACES, SHORT_IDS)[where] = rows
        return out, np.add.reduceat(n_ids, np.searchsorted(at, starts))

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all UTF-8 texts one after another, and how many each has."""
        lengths = np.zeros(len(texts), np.int64)
        out: list[tuple[int, np.ndarray]] = []
        run: list[int] = []
        size = 0

        def close() -> None:
            nonlocal size
            if run:
                ends = np.cumsum([len(texts[k]) for k in run])
                ids, lengths[run] = self._chunk(b"".join(texts[k] for k in run), np.concatenate(([0], ends[:-1])))
                out.extend(zip(run, np.split(ids, np.cumsum(lengths[run])[:-1]), strict=True))
                run.clear()
                size = 0

        # most batches hold no special token and little wide space, so it is looked for in all texts at once
        whole = b"".join(texts)
        specials = [x for x in self.specials if x in whole]
        wide = [x for x in _WIDE_MARKS if x in whole] if any(x in whole for x in _WIDE_LEADS) else []
        del whole
        for k, t in enumerate(texts):
            if not t:
                continue
            if any(x in t for x in specials) or (any(x in t for x in wide) and _MIXED_SPACE(t.decode(errors="replace"))):
                (ids,) = self._ids([t.decode(errors="replace")])
                lengths[k] = len(ids) // 2
                out.append((k, np.frombuffer(ids, np.uint16)))
                continue
            if run and size + len(t) > CHUNK_BYTES:
                close()
            run.append(k)
            size += len(t)
        close()
        out.sort(key=lambda x: x[0])
        return np.concatenate([x for _, x in out]) if out else np.empty(0, np.uint16), lengths


_encoders: dict[tuple[str, bool], TextEncoder] = {}


def _encoder(path: str, ordinary_specials: bool) -> TextEncoder:
    """One a worker, about 36 MB: what it remembers serves all its tasks."""
    key = (path, ordinary_specials)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = TextEncoder(path, ordinary_specials)
    return _encoders[key]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _segments(lengths: np.ndarray) -> list[tuple[int, int]]:
    """Runs of documents (first, last + 1) of about SEGMENT_IDS ids."""
    out, first, total = [], 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > SEGMENT_IDS:
            out.append((first, i))
            first, total = i, 0
        total += int(n)
    if len(lengths):
        out.append((first, len(lengths)))
    return out


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, ordinary_specials: bool = False) -> None:
    """Encode every text of docs (doc_id, text) and write the data set to ``path``.

    Null texts are empty.  Documents with the same doc_id follow each other by the crc32 of the text, then by text, and
    may be dealt to several tasks; null doc_ids come first.  Nothing is cut: a document has all its ids, whatever its
    length.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows_of(batch):
        encode = _encoder(tokenizer, ordinary_specials)
        ids, lengths = encode(batch.column("text").to_pylist())
        ids, lengths = np.insert(ids, np.cumsum(lengths), end_id), lengths + 1
        ends = np.cumsum(lengths)
        spans = _segments(lengths)
        streams = [ids[ends[a] - lengths[a] : ends[b - 1]] for a, b in spans]
        blocks = [s[k : k + range_coder.BLOCK_IDS] for s in streams for k in range(0, len(s), range_coder.BLOCK_IDS)]
        coded = iter(range_coder.encode_blocks(blocks))
        data = [b"".join(next(coded) for _ in range(0, len(s), range_coder.BLOCK_IDS)) for s in streams]
        doc_ids = batch.column("doc_id").to_pylist()
        return {"doc_ids": [doc_ids[a:b] for a, b in spans], "n_tokens": [lengths[a:b] for a, b in spans], "n_ids": [len(s) for s in streams], "blocks": data}

    order = [F.col("doc_id").asc_nulls_first(), F.col("__crc")]
    rows = docs.select("doc_id", text_bytes().alias("text")).withColumn("__crc", F.crc32("text"))
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    segments = over_batches(ordered, rows_of, f"doc_ids array<{kind}>, n_tokens array<bigint>, n_ids bigint, blocks binary")
    placed = segments.withColumns({"part": F.spark_partition_id(), "segment": F.monotonically_increasing_id()})
    placed.write.parquet(f"{path}/segments")
    spark = docs.sparkSession
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = spark.read.parquet(f"{path}/segments").groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    parts.withColumn("start", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0))).write.parquet(f"{path}/parts")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary, little-endian 16-bit) of every document, from the files.

    A damaged block raises.  start counts the ids of all documents before it.
    """
    return _decoded(spark, path, "ids binary", lambda ids: ids.astype("<u2").tobytes())


def _decoded(spark: SparkSession, path: str, column: str, of_ids) -> DataFrame:
    segments = spark.read.parquet(f"{path}/segments")
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()
    name = column.split()[0]
    before = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = segments.select("part", "segment", "n_ids").withColumn("inside", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    parts = spark.read.parquet(f"{path}/parts").select("part", "start")
    starts = starts.join(small(parts), "part").select("segment", (F.col("inside") + F.col("start")).alias("first"))

    def rows_of(batch):
        _encoders.clear()  # a worker that decodes needs no tokenizer beside it
        found = [range_coder.split_blocks(x) for x in batch.column("blocks").to_pylist()]
        ids = iter(range_coder.decode_blocks([b for blocks in found for b in blocks]))
        out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], name: []}
        for blocks, doc_ids, lengths, first in zip(found, *(batch.column(c).to_pylist() for c in ("doc_ids", "n_tokens", "first")), strict=True):
            stream = np.concatenate([next(ids) for _ in blocks])
            ends = np.cumsum(lengths)
            for doc_id, n, end in zip(doc_ids, lengths, ends, strict=True):
                out["doc_id"].append(doc_id)
                out["start"].append(first + int(end) - n)
                out["n_tokens"].append(n)
                out[name].append(of_ids(stream[end - n : end]))
        return out

    located = segments.select("segment", "doc_ids", "n_tokens", "blocks").join(small(starts), "segment")
    return over_batches(located, rows_of, f"doc_id {kind}, start bigint, n_tokens bigint, {column}")


def tokenized(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, path: str | None = None, ordinary_specials: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, written to ``path`` and read back from there.

    Without a path the data set goes to the shared folder.  ids_crc32 is over the ids, with the end id, as
    little-endian unsigned 32-bit integers.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(docs, path, tokenizer or tokenizer_path(), end_id, ordinary_specials)
    return _decoded(spark, path, "ids_crc32 bigint", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))
