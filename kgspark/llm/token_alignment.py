"""Alignment of the tokens of two tokenizers over the same bytes, and corpus-wide counts of linked ids.

Tokens are nodes of a bipartite graph; a token of A and one of B are linked where their byte ranges overlap.  Both
tokenizers tile the same bytes, so the connected components, found by union-find, are exactly the smallest groups that
both cut at both ends.  The members of a component expand into links, whose (A id, B id) pairs are counted once a document.

The counts come back to the documents without their pairs being shuffled where these are frequent: the most frequent
pairs, at most FREQUENT of them, are broadcast; pairs beyond them are rare, so a join by the pair has no hot key.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_batches, ready, roots, settle, small, text_bytes
from .token_output import _encoder, tokenizer_path

#: Bytes of text that are aligned at once; a longer text comes alone.
CHUNK_BYTES = 1 << 20
#: Pairs of a group beyond which ids are counted first, so that a repeated id does not multiply rows.
WIDE = 1 << 12
#: Pairs whose counts are broadcast (13 bytes each).
FREQUENT = 1 << 20


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PairOfTokenizers:
    """The two tokenizers, the bytes of each of their ids, and the digits from which groups are written."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor

        self.a = _encoder(path_a, True)
        self.b = SentencePieceProcessor(model_file=path_b)
        of = byte_of_character()
        vocabulary = self.a.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for piece, k in vocabulary.items():
            self.bytes_a[k] = bytes(of[c] for c in piece) if all(c in of for c in piece) else piece.encode()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in ((k, self.b.id_to_piece(k)) for k in range(self.b.get_piece_size()))]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        # digits of id k with what follows: at 2 k a comma, at 2 k + 1 the end of the group's side
        self.digits = [b"%d%s" % (k, end) for n, ends in ((len(self.bytes_a), (b",", b"|")), (len(self.bytes_b), (b",", b";"))) for k in range(n) for end in ends]

    def tokens(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and numbers of them by text, ids of B and theirs; none for texts that a tokenizer does not give back."""
        wanted = [b" " + x if x else b"" for x in texts]
        ids_a, n_a = self.a(wanted)
        ids_a = ids_a.astype(np.int64)
        listed = self.b.encode([x.decode(errors="replace") for x in texts], num_threads=1)
        n_b = np.array([len(x) for x in listed], np.int64)
        ids_b = np.fromiter((k for x in listed for k in x), np.int64, int(n_b.sum()))
        whole = np.ones(len(texts), bool)
        for ids, n, table in ((ids_a, n_a, self.bytes_a), (ids_b, n_b, self.bytes_b)):
            pieces = list(map(table.__getitem__, ids.tolist()))
            ends = np.cumsum(n).tolist()
            whole &= [b"".join(pieces[e - k : e]) == x for e, k, x in zip(ends, n.tolist(), wanted, strict=True)]
        ids_a, ids_b = ids_a[np.repeat(whole, n_a)], ids_b[np.repeat(whole, n_b)]
        return ids_a, np.where(whole, n_a, 0), ids_b, np.where(whole, n_b, 0)


def pair_kind(size_a: int, size_b: int) -> str:
    """The integers that hold A id * size_b + B id."""
    return "<u4" if size_a * size_b <= 1 << 32 else "<i8"


_pairs: dict[tuple[str, str], PairOfTokenizers] = {}


def _pair(path_a: str, path_b: str) -> PairOfTokenizers:
    """One a worker, which serves all its tasks."""
    key = (path_a, path_b)
    if key not in _pairs:
        _pairs.clear()
        _pairs[key] = PairOfTokenizers(*key)
    return _pairs[key]


def groups(sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of its group, from 0 in order, for each token of A and of B, given their sizes in bytes."""
    ends_a, ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    n, m = len(ends_a), len(ends_b)
    # the other side's token that holds a token's last byte; each overlap ends at the end of one of its two tokens
    left = np.concatenate((np.arange(n), np.searchsorted(ends_a, ends_b)))
    right = n + np.concatenate((np.searchsorted(ends_b, ends_a), np.arange(m)))
    root = roots(n + m, left, right)
    number = np.cumsum(root[:n] == np.arange(n)) - 1
    return number[root[:n]], number[root[n:]]


def _expanded(ids_a, ids_b, in_a, in_b, first_b, base):
    """For each group's links: the group, the pair of ids as one number, and how often it occurs there."""
    count_a, count_b = np.bincount(in_a), np.bincount(in_b)
    wide = count_a * count_b > WIDE
    narrow = ~wide[in_a]
    times = np.where(narrow, count_b[in_a], 0)
    offset = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    group = np.repeat(in_a, times)
    pair = np.repeat(ids_a, times) * base + ids_b[first_b[group] + offset]
    out = [(group, pair, np.ones(len(pair), np.int64))]
    first_a = np.cumsum(count_a) - count_a
    for g in np.flatnonzero(wide).tolist():
        a, of_a = np.unique(ids_a[first_a[g] : first_a[g] + count_a[g]], return_counts=True)
        b, of_b = np.unique(ids_b[first_b[g] : first_b[g] + count_b[g]], return_counts=True)
        pair = (a[:, None] * base + b[None, :]).ravel()
        out.append((np.full(len(pair), g), pair, (of_a[:, None] * of_b[None, :]).ravel()))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def align(texts: list[bytes], pair: PairOfTokenizers) -> dict[str, list]:
    """n_a, n_b, n_groups, n_links, the written groups, and the distinct linked pairs with how often each occurs, by text."""
    ids_a, n_a, ids_b, n_b = pair.tokens(texts)
    none = {"n_a": n_a, "n_b": n_b, "n_groups": 0 * n_a, "n_links": 0 * n_a, "groups": [b""] * len(texts), "pairs": [b""] * len(texts), "times": [b""] * len(texts)}
    if not len(ids_a):
        return none
    in_a, in_b = groups(pair.sizes_a[ids_a], pair.sizes_b[ids_b])
    count_a, count_b = np.bincount(in_a), np.bincount(in_b)
    end_a, end_b = np.cumsum(count_a), np.cumsum(count_b)
    doc_of_a = np.repeat(np.arange(len(texts)), n_a)
    doc_of = doc_of_a[end_a - 1]
    n_groups = np.bincount(doc_of, minlength=len(texts))
    n_links = np.zeros(len(texts), np.int64)
    np.add.at(n_links, doc_of, count_a * count_b)

    written = np.empty(len(ids_a) + len(ids_b), np.int64)
    at_a, at_b = np.arange(len(ids_a)), np.arange(len(ids_b))
    written[at_a + (end_b - count_b)[in_a]] = 2 * ids_a + (at_a + 1 == end_a[in_a])
    written[at_b + end_a[in_b]] = 2 * (len(pair.bytes_a) + ids_b) + (at_b + 1 == end_b[in_b])
    digits = list(map(pair.digits.__getitem__, written.tolist()))
    ends = np.cumsum(n_a + n_b).tolist()

    base = len(pair.bytes_b)
    group, linked, times = _expanded(ids_a, ids_b, in_a, in_b, end_b - count_b, base)
    held = len(pair.bytes_a) * base
    key = doc_of[group] * held + linked
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    times = np.add.reduceat(times, first)
    doc, linked = np.divmod(key[first], held)
    cuts = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
    linked, times = linked.astype(pair_kind(len(pair.bytes_a), base)), times.astype("<i8")
    return none | {
        "n_groups": n_groups,
        "n_links": n_links,
        "groups": [b"".join(digits[e - k : e])[:-1] for e, k in zip(ends, (n_a + n_b).tolist(), strict=True)],
        "pairs": [linked[i:j].tobytes() for i, j in zip(cuts, cuts[1:])],
        "times": [times[i:j].tobytes() for i, j in zip(cuts, cuts[1:])],
    }


def _chunks(texts: list[bytes]):
    run, size = [], 0
    for x in texts:
        if run and size + len(x) > CHUNK_BYTES:
            yield run
            run, size = [], 0
        run.append(x)
        size += len(x)
    if run:
        yield run


def alignments(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, keep_groups: bool = False) -> DataFrame:
    """Of every row of docs (doc_id, text): n_a, n_b, n_groups, n_links, groups_sha256, pairs and times; groups on request.

    pairs has the distinct linked (A id * B's vocabulary + B id) in ascending order as integers of ``pair_kind``, times
    how often each is linked in the row as integers of 8 bytes.
    """
    path_a, path_b = path_a or tokenizer_path(), path_b or tokenizer_path("piece_bpe_32k.model")
    kept = "groups string, " if keep_groups else ""

    def rows_of(batch):
        pair = _pair(path_a, path_b)
        out: dict[str, list] = {}
        for texts in _chunks(batch.column("text").to_pylist()):
            got = align(texts, pair)
            got["groups_sha256"] = [hashlib.sha256(x).hexdigest() if x else "" for x in got["groups"]]
            got["groups"] = [x.decode() for x in got["groups"]] if keep_groups else []
            for name, values in got.items():
                out.setdefault(name, []).extend(values)
        return out | {"doc_id": batch.column("doc_id")}

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, {kept}pairs binary, times binary"
    return over_batches(docs.select("doc_id", text_bytes().alias("text")), rows_of, schema)


def _all_numbers(column, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.int64)


def pair_counts(aligned: DataFrame, size_a: int, size_b: int) -> DataFrame:
    """pair, n (rows of ``alignments`` that hold it linked) and best (whether no pair of its A id has a higher n).

    Batches are counted where they are read; their counts are then added up.
    """
    kind = pair_kind(size_a, size_b)

    def rows_of(batch):
        pair, n = np.unique(_all_numbers(batch.column("pairs"), kind), return_counts=True)
        return {"pair": pair, "n": n}

    summed = over_batches(aligned.select("pairs"), rows_of, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = settle(summed.withColumn("a", F.expr(f"pair div {size_b}")))
    most = counted.groupBy("a").agg(F.max("n").alias("most"))
    return counted.join(small(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _frequency(counts: DataFrame, most: int) -> int:
    """The least power of 2 such that at most ``most`` pairs have that count or a higher one."""
    found = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).count().collect()
    above, k = 0, 64
    held = {r.k: r["count"] for r in found}
    while k and above + held.get(k - 1, 0) <= most:
        k -= 1
        above += held.get(k, 0)
    return 1 << k


def token_alignment(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of docs (doc_id, text).

    A encodes a space and the text, B the text; special tokens in texts are ordinary text.  Texts that are null, empty or
    not given back byte for byte by both tokenizers have no tokens: zeros, and an empty groups_sha256.  Every row counts
    as a document, repeated ones and those of null doc_id too.  No rows in, no rows out; other columns are not read.
    A task holds the tokens of about CHUNK_BYTES of text, or of one longer text.
    """
    spark = docs.sparkSession
    path_a, path_b = path_a or tokenizer_path(), path_b or tokenizer_path("piece_bpe_32k.model")
    size_a, size_b = (len(x) for x in (_pair(path_a, path_b).bytes_a, _pair(path_a, path_b).bytes_b))
    kind = pair_kind(size_a, size_b)
    rows = settle(alignments(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()))
    counts = settle(pair_counts(rows, size_a, size_b))
    least = _frequency(counts, frequent)
    known = counts.filter(F.col("n") >= least).orderBy("pair").toArrow()
    table = spark.sparkContext.broadcast((np.asarray(known["pair"]).astype(kind), np.asarray(known["n"]), np.asarray(known["best"])))

    def rows_of(batch):
        pairs, n, best = table.value
        row, linked = batch.column("row").to_numpy(), _all_numbers(batch.column("pairs"), kind)
        times = _all_numbers(batch.column("times"), "<i8")
        sizes = np.array([len(x) // 8 for x in batch.column("times").to_pylist()])
        of = np.repeat(np.arange(len(row)), sizes)
        at = np.minimum(np.searchsorted(pairs, linked.astype(kind)), max(len(pairs) - 1, 0))
        found = pairs[at] == linked if len(pairs) else np.zeros(len(linked), bool)
        total, of_best = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        np.add.at(total, of[found], times[found] * n[at[found]])
        np.add.at(of_best, of[found], times[found] * best[at[found]])
        ends = np.cumsum(np.bincount(of[~found], minlength=len(row))).tolist()
        rest = [x[~found].tolist() for x in (linked, times)]
        rest = [[x[i:j] for i, j in zip([0, *ends], ends)] for x in rest]
        return {"row": row, "n_best": of_best, "count_sum": total, "rare": rest[0], "rare_times": rest[1]}

    ready(spark)
    summed = settle(over_batches(rows.select("row", "pairs", "times"), rows_of, "row bigint, n_best bigint, count_sum bigint, rare array<bigint>, rare_times array<bigint>"))
    sums = summed.select("row", "n_best", "count_sum")
    if least > 1:  # the pairs left are rare: none stands in as many as ``least`` rows
        rare = summed.select("row", F.explode(F.arrays_zip("rare", "rare_times")).alias("x")).select("row", F.col("x.rare").alias("pair"), F.col("x.rare_times").alias("times"))
        held = rare.join(counts.filter(F.col("n") < least), "pair")
        more = held.select("row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
        sums = sums.unionByName(more).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.drop("pairs", "times").join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
