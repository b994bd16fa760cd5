"""Brown class n-grams: exchange clustering of words, class transitions and word emissions.

Words are counted over the whole training corpus in a distributed table.  Every word with MIN_COUNT occurrences is a
symbol of its own; shapes stand for the rarer ones.  Bigram counts of all symbols stay a distributed table, each symbol
with its neighbours.  The exchange algorithm clusters the most frequent words and the shapes to begin with; then each
round reads the table against the classes of the round before and moves words to their best class.  A text's
probability is the product of class transitions and of emissions of its words from their classes.

The driver and the workers hold a hash and a class of every symbol word (10 bytes each) and class-by-class sums; counts
of words beyond the most frequent are joined to the texts by a shuffle.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _IS_SPACE, LOWER_BYTES, _array, give_back, lower_spaced_words, mix64, over_batches, settle, spaced_word_hashes, text_bytes

#: Words that the clustering begins with, classes, and words whose counts are broadcast.
SYMBOL_WORDS, CLASSES, HEAD_WORDS = 512, 48, 200_000
#: Least count of words that are symbols of their own.
MIN_COUNT = 5
#: Shapes of all other words: by length and by their last two bytes.
SHAPES = 64
#: Passes of the exchange algorithm at most, and the rise of the log-likelihood, as a share, with which a sweep is the last.
PASSES, LEAST_RISE = 12, 1e-3
#: Bytes of text whose words are looked up at once; a longer text is looked up alone.
CHUNK_BYTES = 1 << 18
#: Pairs of symbols that a task counts at once, about.
GROUP_PAIRS = 1 << 20


def shape(word: bytes) -> int:
    return (min(len(word), 15) >> 2 << 4) | ((word[-1] * 31 + (word[-2] if len(word) > 1 else 0)) & 15)


def held_out(doc_id: Column, modulus: int = 7, remainder: int = 2) -> Column:
    """Whether crc32 of the id as text leaves this remainder; null is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def exchange(bigrams: np.ndarray, classes: int, passes: int = PASSES) -> np.ndarray:
    """The class of each symbol, 0 to classes - 1; the last symbol (text end) keeps class 0 to itself.

    Each symbol in turn, the most frequent first, moves to the class that raises the likelihood of the bigrams most,
    until a pass moves none.
    """
    n = len(bigrams)
    counts = bigrams.astype(float)
    frequency = counts.sum(axis=0) + counts.sum(axis=1)
    order = sorted(range(n - 1), key=lambda k: (-frequency[k], k))
    of = np.zeros(n, int)
    for place, k in enumerate(order):
        of[k] = 1 + (place if place < classes - 1 else place % (classes - 1))
    table = np.zeros((classes, classes))
    np.add.at(table, (of[:, None].repeat(n, 1), of[None, :].repeat(n, 0)), counts)

    def f(x):
        return x * np.log(np.maximum(x, 1e-300))

    for _ in range(passes):
        moved = 0
        for k in order:
            if not frequency[k]:
                continue
            own, itself = of[k], counts[k, k]
            to, frm = np.bincount(of, counts[k], classes), np.bincount(of, counts[:, k], classes)
            to[own] -= itself
            frm[own] -= itself
            table[own] -= to
            table[:, own] -= frm
            table[own, own] -= itself
            # what other classes exchange with the symbol stands in their sums wherever it goes
            left, right = table.sum(axis=1) + frm, table.sum(axis=0) + to
            diagonal = table.diagonal()
            rows = f(table + to[None, :]) - f(table)
            columns = f(table + frm[:, None]) - f(table)
            gain = rows.sum(axis=1) - rows.diagonal() + columns.sum(axis=0) - columns.diagonal()
            gain += f(diagonal + to + frm + itself) - f(diagonal)
            gain -= f(left + to.sum() + itself) - f(left) + f(right + frm.sum() + itself) - f(right)
            gain[0] = -np.inf
            best = int(np.argmax(gain))
            if gain[best] <= gain[own] + 1e-9:
                best = own
            moved += best != own
            of[k] = best
            table[best] += to
            table[:, best] += frm
            table[best, best] += itself
        if not moved:
            break
    return of


@dataclass
class Model:
    """What scoring needs: counts of the head words, hashes of the symbol words, the classes, and their log10 probabilities."""

    head: dict[bytes, int]
    head_counts: np.ndarray
    hashes: Vocabulary
    class_of: np.ndarray
    transitions: np.ndarray  # log10 P(class | class before)
    mass: np.ndarray  # log10 of what emissions of a class are divided by
    train_tokens: int
    vocabulary: int
    end_count: int


class Vocabulary:
    """Hashes of the symbol words in ascending order; where those of each leading bits begin."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.append(hashes.astype(np.uint64), np.uint64(0xFFFF_FFFF_FFFF_FFFF))
        bits = max(8, len(hashes).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.hashes[:-1], np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def __len__(self) -> int:
        return len(self.hashes) - 1

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 if it is none of a symbol word."""
        at = self.first[wanted >> self.shift].astype(np.int64)
        here = self.hashes[at]
        below = np.flatnonzero(here < wanted)
        while len(below):
            at[below] += 1
            here[below] = self.hashes[at[below]]
            below = below[here[below] < wanted[below]]
        return np.where((here == wanted) & (at < len(self)), at, -1)


def _symbols(texts: list[bytes], hashes: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the words of all texts: the place of a word's hash, or its shape's; and where each text's words end."""
    data = b" ".join(texts).translate(LOWER_BYTES)
    if not data:
        return np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    b = np.frombuffer(data, np.uint8)
    word = np.concatenate(([False], ~_IS_SPACE[b], [False]))
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    length, codes = ends - starts, b.astype(np.int64)
    last = codes[ends - 1] * 31 + np.where(length > 1, codes[ends - 2], 0)
    symbols = len(hashes) + ((np.minimum(length, 15) >> 2 << 4) | (last & 15))
    if len(hashes):
        at = hashes.find(spaced_word_hashes(data))
        symbols = np.where(at >= 0, at, symbols)
    return symbols, np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))


def _chunks(texts: list[bytes]):
    """The texts in runs of about CHUNK_BYTES."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > CHUNK_BYTES:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def neighbours(train: DataFrame, hashes: Vocabulary, tokens: int | None = None) -> DataFrame:
    """A row for each symbol: the symbols after it and those before it, and how often they stand there.

    Texts begin and end with the end symbol.  A pair of a symbol with itself is not given twice.

    Pairs are counted in groups, then dealt by symbol to as many groups again.  ``tokens`` (if not given, the bytes of the
    texts) bounds the pairs, so a group has about GROUP_PAIRS of them however many there are; a frequent pair comes once
    from each batch, and a frequent symbol has each of its neighbours once.
    """
    end = len(hashes) + SHAPES
    size = end + 1
    if tokens is None:
        tokens = train.agg(F.sum(F.length("__bytes").cast("long"))).first()[0] or 0
    groups = 1 + tokens // GROUP_PAIRS
    shared = train.sparkSession.sparkContext.broadcast(hashes)

    def dealt(to: np.ndarray, codes: np.ndarray, n: np.ndarray) -> dict[str, list]:
        """A row for each group: its codes and their counts, as bytes."""
        order = np.argsort(to, kind="stable")
        to, codes, n = to[order], codes[order], n[order]
        cuts = np.flatnonzero(np.diff(to, prepend=-1))
        parts = [[x.astype("<i8").tobytes() for x in np.split(v, cuts[1:])] if len(to) else [] for v in (codes, n)]
        return {"to": to[cuts], "codes": parts[0], "n": parts[1]}

    def group_of(x: np.ndarray) -> np.ndarray:
        to = mix64(x.astype(np.uint64)) % np.uint64(groups)
        return to.astype(np.int16 if groups < 1 << 15 else np.int64)  # short numbers are sorted by their digits

    def summed(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The distinct codes of a group in ascending order, and the sums of their counts."""
        codes, n = (np.frombuffer(b"".join(table.column(c).to_pylist()), "<i8") for c in ("codes", "n"))
        order = np.argsort(codes)
        codes, n = codes[order], n[order]
        cuts = np.flatnonzero(np.diff(codes, prepend=-1))
        return codes[cuts], np.add.reduceat(n, cuts)

    def pairs_of(batch):
        codes = [np.empty(0, np.int64)]
        for texts in _chunks(batch.column("__bytes").to_pylist()):
            symbols, ends = _symbols(texts, shared.value)
            path = np.insert(symbols, np.concatenate(([0], ends)), end)
            codes.append(path[:-1] * size + path[1:])
        pairs, n = np.unique(np.concatenate(codes), return_counts=True)
        return dealt(group_of(pairs), pairs, n)

    def by_symbol(table):
        pairs, n = summed(table)
        first, second = pairs // size, pairs % size
        # a pair stands with each of its symbols: symbol, whether the other is before it, other
        two = first != second
        places = np.concatenate(((first << 33) + second, (second[two] << 33) + (1 << 32) + first[two]))
        rows = dealt(group_of(places >> 33), places, np.concatenate((n, n[two])))
        out = pa.table([_array(rows["to"], pa.int64()), pa.array(rows["codes"], pa.binary()), pa.array(rows["n"], pa.binary())], ["to", "codes", "n"])
        give_back()
        return out

    def row_each(table):
        places, n = summed(table)
        symbols, row = np.unique(places >> 33, return_inverse=True)
        before, other = (places >> 32 & 1).astype(bool), (places & 0xFFFF_FFFF).astype(np.int32)
        columns = [pa.array(symbols, pa.int32())]
        for side in (~before, before):
            offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row[side], minlength=len(symbols))))), pa.int32())
            columns += [pa.ListArray.from_arrays(offsets, pa.array(x[side], kind)) for x, kind in ((other, pa.int32()), (n, pa.int64()))]
        give_back()
        return pa.table(columns, ["symbol", "after", "n_after", "before", "n_before"])

    kind = "to bigint, codes binary, n binary"
    pairs = over_batches(train.select("__bytes"), pairs_of, kind).groupBy("to").applyInArrow(by_symbol, kind)
    return settle(pairs.groupBy("to").applyInArrow(row_each, "symbol int, after array<int>, n_after array<bigint>, before array<int>, n_before array<bigint>"))


def _flat(batch: pa.RecordBatch, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, other symbol and count of all neighbours on one side, in a batch of rows."""
    others, n = batch.column(side), batch.column(f"n_{side}")
    row = np.repeat(np.arange(len(others)), others.value_lengths().to_numpy(zero_copy_only=False))
    return row, others.flatten().to_numpy(), n.flatten().to_numpy()


def class_table(table: DataFrame, of: np.ndarray, classes: int) -> np.ndarray:
    """Bigrams by class and class, over the whole table of neighbours."""
    shared = table.sparkSession.sparkContext.broadcast(of)

    def rows_of(batch):
        row, other, n = _flat(batch, "after")
        a = shared.value[batch.column("symbol").to_numpy()].astype(np.int64)[row]
        codes = np.bincount(a * classes + shared.value[other], n, classes * classes)
        kinds = np.flatnonzero(codes)
        return {"pair": kinds, "n": codes[kinds].astype(np.int64)}

    got = over_batches(table.select("symbol", "after", "n_after"), rows_of, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(classes * classes)
    out[np.asarray(got["pair"])] = np.asarray(got["n"])
    shared.destroy()
    return out.reshape(classes, classes)


def likelihood(table: np.ndarray) -> float:
    def f(x):
        return float((x * np.log(np.maximum(x, 1e-300))).sum())

    return f(table) - f(table.sum(axis=0)) - f(table.sum(axis=1))


def best_classes(contexts: np.ndarray, own: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The likeliest class of each symbol under these class sums; its own where no other is better.

    contexts: counts of the classes after it, of those before it, and of itself after itself.
    """
    classes = len(sums)
    logs = np.log(np.maximum(sums, 0.5))
    after, before, twice = contexts[:, :classes], contexts[:, classes:-1], contexts[:, -1:]
    gain = after @ logs.T + before @ logs + twice * logs.diagonal()
    for counts, axis in ((after, 1), (before, 0)):
        gain -= (counts.sum(axis=1, keepdims=True) + twice) * np.log(np.maximum(sums.sum(axis=axis), 0.5))
    gain[:, 0] = -np.inf
    best, row = gain.argmax(axis=1), np.arange(len(own))
    return np.where(gain[row, best] > gain[row, own] + 1e-9, best, own)


def moves(table: DataFrame, of: np.ndarray, sums: np.ndarray, part: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of one of ``parts`` parts that have a better class, and that class."""
    classes, end = len(sums), len(of) - 1
    width = 2 * classes + 1
    shared = table.sparkSession.sparkContext.broadcast(of)

    def rows_of(batch):
        of, symbol = shared.value, batch.column("symbol").to_numpy()
        contexts = np.zeros(len(symbol) * width)
        for side, shift in (("after", 0), ("before", classes)):
            row, other, n = _flat(batch, side)
            code = row * width + of[other] + shift
            itself = symbol[row] == other
            code[itself] = row[itself] * width + 2 * classes
            contexts += np.bincount(code, n, len(contexts))
        contexts = contexts.reshape(-1, width)
        own = of[symbol].astype(np.int64)
        best = best_classes(contexts, own, sums)
        moved = best != own
        return {"symbol": symbol[moved], "class": best[moved]}

    chosen = table.filter((F.col("symbol") < end) & (F.pmod(F.xxhash64("symbol"), F.lit(parts)) == part))
    got = over_batches(chosen, rows_of, "symbol int, class int").toArrow()
    shared.destroy()
    return np.asarray(got["symbol"]), np.asarray(got["class"])


def exchange_rounds(table: DataFrame, of: np.ndarray, classes: int, rounds: int = 2 * PASSES) -> tuple[np.ndarray, np.ndarray]:
    """Classes after the exchange over the whole table of neighbours, and the bigrams by class.

    The words of a round move at once, each to its best class under the sums of the round before, and neighbours that
    move together can undo each other's gain.  So a round takes one part of the words; one that lowers the likelihood
    is undone and the parts are made smaller.  It ends when no part has a word that moves, when a sweep over all parts
    raises the likelihood by less than LEAST_RISE of it, or after ``rounds``.
    """
    sums = class_table(table, of, classes)
    parts, part, still = 2, 0, 0
    sweep = likelihood(sums)
    for _ in range(rounds):
        symbols, to = moves(table, of, sums, part, parts)
        still = 0 if len(symbols) else still + 1
        if still == parts:
            break
        if len(symbols):
            moved = of.copy()
            moved[symbols] = to
            after = class_table(table, moved, classes)
            if likelihood(after) > likelihood(sums):
                of, sums = moved, after
            else:
                parts, still = 2 * parts, 0
        part = (part + 1) % parts
        if part == 0:
            if likelihood(sums) - sweep < LEAST_RISE * abs(sweep):
                break
            sweep = likelihood(sums)
    return of, sums


def word_counts(train: DataFrame) -> DataFrame:
    """word, n and shape of every distinct word."""

    def rows_of(batch):
        counts: Counter[bytes] = Counter()
        for data in batch.column("__bytes").to_pylist():
            counts.update(lower_spaced_words(data))
        return {"word": list(counts), "n": list(counts.values()), "shape": [shape(w) for w in counts]}

    parts = over_batches(train.select("__bytes"), rows_of, "word binary, n bigint, shape int")
    return parts.groupBy("word").agg(F.sum("n").alias("n"), F.max("shape").alias("shape"))


def _head(counts: DataFrame, size: int) -> tuple[list[tuple[bytes, int, int]], int]:
    """The most frequent words, at most ``size``: all those with at least the count that is returned."""
    spread = sorted(((r["n"], r["count"]) for r in counts.groupBy("n").count().filter("n > 1").collect()), reverse=True)
    least, total = 0, 0
    for n, words in spread:
        if total + words > size:
            break
        least, total = n, total + words
    if not least:
        return [], 1 << 62
    got = counts.filter(F.col("n") >= least).select("word", "n", "shape").toArrow().to_pydict()
    return sorted(zip(got["word"], got["n"], got["shape"], strict=True), key=lambda r: (-r[1], r[0])), least


def fit(train: DataFrame, counts: DataFrame, classes: int = CLASSES) -> tuple[Model, int]:
    """train: __bytes; counts: settled ``word_counts``.  The model, and the least count of the broadcast words."""
    totals = counts.agg(F.sum("n"), F.count("*")).first()
    n_docs = train.count()
    rows, least = _head(counts, HEAD_WORDS)
    head = {w: i for i, (w, _, _) in enumerate(rows)}
    head_counts = np.array([n for _, n, _ in rows] + [0], np.int64)

    def hashed(batch):
        return {"hash": spaced_word_hashes(b" ".join(batch.column("word").to_pylist())).view(np.int64), "n": batch.column("n"), "shape": batch.column("shape")}

    got = over_batches(counts.filter(F.col("n") >= MIN_COUNT), hashed, "hash bigint, n bigint, shape int").toArrow()
    hashes, first, at = np.unique(np.asarray(got["hash"]).view(np.uint64), return_index=True, return_inverse=True)
    n_of, shape_of = np.bincount(at, np.asarray(got["n"]), len(hashes)), np.asarray(got["shape"])[first]
    words_of = Vocabulary(hashes)
    table = neighbours(train, words_of, int(totals[0] or 0) + n_docs)
    # to begin with the most frequent words and the shapes are clustered; any other word has its shape's class
    seeds = np.lexsort((hashes, -n_of))[:SYMBOL_WORDS]
    coarse = np.concatenate((SYMBOL_WORDS + shape_of, SYMBOL_WORDS + np.arange(SHAPES + 1))).astype(np.int32)
    coarse[seeds] = np.arange(len(seeds))
    of = exchange(class_table(table, coarse, SYMBOL_WORDS + SHAPES + 1), classes)[coarse].astype(np.int16)
    of, sums = exchange_rounds(table, of, classes)
    unigram = (sums.sum(axis=0) + 0.5) / (sums.sum() + 0.5 * classes)
    transitions = np.log10((sums + 2 * unigram[None, :]) / (sums.sum(axis=1, keepdims=True) + 2))
    own = of[: len(hashes)]
    words, tokens = np.bincount(own, minlength=classes).astype(float), np.bincount(own, n_of, classes)
    for r in counts.filter(F.col("n") < MIN_COUNT).groupBy("shape").agg(F.count("*").alias("v"), F.sum("n").alias("n")).collect():
        c = of[len(hashes) + r["shape"]]
        words[c], tokens[c] = words[c] + r["v"], tokens[c] + r["n"]
    words[0], tokens[0] = 1, n_docs
    model = Model(head, head_counts, words_of, of, transitions, np.log10(tokens + words + 1), int(totals[0] or 0) + n_docs, int(totals[1]) + (n_docs > 0), n_docs)
    return model, least


def score(docs: DataFrame, classes: int = CLASSES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every document.

    docs: doc_id, text.  Null or empty texts are the end token alone.  Repeated rows are scored alike and each counts
    in training.  Without training documents all words are unknown and probabilities are those of smoothing alone.
    """
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), text_bytes().alias("__bytes"))
    train = rows.filter("NOT held_out")
    counts = settle(word_counts(train))
    model, least = fit(train, counts, classes)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows_of(batch):
        m = shared.value
        logs = np.log10(m.head_counts + 1.0)
        end_class, end_log = m.class_of[-1], float(np.log10(m.end_count + 1.0))
        out: dict[str, list] = {c: [] for c in ("n_tokens", "head_known", "head_logs", "paths")}
        words_left: list[bytes] = []
        n_left: list[int] = []
        left = [np.zeros(1, np.int64)]
        for texts in _chunks(batch.column("__bytes").to_pylist()):
            symbols, ends = _symbols(texts, m.hashes)
            words = lower_spaced_words(b" ".join(texts))
            sizes = np.diff(ends, prepend=0)
            text = np.repeat(np.arange(len(texts)), sizes)
            at = np.fromiter(map(m.head.get, words, repeat(-1)), np.int32, len(words))
            found = at >= 0
            # texts stand between end classes, which they share: from each to the next is one text's path
            path = np.insert(m.class_of[symbols], np.concatenate(([0], ends)), end_class)
            steps = m.transitions[path[:-1], path[1:]] - m.mass[path[1:]]
            out["n_tokens"] += (sizes + 1).tolist()
            out["head_known"] += (np.bincount(text, found, len(texts)).astype(np.int64) + (m.end_count > 0)).tolist()
            out["head_logs"] += (np.bincount(text, np.where(found, logs[at], 0.0), len(texts)) + end_log).tolist()
            out["paths"] += np.add.reduceat(steps, ends - sizes + np.arange(len(texts))).tolist()
            k = np.flatnonzero(~found)
            counted = Counter(zip(text[k].tolist(), map(words.__getitem__, k.tolist())))
            words_left += [w for _, w in counted]
            n_left += counted.values()
            left.append(np.bincount(np.fromiter((t for t, _ in counted), np.int64, len(counted)), minlength=len(texts)))
        rest = pa.StructArray.from_arrays([pa.array(words_left, pa.binary()), pa.array(n_left, pa.int32())], ["word", "tf"])
        offsets = pa.array(np.cumsum(np.concatenate(left)), pa.int32())
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "rest": pa.ListArray.from_arrays(offsets, rest)} | out

    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, head_known bigint, head_logs double, paths double, rest array<struct<word: binary, tf: int>>"
    scanned = settle(over_batches(rows, rows_of, schema).withColumn("row", F.monotonically_increasing_id()))
    rest = scanned.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.tf")
    known = rest.join(counts.filter(F.col("n") < least).select("word", "n"), "word")
    known = known.groupBy("row").agg(F.sum("tf").alias("rest_known"), F.sum(F.col("tf") * F.log10(F.col("n") + 1)).alias("rest_logs"))
    joined = scanned.drop("rest").join(known, "row", "left")
    logs = F.col("head_logs") + F.coalesce("rest_logs", F.lit(0.0))
    n_known = F.col("head_known") + F.coalesce("rest_known", F.lit(0))
    base = logs - F.col("n_tokens") * F.log10(F.lit(float(model.train_tokens + model.vocabulary + 1)))
    full = logs + F.col("paths")
    return joined.select(
        "doc_id", "held_out", "n_tokens", n_known.cast("long").alias("n_known"), F.lit(model.train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), full.alias("score"),
        F.pow(F.lit(10.0), -full / F.col("n_tokens")).alias("perplexity"),
    )
