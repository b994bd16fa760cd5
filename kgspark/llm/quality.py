"""Quality rules: base counts, then divergence of character-class and common-word histograms from the language's.

Language references are means over all documents of a language that pass the base rules, one vote a document; a
document is held against its own language with the Jensen-Shannon distance, if it is long enough to tell.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, over_batches, settle, small, spaced_word_hashes, text_bytes, window_hashes

# Common words by language (fixed values).
COMMON_WORDS = {
    "en": "the of and to in a is that for it was on are as with be by at this from or an have not but they his which you one we all were there".split(),
    "de": "der die das und in zu den ein eine von mit ist im des auf für nicht dem sich als auch es an er hat aus bei sie nach wird einer um".split(),
    "fr": "le la les de des et à un une du en que qui dans est pour pas sur au par ce il plus se avec sont son ne ou cette elle nous".split(),
    "es": "el la los las de del que y a en un una es se no por con su para al lo como más o este ha sus si sobre entre esta".split(),
}

# Character classes (fixed values); a byte from 0xC0 starts a character outside ASCII.
CLASSES = ("lower", "upper", "digit", "space", "sentence", "symbol", "other", "latin", "wide")
_SYMBOLS = b"#*$%&|<>"
_CLASS = np.full(256, 9, np.uint8)  # 9: a byte inside a character
for _b in range(128):
    _c = bytes([_b])
    _CLASS[_b] = 0 if _c.islower() else 1 if _c.isupper() else 2 if _c.isdigit() else 3 if _c.isspace() else 4 if _c in b".,;:!?'\"-()" else 5 if _c in _SYMBOLS else 6
_CLASS[0xC2:0xCA] = 7
_CLASS[0xCA:0xF8] = 8


@dataclass(frozen=True)
class Limits:
    """base: fewest words and most repeated words in 100; then the words from which divergence tells, and its limits."""

    min_words: int = 50
    max_repeat_percent: int = 50
    guard_words: int = 80
    max_class_distance: float = 0.30
    max_word_distance: float = 0.36


def base_counts(data: bytes) -> tuple[int, int, int, int, int, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the character classes of a text's bytes."""
    classes = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=10)[:9]
    words = spaced_word_hashes(data)
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeated = 0
    if len(words) >= 3:
        windows = window_hashes(words, 3)
        order = np.argsort(windows, kind="stable")
        same = windows[order][1:] == windows[order][:-1]
        twice = np.zeros(len(windows), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(len(words), bool)
        for k in range(3):
            covered[k : k + len(twice)] |= twice
        repeated = int(covered.sum())
    return len(words), int(classes.sum() - classes[3]), int(classes[5]), len(lines) - len(set(lines)), repeated, classes


def measure(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns of docs with __n_words and the other counts, __classes (by CLASSES) and __common (by language)."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema])
    schema += ", __n_words bigint, __word_chars bigint, __n_symbols bigint, __n_dup_lines bigint, __n_repeat_words bigint, __classes array<int>, __common array<int>"
    places = {lang: {w.encode(): i for i, w in enumerate(words)} for lang, words in COMMON_WORDS.items()}
    strip = b".,;:!?'\"-()"

    def rows_of(batch):
        out = [[] for _ in range(7)]
        for data, lang in zip(batch.column("__bytes").to_pylist(), batch.column("__lang").to_pylist(), strict=True):
            *counts, classes = base_counts(data)
            at = places.get(lang)
            common: list[int] = []
            if at is not None:
                common = [0] * (len(at) + 1)
                for w in data.translate(LOWER_BYTES).split():
                    i = at.get(w)
                    if i is None:
                        i = at.get(w.strip(strip), -1)
                    common[i] += 1
            for column, x in zip(out, [*counts, classes.tolist(), common], strict=True):
                column.append(x)
        names = ("__n_words", "__word_chars", "__n_symbols", "__n_dup_lines", "__n_repeat_words", "__classes", "__common")
        return {c: batch.column(c) for c in columns} | dict(zip(names, out, strict=True))

    return over_batches(docs.withColumns({"__bytes": text_bytes(), "__lang": F.col("lang")}).select(*columns, "__bytes", "__lang"), rows_of, schema)


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(total > 0, F.transform(counts, lambda x: x / total))


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (root of the divergence in bits, 0 to 1) of two arrays of shares; null if either is."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(a * 2 / (a + b))).otherwise(F.lit(0.0))

    both = F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a))
    return F.sqrt(F.greatest(F.aggregate(both, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def _base_failed(limits: Limits) -> Column:
    return (F.col("__n_words") < limits.min_words) | (F.col("__n_repeat_words") * 100 > F.col("__n_words") * limits.max_repeat_percent)


def references(measured: DataFrame, limits: Limits) -> DataFrame:
    """One row a language: mean shares of character classes and of common words over its documents.

    Languages without a word list have no word shares.  A null language is a language of its own.
    """
    good = measured.filter(~_base_failed(limits) & (F.col("__n_words") >= limits.guard_words))
    shares = good.select(F.col("lang").alias("__l"), _shares(F.col("__classes")).alias("c"), _shares(F.col("__common")).alias("w"))
    widest = max(map(len, COMMON_WORDS.values())) + 1
    sums = [F.avg(F.get("c", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))] + [F.avg(F.get("w", F.lit(i))).alias(f"w{i}") for i in range(widest)]
    means = shares.groupBy("__l").agg(*sums)
    words = F.filter(F.array(*[f"w{i}" for i in range(widest)]), lambda x: x.isNotNull())
    return means.select("__l", F.array(*[f"c{i}" for i in range(len(CLASSES))]).alias("__ref_classes"), words.alias("__ref_words"))


def judge(docs: DataFrame, columns: list[str], limits: Limits = Limits()) -> DataFrame:
    """The named columns of docs with the base counts, base_failed, both distances and kept, named with ``__``.

    docs: text, lang and the named columns.  Null or empty texts have no words and fail.  Documents shorter than the
    guard, or whose language has no reference, are kept if the base rules pass.  Repeated rows are judged alike and
    each counts in the references.
    """
    needed = list(dict.fromkeys([*columns, "lang"]))
    measured = settle(measure(docs, needed))
    reference = small(settle(references(measured, limits)))
    joined = measured.join(reference, F.col("lang").eqNullSafe(F.col("__l")), "left")
    known = F.when(F.size("__common") == F.size("__ref_words"), _shares(F.col("__common")))
    joined = joined.withColumns({"__base_failed": _base_failed(limits), "__class_distance": _distance(_shares(F.col("__classes")), F.col("__ref_classes")), "__word_distance": _distance(known, F.col("__ref_words"))})
    near = (F.coalesce("__class_distance", F.lit(0.0)) <= limits.max_class_distance) & (F.coalesce("__word_distance", F.lit(0.0)) <= limits.max_word_distance)
    return joined.withColumn("__kept", ~F.col("__base_failed") & ((F.col("__n_words") < limits.guard_words) | near)).drop("__l", "__ref_classes", "__ref_words", "__classes", "__common")


def quality(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, n_words, the base counts, base_failed, kept and both distances (to six places) of every document."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    rounded = [F.round(f"__{c}", 6).alias(c) for c in ("class_distance", "word_distance")]
    return judge(docs, ["doc_id"], limits).select("doc_id", *[F.col(f"__{c}").alias(c) for c in names], *rounded)


def kept_documents(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The documents that pass, with the columns of docs."""
    return judge(docs, docs.columns, limits).filter("__kept").select(*docs.columns)
