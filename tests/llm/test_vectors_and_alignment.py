"""op11 to op13 against plain versions, with the odd rows that each has a defined result for."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kgspark.llm import simhash_dedup, token_alignment, vector_codes
from kgspark.llm.common import roots
from kgspark.llm.registry import op12_simhash_dedup, op13_token_alignment


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts))
    cut = [[[math.floor(scale * x) for x in (*v, *[0.0] * (width * parts - len(v)))][p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    start: dict = {}
    for (i, v, _), c in sorted(zip(kept, cut, strict=True), key=lambda x: (x[0][0] is None, x[0][0] or 0, x[0][1])):
        start.setdefault(i, c)
    books = [[c[p] for c in list(start.values())[:entries]] for p in range(parts)]

    def best(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for c in cut:
                members[best(c[p], books[p])[1]].append(c[p])
            books[p] = [[sum(x) // len(members[k]) for x in zip(*members[k], strict=True)] if k in members else e for k, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[best(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for (_, _, lab), e in zip(kept, errors, strict=True):
        by_label[lab] += e
    return [(i, "".join(f"{k:02x}" for _, k in f), e, by_label[lab], sha) for (i, _, lab), f, e in zip(kept, found, errors, strict=True)]


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_codes_are_those_of_plain_rounds(spark):
    draw = random.Random(4)
    centres = [[draw.uniform(-1, 1) for _ in range(16)] for _ in range(5)]
    rows = []
    for k in range(180):
        v = [float(np.float32(x + draw.gauss(0, 0.2))) for x in centres[k % 5]]
        rows.append((k if k % 9 else None, v, k % 4 or None))
    rows += [rows[7], rows[7], (3, rows[40][1], 2)]  # repeated rows, and an id with two vectors
    rows += [(500, None, 1), (501, [None, *rows[1][1][1:]], 1), (502, [math.nan, *rows[1][1][1:]], 1), (503, [-math.inf, *rows[1][1][1:]], 1)]
    rows += [(504, rows[1][1][:5], 1), (505, [], None), (-1, [0.0] * 16, 1)]
    got = vector_codes.vector_codes(vectors_of(spark, rows).withColumns({"id": F.lit(1), "error": F.lit("x"), "block": F.lit(0)}))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert as_rows(got) == sorted(plain_codes(rows), key=repr)


@pytest.mark.parametrize("dims", [1, 8, 10])
def test_codes_of_few_vectors_and_uneven_parts(spark, dims):
    rows = [(k, [float(np.float32((k * 7 + d) % 5 - 2.3)) for d in range(dims)], 0) for k in range(5)]
    assert as_rows(vector_codes.vector_codes(vectors_of(spark, rows))) == sorted(plain_codes(rows), key=repr)


def test_codes_of_nothing_and_of_null_ids(spark):
    assert vector_codes.vector_codes(vectors_of(spark, [])).collect() == []
    assert vector_codes.vector_codes(vectors_of(spark, [(1, None, 1)])).collect() == []
    rows = [(None, [0.5] * 8, 1), (None, [0.25] * 8, 1)]
    assert as_rows(vector_codes.vector_codes(vectors_of(spark, rows))) == sorted(plain_codes(rows), key=repr)


def test_components_out_of_range_are_the_largest(spark):
    most = vector_codes.largest(8)
    got = vector_codes.vector_codes(vectors_of(spark, [(1, [3e38] + [0.0] * 7, 1), (2, [-3e38] + [0.0] * 7, 1)]), entries=1, rounds=0).collect()
    assert {r.vec_id: r.error for r in got} == {1: 0, 2: (2 * most) ** 2}


def plain_fingerprint(text, words=3):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", w) if x]
    shingles = [" ".join(w[k : k + words]) for k in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(fps, radius):
    """The smallest id reachable for each (id, fingerprint), by trying all pairs."""
    n = len(fps)
    ids = np.array([f for _, f in fps], np.uint64)
    root = list(range(n))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(n):
        for j in np.flatnonzero(np.bitwise_count(ids[i] ^ ids[i + 1 :]) <= radius) + i + 1:
            root[find(int(j))] = find(i)
    least: dict = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [least.get(find(k)) for k in range(n)]


def test_fingerprints_and_groups(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fps = [(r.doc_id, plain_fingerprint(r.text)) for r in docs]
    want = sorted((i, f"{f:016x}", c) for (i, f), c in zip(fps, plain_groups(fps, 2), strict=True))
    assert sorted(tuple(r) for r in op12_simhash_dedup(spark, sf).collect()) == want


def test_xxhash_is_that_of_spark(spark):
    texts = ["a", "Straße über dem Fluß", "x" * 40, "one two three" * 9, "日本 語 の"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t")).collect()
    assert [r[0] % (1 << 64) for r in got] == [xxhash.xxh64_intdigest(t.encode(), 42) for t in texts]


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_masks_cover_all_pairs_of_places(radius):
    places = list(range(64))
    tables = simhash_dedup.masks(radius, places)
    assert len(tables) == 2 ** (radius + 1) - 1
    some = itertools.combinations(places, radius) if radius < 3 else (random.Random(1).sample(places, 3) for _ in range(3000))
    for differ in some:
        gap = sum(1 << p for p in differ)
        assert any(gap & m == 0 for m in tables)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_links_join_what_all_pairs_join(spark, radius, monkeypatch):
    """Chains and crowds around a few fingerprints, with buckets that are covered again."""
    monkeypatch.setattr(simhash_dedup, "LARGE", 20)
    draw = random.Random(radius)
    found = {0, (1 << 64) - 1}
    for _ in range(6):
        x = draw.getrandbits(64)
        for _ in range(150):
            found.add(x)
            found.add(x ^ sum(1 << p for p in draw.sample(range(64), draw.randint(1, 4))))
            if draw.random() < 0.2:
                x ^= 1 << draw.randrange(64)
    fps = sorted(found)
    df = spark.createDataFrame([(simhash_dedup._signed(x),) for x in fps], "fp bigint")
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash_dedup.links(df, radius).collect()]
    place = {x: k for k, x in enumerate(fps)}
    mine = roots(len(fps), np.array([place[a] for a, _ in links], int), np.array([place[b] for _, b in links], int))
    assert mine.tolist() == plain_groups(list(enumerate(fps)), radius)


def test_simhash_odd_rows(spark):
    rows = [(5, None), (3, ""), (9, " \t\n"), (None, "One two THREE four"), (7, "one TWO three four"), (8, "one\ttwo\nthree four"), (2, "alone"), (2, "alone"), (4, "word " * 30_000), (None, "other text here")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"fp": F.lit("x"), "root": F.lit(1), "key": F.lit(2), "table": F.lit(3)})
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash_dedup.simhash_groups(df).collect()), key=repr)
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    assert got == sorted(((i, f"{f:016x}", c) for (i, f), c in zip(prints, plain_groups(prints, 2), strict=True)), key=repr)
    assert {i: f for i, f, _ in got}[5] == "0" * 16
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash_dedup.simhash_groups(empty).collect() == []


class Plain:
    """Tokens and groups one document after another, from the libraries as they are."""

    def __init__(self):
        import public_tokenizers
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        from tokenizers.decoders import ByteLevel

        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        self.of = token_alignment.byte_of_character()
        assert ByteLevel().decode(list(self.of)).encode(errors="replace")  # each character is one of the library's

    def groups(self, text):
        if not text:
            return []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        of_a = [bytes(self.of[c] for c in self.a.id_to_token(k)) for k in a]
        of_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in ((k, self.b.id_to_piece(k)) for k in b)]
        if b"".join(of_a) != (" " + text).encode() or b"".join(of_b) != (" " + text).encode():
            return []
        out, i, j = [], 0, 0
        while i < len(a):
            first_a, first_b = i, j
            at_a, at_b = len(of_a[i]), len(of_b[j])
            i, j = i + 1, j + 1
            while at_a != at_b:
                if at_a < at_b:
                    at_a += len(of_a[i])
                    i += 1
                else:
                    at_b += len(of_b[j])
                    j += 1
            out.append((a[first_a:i], b[first_b:j]))
        return out

    def all(self, rows):
        found = [(i, self.groups(t)) for i, t in rows]
        links = [[(x, y) for a, b in g for x in a for y in b] for _, g in found]
        held = Counter(p for ls in links for p in set(ls))
        most: dict = {}
        for (x, _), n in held.items():
            most[x] = max(most.get(x, 0), n)
        out = []
        for (i, g), ls in zip(found, links, strict=True):
            text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
            sha = hashlib.sha256(text.encode()).hexdigest() if g else ""
            out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(ls), sum(held[p] == most[p[0]] for p in ls), sum(held[p] for p in ls), sha))
        return sorted(out, key=repr)


ODD_TEXTS = [
    None, "", " ", "  leading", "trailing  ", "a▁b", "x <|endoftext|> y", "<s> </s> <unk> <0x41>", "\u0000 nul", "\r\n\r\n\t tab", "日本語のテキスト。" * 30, "🙂🙃" * 40,
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "1234567890" * 20, " " * 500, "  wide　space", "ﬁ ligature Ａ", "é é", "=" * 300 + "\n" + "-" * 77,
    "don't won't I'll", "ΑΒΓ абв אבג", "﻿bom", "z" * 5000, "word " * 4000, "กำ" * 60, "𝕏" * 50,
]


def test_alignment_of_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(token_alignment, "CHUNK_BYTES", 3000)
    rows = list(enumerate(ODD_TEXTS)) + [(None, "a null id"), (3, ODD_TEXTS[3]), (3, ODD_TEXTS[3])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"row": F.lit("x"), "pairs": F.lit(1), "n_a": F.lit(0), "pair": F.lit(2)})
    want = Plain().all(rows)
    for frequent in (token_alignment.FREQUENT, 40, 0):
        got = token_alignment.token_alignment(df, frequent=frequent)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert token_alignment.token_alignment(df.limit(0)).collect() == []
    assert {r.groups_sha256 for r in token_alignment.token_alignment(df.filter("text IS NULL")).collect()} == {""}


def test_wide_groups_count_as_narrow_ones(monkeypatch):
    path_a, path_b = token_alignment.tokenizer_path(), token_alignment.tokenizer_path("piece_bpe_32k.model")
    pair = token_alignment.PairOfTokenizers(path_a, path_b)
    texts = [(t or "").encode() for t in ODD_TEXTS]
    before = token_alignment.align(texts, pair)
    monkeypatch.setattr(token_alignment, "WIDE", 1)
    after = token_alignment.align(texts, pair)
    assert before["pairs"] == after["pairs"] and before["times"] == after["times"]


def test_groups_are_components_of_overlaps():
    draw = random.Random(3)
    for _ in range(200):
        n = draw.randint(1, 60)
        cuts = [sorted({n, *draw.sample(range(1, n + 1), draw.randint(0, n))}) for _ in range(2)]
        sizes = [np.diff([0, *c]) for c in cuts]
        both = sorted(set(cuts[0]) & set(cuts[1]))
        got = token_alignment.groups(*sizes)
        for g, c in zip(got, cuts, strict=True):
            assert g.tolist() == [sum(x < e for x in both) for e in c]


def test_alignment_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((tuple(r) for r in op13_token_alignment(spark, sf).collect()), key=repr)
    assert got == Plain().all([(r.doc_id, r.text) for r in docs])
