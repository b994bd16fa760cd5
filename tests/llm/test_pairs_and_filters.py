"""Near-dedup, decontamination, quality and licences against plain versions on small fixtures."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kgspark.llm import decontaminate, licenses, near_dedup, quality

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, extra int"


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER))


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))


def family(rng, n, edits):
    base = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(30, 120))]
    out = [" ".join(base)]
    for _ in range(n - 1):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(9999)}"
        out.append(" ".join(w))
    return out


def plain_groups(rows, words, percent):
    sets, links = {}, defaultdict(set)
    for k, (_, t) in enumerate(rows):
        w = spaced(t)
        sets[k] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    for a in sets:
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                links[a].add(b)
                links[b].add(a)
    out = []
    for a in sets:
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        out.append((rows[a][0], len(sets[a]), min(rows[b][0] for b in seen)))
    return sorted(out)


@pytest.mark.parametrize("words", [4, 5])
def test_near_groups(spark, words):
    rng = random.Random(words)
    texts = [t for n in (1, 1, 2, 3, 5, 30) for t in family(rng, n, 6)]
    texts += [None, "", " \t\n", "One two", "one  TWO", "one two three", "É é", texts[3], texts[3].upper(), " ".join(f"x{i}" for i in range(20_000))]
    rows = [(10 * k + 3, t) for k, t in enumerate(texts)]
    rows.append(rows[5])
    df = spark.createDataFrame([(i, t, "en", None, 1) for i, t in rows], DOCS)
    got = near_dedup.near_groups(df, words, 80)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == plain_groups(rows, words, 80)
    assert got.filter("kept <> (doc_id = component_id)").count() == 0
    stay = near_dedup.deduplicated(df, words, 80)
    assert stay.columns == df.columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted({r.doc_id for r in got.filter("kept").collect()})


def test_large_bucket_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rng = random.Random(9)
    rows = [(k, t) for k, t in enumerate(family(rng, 40, 9))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_groups(df, 4, 80)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == plain_groups(rows, 4, 80)
    monkeypatch.setattr(near_dedup, "LEVELS", 0)
    got = near_dedup.near_groups(df, 4, 80)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == plain_groups(rows, 4, 80)


def test_a_bucket_of_many_components_is_parted(spark):
    """20,000 members of one bucket, each a component of its own but for pairs that share all bands: rows stay linear."""
    n = 20_000
    bands = spark.range(n).select(F.col("id").alias("node"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("slot"))
    bands = bands.withColumn("band", F.when(F.col("slot") == 3, F.lit(7)).otherwise(F.xxhash64((F.col("node") / 2).cast("long") % 3000, "slot"))).cache()
    members = bands.filter("slot = 3").select("band", F.col("slot").cast("int").alias("slot"), "node", F.col("node").alias("comp"), F.lit(100).cast("long").alias("n"))
    out, parted = near_dedup._parted(members, bands)
    assert parted and out.count() <= near_dedup.FOLLOWING * n
    assert out.groupBy("band").count().agg(F.max("count")).first()[0] <= near_dedup.BLOCK
    assert near_dedup._in_blocks(out).count() <= 2 * out.count()
    met = out.select("band", F.col("node").alias("a")).join(out.select("band", F.col("node").alias("b")), "band").filter("b = a + 1 and a % 2 = 0").select("a").distinct().count()
    assert met == n / 2


def test_near_groups_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_groups(df).count() == 0
    one = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_groups(one).collect()} == {(None, 4, False), (4, 4, True)}


def test_estimate_is_fair():
    import numpy as np

    rng = np.random.default_rng(3)
    got = []
    for _ in range(200):
        u = near_dedup.window_hashes(rng.integers(0, 1 << 62, 300, np.uint64), 1)
        x, y = near_dedup.sketch(u[:270]), near_dedup.sketch(u[30:])
        got.append(near_dedup.estimate(x.reshape(1, -1), y.reshape(1, -1), np.array([270]), np.array([270]))[0])
    assert abs(np.mean(got) - 0.8) < 0.02


def plain_hits(text, items, window=10):
    words, hit, found = alnum(text), set(), set()
    for item, t in items:
        w = alnum(t)
        n = min(window, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in grams:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_pieces_hold_each_window_of_a_long_item():
    rng = random.Random(8)
    for n in (0, 1, 9, 10, 11, 25, 300):
        words = [f"w{rng.randrange(99)}" for _ in range(n)]
        for most in (1, 40, 333, 10_000):
            cut = [p.decode().split() for p in decontaminate.pieces(" ".join(words).encode(), most, 10)]
            windows = {tuple(w[i : i + 10]) for w in [words] for i in range(max(1, len(w) - 9))}
            assert {tuple(w[i : i + 10]) for w in cut for i in range(max(1, len(w) - 9))} == windows
            assert all(sum(len(x) + 1 for x in w[:-1]) <= most + 40 for w in cut)


@pytest.mark.parametrize("part_bytes", [1 << 20, 400])
def test_contamination(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(decontaminate, "PART_BYTES", part_bytes)
    rng = random.Random(4)
    words = [f"w{k}" for k in range(30)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 9, 10, 14])))) for k in range(12)] + [(12, None), (13, "É, b c! d e f g h i j"), (14, " ".join(rng.choice(words) for _ in range(200)))]
    items += [items[5]] * 3
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(8)] + [f"pre {items[k][1]} post" for k in range(12)] + [None, "", "x É b C d e f g h I j y", " ".join(["w1"] * 30_000)]
    rows = [(k, t, "en", "s", 7) for k, t in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, bench)
    assert sorted(tuple(r) for r in got.collect()) == sorted((k, *plain_hits(t, items)) for k, t, *_ in rows)
    stay = decontaminate.decontaminated(docs, bench)
    assert stay.columns == docs.columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted(k for k, t, *_ in rows if not plain_hits(t, items)[4])
    cut = decontaminate.decontaminated(docs, bench, remove="spans")
    assert cut.count() == len(rows)
    assert decontaminate.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_spans_are_cut():
    assert decontaminate.without_words("keep, Hit one! and two.", [1, 4], [3, 5]) == "keep, ! and ."


def plain_counts(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


PROSE = "the house of the river and a road that is on the hill was built for it as with be by at this from or"


def test_quality(spark):
    rng = random.Random(1)
    good = [" ".join(rng.choice(PROSE.split()) + rng.choice(["", "", "ing", ","]) + str(rng.choice(["", "x", "ly"])) for _ in range(rng.randint(90, 200))) for _ in range(20)]
    junk = ["### ".join(f"w{rng.randrange(999)}%%%&&&" for _ in range(150)) for _ in range(2)]
    texts = [*good, *junk, None, "", "a\nb\na\n \na", "x y z " * 60, "É€漢字 " * 3, "\x0b\x0c\x1c", " ".join(rng.choice(good[0].split()) for _ in range(50_000))]
    rows = [(k, t, "en" if k % 9 else None, "s", 1) for k, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in quality.quality(df).collect()}
    for k, t, *_ in rows:
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_counts(t)
    assert all(got[k].kept for k in range(20) if not plain_counts(texts[k])[5])
    assert not any(got[k].kept for k in (20, 21))
    assert quality.kept_documents(df).columns == df.columns
    assert quality.quality(df.limit(0)).count() == 0


def test_distance(spark):
    p, q = [0.5, 0.5, 0.0], [0.1, 0.4, 0.5]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a)
    got = spark.createDataFrame([(p, q)], "p array<double>, q array<double>").select(quality._distance(F.col("p"), F.col("q")).alias("d")).first().d
    assert abs(got - math.sqrt((kl(p) + kl(q)) / 2)) < 1e-12


def test_licenses(spark):
    body = licenses.TEMPLATES[0].text
    texts = ["Released under the MIT License.", "MIT-license mit LICENSE x apache license", None, "", "no such thing", "GNU Lesser General Public License", f"start {body} end", body.replace("copy", "cpy"), "mit is not a license", "licensed under cc by nc 4 0", "mit license " * 5000]
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)] * 2, DOCS).withColumns({"n_words": F.lit(0), "labels": F.lit("clash")})
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    for k, t in enumerate(texts):
        w = alnum(t)
        at = [i for p, _ in licenses.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        names = sorted({n for p, n in licenses.BASE if f" {p} " in f" {' '.join(w)} "})
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(names))
        assert set(names) <= set(r.labels.split(",")) | ({""} if not names else set()) and 0 <= r.score <= 1
    assert got[5].labels == "gpl,lgpl" and got[6].labels == "mit" and got[7].labels == "mit" and got[8].labels == "" and got[9].labels == "cc-by-nc"
    assert licenses.scan(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_licence_labels_by_brute_force(seed):
    """Every place of every template, without the index."""
    rng = random.Random(seed)
    frequencies = {w: rng.randint(0, 900) for t in licenses.TEMPLATES for w in licenses.lower_alnum_words(t.text.encode())}
    index = licenses.build(1000, frequencies)
    found = 0
    for _ in range(40):
        words = []
        for _ in range(rng.randint(0, 3)):
            body = rng.choice(licenses.TEMPLATES).text.split()
            body = [w for w in body if rng.random() > rng.choice([0, 0.01, 0.1])]
            for _ in range(rng.choice([0, 0, 3, 20])):
                body.insert(rng.randrange(len(body) + 1), rng.choice(["the", "software", "zebra", "license"]))
            words += [rng.choice(["plain", "of", "software"]) for _ in range(rng.randint(0, 6))] + body
        data = [w.encode() for w in words]
        places = defaultdict(set)
        for k, w in enumerate(data):
            places[w].add(k)
        want = {label for p, label in licenses.BASE if f" {p} " in f" {' '.join(words)} "}
        for t, template in enumerate(index.words):
            starts = [[k for k in range(len(data)) if data[k : k + len(p)] == p] for p in index.mandatory[t]]
            for start in range(-len(template), len(data)):
                if all(any(start - 4 <= p <= start + len(template) + 4 for p in ps) for ps in starts):
                    if licenses.found_weight(template, start, places, index.weights) >= 0.7 * index.total(t):
                        want.add(index.labels[t])
        assert licenses.match(data, index)[2] == want
        found += bool(want)
    assert found > 10
