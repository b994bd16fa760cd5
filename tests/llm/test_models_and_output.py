"""HTML text, mixing, sharding, token output, language model and URL filter."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kgspark.llm import class_lm, html_text, mixing, range_coder, sharding, token_output, url_filter
from kgspark.llm.common import SPACED_WORD

DOCS = "doc_id long, text string, lang string, source string, size int"
PAGE = """<html><head><title>x</title><script>var t="</p>";</script><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><main><article><header><h1>Title &amp; more</h1></header><p>First   para <a href="#">link</a> here &lt;b&gt;.<p>Second<br>line &copy; x<div class="ad">Buy now</div>
<aside>side</aside><ul><li>one</li><li>two</li></ul><form><label>mail</label></form></article><section id="comments"><p>great post</p></section></main><div class="sidebar"><p>more</p></div><footer>foot</footer></body></html>"""


def test_page(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>cut &am"), (5, "u", "<article><p>" + "word " * 30_000 + "</p>")], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    assert got[1].text == "Title & more\nFirst para link here <b>.\nSecond line © x\none\ntwo"
    assert (got[2].text, got[2].n_chars, got[3].text) == ("", 0, "")
    assert got[5].n_chars == 30_000 * 5 - 1
    assert html_text.extract(df.limit(0)).count() == 0


def test_tree_holds_its_labels():
    tree = html_text.grow(html_text.LABELLED)
    assert sum(html_text.classify(tree, r[:-1]) == bool(r[-1]) for r in html_text.LABELLED) / len(html_text.LABELLED) > 0.97


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        left, weight = total - sum(fixed.values()), sum(w[s] for s in rest)
        target = {s: left * w[s] / weight for s in rest}
        over = [s for s in rest if target[s] > 3 * sizes[s]]
        if not over:
            return fixed | target
        fixed |= {s: 3 * sizes[s] for s in over}


@pytest.mark.parametrize("seed", range(3))
def test_mix(spark, seed):
    rng = random.Random(seed)
    rows = [(k, " ".join(["w"] * rng.choice([0, 1, 5, 40])), "en", rng.choice(["a", "b", "c", "é", None, "z"] if k % 3 else ["b"]), 99) for k in range(150)]
    rows += [(200, None, "en", "only null", 1), (None, "x y", "en", "b", 1), rows[0], (300, "w " * 3000, "en", "z", 1)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix_sizes(df).join(df.select("doc_id", "source").distinct(), "doc_id", "left").collect()
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(re.findall(SPACED_WORD, t or ""))
    want = plain_targets(dict(sizes))
    out = mixing.mix(df)
    taken = {r.source: r.t for r in out.groupBy("source").agg(F.sum(F.col("epochs") * F.col("size") + F.col("partial")).alias("t")).collect()}
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
    for r in out.select("source", "source_size", "target").distinct().collect():
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
    key = lambda d: sorted((tuple(r) for r in d.collect()), key=repr)
    assert key(mixing.mix_sizes(df)) == key(mixing.mix_sizes(df.repartition(7)))
    assert mixing.mixed_documents(df).columns == df.columns
    assert mixing.mix_sizes(df.limit(0)).count() == 0


def test_better_documents_are_taken_more_often(spark):
    rows = [(k, ("## $$ %% && ** || " if k % 2 else "aa bb cc dd ee ff ") * 5, "en", "a" if k < 400 else "b", 0) for k in range(1200)]
    out = mixing.mix(spark.createDataFrame(rows, DOCS)).filter("source = 'b'")
    by = {r.odd: r.t for r in out.groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.sum(F.col("epochs") * F.col("size") + F.col("partial")).alias("t")).collect()}
    assert by[0] >= by[1]


def test_shards(spark):
    rows = [(k * 7 % 5000, f"text {k % 50} é", "en", "s", 1) for k in range(5000)] + [(None, None, "en", "s", 1), (3, "", "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    got = sharding.shard_documents(df).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        assert r.law == "key" and 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) < 1.5 * min(map(len, slots.values()))
    assert 150 < sum(r.grown_shard == 16 for r in got) < 450
    texts = {(i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t, *_ in rows}
    assert {(r.doc_id, r.text_crc32, r["size"]) for r in got} == texts
    assert sharding.shard_documents(df.limit(0)).count() == 0


def plain_shard(name, tree):
    """One level after another, with the draws of all children."""
    left, path = tree, ""
    for level in ("region", "rack", "shard"):
        labels = {getattr(x, level) for x in left}
        drawn = {}
        for label in labels:
            u = (int(hashlib.md5(f"{name}{path}/{label}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            drawn[label] = -math.log(u) / sum(x.weight for x in left if getattr(x, level) == label)
        best = min(drawn, key=drawn.get)
        left, path = [x for x in left if getattr(x, level) == best], f"{path}/{best}"
    return left[0].shard


def test_tree_by_plain_descents(spark):
    df = spark.createDataFrame([(k if k else None, "kept") for k in range(1200)], "doc_id long, __1 string")
    trees = {f"n{n}": sharding.even_tree(n) for n in (1, 9, 16, 33)}
    trees["uneven"] = [sharding.Leaf(3, 7, 1, 0.5), sharding.Leaf(1, 7, 2, 3.0), sharding.Leaf(9, 2, 1, 1.5), sharding.Leaf(5, 2, 1, 0.0), sharding.Leaf(6, 2, 1, 0.25)]
    trees["more"] = sharding.grown(trees["n16"], 3)
    got = sharding.assign(df.drop("__1"), "doc_id", trees).collect()
    for r in got:
        for column, tree in trees.items():
            assert r[column] == plain_shard("null" if r.doc_id is None else str(r.doc_id), [x for x in tree if x.weight > 0])
        assert r.more in (r.n16, 16, 17, 18)
    with pytest.raises(ValueError):
        sharding.assign(df, "doc_id", {"s": []})


def test_grown_weights_move_rows_only_along_the_path(spark):
    """At the first level where old and new path part, the new one goes to a node above the shard that grew."""
    df = spark.range(6000).withColumnRenamed("id", "doc_id")
    before = sharding.even_tree(24)
    after = [replace(x, weight=3.0) if x.shard == 13 else x for x in before]
    at = {x.shard: (x.region, x.rack, x.shard) for x in before}
    got = sharding.assign(df, "doc_id", {"a": before, "b": after}).collect()
    moved = [(at[r.a], at[r.b]) for r in got if r.a != r.b]
    assert moved
    for old, new in moved:
        k = next(k for k in range(3) if old[k] != new[k])
        assert new[: k + 1] == at[13][: k + 1]
    share = Counter(r.b for r in got)
    assert abs(share[13] / 6000 - 3 / 26) < 0.015
    assert abs(sum(n for s, n in share.items() if at[s][0] == 1) / 6000 - 10 / 26) < 0.02


def test_regrouped_shards_and_light_ones(spark):
    df = spark.range(20_000).withColumnRenamed("id", "doc_id")
    before = sharding.even_tree(8)
    regrouped = [replace(x, region=x.shard % 2) for x in before]
    light = [*before, sharding.Leaf(8, 1, 1, 0.01)]
    got = sharding.assign(df, "doc_id", {"a": before, "b": regrouped, "c": light}).collect()
    assert sum(r.a != r.b for r in got) > 5000
    assert 8 <= sum(r.c == 8 for r in got) <= 50
    for column in ("a", "b"):
        assert all(abs(n - 2500) < 250 for n in Counter(r[column] for r in got).values())


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 65535), st.integers(0, 20)), min_size=1, max_size=120), min_size=1, max_size=6))
def test_range_coder_round_trip(blocks):
    arrays = [np.array(b, np.uint16) for b in blocks]
    coded = range_coder.encode_blocks(arrays)
    back = range_coder.decode_blocks([x for c in coded for x in range_coder.split_blocks(c)])
    assert all((a == b).all() for a, b in zip(arrays, back, strict=True))


def test_range_coder_long_and_damaged():
    rng = np.random.default_rng(0)
    text = np.minimum(rng.zipf(1.3, 6000), 50_000).astype(np.uint16)
    blocks = [text[:2048], text[2048:4096], np.full(2048, 7, np.uint16), text[4096:]]
    coded = range_coder.encode_blocks(blocks)
    assert len(coded[2]) < 400
    back = range_coder.decode_blocks([x for c in coded for x in range_coder.split_blocks(c)])
    assert all((a == b).all() for a, b in zip(blocks, back, strict=True))
    bad = bytearray(coded[0])
    bad[60] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        range_coder.split_blocks(bytes(bad))


def test_token_output(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = ["Hello world, it's  fine.\n\n ok", None, "", " lead", "trail ", "tab\tx \t y", "é ñ 漢字 1²x", "<|endoftext|> x", "a   b", "word " * 40_000, "a b"]
    rows = [(100 - k, t) for k, t in enumerate(texts)] + [(50, "same id"), (50, "other"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"start": F.lit("clash"), "n_tokens": F.lit(1)})
    tok = Tokenizer.from_file(token_output.tokenizer_path())
    ids = {r: [*tok.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows}
    at, want = 0, []
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()))):
        want.append((r[0], at, len(ids[r]), zlib.crc32(np.array(ids[r], "<u4").tobytes())))
        at += len(ids[r])
    path = str(tmp_path / "tokens")
    got = token_output.tokenized(df, path=path)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
    again = token_output.read(spark, path)
    assert {r.start: np.frombuffer(r.ids, "<u2").tolist() for r in again.collect()}[0] == [*tok.encode("no id").ids, 2]
    assert token_output.tokenized(df.limit(0)).count() == 0


@pytest.mark.parametrize("head", [200_000, 20])
def test_class_lm(spark, monkeypatch, head):
    monkeypatch.setattr(class_lm, "HEAD_WORDS", head)
    rng = random.Random(2)
    nouns, verbs = [f"n{k}" for k in range(30)], [f"v{k}" for k in range(30)]
    texts = [" ".join(f"The {rng.choice(nouns)} {rng.choice(verbs)} a {rng.choice(nouns)}" for _ in range(rng.randint(1, 30))) for _ in range(120)] + [None, "", "new words É"]
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(texts)] + [(None, "The n1", "en", "s", 1), (900, "The n1 v1 a n2 " * 8_000, "en", "s", 1)]
    rows += rows[3:5]
    got = {r.doc_id: r for r in class_lm.score(spark.createDataFrame(rows, DOCS), classes=12).collect()}
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {k: [*re.findall(SPACED_WORD, (t or "").translate(upper)), None] for k, t, *_ in rows}
    held = {k: zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2 for k in tokens}
    c = Counter(w for k, *_ in rows if not held[k] for w in tokens[k])
    n, v = sum(c.values()), len(c)
    base = score = 0.0
    for k, ws in tokens.items():
        r = got[k]
        b = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        assert math.isclose(r.base_score, b, rel_tol=1e-9)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(ws), sum(c[w] > 0 for w in ws), n)
        if held[k]:
            base, score = base + b, score + r.score
    assert score > base
    empty = class_lm.score(spark.createDataFrame([], DOCS))
    assert empty.count() == 0


def likelihood(table, of, classes):
    n = np.zeros((classes, classes))
    np.add.at(n, (of[:, None].repeat(len(of), 1), of[None, :].repeat(len(of), 0)), table)
    x = lambda v: float((v * np.log(np.maximum(v, 1e-300))).sum())
    return x(n) - x(n.sum(axis=0)) - x(n.sum(axis=1))


@pytest.mark.parametrize("seed", range(4))
def test_exchange_ends_where_no_move_helps(seed):
    rng = np.random.default_rng(seed)
    table = rng.poisson(rng.gamma(0.3, 8, (14, 14)))
    of = class_lm.exchange(table, 5, passes=50)
    best = likelihood(table, of, 5)
    assert of[13] == 0 and (of[:13] > 0).all()
    for k in range(13):
        for c in range(1, 5):
            other = of.copy()
            other[k] = c
            assert likelihood(table, other, 5) <= best + 1e-6


def test_urls(spark):
    urls = ["http://A.Example.com/en/x?q", "https://www.example.com/en/1", "http://net/es/", "http://x.net/fr/", "http://a.org", "ftp://b.example.com", None, "no scheme", "", "http://com/", "x://h#f/en/", "http://notexample.com/en/", "https://casino-win.example.org/play?a=1&b=2", "http://" + "a" * 5000 + ".org/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    model = url_filter.fit(url_filter.labelled_urls(spark))
    got = {r.page_id: r for r in url_filter.judge(df, model).collect()}
    for k, u in enumerate(urls):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, key=lambda x: len(x[0]), default=None)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule and rule[0])
        assert got[k].verdict == (rule[1] if rule else "block" if got[k].score > 0 else "allow")
    assert got[12].verdict == "block"


def test_trees_in_sql_are_the_trees(spark):
    model = url_filter.fit(url_filter.labelled_urls(spark))
    df = spark.createDataFrame(list(url_filter.LABELLED), "url string, label int").select(F.monotonically_increasing_id().alias("page_id"), F.col("url").alias("__url"), "label")
    host, path = url_filter.parts(F.col("__url"))
    staged = df.withColumns({"h": host, "p": path})
    named = url_filter.features(F.col("__url"), F.col("h"), F.col("p")) | {"suffix_rate": model.suffix_rate(F.col("h"))}
    rows = staged.select("label", model.score(named).alias("score"), *[c.alias(k) for k, c in named.items()]).collect()
    for r in rows:
        assert math.isclose(r.score, model.bias + sum(url_filter.walk(t, r.asDict()) for t in model.trees), abs_tol=1e-9)
    assert sum((r.score > 0) == bool(r.label) for r in rows) / len(rows) > 0.95
    half = spark.createDataFrame(list(url_filter.LABELLED[::2]), "url string, label int")
    other = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(url_filter.LABELLED[1::2])], "page_id long, url string")
    judged = {r.page_id: r.score > 0 for r in url_filter.judge(other, url_filter.fit(half)).collect()}
    assert sum(judged[k] == bool(y) for k, (_, y) in enumerate(url_filter.LABELLED[1::2])) / len(judged) >= 0.8


def test_class_lm_clusters_words_beyond_the_seeds(spark, monkeypatch):
    """Two kinds of words that alternate, spelled alike: only their bigrams tell them apart."""
    monkeypatch.setattr(class_lm, "SYMBOL_WORDS", 4)
    rng = random.Random(5)
    kinds = [[f"{c}{k:02d}xx" for k in range(40)] for c in "ab"]
    texts = [" ".join(rng.choice(kinds[k % 2]) for k in range(rng.randint(20, 60))) for _ in range(300)] + ["rare1 rare2", "", " "]
    train = spark.createDataFrame([(t,) for t in texts], "text string").select(class_lm.text_bytes().alias("__bytes"))
    counts = class_lm.word_counts(train).cache()
    model, _ = class_lm.fit(train, counts, classes=4)
    symbols, ends = class_lm._symbols([" ".join(k).encode() for k in kinds], model.hashes)
    assert len(model.hashes) == 80 and len(set(symbols)) == 80 and ends.tolist() == [40, 80]
    a, b = (set(model.class_of[s].tolist()) for s in np.split(symbols, [40]))
    assert not a & b
    # the table of neighbours is the plain count
    want = Counter()
    for t in texts:
        path = [84 + 60, *class_lm._symbols([t.encode()], model.hashes)[0].tolist(), 84 + 60]
        want.update(zip(path, path[1:]))
    got = Counter()
    for r in class_lm.neighbours(train, model.hashes).collect():
        for k, n in zip(r.after, r.n_after, strict=True):
            got[r.symbol, k] += n
        for k, n in zip(r.before, r.n_before, strict=True):
            assert want[k, r.symbol] == n and k != r.symbol
    assert got == want


def test_special_tokens_in_texts_get_their_ids(spark, tmp_path):
    """op7 and the pipeline's last stage against a tokenizer as it is loaded."""
    from tokenizers import Tokenizer

    import corpus_pipeline
    from kgspark.llm import registry

    texts = ["<|endoftext|> x", "a<|endoftext|>b", "one two <|endoftext|> three\nfour", "  odd\n\n <|endoftext|>\n", "<|endoftext|><|endoftext|>", "<|endoftext|", "plain text", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    tok = Tokenizer.from_file(token_output.tokenizer_path())
    at, want = 0, []
    for k, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for got in (registry.op7_token_output(spark, str(tmp_path)), corpus_pipeline.token_stage(spark, docs, str(tmp_path))):
        assert sorted(map(tuple, got.collect())) == want


def test_neighbours_are_counted_in_groups_of_bounded_size(spark, monkeypatch):
    """Groups grow with the tokens, none takes in the whole corpus, and their sums are the plain counts."""
    rng = random.Random(9)
    texts = [" ".join(f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.randrange(60))) for _ in range(80)] + ["", " \n"]
    train = spark.createDataFrame([(t,) for t in texts], "text string").select(class_lm.text_bytes().alias("__bytes")).repartition(3)
    hashes = class_lm.Vocabulary(np.sort(class_lm.spaced_word_hashes(" ".join(f"w{k}" for k in range(60)).encode())))
    end = 60 + class_lm.SHAPES
    want = Counter()
    for t in texts:
        path = [end, *class_lm._symbols([t.encode()], hashes)[0].tolist(), end]
        want.update(zip(path, path[1:]))
    monkeypatch.setattr(class_lm, "GROUP_PAIRS", 64)
    for tokens in (None, sum(want.values()), 0):
        after, before = Counter(), Counter()
        rows = class_lm.neighbours(train, hashes, tokens).collect()
        assert len({r.symbol for r in rows}) == len(rows)
        for r in rows:
            after.update(dict(zip(((r.symbol, k) for k in r.after), r.n_after, strict=True)))
            before.update(dict(zip(((k, r.symbol) for k in r.before), r.n_before, strict=True)))
        assert after == want
        assert before == Counter({k: n for k, n in want.items() if k[0] != k[1]})


def test_ids_are_decoded_in_few_steps(monkeypatch):
    """The segment of a batch is coded in lockstep, so steps, not ids, cost calls: they are those of one block."""
    rng = np.random.default_rng(7)
    ids = rng.zipf(1.3, 20_000).clip(0, 50_000).astype(np.uint16)
    blocks = [ids[k : k + range_coder.BLOCK_IDS] for k in range(0, len(ids), range_coder.BLOCK_IDS)]
    coded = b"".join(range_coder.encode_blocks(blocks))
    steps, plain = [], range_coder._find
    monkeypatch.setattr(range_coder, "_find", lambda *a: steps.append(1) or plain(*a))
    got = range_coder.decode_blocks(range_coder.split_blocks(coded))
    assert np.array_equal(np.concatenate(got), ids)
    assert len(steps) <= 1024
    # blocks of twice the length, as earlier data sets have them, are still read
    longer = [ids[k : k + 2048] for k in range(0, len(ids), 2048)]
    old = range_coder.decode_blocks(range_coder.split_blocks(b"".join(range_coder.encode_blocks(longer))))
    assert np.array_equal(np.concatenate(old), ids)
