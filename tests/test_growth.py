"""Steps whose cost must grow no faster than the input: what they shuffle, write and hold."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kgspark.operators import ingest, proposals, retrieve
from kgspark.plans import registry
from kgspark.sources import documents, language


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


DOCS = [(1, "Red widget red"), (2, "blue, 12 widgets"), (3, ""), (4, None), (5, "Ünder red ß"), (6, "x " * 40)]


@pytest.mark.parametrize("step", [1, 7, 1 << 20])
def test_documents_are_posted_where_they_lie(spark, monkeypatch, step):
    monkeypatch.setattr(retrieve, "STEP", step)
    docs = spark.createDataFrame(DOCS, "id long, text string").coalesce(1)
    posted, vectors = retrieve.postings(docs), retrieve.hash_embedding(docs)
    assert "Exchange" not in plan(posted) + plan(vectors)
    want = {("red", 1, 2, 3), ("widget", 1, 1, 3), ("blue", 2, 1, 3), ("12", 2, 1, 3), ("widgets", 2, 1, 3), ("ünder", 5, 1, 3), ("red", 5, 1, 3), ("ß", 5, 1, 3), ("x", 6, 40, 40)}
    assert {tuple(r) for r in posted.collect()} == want and posted.count() == len(want)
    # as a plain sum over tokens by Spark's own MD5
    digest = F.md5(F.col("term").cast("binary"))
    number = lambda a, n: F.conv(F.substring(digest, a, n), 16, 10).cast("long")
    sums = posted.groupBy("id", (number(1, 8) % 256).alias("dim")).agg(F.sum(F.when(number(9, 2) % 2 == 0, 1).otherwise(-1) * F.col("tf")).alias("v")).filter("v <> 0").collect()
    norms = {i: sum(r.v**2 for r in sums if r.id == i) ** 0.5 for i in {r.id for r in sums}}
    assert {(r.id, r.dim, r.value) for r in vectors.collect()} == {(r.id, r.dim, r.v / norms[r.id]) for r in sums}


def test_rows_of_one_id_are_one_document(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b"), (1, "a"), (None, "c"), (None, "c d")], "id long, text string")
    assert sorted((tuple(r) for r in retrieve.postings(docs).collect()), key=str) == sorted([("a", 1, 2, 3), ("b", 1, 1, 3), ("b", 2, 1, 1), ("c", None, 2, 3), ("d", None, 1, 3)], key=str)


def test_upkeep_writes_no_postings_again(spark, tmp_path):
    concepts = spark.createDataFrame([(1, "T", "red one", ""), (2, "T", "red two", ""), (3, "T", "blue", "")], "id long, concept_type string, name string, description string")
    index = retrieve.Index.written(concepts, str(tmp_path / "index"))
    less = index.forgotten(spark.createDataFrame([(2,)], "id long"))
    assert set(index.posted.inputFiles()) <= set(less.posted.inputFiles()) and set(index.vectors.inputFiles()) <= set(less.vectors.inputFiles())
    assert {(r.term, r.id) for r in less.posted.collect()} == {("red", 1), ("one", 1), ("blue", 3)} and {r.id for r in less.vectors.collect()} == {1, 3}
    compact = less.write(str(tmp_path / "less"))
    assert compact.posted.count() == 3 and compact.n_docs.first().n == 2


def _ranks(words: str) -> dict[str, int]:
    t = f" {words} "
    counts = Counter(t[i : i + 3] for i in range(len(t) - 2))
    return {run: k for k, run in enumerate(sorted(counts, key=lambda r: (-counts[r], r))[: language.RUNS], 1)}


@pytest.mark.parametrize("step", [5, 1 << 21])
def test_languages_are_told_where_the_texts_lie(spark, monkeypatch, step):
    monkeypatch.setattr(language, "STEP", step)
    # lower-case words, one with letters beyond 16 bits; a text of more than RUNS runs; equal counts; nothing to tell
    long = " ".join(f"{a}{b}{c}o" for a in "abcdefgh" for b in "aeiou" for c in "klmnrst")
    texts = {1: "the cat and the hat", 2: "der hut und die katze", 3: long, 4: "\U00010428\U00010429\U0001042a the cat", 5: "zzz", 6: "", 7: None, 8: "x"}
    known = {"en": "the hat and the cat sat", "de": "die katze und der hut", "xx": long, "deseret": "\U00010428\U00010429\U0001042a"}
    profiles = language.profiles(spark.createDataFrame(list(known.items()), "lang string, text string"))
    want = {k: _ranks(v) for k, v in known.items()}
    assert {(r.lang, r.run): r["rank"] for r in profiles.collect()} == {(k, run): n for k, v in want.items() for run, n in v.items()}
    found = language.detect(spark.createDataFrame(list(texts.items()), "id long, text string"), profiles)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.id: (r.lang, r.confidence) for r in found.collect()}
    for i, text in texts.items():
        own = _ranks(text or "")
        near = sorted((-sum(300 - min(abs(own[r] - n), 300) for r, n in ranks.items() if r in own), lang) for lang, ranks in want.items())
        best, second = near[0], near[1]
        assert got[i] == ((best[1], (best[0] - second[0]) / best[0]) if best[0] else (None, None)), i


def test_files_are_decoded_without_a_shuffle(spark):
    files = spark.createDataFrame([("/a/one.txt", b"Alle Menschen sind frei und gleich"), ("/a/two.txt", "Всі люди народжуються вільними".encode()), ("/a/none.txt", b"")], "path string, content binary")
    read = documents.decoded(files)
    assert "Exchange" not in plan(read)
    assert {(r.name, r.lang) for r in read.collect()} == {("one", "de"), ("two", "uk"), ("none", None)}


@pytest.mark.parametrize("block", [3, 1024])
def test_a_task_gives_few_vectors_and_holds_a_block(monkeypatch, block):
    monkeypatch.setattr(retrieve, "ROW_BLOCK", block)
    rng = np.random.default_rng(5)
    rows = np.round(rng.normal(size=(400, 4)), 1)
    rows[200:210] = rows[0]  # ties
    held = np.argsort(-(rows @ rows[0]), kind="stable")  # the best first, so that few come after them
    batches = [pa.RecordBatch.from_arrays([pa.array(held[i : i + 50]), pa.array(rows[held[i : i + 50]].tolist(), pa.list_(pa.float64()))], names=["id", "v"]) for i in range(0, 400, 50)]
    got = [r for b in retrieve._best_of(batches, {4: (np.array([7]), rows[:1])}, 5) for r in b.to_pylist()]
    scores = np.round(rows @ rows[0], 9)
    want = sorted(range(400), key=lambda i: (-scores[i], i))[:5]
    assert [r["id"] for r in sorted(got, key=lambda r: (-r["score"], r["id"]))[:5]] == want
    # before, every batch gave at least five
    assert len(got) < 5 * len(batches)


def test_exported_lines_are_parsed_once(spark, sf):
    assert "get_json_object" not in plan(registry.QUERIES["export_records"](spark, sf))


def test_a_review_gives_no_task_most_rows(spark, monkeypatch):
    """all actions lack the same object and all relations lead to the same nation, as with few nations and many customers."""
    files = {}
    settle = proposals.settle

    def counted(df):
        out = settle(df)
        sizes = [r[1] for r in out.groupBy(F.input_file_name()).count().collect()]
        if sum(sizes) >= 300:
            files[len(files)] = max(sizes) / sum(sizes)
        return out

    monkeypatch.setattr(proposals, "settle", counted)
    monkeypatch.setattr(proposals, "HOT", 20, raising=False)
    monkeypatch.setattr(proposals, "RUN", 5, raising=False)
    k = F.col("id")
    own = F.concat(F.lit("c"), k.cast("string"))
    items = lambda kind, **fields: proposals.as_items(spark.range(400).select(F.lit(0).alias("file_no"), F.lit(0).alias("chunk"), k.alias("item"), F.lit(kind).alias("kind"), *[c.alias(f) for f, c in fields.items()]))
    every = items("concept", client_ref=own, type=F.lit("Customer"), name=F.concat(F.lit("new "), k.cast("string")))
    every = every.unionByName(items("relation", client_ref=F.concat(F.lit("r"), k.cast("string")), type=F.lit("located_in"), source_ref=own, target_ref=F.lit("Nation:here")))
    every = every.unionByName(items("action", client_ref=F.concat(F.lit("a"), k.cast("string")), type=F.lit("remind"), name=own, source_ref=own, target_ref=F.lit("none")))
    empty = ingest.State.empty(spark)
    nation = spark.createDataFrame([(1, "Nation", "HERE", "", {})], empty.concepts.schema)
    state = ingest.State(registry.RULED, nation, empty.relations, empty.rules, empty.actions, 10)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {c: spark.conf.get(c) for c in settings}
    try:
        for c, v in settings.items():
            spark.conf.set(c, v)
        report = proposals.apply_proposal(every, spark.createDataFrame([("none", "skip")], "client_ref string, action string"), state, default="create_new").report
        got = {r.client_ref: (r.outcome, r.id) for r in report.collect()}
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert got == {f"{c}{i}": ("created", str(10 + 400 * n + i)) for n, c in enumerate("cra") for i in range(400)}
    assert files and max(files.values()) < 0.7
