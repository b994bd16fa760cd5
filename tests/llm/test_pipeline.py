"""The corpus pipeline over the smallest tables, stage by stage against plain versions of its decisions."""

import zlib
from collections import Counter

import duckdb
import numpy as np
from test_pairs_and_filters import plain_counts, plain_groups, plain_hits

import corpus_pipeline
from kgspark.llm import token_output
from kgspark.llm.common import settle
from kgspark.llm.registry import ORACLES


def sql(files, name):
    """The rows of a query's SQL over these documents."""
    con = duckdb.connect()
    con.read_parquet(files).create_view("documents")
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    return [dict(zip(names, r, strict=True)) for r in result.fetchall()]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(settle(stage(spark, steps[-1], sf)))
    start, good, unique, clean, mixed, out = steps
    for s in steps[:-1]:
        assert s.columns == docs.columns
    texts = {r.doc_id: r.text for r in start.collect()}
    ids = [{r.doc_id for r in s.collect()} for s in steps[:-1]]
    judged = sql(f"{sf}/documents.parquet", "op4_quality_rules")
    assert ids[1] == {r["doc_id"] for r in judged if r["kept"]}
    assert not any(plain_counts(texts[k])[5] for k in ids[1])
    groups = plain_groups([(k, texts[k]) for k in sorted(ids[1])], 5, 80)
    assert ids[2] == {c for _, _, c in groups}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert ids[3] == {k for k in ids[2] if not plain_hits(texts[k], items)[4]}
    assert ids[4] <= ids[3]
    copies = {}
    for r in sql(clean.inputFiles(), "op5_mix_sources"):
        epochs = round(r["target"]) // r["source_size"] if r["source_size"] else 0
        partial = r["taken"] - epochs * r["size"]
        copies[r["doc_id"]] = 1 if not r["size"] else epochs + (partial > 0 and 2 * partial >= r["size"])
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({k: n for k, n in copies.items() if n})
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_output.tokenizer_path())
    at = 0
    for r, k in zip(out.orderBy("start").collect(), sorted(r.doc_id for r in mixed.collect()), strict=True):
        code = [*tok.encode(texts[k], add_special_tokens=False).ids, 2]
        assert tuple(r) == (k, at, len(code), zlib.crc32(np.array(code, "<u4").tobytes()))
        at += len(code)
    assert good.count() > unique.count() >= clean.count()


def test_run_and_registration(spark, sf):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert "pipeline" not in entry.oracle_sql()
    assert len([n for n in entry.queries() if n.startswith("op")]) == 13


def test_odd_rows(spark, tmp_path):
    """Nulls in any column, repeated rows, another order of rows, and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    body = " ".join(f"word{k}" for k in range(120))
    rows = [(1, body, "en", "a", 5), (1, body, "en", "a", 5), (2, body + " more", "en", "a", None), (3, None, None, None, None), (None, body.replace("word", "term"), None, None, 1), (4, "", "en", "b", 0), (5, " ".join(f"other{k}" for k in range(90)), "xx", None, 2)]
    spark.createDataFrame([(1, "a benchmark passage that no document holds at all in its text")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = []
    for name, some in (("first", rows), ("again", rows[::-1]), ("none", [])):
        folder = tmp_path / name
        spark.createDataFrame(some, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{tmp_path}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
        found.append(sorted(map(tuple, corpus_pipeline.run(spark, str(folder)).collect()), key=repr))
    assert found[0] == found[1] and found[2] == []
    assert {r[0] for r in found[0]} <= {1, None, 5} and found[0]
