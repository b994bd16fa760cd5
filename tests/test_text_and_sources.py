"""Scalar functions, readers, retrieval and prompts on small inputs."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from kgspark.functions import text
from kgspark.operators import prompts, retrieve, stats
from kgspark.operators.ontology import ActionType, ConceptType, Ontology, RuleType
from kgspark.sources import charset, documents, records


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_scalars(spark):
    assert one(spark, "signedBy_two", text.humanize) == "signed by two"
    assert one(spark, " sk-12345678 ", text.mask_key) == "sk-...5678"
    assert one(spark, "  ", text.mask_key) == ""
    assert one(spark, "line_items", text.infer_concept_type) == "LineItem"
    assert one(spark, "s", text.infer_concept_type) == "S"
    assert [one(spark, p, text.file_kind) for p in ("a.PDF", "b.tar.gz", "c.md", "d")] == ["pdf", "passthrough", "text", "passthrough"]
    assert one(spark, "abcab", text.trigrams) == ["abc", "bca", "cab"]
    assert one(spark, "ab", text.trigrams) == []
    assert one(spark, "Añb-c9  x", text.tokens) == ["añb", "c9", "x"]


def test_binary_and_bounds(spark):
    assert one(spark, "abc\0def", text.looks_binary) is True
    assert one(spark, "", text.looks_binary) is False
    assert one(spark, "plain\ttext\n", text.looks_binary) is False
    assert one(spark, "\x01" + "a" * 9, text.looks_binary) is True
    assert one(spark, "\x01" + "a" * 10, text.looks_binary) is False
    assert one(spark, "é" * 10, lambda c: text.bounded_description(c, 7)) == "ééé…"
    assert one(spark, "abc", lambda c: text.bounded_description(c, 3)) == "abc"
    assert one(spark, "\0" * 100, text.bounded_description).startswith("[binary content")


def test_chunks(spark):
    body = "\n\n".join("x" * 7000 for _ in range(3))
    got = one(spark, body, text.paragraph_chunks)
    assert len(got) >= 2 and all(len(c) <= 12_004 for c in got) and "".join(got).count("x") == 21_000
    assert one(spark, "a\n\nb\n\nc", lambda c: text.paragraph_chunks(c, 4)) == ["a\n\nb", "c"]
    assert one(spark, "short", text.paragraph_chunks) == ["short"]


@pytest.mark.parametrize(
    ("raw", "ids", "body"),
    [("Cited: [#1, #42]\nAnswer: hello world", [1, 42], "hello world"), ("cited: 7 9 9\nbody", [7, 9], "body"), ("no citations", [], "no citations"), ("hi\nCited: 3\nrest", [3], "hi\nrest"), ("1\n2\n3\n4\n5\ncited: 9", [], "1\n2\n3\n4\n5\ncited: 9")],
)
def test_citations(spark, raw, ids, body):
    assert one(spark, raw, text.cited_ids) == ids
    assert one(spark, raw, text.answer_text) == body


def test_directives(spark):
    body = "prose\n@concept_type Party\n@concept Party: Ann,\n@concepttype no\n  @rule strict r on Contract: when a then b;\n@action sign: Person -> Contract (date) => effect\n@concept Party: Ann"
    docs = spark.createDataFrame([(1, body), (2, "nothing here"), (3, None)], "id long, body string")
    found = documents.directives(docs)
    assert [(r.line_no, r.tag, r.rest) for r in found.orderBy("line_no").collect()] == [
        (2, "concept_type", "Party"), (3, "concept", "Party: Ann"), (5, "rule", "strict r on Contract: when a then b"), (6, "action", "sign: Person -> Contract (date) => effect"), (7, "concept", "Party: Ann"),
    ]
    assert [tuple(r) for r in documents.mentions(found).collect()] == [(1, "Party", "Ann", "mentions_party")]


@pytest.mark.parametrize(
    ("data", "want"),
    [(b"plain", "plain"), (b"\xef\xbb\xbfcaf\xc3\xa9", "café"), (b"na\xefve r\xe9sum\xe9", "naïve résumé"), (b"\xff\xfeh\x00\xe9\x00", "hé"), ("café".encode(), "café")],
)
def test_decode(data, want):
    assert charset.decode(data).text == want


def docx(*paragraphs):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r>{p}</w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_docx():
    assert documents.docx_text(docx("<w:t>one</w:t><w:tab/><w:t>two</w:t>", "<w:t>three</w:t><w:br/><w:t>four</w:t>")) == "one\ttwo\nthree\nfour"


def sheet(rows):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'

    def cell(v):
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        return f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) else "<c/>" if v is None else f'<c t="inlineStr"><is><t>{v}</t></is></c>'

    body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def test_sheets(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(sheet([["name", " amount ", "paid", "description"], ["INV-1", 12.5, True, "d"], [None, 3, False, None], ["INV-2", 7, None, 5]]))
    got = documents.read_sheets(spark, str(tmp_path), "Invoice").orderBy("name").collect()
    assert [(r.name, r.description, r.properties) for r in got] == [("INV-1", "d", {"amount": "12.5", "paid": "true"}), ("INV-2", "", {"amount": "7"})]


def test_read_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("the end of the road")
    (tmp_path / "b.MD").write_bytes(b"caf\xe9 et la vie")
    (tmp_path / "c.bin").write_text("no")
    got = documents.read_documents(spark, str(tmp_path)).orderBy("name").collect()
    assert [(r.name, r.body, r.lang, r.is_binary) for r in got] == [("a", "the end of the road", "en", False), ("b", "café et la vie", "fr", False)]


def test_triples(spark):
    lines = [(0, "Person:Alice authored Paper:Survey"), (1, "# comment"), (2, "Person:Bob  authored Paper:Survey # note"), (3, ""), (4, "Paper:Survey covers Topic:a:b")]
    df = spark.createDataFrame([("f", k, x) for k, x in lines], "file string, line_no long, line string")
    c, r = records.parse_triples(df)
    assert [(x.concept_type, x.name) for x in c.orderBy("first_seq").collect()] == [("Person", "Alice"), ("Paper", "Survey"), ("Person", "Bob"), ("Topic", "a:b")]
    assert r.count() == 3
    with pytest.raises(Exception, match="not a triple"):
        records.parse_triples(spark.createDataFrame([("f", 0, "a b c")], "file string, line_no long, line string"))[1].collect()


def test_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text('name,affiliation,description\n"Ann ""A""","x,y",first\nBob,,\n')
    got = records.read_table(spark, str(tmp_path / "p.csv"), "Person").orderBy("name").collect()
    assert [(r.name, r.description, r.properties) for r in got] == [('Ann "A"', "first", {"affiliation": "x,y"}), ("Bob", "", {})]
    (tmp_path / "bad.csv").write_text("affiliation\nx\n")
    with pytest.raises(ValueError, match="name"):
        records.read_table(spark, str(tmp_path / "bad.csv"), "Person")
    (tmp_path / "empty.csv").write_text("name,a\n,x\n")
    with pytest.raises(Exception, match="no name"):
        records.read_table(spark, str(tmp_path / "empty.csv"), "Person").collect()


def test_jsonl(spark, tmp_path):
    lines = ['{"kind":"concept","id":0,"concept_type":"A","name":"x"}', "# c", "", '{"kind":"named_relation","relation_type":"r","source_type":"A","source_name":"x","target_type":"A","target_name":"y"}']
    df = records.parse_jsonl(spark.createDataFrame(list(enumerate(lines)), "line_no long, line string"))
    assert records.concepts_of(df).first().description == ""
    assert records.named_relations_of(df).first().weight == 1.0
    with pytest.raises(Exception, match="unknown record kind"):
        records.parse_jsonl(spark.createDataFrame([(0, '{"kind":"zzz"}')], "line_no long, line string")).collect()
    concepts = spark.createDataFrame([(1, "A", "x", "")], "id long, concept_type string, name string, description string")
    relations = spark.createDataFrame([(2, "r", 1, 1)], "id long, relation_type string, source long, target long")
    records.write_jsonl(Ontology([ConceptType("A")]), concepts, relations, str(tmp_path / "out"), actions=relations.limit(0))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["0-ontology", "1-concept", "2-relation", "3-action"]
    back = records.parse_jsonl(records.numbered_lines(spark, str(tmp_path / "out/1-concept")))
    assert records.concepts_of(back).first().name == "x"


TOPICS = [(1, "Topic", "Retrieval Augmented Generation", "search before answers"), (2, "Topic", "Knitting", ""), (3, "Topic", "Sourdough Baking", ""), (4, "Person", "Retrieval Researcher", "")]


def test_ranking(spark):
    onto = Ontology([ConceptType("Topic"), ConceptType("Person")])
    c = spark.createDataFrame(TOPICS, "id long, concept_type string, name string, description string")
    index = retrieve.Index.build(c)
    got = retrieve.rank(index, onto, retrieve.Request("Retrieval Augmented Generation")).collect()
    assert got[0].id == 1 and not {2, 3} & {r.id for r in got}
    typed = retrieve.rank(index, onto, retrieve.Request("retrieval", concept_types=("Person",))).collect()
    assert [r.id for r in typed] == [4]
    assert retrieve.rank(index, onto, retrieve.Request("retrieval", top_k=0)).count() == 0
    swapped = index.replaced(spark.createDataFrame([(2, "Topic", "Retrieval", ""), (9, "Topic", "Retrieval", "")], c.schema)).forgotten(spark.createDataFrame([(1,), (77,)], "id long"))
    assert {r.id for r in retrieve.rank(swapped, onto, retrieve.Request("retrieval")).collect()} == {2, 4, 9}
    assert swapped.n_docs.first().n == 4 and swapped.posted.columns == index.posted.columns
    flat = retrieve.Index.build(c, embed=lambda docs: docs.select("id", F.lit(0).alias("dim"), F.lit(1.0).alias("value")))
    assert {r.vector for r in retrieve.rank(flat, onto, retrieve.Request("knitting", lexical_weight=0.0)).collect()} == {1.0}


@pytest.mark.parametrize("block", [1024, 2])
def test_dense_topk(spark, monkeypatch, block):
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", block)
    rows = [(k, [float(k % 4), 1.0, float(k % 3)]) for k in range(40)] + [(40, None), (41, [1.0]), (42, []), (3, [3.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    got = sorted((r.query_id, r["rank"], r.id, r.score) for r in retrieve.dense_topk(df.filter("id % 10 = 0 OR id = 41"), df, 5).collect())
    want = []
    for q, v in rows:
        if (q % 10 == 0 or q == 41) and v:
            found = sorted((-sum(x * y for x, y in zip(v, w)), i) for i, w in rows if w and len(w) == len(v))[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    assert got == sorted(want)
    assert retrieve.dense_topk(df.limit(0), df, 5).count() == 0 and retrieve.dense_topk(df, df.limit(0), 5).count() == 0


def test_prompts(spark):
    onto = Ontology([ConceptType("B"), ConceptType("A", description="first")], [], [RuleType("r", "", "act", ("A",), strict=True)], [ActionType("sign", "A", "B", ("date",), "done")])
    assert [r.line for r in prompts.static_lines(onto, spark).collect()] == ["- A :: first", "- B :: (no description)", "- [MUST] r (A): when - then act", "- sign: (A) -> (B) [date] => done"]
    asked = spark.createDataFrame([(1, "", "", "why?")], "prompt_id long, system string, context string, question string")
    assert prompts.answer(asked).first().raw == prompts.echo(asked).first().raw == "[echo] why?"


def test_citations_are_asked_for_again_once(spark):
    class Scripted:
        """Answers by the first word of the question; asked again, as the script says."""

        def generate(self, system, context, question):
            first, again = {"good": ("Cited: #1\nAnswer: a", None), "mends": ("Cited: #1, #9\nAnswer: b", "Cited: #2\nAnswer: b2"), "more": ("Cited: #9\nAnswer: c", "Cited: #1, #2, #8\nAnswer: c2"), "worse": ("Cited: #1, #9\nAnswer: d", "Cited: #7, #8\nAnswer: d2"), "fails": ("Cited: #9\nAnswer: e", prompts.ModelError("down")), "none": ("Hello", None)}[question.split()[0]]
            if "cite only" not in question:
                return first
            assert question.endswith("cite only: #1, #2")
            if isinstance(again, Exception):
                raise again
            return again

    asked = [(k, "", "", f"{w} question") for k, w in enumerate(("good", "mends", "more", "worse", "fails", "none"))]
    df = spark.createDataFrame(asked, "prompt_id long, system string, context string, question string")
    allowed = spark.range(6).selectExpr("id AS prompt_id").crossJoin(spark.range(1, 3))
    got = {r.prompt_id: (r.answer, r.cited, r.n_asked) for r in prompts.answer_cited(df, allowed, Scripted).collect()}
    assert got == {0: ("a", [1], 1), 1: ("b2", [2], 2), 2: ("c2", [1, 2], 2), 3: ("d", [1], 2), 4: ("e", [], 2), 5: ("Hello", [], 1)}
    # a second round goes to those that still cite others
    twice = {r.prompt_id: r.n_asked for r in prompts.answer_cited(df, allowed, Scripted, retries=2).collect()}
    assert twice == {0: 1, 1: 2, 2: 3, 3: 3, 4: 3, 5: 1}
    assert {r.answer for r in prompts.answer_cited(df, allowed, Scripted, retries=0).collect()} == {"a", "b", "c", "d", "e", "Hello"}


def test_history(spark):
    rows = [("a", t, float(t)) for t in (0, 30, 59, 60, 100, 121, 500)]
    got = stats.history(spark.createDataFrame(rows, "series string, at long, value double"))
    assert sorted(r.at for r in got.collect()) == [0, 60, 121, 500]
    assert [r.delta_percent for r in stats.delta(spark.createDataFrame([("z", 0, 0.0), ("z", 1, 5.0)], "series string, at long, value double")).collect()] == [100.0]


def test_parsed_directives_gives_no_length_of_a_description_that_was_cut(spark, tmp_path):
    from kgspark.plans import registry

    spark.createDataFrame([(1, "s", "short"), (2, "s", "x" * 70_000)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["parsed_directives"](spark, str(tmp_path)).filter("type = 'Note'").collect()
    assert {r.doc: r.n_description is None for r in got} == {1: False, 2: True}
