"""A folder of all classes of sources becomes one graph, and directives become the records they stand for."""

from __future__ import annotations

import io
import json
import zipfile

import pytest

from kgspark.sources import directives, documents, seeder

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def xlsx(rows, decoy=None):
    """A workbook whose first sheet in order is kept in the part named second; texts are shared, numbers plain."""
    shared: list[str] = []

    def cell(ref, v):
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v}</v></c>'
        shared.append(v)
        return f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>'

    def sheet(rows):
        lines = "".join(f'<row r="{n}">' + "".join(cell(f"{chr(65 + k)}{n}", v) for k, v in enumerate(r)) + "</row>" for n, r in enumerate(rows, 1))
        return f"<worksheet {NS}><sheetData>{lines}</sheetData></worksheet>"

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet2.xml", sheet(rows))
        z.writestr("xl/worksheets/sheet1.xml", sheet(decoy or [["name"], ["wrong sheet"]]))
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="A" r:id="rId7"/><sheet name="B" r:id="rId1"/></sheets></workbook>')
        rel = "".join(f'<Relationship Id="{i}" Target="{t}"/>' for i, t in (("rId1", "worksheets/sheet1.xml"), ("rId7", "worksheets/sheet2.xml")))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rel}</Relationships>')
        # styled runs are one text, readings are none of it
        items = "".join(f"<si><r><t>{s[:2]}</t></r><r><t>{s[2:]}</t></r><rPh><t>zz</t></rPh></si>" if len(s) > 3 else f"<si><t>{s}</t></si>" for s in shared)
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>{items}</sst>")
    return out.getvalue()


def ods(rows):
    def cell(v):
        if v is None:
            return "<table:table-cell/>"
        if isinstance(v, bool):
            return f'<table:table-cell office:value-type="boolean" office:boolean-value="{str(v).lower()}"/>'
        if isinstance(v, (int, float)):
            return f'<table:table-cell office:value-type="float" office:value="{v}"><text:p>shown</text:p></table:table-cell>'
        return f'<table:table-cell office:value-type="string"><text:p>{v}</text:p></table:table-cell>'

    body = "".join("<table:table-row>" + "".join(map(cell, r)) + "</table:table-row>" for r in rows)
    spaces = " ".join(f'xmlns:{p}="urn:oasis:names:tc:opendocument:xmlns:{p}:1.0"' for p in ("office", "table", "text"))
    tail = '<table:table-row table:number-rows-repeated="1048000"><table:table-cell table:number-columns-repeated="1024"/></table:table-row>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("content.xml", f"<office:document-content {spaces}><office:body><office:spreadsheet><table:table>{body}{tail}</table:table><table:table/></office:spreadsheet></office:body></office:document-content>")
    return out.getvalue()


def lines(*records):
    return "\n".join(["# a comment", "", *map(json.dumps, records)]) + "\n"


def named(kind, a, b):
    (s, sn), (t, tn) = a.split(":"), b.split(":")
    return {"kind": "named_relation", "relation_type": kind, "source_type": s, "source_name": sn, "target_type": t, "target_name": tn}


def write_tree(at):
    types = [{"name": n} for n in ("Company", "Person", "Contract", "Invoice", "LineItem")]
    links = [("employed_by", "Person", "Company", "ManyToOne"), ("between", "Contract", "Company", None), ("signed_by", "Contract", "Person", None), ("issued_to", "Invoice", "Company", "ManyToOne"), ("has_line_item", "Invoice", "LineItem", "OneToMany")]
    onto = {"concept_types": {t["name"]: t for t in types}, "relation_types": {n: {"name": n, "domain": d, "range": r} | ({"cardinality": c} if c else {}) for n, d, r, c in links}}
    (at / "ontology.json").write_text(json.dumps(onto, indent=1))
    people = [{"kind": "concept", "id": 0, "concept_type": "Company", "name": f"Co {k}", "properties": {"country": "CH", "size": k, "listed": True}} for k in range(3)]
    people += [{"kind": "concept", "id": 0, "concept_type": "Person", "name": f"P {k}"} for k in range(3)]
    (at / "seed.jsonl").write_text(lines(*people, *[named("employed_by", f"Person:P {k}", f"Company:Co {k}") for k in range(3)]))
    (at / "contracts").mkdir()
    for k in (1, 2, 3):
        (at / "contracts" / f"contract-00{k}.txt").write_text(f"Contract {k}")
    (at / "contracts" / "scan.bin").write_bytes(b"\0\1")
    (at / "invoices.xlsx").write_bytes(xlsx([["Name", " amount_eur ", "DESCRIPTION", "paid"], *[[f"INV-{k}", 10.5 * k, "bill" if k != 2 else 7, k % 2 == 0] for k in range(5)], [None, 3], ["  ", 1]]))
    (at / "line_items.ods").write_bytes(ods([["name", "quantity", "invoice"], *[[f"L{k}", k, f"INV-{k % 5}"] for k in range(8)]]))
    (at / "relations.jsonl").write_text(lines(*[named("between", f"Contract:contract-00{k}", f"Company:Co {j}") for k in (1, 2, 3) for j in (0, 1)], *[named("signed_by", f"Contract:contract-00{k}", f"Person:P {k - 1}") for k in (1, 2, 3)], *[named("issued_to", f"Invoice:INV-{k}", "Company:Co 2") for k in range(5)], *[named("has_line_item", f"Invoice:INV-{k % 5}", f"LineItem:L{k}") for k in range(8)]))
    (at / "notes.pdf").write_bytes(b"%PDF")


def test_a_folder_becomes_a_graph(spark, tmp_path):
    write_tree(tmp_path)
    state, totals = seeder.seed(spark, str(tmp_path))
    concepts = {r.id: r for r in state.concepts.collect()}
    assert totals == {"concepts": 22, "relations": 25, "ontology_updates": 3, "rules": 0, "actions": 0}
    assert [concepts[k].name for k in (*range(1, 7), *range(10, 26))] == [*[f"Co {k}" for k in range(3)], *[f"P {k}" for k in range(3)], *[f"contract-00{k}" for k in (3, 2, 1)], *[f"INV-{k}" for k in range(5)], *[f"L{k}" for k in range(8)]]
    assert [concepts[k].concept_type for k in (10, 13, 18)] == ["Contract", "Invoice", "LineItem"]
    assert concepts[1].properties == {"country": "CH", "size": "0", "listed": "true"} and concepts[10].description == "Contract 3"
    assert concepts[14].properties == {"amount_eur": "10.5", "paid": "false"} and concepts[14].description == "bill" and concepts[15].description == ""
    assert concepts[18].properties == {"quantity": "0", "invoice": "INV-0"}
    relations = {r.id: (r.relation_type, r.source, r.target, r.weight) for r in state.relations.collect()}
    assert relations[7] == ("employed_by", 4, 1, 1.0) and sorted(relations) == [7, 8, 9, *range(26, 48)]
    assert relations[26] == ("between", 12, 1, 1.0) and relations[47] == ("has_line_item", 15, 25, 1.0)
    assert state.next_id == 48


def test_order_of_sources_and_failures(spark, tmp_path):
    for name in ("z.jsonl", "relations.jsonl", "a.NDJSON", "seed.jsonl", "b.triples", "x.xlsx", "ontology.json", "readme"):
        (tmp_path / name).write_text("# nothing")
    for name in ("papers", "authors"):
        (tmp_path / name / "deep").mkdir(parents=True)
        (tmp_path / name / "a.txt").write_text("x")
        (tmp_path / name / "deep" / "b.txt").write_text("y")
    got = [(k, p.rsplit("/", 1)[-1]) for k, p in seeder.sources_of(spark, str(tmp_path))]
    assert got == [("ontology", "ontology.json"), ("seed", "seed.jsonl"), ("records", "a.NDJSON"), ("records", "z.jsonl"), ("triples", "b.triples"), ("texts", "authors"), ("texts", "papers"), ("workbook", "x.xlsx"), ("relations", "relations.jsonl")]
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "seed.jsonl").write_text(lines({"kind": "concept", "id": 0, "concept_type": "Ghost", "name": "x"}))
    with pytest.raises(ValueError, match="UnknownConceptType"):
        seeder.seed(spark, str(bad))


def test_triples_of_a_file(spark, tmp_path):
    (tmp_path / "seed.jsonl").write_text(lines({"kind": "concept_type_decl", "name": "A"}, {"kind": "relation_type_decl", "name": "to", "domain": "A", "range": "A", "symmetric": True}))
    (tmp_path / "t.triples").write_text("A:x  to A:y # note\n\nA:y to A:z\n")
    state, _ = seeder.seed(spark, str(tmp_path))
    assert sorted((r.id, r.name) for r in state.concepts.collect()) == [(1, "x"), (2, "y"), (5, "z")]
    assert sorted((r.id, r.source, r.target) for r in state.relations.collect()) == [(3, 1, 2), (4, 2, 1), (6, 2, 5), (7, 5, 2)]


BODY = """Some prose about a deal.
@concept_type Party -- who takes part
@concept Party: Acme Corp -- the buyer,
  @concept Party: Beta
@relation_type signs: Party -> Contract [symmetric]
@relation Party:Acme Corp -works with-> Party:Beta;
@rule strict Pay on Contract, Party: when due then pay in full
@rule plain: just do it
@rule order: WHEN late THEN fine
@action sign: Person -> Contract (date, place) => a signed contract
@action wait: Person
@action : nobody
@concept no colon
@relation A:b - c
@conceptual none
@rule
"""


def test_directives_become_records(spark):
    docs = spark.createDataFrame([(1, "Note", "deal", BODY)], "doc long, type string, name string, body string")
    rows = directives.text_records(docs).orderBy("line_no", "m", "part").collect()
    told = lambda r: json.loads(r.declared)
    got = [(r.line_no, r.kind.removesuffix("_type_decl"), told(r)["name"] if r.declared else r.name or f"{r.source_name}>{r.target_name}") for r in rows]
    end = (1 << 31) - 1
    assert got == [
        (0, "concept", "Note"), (0, "concept", "deal"), (2, "concept", "Party"), (3, "concept", "Party"), (3, "concept", "Acme Corp"), (4, "concept", "Party"), (4, "concept", "Beta"), (5, "relation", "signs"),
        (6, "relation", "works with"), (6, "named_relation", "Acme Corp>Beta"), (7, "concept", "Contract"), (7, "concept", "Party"), (7, "rule", "Pay"), (8, "rule", "plain"), (9, "rule", "order"),
        (10, "concept", "Person"), (10, "concept", "Contract"), (10, "action", "sign"), (11, "concept", "Person"), (11, "action", "wait"),
        (end, "relation", "mentions_party"), (end, "named_relation", "deal>Acme Corp"), (end, "relation", "mentions_party"), (end, "named_relation", "deal>Beta"),
    ]
    by_line = {(r.line_no, r.part): r for r in rows if r.line_no < end}
    assert told(by_line[2, 0]) == {"name": "Party", "description": "who takes part"} and by_line[3, 1].description == "the buyer"
    assert told(by_line[5, 0]) == {"name": "signs", "domain": "Party", "range": "Contract", "symmetric": True}
    assert told(by_line[6, 0]) == {"name": "works with", "domain": "Party", "range": "Party"}
    assert told(by_line[7, 2]) == {"name": "Pay", "when": "due", "then": "pay in full", "applies_to": ["Contract", "Party"], "strict": True}
    assert told(by_line[8, 0]) == {"name": "plain", "when": "", "then": "just do it", "applies_to": [], "strict": False}
    assert told(by_line[9, 0])["when"] == "WHEN late" and told(by_line[9, 0])["then"] == "fine"
    assert told(by_line[10, 2]) == {"name": "sign", "subject": "Person", "object": "Contract", "parameters": ["date", "place"], "effect": "a signed contract"}
    assert told(by_line[11, 1]) == {"name": "wait", "subject": "Person", "parameters": [], "effect": ""}


def test_texts_with_directives_are_ingested(spark, tmp_path):
    folder = tmp_path / "notes"
    folder.mkdir()
    (folder / "b.md").write_text("@concept Party: Acme\n@relation Party:Acme -knows-> Party:Beta\n")
    (folder / "a.txt").write_text("@concept Party: Beta\n@rule pay on Party: when due then pay\n")
    state, totals = seeder.seed(spark, str(tmp_path))
    # the last file comes first: its relation waits for Beta, as does its mention
    assert [(r.id, r.concept_type, r.name) for r in state.concepts.orderBy("id").collect()] == [(1, "Note", "b"), (2, "Party", "Acme"), (4, "Note", "a"), (5, "Party", "Beta")]
    assert [(r.id, r.relation_type, r.source, r.target) for r in state.relations.orderBy("id").collect()] == [(3, "mentions_party", 1, 2), (6, "mentions_party", 4, 5), (7, "knows", 2, 5), (8, "mentions_party", 1, 5)]
    assert [t.name for t in state.ontology.rule_types] == ["pay"] and totals["relations"] == 4


def test_workbooks_in_either_format():
    rows = [["x", "name"], [1, "a"], [None, None], [True, " b "], ["t", ""]]
    for data in (xlsx(rows), ods(rows)):
        assert documents.sheet_rows(data) == [{"x": 1.0, "name": "a"}, {"x": True, "name": " b "}]
    assert documents.sheet_rows(xlsx([])) == []
