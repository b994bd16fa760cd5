"""Proposals of all six kinds: merged across files, and applied after review, against plain loops."""

from __future__ import annotations

import json
import random
import re

import pytest
from test_ingest import Plain, Stop

from kgspark.operators import proposals
from kgspark.operators.ingest import State
from kgspark.operators.ontology import ActionType, ConceptType, Ontology, RelationType, RuleType
from kgspark.operators.proposals import ITEM, KINDS

SCHEMA = ", ".join(f"`{c}` {t}" for c, t in ITEM.items())


def item(kind, ref, **fields):
    return dict.fromkeys(ITEM) | {"file_no": 0, "chunk": 0, "item": 0, "kind": kind, "client_ref": ref} | fields


def listed(items):
    return [x | {"item": k} for k, x in enumerate(items)]


def frame(spark, items):
    return spark.createDataFrame([tuple(x[c] for c in ITEM) for x in items], SCHEMA).repartition(3)


ONTOLOGY = Ontology(
    [ConceptType("Person", disjoint_with=("Robot",)), ConceptType("Robot", disjoint_with=("Person",)), ConceptType("Boss", parent="Person"), ConceptType("Paper", properties=("year", "lang"), required_properties=("year",))],
    [RelationType("knows", "Person", "Person", symmetric=True), RelationType("pair", "Person", "Person", "OneToOne", symmetric=True), RelationType("boss", "Person", "Person", "ManyToOne"), RelationType("wrote", "Person", "Paper", "OneToMany")],
    [RuleType("duty", "", "")],
    [ActionType("call", "Person", "Person")],
)


def reviewed(items, decisions, default, strict, lang, start):
    """The report and the graph of a plain loop."""
    g = start
    report, refs = [], {}

    def resolve(ref):
        if ref in refs:
            return refs[ref]
        if ref is not None and ":" in ref:
            t, n = ref.split(":", 1)
            return g.names.get((t, n.lower()))
        return None

    def update(i, x):
        kind, old = g.concepts[i][1], g.concepts[i]
        g.concepts[i] = (i, kind, x["name"], x["description"] or old[3], old[4])
        if x["properties"]:
            t, keys = g.types["concept_type_decl"][kind], set(x["properties"])
            if t.get("properties") is not None and keys - set(t["properties"]):
                raise Stop("InvalidProperty")
            if set(t.get("required_properties", [])) - keys:
                raise Stop("MissingRequiredProperty")
            g.concepts[i] = (*g.concepts[i][:4], tuple(sorted(x["properties"].items())))

    for kind in KINDS:
        for x in sorted((x for x in items if x["kind"] == kind), key=lambda x: (x["file_no"], x["chunk"], x["item"])):
            action = decisions.get(x["client_ref"], default)
            if action == "skip":
                report.append((kind, x["client_ref"], "skipped", None, None))
                continue
            what, i = "created", None
            try:
                if kind == "concept_type":
                    g.add_type("concept_type_decl", {"name": x["name"], "properties": x["property_names"] or None, "parent": x["parent"]})
                    i = x["name"]
                elif kind == "relation_type":
                    if not g.add_type("relation_type_decl", {"name": x["name"], "domain": x["domain"], "range": x["range"], "symmetric": bool(x["symmetric"])}):
                        raise Stop("UnknownConceptType")
                    i = x["name"]
                elif kind == "concept":
                    there = g.names.get((x["type"], x["name"].lower()))
                    if action == "merge" and there is not None:
                        update(there, x)
                        what, i = "merged", there
                    else:
                        g.concept(x | {"id": 0, "properties": ({"lang": lang} if lang else {}) | (x["properties"] or {})})
                        i = g.names[x["type"], x["name"].lower()]
                    refs[x["client_ref"]] = refs[f"{x['type']}:{x['name']}"] = i
                elif kind == "relation":
                    a, b = resolve(x["source_ref"]), resolve(x["target_ref"])
                    if a is None or b is None:
                        raise Stop("DanglingRef")
                    before = set(g.relations)
                    g.relation(x["type"], a, b, 1.0 if x["weight"] is None else x["weight"], 0)
                    i = min(set(g.relations) - before)
                elif kind == "rule":
                    if x["type"] not in g.types["rule_type_decl"]:
                        raise Stop("UnknownRelationType")
                    scope = tuple(c for c in map(resolve, x["applies_to"] or []) if c is not None)
                    i = g.fresh()
                    g.rules[i] = (i, x["type"], x["name"], x["when"] or "", x["then"] or "", scope, bool(x["strict"]), x["description"] or "")
                else:
                    a = resolve(x["source_ref"])
                    if a is None:
                        raise Stop("DanglingRef")
                    if x["type"] not in g.types["action_type_decl"]:
                        raise Stop("UnknownRelationType")
                    i = g.fresh()
                    g.actions[i] = (i, x["type"], x["name"], a, resolve(x["target_ref"]), x["effect"] or "", x["description"] or "")
                report.append((kind, x["client_ref"], what, str(i), None))
            except Stop as e:
                report.append((kind, x["client_ref"], "failed", None, str(e)))
                if strict:
                    return report, g
    return report, g


def plain_graph():
    g = Plain()
    for x in ONTOLOGY.concept_types:
        g.add_type("concept_type_decl", {"name": x.name, "parent": x.parent, "properties": x.properties, "required_properties": x.required_properties, "disjoint_with": list(x.disjoint_with)})
    for x in ONTOLOGY.relation_types:
        g.add_type("relation_type_decl", {"name": x.name, "domain": x.domain, "range": x.range, "symmetric": x.symmetric, "cardinality": x.cardinality})
    g.types["rule_type_decl"]["duty"] = g.types["action_type_decl"]["call"] = {}
    for kind, name in (("Person", "Ann"), ("Person", "Bob"), ("Robot", "R1")):
        g.concept({"type": kind, "name": name, "id": 0, "description": "", "properties": {"k": "v"}})
    g.relation("pair", 1, 2, 1.0, 0)
    return g


def graph(spark):
    g = plain_graph()
    made = State.empty(spark, ONTOLOGY)
    concepts = spark.createDataFrame([(i, t, n, d, dict(p)) for i, t, n, d, p in g.concepts.values()], made.concepts.schema)
    return State(ONTOLOGY, concepts, spark.createDataFrame(list(g.relations.values()), made.relations.schema), made.rules, made.actions, g.next)


def check(spark, items, decisions, default="skip", strict=False, lang=None):
    want, g = reviewed(items, decisions, default, strict, lang, plain_graph())
    rows = spark.createDataFrame(list(decisions.items()), "client_ref string, action string")
    got = proposals.apply_proposal(frame(spark, items), rows, graph(spark), lang, default, strict)
    assert sorted((tuple(r) for r in got.report.collect()), key=repr) == sorted(want, key=repr)
    s, as_set = got.state, lambda df, f: sorted((f(r) for r in df.collect()), key=repr)
    assert as_set(s.concepts, lambda r: (r.id, r.concept_type, r.name, r.description, tuple(sorted(r.properties.items())))) == sorted(g.concepts.values(), key=repr)
    assert as_set(s.relations, tuple) == sorted(g.relations.values(), key=repr)
    assert as_set(s.rules, lambda r: (*r[:5], tuple(r.applies_to), *r[6:])) == sorted(g.rules.values(), key=repr)
    assert as_set(s.actions, tuple) == sorted(g.actions.values(), key=repr)
    assert {x.name for x in s.ontology.concept_types} == set(g.types["concept_type_decl"])
    assert {x.name for x in s.ontology.relation_types} == set(g.types["relation_type_decl"])
    if not strict:
        assert s.next_id == g.next
    return want


def random_items(seed):
    draw = random.Random(seed)
    items = [item("concept_type", "t0", name="Topic", parent="Paper"), item("concept_type", "t1", name="Paper", property_names=["year", "lang"] if seed % 2 else None), item("concept_type", "t2", name="Ghost")]
    items += [item("relation_type", "rt0", name="about", domain="Person", range="Topic"), item("relation_type", "rt1", name="lost", domain="Nothing", range="Topic"), item("relation_type", "rt2", name="haunts", domain="Ghost", range="Person", symmetric=True)]
    names = ["Ann", "ANN", "bob", "Cy", "cy", "Dan", "R1", "r2", "Eve"]
    for k in range(28):
        props = draw.choice([None, None, {"year": "1"}, {"other": "2"}, {}])
        items.append(item("concept", f"c{k}", type=draw.choice(["Person", "Person", "Robot", "Boss", "Paper", "Topic", "Nobody"]), name=draw.choice(names), description=draw.choice([None, "", f"d{k}"]), properties=props))
    refs = [f"c{k}" for k in range(30)] + ["Person:ann", "Person:Cy", "Person:nobody", "none", "Robot:r1", "Boss:Eve"]
    for k in range(40):
        items.append(item("relation", f"r{k}", type=draw.choice(["knows", "pair", "pair", "boss", "boss", "wrote", "about", "lost", "haunts"]), source_ref=draw.choice(refs), target_ref=draw.choice(refs), weight=draw.choice([None, 0.5])))
    for k in range(8):
        items.append(item("rule", f"ru{k}", type=draw.choice(["duty", "duty", "none"]), name=f"rule {k}", applies_to=draw.choice([None, draw.sample(refs, 3)]), strict=draw.choice([None, True])))
        items.append(item("action", f"a{k}", type=draw.choice(["call", "call", "none"]), name=f"act {k}", source_ref=draw.choice(refs), target_ref=draw.choice([None, *refs]), effect="e"))
    draw.shuffle(items)
    items = listed(items)
    decisions = {x["client_ref"]: draw.choice(["create_new", "create_new", "merge", "merge", "skip"]) for x in items if draw.random() < 0.9}
    return items, decisions


@pytest.mark.parametrize("seed", range(3))
def test_random_reviews(spark, seed):
    items, decisions = random_items(seed)
    report = check(spark, items, decisions, default=("skip", "merge", "create_new")[seed], lang=(None, "en", "fr")[seed])
    assert {r[2] for r in report} == {"created", "merged", "skipped", "failed"}


@pytest.mark.parametrize("seed", [7, 8])
def test_strict_ends_at_the_first_failure(spark, seed):
    items, decisions = random_items(seed)
    if seed == 8:  # no type fails, so a concept or relation is the first
        items = [x for x in items if x["name"] != "lost"]
    report = check(spark, items, decisions, strict=True, default="create_new")
    assert report[-1][2] == "failed" and sum(r[2] == "failed" for r in report) == 1


def test_frequent_refs_and_short_runs(spark, monkeypatch):
    """Refs that more than a few items use are looked up where these lie; ids go on from run to run."""
    monkeypatch.setattr(proposals, "HOT", 2)
    monkeypatch.setattr(proposals, "RUN", 2)
    items, decisions = random_items(4)
    check(spark, items, decisions, default="create_new")


def test_nothing_is_proposed(spark):
    assert check(spark, [], {"x": "merge"}) == []


def merged_plain(files):
    """The proposals of several files as one, item after item."""
    canonical, kept, firsts = {}, [], {}

    def lead(ref):
        for _ in range(4):
            if canonical.get(ref) in (None, ref):
                break
            ref = canonical[ref]
        return ref

    def graph_ref(ref):
        return ":" in ref and not re.match(r"^f\d+/", ref)

    for n, items in enumerate(files):
        local = {x["client_ref"]: f"f{n}/{x['client_ref']}" for x in items}

        def rewrite(ref, local=local):
            return ref if ref is None or graph_ref(ref) else lead(local.get(ref, ref))

        for kind in KINDS:
            for x in (x for x in items if x["kind"] == kind):
                x = x | {"client_ref": local[x["client_ref"]], "file_no": n}
                if kind in ("relation", "action"):
                    x |= {"source_ref": rewrite(x["source_ref"]), "target_ref": rewrite(x["target_ref"])}
                if kind == "rule" and x["applies_to"] is not None:
                    x["applies_to"] = [rewrite(r) for r in x["applies_to"]]
                key = {"concept_type": ("name",), "relation_type": ("name",), "relation": ("type", "source_ref", "target_ref")}.get(kind, ("type", "name"))
                key = (kind, *(x[f] for f in key))
                if kind == "concept":
                    key = (kind, x["type"], x["name"].strip().lower())
                if key in firsts:
                    canonical[x["client_ref"]] = firsts[key]
                else:
                    firsts[key] = x["client_ref"]
                    kept.append(x)
    for x in kept:
        for f in ("source_ref", "target_ref"):
            if x[f] is not None and not graph_ref(x[f]):
                x[f] = lead(x[f])
        if x["applies_to"]:
            x["applies_to"] = [r if graph_ref(r) else lead(r) for r in x["applies_to"]]
    return kept


def test_files_merge_as_one_after_another(spark):
    draw = random.Random(2)
    files = []
    for n in range(5):
        items = [item("concept_type", "t0", name=draw.choice(["A", "B"])), item("relation_type", "t1", name=draw.choice(["p", "q"]), domain="A", range="B")]
        items += [item("concept", f"c{k}", type="A", name=draw.choice([" x", "X ", "y", "z", f"w{n}"])) for k in range(5)]
        refs = [f"c{k}" for k in range(6)] + ["A:x", "f0/c1", "http://a"]
        items += [item("relation", f"r{k}", type="p", source_ref=draw.choice(refs), target_ref=draw.choice(refs)) for k in range(8)]
        items += [item("rule", "u0", type="ru", name=draw.choice("mn"), applies_to=draw.choice([None, [], refs[:4]])), item("action", "a0", type="ac", name=draw.choice("mn"), source_ref=draw.choice(refs), target_ref=draw.choice([None, *refs]))]
        files.append(listed(items))
    rows = [x | {"file_no": n} for n, f in enumerate(files) for x in f]
    got = [r.asDict(recursive=True) for r in proposals.merge_files(frame(spark, rows)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, merged_plain(files)))


def test_refs_lead_through_four_links(spark):
    """Client refs that a file gives twice make chains: a ref leads on at most four times."""
    links = [(f"n{k}", f"n{k + 1}") for k in range(7)] + [("self", "self"), ("x", "y"), ("y", "x")]
    got = dict(tuple(r) for r in proposals.lead_on(spark.createDataFrame(links, "ref string, to string")).collect())
    follow = dict(links)

    def lead(ref):
        for _ in range(4):
            if follow.get(ref) in (None, ref):
                break
            ref = follow[ref]
        return ref

    assert got == {k: lead(k) for k, _ in links if k != "self"}
    assert got["n0"] == "n4" and got["n5"] == "n7"


def test_replies_of_six_kinds(spark):
    reply = {
        "concept_types": [{"name": "A", "properties": ["p"], "confidence": 0.5}], "relation_types": [{"name": "r", "domain": "A", "range": "A", "symmetric": True}],
        "concepts": [{"concept_type": "A", "name": "x", "properties": [["k", "1"], ["l", "2"], ["k", "3"]]}], "relations": [{"relation_type": "r", "source_ref": "c7-c-0", "target_ref": "A:y", "weight": 0.25}],
        "rules": [{"rule_type": "R", "name": "u", "when": "w", "then": "t", "applies_to": ["A:x"], "strict": True}], "actions": [{"action_type": "T", "name": "v", "subject_ref": "A:x", "object_ref": None, "parameters": [["d", "1"]], "effect": "e"}],
    }
    rows = [(0, 7, "```json\n" + json.dumps(reply) + "\n```"), (0, 8, "no json"), (1, 0, json.dumps({"concepts": [{"concept_type": "A", "name": "X ", "confidence": 0.9}]})), (1, 1, json.dumps({"concepts": [{"concept_type": "A", "name": "x", "confidence": 0.9}, {"concept_type": "A", "name": "x", "confidence": 0.95}]}))]
    items = proposals.parse_replies(spark.createDataFrame(rows, "file_no long, chunk long, reply string"))
    got = {r.client_ref: r for r in items.filter("file_no = 0").collect()}
    assert sorted(got) == ["c7-a-0", "c7-c-0", "c7-ct-0", "c7-r-0", "c7-rt-0", "c7-ru-0"]
    assert got["c7-c-0"].properties == {"k": "3", "l": "2"} and got["c7-r-0"].weight == 0.25 and got["c7-ru-0"].applies_to == ["A:x"] and got["c7-a-0"].target_ref is None
    assert [(r.file_no, r.client_ref) for r in proposals.merge_chunks(items).filter("kind = 'concept'").orderBy("file_no").collect()] == [(0, "c7-c-0"), (1, "c1-c-1")]


def test_conflicts_of_six_kinds(spark):
    items = listed([
        item("concept_type", "t0", name="Person"), item("concept_type", "t1", name="New"), item("relation_type", "t2", name="knows", domain="a", range="b"),
        item("concept", "c0", type="Person", name="ANN"), item("concept", "c1", type="Person", name="New One"),
        item("relation", "r0", source_ref="c1", target_ref="Person:bob"), item("relation", "r1", source_ref="none", target_ref="gone"), item("relation", "r2", source_ref="Person:new one", target_ref="c0"), item("relation", "r3", source_ref="Person:New One", target_ref="Person:x"),
        item("action", "a0", source_ref="c0", target_ref=None), item("action", "a1", source_ref="c0", target_ref="Robot:no"), item("rule", "u0", applies_to=["none"]),
    ])
    people = spark.createDataFrame([(4, "Person", "Ann"), (5, "Person", "Bob")], "id long, concept_type string, name string")
    got = sorted(tuple(r) for r in proposals.conflicts(frame(spark, items), ONTOLOGY, people).collect())
    assert got == [
        ("action", "a1", "dangling_ref", "Robot:no"), ("concept", "c0", "exists", "4"), ("concept_type", "t0", "exists", "Person"),
        ("relation", "r1", "dangling_ref", "none"), ("relation", "r2", "dangling_ref", "Person:new one"), ("relation", "r3", "dangling_ref", "Person:x"), ("relation_type", "t2", "exists", "knows"),
    ]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_reply_is_parsed_once(spark):
    replies = spark.range(3).selectExpr("id AS file_no", "id AS chunk", "concat('{\"concept_types\": [{\"name\": \"A\"}], \"actions\": [{\"name\": \"b\"}, null]}', left('', id)) AS reply")
    items = proposals.parse_replies(replies)
    assert plan_of(items).count("from_json(") == 1
    got = {tuple(r) for r in items.filter("chunk = 1").select("kind", "item", "client_ref", "name", "confidence").collect()}
    assert got == {("concept_type", 0, "c1-ct-0", "A", 0.0), ("action", 0, "c1-a-0", "b", 0.0), ("action", 1, "c1-a-1", None, 0.0)}


def test_chunks_merge_in_one_grouping(spark):
    replies = spark.createDataFrame([(1, 0, '{"concepts": [{"concept_type": "T", "name": " a", "confidence": 0.5}], "relation_types": [{"name": "r", "confidence": 0.1}]}'), (1, 1, '{"concepts": [{"concept_type": "T", "name": "A ", "confidence": 0.9}], "relation_types": [{"name": "r", "confidence": 0.9}]}')], "file_no long, chunk long, reply string")
    merged = proposals.merge_chunks(proposals.parse_replies(replies))
    assert plan_of(merged).count("from_json(") == 2
    assert {(r.kind, r.client_ref) for r in merged.collect()} == {("concept", "c1-c-0"), ("relation_type", "c0-rt-0")}
