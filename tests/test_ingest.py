"""Streams of records of all kinds, against a plain loop that applies them one after another."""

from __future__ import annotations

import json
import random

import pytest

from kgspark.operators import ingest
from kgspark.operators.ingest import ACTION, CONCEPT, RECORD, RELATION, RULE, RETRY, State, ingest_records
from kgspark.operators.ontology import ConceptType, Ontology, RelationType

FIELDS = [f.split()[0] for f in RECORD.split(", ")]


class Stop(Exception):
    pass


class Plain:
    """The graph as dictionaries."""

    def __init__(self, ontology=None):
        self.types = {k: {} for k in ("concept_type_decl", "relation_type_decl", "rule_type_decl", "action_type_decl")}
        self.concepts, self.relations, self.rules, self.actions, self.names = {}, {}, {}, {}, {}
        self.next = 1
        self.counts = dict.fromkeys(("concepts", "relations", "ontology_updates", "rules", "actions"), 0)

    def fresh(self):
        self.next += 1
        return self.next - 1

    def observe(self, i):
        self.next = max(self.next, i + 1)

    def is_a(self, kind, above):
        seen = set()
        while kind is not None and kind not in seen:
            if kind == above:
                return True
            seen.add(kind)
            kind = self.types["concept_type_decl"].get(kind, {}).get("parent")
        return False

    def add_type(self, kind, d):
        types = self.types["concept_type_decl"]
        if kind == "concept_type_decl":
            d = {**d, "disjoint_with": list(d.get("disjoint_with", []))}
            d["disjoint_with"] += [n for n, o in types.items() if d["name"] in o["disjoint_with"] and n not in d["disjoint_with"] and n != d["name"]]
            types[d["name"]] = d
            for o in d["disjoint_with"]:
                if o in types and d["name"] not in types[o]["disjoint_with"]:
                    types[o]["disjoint_with"].append(d["name"])
        else:
            needs = {"relation_type_decl": [d.get("domain"), d.get("range")], "rule_type_decl": d.get("applies_to", []), "action_type_decl": [d.get("subject")] + ([d["object"]] if d.get("object") else [])}[kind]
            if not all(n in types for n in needs):
                return False
            if kind == "relation_type_decl" and d.get("inverse_of") is not None and (d["inverse_of"] == "" or (d["inverse_of"] == d["name"] and not d.get("symmetric"))):
                raise Stop("UnknownRelationType")
            self.types[kind][d["name"]] = d
        self.counts["ontology_updates"] += 1
        return True

    def concept(self, r):
        t = self.types["concept_type_decl"].get(r["type"])
        if t is None:
            raise Stop("UnknownConceptType")
        keys = set(r["properties"] or {})
        if t.get("properties") is not None and keys - set(t["properties"]):
            raise Stop("InvalidProperty")
        if set(t.get("required_properties", [])) - keys:
            raise Stop("MissingRequiredProperty")
        name = r["name"].lower()
        if any((o, name) in self.names for o in t["disjoint_with"]):
            raise Stop("DisjointTypeViolation")
        i = r["id"] or self.fresh()
        self.observe(i)
        if self.names.get((r["type"], name), i) != i:
            raise Stop("DuplicateConcept")
        self.names[r["type"], name] = i
        self.concepts[i] = (i, r["type"], r["name"], r["description"] or "", tuple(sorted((r["properties"] or {}).items())))
        self.counts["concepts"] += 1

    def relation(self, kind, source, target, weight, i):
        if source not in self.concepts or target not in self.concepts:
            raise Stop("UnknownConcept")
        t = self.types["relation_type_decl"].get(kind)
        if t is None:
            raise Stop("UnknownRelationType")
        if not self.is_a(self.concepts[source][1], t["domain"]) or not self.is_a(self.concepts[target][1], t["range"]):
            raise Stop("SchemaViolation")
        c = t.get("cardinality", "ManyToMany")
        if (c in ("OneToOne", "ManyToOne") or t.get("functional")) and any(x[1:3] == (kind, source) for x in self.relations.values()):
            raise Stop("CardinalityViolation")
        if c in ("OneToOne", "OneToMany") and any((x[1], x[3]) == (kind, target) for x in self.relations.values()):
            raise Stop("CardinalityViolation")
        if not i or i in self.relations:
            i = self.fresh()
        self.observe(i)
        self.relations[i] = (i, kind, source, target, weight)
        if t.get("symmetric") and source != target:
            j = self.fresh()
            self.relations[j] = (j, kind, target, source, weight)
        self.counts["relations"] += 1

    def apply(self, r):
        kind = r["kind"]
        if kind == "ontology":
            d = json.loads(r["declared"])
            self.types = {ingest._LISTS[k]: {x["name"]: {"disjoint_with": [], **x} for x in d.get(k, [])} for k in ingest._LISTS}
            self.counts["ontology_updates"] += 1
        elif kind in self.types:
            return self.add_type(kind, json.loads(r["declared"]))
        elif kind == "concept":
            self.concept(r)
        elif kind == "relation":
            self.relation(r["type"], r["source"], r["target"], r["weight"] if r["weight"] is not None else 0.0, r["id"])
        elif kind == "named_relation":
            ends = [self.names.get((r[f"{e}_type"], (r[f"{e}_name"] or "").lower())) for e in ("source", "target")]
            if None in ends:
                return False
            self.relation(r["type"], *ends, r["weight"] if r["weight"] is not None else 1.0, 0)
        elif kind == "rule":
            if r["type"] not in self.types["rule_type_decl"] or any(c not in self.concepts for c in r["applies_to"] or []):
                return False
            i = r["id"] or self.fresh()
            self.observe(i)
            self.rules[i] = (i, r["type"], r["name"], r["when"] or "", r["then"] or "", tuple(r["applies_to"] or []), bool(r["strict"]), r["description"] or "")
            self.counts["rules"] += 1
        else:
            if r["type"] not in self.types["action_type_decl"] or r["subject"] not in self.concepts or (r["object"] is not None and r["object"] not in self.concepts):
                return False
            i = r["id"] or self.fresh()
            self.observe(i)
            self.actions[i] = (i, r["type"], r["name"], r["subject"], r["object"], r["effect"] or "", r["description"] or "")
            self.counts["actions"] += 1
        return True

    def run(self, stream):
        """The code and record at which the stream ends, if it does."""
        late = []
        try:
            for r in stream:
                if not self.apply(r):
                    late.append(r)
            for r in late:
                if not self.apply(r) and r["kind"] == "named_relation":
                    raise Stop("UnknownNamed")
        except Stop as e:
            return str(e), r["seq"]
        return None, None


def record(kind, **fields):
    return dict.fromkeys(FIELDS) | {"kind": kind} | fields


def numbered(records, step=1):
    return [r | {"seq": k * step} for k, r in enumerate(records)]


def decl(kind, **fields):
    return record(f"{kind}_type_decl", declared=json.dumps(fields))


def frame(spark, stream):
    return spark.createDataFrame([tuple(r[f] for f in FIELDS) for r in stream], RECORD).repartition(5)


def same(got, plain, want_end):
    as_set = lambda df, f: sorted((f(r) for r in df.collect()), key=repr)
    assert (got.error, got.failed_at) == want_end
    assert got.counts == plain.counts
    s = got.state
    assert as_set(s.concepts, lambda r: (r.id, r.concept_type, r.name, r.description, tuple(sorted(r.properties.items())))) == sorted(plain.concepts.values(), key=repr)
    assert as_set(s.relations, tuple) == sorted(plain.relations.values(), key=repr)
    assert as_set(s.rules, lambda r: (*r[:5], tuple(r.applies_to), *r[6:])) == sorted(plain.rules.values(), key=repr)
    assert as_set(s.actions, tuple) == sorted(plain.actions.values(), key=repr)
    if got.error is None:
        assert s.next_id == plain.next
        assert {x.name for x in s.ontology.concept_types} == set(plain.types["concept_type_decl"])
        assert {x.name for x in s.ontology.relation_types} == set(plain.types["relation_type_decl"])


def check(spark, stream):
    plain = Plain()
    end = plain.run(stream)
    same(ingest_records(frame(spark, stream), State.empty(spark)), plain, end)
    return end


def random_stream(seed, n, faults):
    draw = random.Random(seed)
    kinds = ["Person", "Author", "Paper", "Topic"]
    schema = [
        decl("relation", name="knows", domain="Person", range="Person", symmetric=True),
        decl("concept", name="Person", disjoint_with=["Topic"] if seed % 2 else []),
        decl("relation", name="wrote", domain="Person", range="Paper"),
        decl("rule", name="cite", when="a", then="b", applies_to=["Paper"]),
        decl("concept", name="Author", parent="Person"),
        decl("concept", name="Paper"),
        decl("action", name="read", subject="Person", object="Paper"),
        decl("concept", name="Topic"),
        decl("relation", name="first", domain="Paper", range="Person", cardinality="ManyToOne"),
        decl("relation", name="lost", domain="Nothing", range="Paper"),
        decl("concept", name="Paper", description="again") if seed % 3 == 0 else decl("concept", name="Paper"),
    ]
    names, body, used = set(), [], set()
    for k in range(n):
        kind = draw.choice(kinds)
        name = f"{kind[:2]}{draw.randrange(10**6) if not faults else draw.randrange(120)}"
        i = draw.choice([0, 0, 0, 200 + k, None])
        other = f"{draw.choice(kinds)}"
        match draw.randrange(8):
            case 0 | 1 | 2:
                if faults or (kind, name) not in names:
                    body.append(record("concept", id=i, type=kind, name=name, properties=draw.choice([None, {"a": "1"}])))
                    names.add((kind, name))
                    if i:
                        used.add((i, kind))
            case 3:
                if i and used:
                    j, same_kind = draw.choice(sorted(used))
                    body.append(record("concept", id=j, type=same_kind, name=f"renamed {k}", description="new"))
            case 4 | 5:
                people = sorted(x for x in names if x[0] in ("Person", "Author"))
                if len(people) > 1:
                    (a, b), (c, d) = draw.sample(people, 2)
                    body.append(record("named_relation", type="knows", source_type=a, source_name=b.upper(), target_type=c, target_name=d, weight=draw.choice([None, 0.5])))
            case 6:
                ids = sorted(x for x, t in used if t in ("Person", "Author"))
                if ids:
                    a, b = draw.choice(ids), draw.choice(ids)
                    body.append(record("relation", id=draw.choice([0, 300, 301, 210, 5, 9]), type="knows", source=a, target=b, weight=2.0))
                if faults and draw.random() < 0.1:
                    body.append(record("relation", id=0, type=draw.choice(["knows", "wrote", "no such"]), source=draw.randrange(30), target=draw.randrange(30)))
            case 7:
                ids = sorted(x for x, _ in used) or [1]
                refs = [draw.choice([draw.choice(ids), draw.randrange(1, 40)]) for _ in range(draw.randrange(3))]
                body.append(record("rule", id=draw.choice([0, 0, 205]), type=draw.choice(["cite", "cite", "never"]), name=f"r{k}", applies_to=refs, strict=draw.choice([None, True])))
                body.append(record("action", id=0, type="read", name=f"a{k}", subject=draw.choice([*ids, 3]), object=draw.choice([None, draw.choice(ids), 99999])))
    for d in reversed(schema):
        at = draw.randrange(1 + len(body) // 4) if d["kind"] != "concept_type_decl" else 0
        body.insert(at, d)
    if not faults:
        # relations by names may come before what they name; concepts are after their types
        late = [r for r in body if r["kind"] == "named_relation" and draw.random() < 0.4]
        body = [r for r in body if r not in late]
        body[len(schema) : len(schema)] = late
    return numbered(body, 3)


@pytest.mark.parametrize("seed", [0, 3])
def test_random_streams(spark, seed):
    check(spark, random_stream(seed, 90, faults=False))


@pytest.mark.parametrize("seed", [10, 13])
def test_random_streams_that_fail(spark, seed):
    assert check(spark, random_stream(seed, 90, faults=True)) != (None, None)


PEOPLE = [decl("concept", name="Person"), decl("concept", name="Paper", properties=["year"], required_properties=["year"])]


@pytest.mark.parametrize(
    "tail, code",
    [
        ([record("concept", type="Nobody", name="x")], "UnknownConceptType"),
        ([record("concept", type="Paper", name="x", properties={"year": "1", "b": "2"})], "InvalidProperty"),
        ([record("concept", type="Paper", name="x")], "MissingRequiredProperty"),
        ([record("concept", type="Person", name="Ann"), record("concept", type="Person", name="ANN")], "DuplicateConcept"),
        ([record("concept", type="Person", name="Ann", id=7), record("concept", type="Person", name="ann", id=7)], None),
        ([record("concept", type="Person", name="Ann", id=7), record("concept", type="Person", name="Bob", id=7), record("concept", type="Person", name="Ann")], "DuplicateConcept"),
        ([decl("concept", name="Robot", disjoint_with=["Person"]), record("concept", type="Robot", name="Ann"), record("concept", type="Person", name="ann")], "DisjointTypeViolation"),
        ([record("named_relation", type="knows", source_type="Person", source_name="a", target_type="Person", target_name="b")], "UnknownNamed"),
        ([decl("relation", name="is", domain="Person", range="Person", inverse_of="is")], "UnknownRelationType"),
        ([decl("relation", name="is", domain="Person", range="Person", inverse_of="")], "UnknownRelationType"),
        ([record("relation", type="knows", source=1, target=2)], "UnknownConcept"),
        ([decl("relation", name="gone", domain="Ghost", range="Person"), record("rule", type="none", name="r"), record("action", type="none", name="a", subject=1)], None),
        # an ontology takes the place of all types; the counter goes on
        ([record("concept", type="Person", name="Ann"), record("ontology", declared=json.dumps({"concept_types": [{"name": "Place"}], "relation_types": []})), record("concept", type="Place", name="x")], None),
        ([record("ontology", declared=json.dumps({"concept_types": [{"name": "Place"}]})), record("concept", type="Person", name="x")], "UnknownConceptType"),
        # a concept named by the id that the counter will give it: the rule waits for it
        ([decl("rule", name="duty", when="", then=""), record("rule", type="duty", name="early", applies_to=[2]), record("concept", type="Person", name="Ann"), record("concept", type="Person", name="Bob"), record("rule", type="duty", name="late", applies_to=[1, 2])], None),
        # a relation's own id that the counter has given away
        ([decl("relation", name="knows", domain="Person", range="Person", symmetric=True), record("concept", type="Person", name="A", id=1), record("concept", type="Person", name="B", id=2), record("relation", type="knows", source=1, target=2), record("relation", type="knows", source=2, target=2, id=4), record("relation", type="knows", source=1, target=1, id=9)], None),
        ([decl("relation", name="one", domain="Person", range="Person", cardinality="OneToOne"), *[record("concept", type="Person", name=n, id=i) for n, i in (("A", 1), ("B", 2), ("C", 3))], record("relation", type="one", source=1, target=2), record("relation", type="one", source=3, target=2)], "CardinalityViolation"),
        ([], None),
    ],
)
def test_single_cases(spark, tail, code):
    assert check(spark, numbered([*PEOPLE, *tail]))[0] == code


def test_triples_get_the_ids_of_one_counter(spark):
    """Two symmetric relations have their inverses right after them."""
    types = [decl("concept", name=n) for n in ("Person", "Paper", "Topic")]
    types += [decl("relation", name="authored", domain="Person", range="Paper"), decl("relation", name="covers", domain="Paper", range="Topic"), decl("relation", name="related_to", domain="Topic", range="Topic", symmetric=True)]
    lines = [("Person:Ann", "authored", "Paper:Survey"), ("Paper:Survey", "covers", "Topic:A"), ("Topic:A", "related_to", "Topic:B"), ("Topic:B", "related_to", "Topic:C")]
    body, seen = [], set()
    for s, p, o in lines:
        for end in (s, o):
            if end not in seen:
                body.append(record("concept", type=end.split(":")[0], name=end.split(":")[1]))
                seen.add(end)
        body.append(record("named_relation", type=p, source_type=s.split(":")[0], source_name=s.split(":")[1], target_type=o.split(":")[0], target_name=o.split(":")[1]))
    got = ingest_records(frame(spark, numbered([*types, *body])), State.empty(spark))
    assert got.counts == {"concepts": 5, "relations": 4, "ontology_updates": 6, "rules": 0, "actions": 0}
    assert sorted((r.id, r.source, r.target) for r in got.state.relations.collect()) == [(3, 1, 2), (5, 2, 4), (7, 4, 6), (8, 6, 4), (10, 6, 9), (11, 9, 6)]
    assert got.state.next_id == 12


def test_onto_a_graph(spark):
    """Names, ids and single relations that are there before count."""
    onto = Ontology([ConceptType("Person")], [RelationType("boss", "Person", "Person", "ManyToOne")])
    there = State(onto, spark.createDataFrame([(5, "Person", "Ann", "", {}), (6, "Person", "Bob", "", {})], CONCEPT), spark.createDataFrame([(7, "boss", 5, 6, 1.0)], RELATION), spark.createDataFrame([], RULE), spark.createDataFrame([], ACTION), 8)
    stream = numbered([record("concept", type="Person", name="Cy"), record("named_relation", type="boss", source_type="Person", source_name="cy", target_type="Person", target_name="ANN"), record("concept", id=5, type="Person", name="Anna")])
    got = ingest_records(frame(spark, stream), there)
    assert got.error is None and got.state.next_id == 10
    assert sorted((r.id, r.name) for r in got.state.concepts.collect()) == [(5, "Anna"), (6, "Bob"), (8, "Cy")]
    assert sorted(tuple(r)[:4] for r in got.state.relations.collect()) == [(7, "boss", 5, 6), (9, "boss", 8, 5)]
    again = numbered([record("named_relation", type="boss", source_type="Person", source_name="Anna", target_type="Person", target_name="bob")])
    assert ingest_records(frame(spark, again), got.state).error == "CardinalityViolation"
    assert RETRY > 1 << 50


def test_ids_are_counted_in_one_pass_over_each_range(spark):
    """As a plain loop counts them, over ranges that hold new rows, own ids or both, without a window over the rows."""
    from kgspark.operators.ingest import allocate

    rng = random.Random(11)
    rows = [(at, sub, rng.choice([0, 0, 0, at * 3, 5])) for at in range(400) for sub in range(rng.choice([1, 1, 2]))]
    want, counter = {}, 7
    for at, sub, own in rows:
        want[at, sub] = own or counter
        counter = max(counter, (own or counter) + 1)
    got = allocate(spark.createDataFrame(rows, "at long, sub int, id long").repartition(5), 7)
    assert {(r.at, r.sub): r.new_id for r in got.collect()} == want
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert allocate(spark.createDataFrame([], "at long, sub int, id long"), 7).count() == 0
