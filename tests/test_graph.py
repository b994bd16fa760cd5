"""Graph operators on small graphs, against a plain queue where order matters."""

import random

import pytest

from kgspark.operators import graph as g
from kgspark.operators import mutate, traverse, validate
from kgspark.operators.ontology import ConceptType, Ontology, OntologyError, RelationType
from kgspark.operators.traverse import Expansion

ONTO = Ontology(
    [ConceptType("Thing"), ConceptType("Person", parent="Thing"), ConceptType("Researcher", parent="Person"), ConceptType("Paper"), ConceptType("Topic", disjoint_with=("Person",)), ConceptType("Part", required_properties=("size",), properties=("size", "colour"))],
    [
        RelationType("authored", "Person", "Paper", "OneToMany", inverse_of="authoredBy"),
        RelationType("authoredBy", "Paper", "Person", inverse_of="authored"),
        RelationType("related_to", "Topic", "Topic", symmetric=True),
        RelationType("partOf", "Part", "Part", transitive=True),
        RelationType("paired", "Person", "Person", "OneToOne"),
    ],
)


def concepts(spark, rows):
    return spark.createDataFrame([(i, t, n, "") for i, t, n in rows], "id long, concept_type string, name string, description string")


def relations(spark, rows):
    return spark.createDataFrame([(100 + k, t, s, d, 1.0, 100 + k) for k, (t, s, d) in enumerate(rows)], "id long, relation_type string, source long, target long, weight double, seq long")


def seeds(spark, *ids):
    return spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "id long, ord int")


def test_descendants_and_cycles():
    assert ONTO.descendants("Person") == ["Person", "Researcher"]
    assert ONTO.descendants("Nobody") == []
    assert ONTO.is_subtype("Researcher", "Thing")
    with pytest.raises(OntologyError):
        Ontology([ConceptType("A", parent="B"), ConceptType("B", parent="A")])
    with pytest.raises(OntologyError):
        Ontology([ConceptType("A")], [RelationType("r", "A", "A", inverse_of="r")])


def test_inverses():
    assert ONTO.invalid_inverses() == []
    bad = Ontology(ONTO.concept_types, [RelationType("a", "Person", "Paper", inverse_of="b"), RelationType("b", "Person", "Paper"), RelationType("c", "Person", "Paper", inverse_of="zzz")])
    assert bad.invalid_inverses() == [("a", "not mirrored"), ("c", "unknown inverse")]


def test_subsumption_and_names(spark):
    c = concepts(spark, [(1, "Person", "Ann"), (2, "Researcher", "Bob"), (3, "Paper", "Ann")])
    assert g.of_type(c, ONTO, "Person", subtypes=False).count() == 1
    assert g.of_type(c, ONTO, "Person").count() == 2
    assert g.of_type(c, ONTO, "Nobody").count() == 0
    assert [r.id for r in g.find_by_name(c, "Paper", "ANN").collect()] == [3]
    assert [r.id for r in g.search_by_trigrams(c, g.name_trigrams(c), "bob").collect()] == [2]
    assert g.search_by_trigrams(c, g.name_trigrams(c), "").count() == 3


def test_virtual_inverse(spark):
    r = relations(spark, [("authored", 1, 2)])
    got = g.typed_edges(r, ONTO, ["authoredBy"]).collect()
    assert [(x.id, x.relation_type, x.source, x.target, x.virt) for x in got] == [(100, "authoredBy", 2, 1, 1)]


def test_two_hop_path(spark):
    c = concepts(spark, [(1, "Person", "Alice"), (2, "Person", "Bob"), (3, "Paper", "P"), (4, "Person", "Eve")])
    r = relations(spark, [("authored", 1, 3), ("authored", 2, 3)])
    path = traverse.shortest_path(c, r, ONTO, 1, 2).orderBy("step").collect()
    assert [(x.relation_id, x.concept_id) for x in path] == [(100, 3), (101, 2)]
    assert traverse.shortest_path(c, r, ONTO, 1, 1).count() == 0
    assert traverse.shortest_path(c, r, ONTO, 1, 4).count() == 0
    assert traverse.shortest_path(c, r, ONTO, 1, 2, max_depth=1).count() == 0
    with pytest.raises(KeyError):
        traverse.shortest_path(c, r, ONTO, 1, 99)


def test_closure_chain(spark):
    r = relations(spark, [("partOf", 1, 2), ("partOf", 2, 3)])
    got = traverse.closure(r, ONTO, spark.createDataFrame([(1,)], "id long"), "partOf", 3)
    assert sorted((x.id, x.depth) for x in got.collect()) == [(2, 1), (3, 2)]


def test_capped_star_leaves_out_the_last_edge(spark):
    c = concepts(spark, [(0, "Topic", "hub"), *[(k, "Topic", f"leaf {k}") for k in range(1, 101)]])
    r = relations(spark, [("related_to", 0, k) for k in range(1, 101)])
    sub = traverse.expand(c, r, ONTO, seeds(spark, 0), Expansion(max_depth=2, max_nodes=10))
    assert sub.nodes.count() == 10
    assert sub.edges.count() == 8


def queue_expand(nodes, edges, start, spec):
    """The sequential rule: out edges then in edges in order of insertion; stop when the cap is met."""
    visited, depth, out, queue = list(dict.fromkeys(s for s in start if s in nodes)), {}, {}, []
    depth = {s: 0 for s in visited}
    queue = list(visited)
    while queue:
        n = queue.pop(0)
        if depth[n] >= spec.max_depth:
            continue
        if len(visited) >= spec.max_nodes:
            break
        steps = [(i, d) for i, s, d in edges if s == n] if spec.direction != "Incoming" else []
        steps += [(i, s) for i, s, d in edges if d == n] if spec.direction != "Outgoing" else []
        full = False
        for i, other in steps:
            if other not in nodes:
                continue
            if other not in depth:
                depth[other] = depth[n] + 1
                visited.append(other)
                queue.append(other)
                if len(visited) >= spec.max_nodes:
                    full = True
                    break
            out.setdefault(i, None)
        if full:
            break
    return {n: depth[n] for n in visited}, set(out)


@pytest.mark.parametrize("seed", range(5))
def test_expand_agrees_with_a_queue(spark, seed):
    rng = random.Random(seed)
    n = rng.randint(4, 9)
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(4, 16))]
    spec = Expansion(max_depth=rng.randint(1, 3), direction=rng.choice(["Both", "Outgoing", "Incoming"]), max_nodes=rng.randint(2, n + 2))
    c = concepts(spark, [(k, "Topic", str(k)) for k in range(n)])
    r = relations(spark, [("related_to", s, d) for s, d in pairs])
    start = [rng.randrange(n), rng.randrange(n)]
    sub = traverse.expand(c, r, ONTO, seeds(spark, *start), spec)
    want_nodes, want_edges = queue_expand(set(range(n)), [(100 + k, s, d) for k, (s, d) in enumerate(pairs)], start, spec)
    assert {x.id: x.depth for x in sub.nodes.collect()} == want_nodes
    assert {x.relation_id for x in sub.edges.collect()} == want_edges


def test_enrichment(spark):
    c = concepts(spark, [(k, "Part", str(k)) for k in range(1, 5)])
    r = relations(spark, [("partOf", 1, 2), ("partOf", 2, 3), ("partOf", 3, 4)])
    s = seeds(spark, 1)
    sub = traverse.expand(c, r, ONTO, s, Expansion(max_depth=1))
    assert {(x.id, x.depth) for x in traverse.enrich_transitive(sub, s, r, ONTO).collect()} == {(1, 0), (2, 1), (3, 1), (4, 1)}
    assert traverse.enrich_transitive(sub, s, r, ONTO, enabled=False).count() == 2


def test_violations(spark):
    batch = spark.createDataFrame(
        [(1, "Part", "x", ["colour"]), (2, "Part", "y", ["weight", "size"]), (3, "Alien", "z", []), (4, "Person", "Ann", []), (5, "Topic", "ANN", []), (6, "Person", "ann", []), (7, "Part", "ok", ["size"])],
        "seq long, concept_type string, name string, keys array<string>",
    )
    got = {x.seq: x.code for x in validate.concept_violations(batch, ONTO).collect()}
    assert got == {1: "MissingRequiredProperty", 2: "UnknownProperty", 3: "UnknownConceptType", 5: "DisjointTypeViolation", 6: "DuplicateConcept"} | ({6: "DisjointTypeViolation"} if got[6] == "DisjointTypeViolation" else {})
    assert validate.accepted_before_first(batch, validate.concept_violations(batch, ONTO)).count() == 0


def test_edge_checks(spark):
    c = concepts(spark, [(1, "Researcher", "a"), (2, "Paper", "p"), (3, "Paper", "q"), (4, "Person", "b")])
    r = relations(spark, [("authored", 1, 2), ("authored", 2, 1), ("authored", 1, 99), ("zzz", 1, 2), ("authored", 4, 2)])
    assert {x.id: x.code for x in validate.edge_violations(r, c, ONTO).collect()} == {101: "SchemaViolation", 102: "UnknownConcept", 103: "UnknownRelationType"}
    assert {(x.id, x.side) for x in validate.cardinality_violations(r, ONTO).collect()} == {(104, "target")}


@pytest.mark.parametrize("seed", range(3))
def test_quarantine_agrees_with_a_scan(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["paired", "authored", "related_to"]), rng.randrange(5), rng.randrange(5)) for _ in range(25)]
    got = {x.id for x in validate.quarantine(relations(spark, rows), ONTO).collect()}
    taken, want = set(), set()
    for k, (t, s, d) in enumerate(rows):
        ends = {("paired", "s", s), ("paired", "d", d)} if t == "paired" else {("authored", "d", d)} if t == "authored" else set()
        if not ends & taken:
            taken |= ends
            want.add(100 + k)
    assert got == want


def test_cascade_and_symmetric(spark):
    c = concepts(spark, [(1, "Person", "a"), (2, "Paper", "p"), (3, "Paper", "q")])
    r = relations(spark, [("authored", 1, 2), ("authored", 1, 3)])
    kept, edges = mutate.cascade_delete(c, r, spark.createDataFrame([(1,)], "id long"))
    assert (kept.count(), edges.count()) == (2, 0)
    s = relations(spark, [("related_to", 1, 2), ("related_to", 1, 3), ("related_to", 4, 4)])
    twins = mutate.symmetric_twins(s, ONTO)
    assert {(x.source, x.target) for x in twins.collect()} == {(2, 1), (3, 1)}
    from pyspark.sql import functions as F

    stored = s.unionByName(twins.withColumns({"id": F.col("id") + 50, "seq": F.col("id") + 50}))
    exported = mutate.export_relations(stored, ONTO)
    assert exported.count() == 3
    assert stored.count() == 5


def test_ids_and_log(spark):
    batch = spark.createDataFrame([(5, 0), (3, 0), (4, 77), (9, 0)], "seq long, id long")
    assert {x.seq: x.id for x in mutate.allocate_ids(batch, 100).collect()} == {3: 101, 5: 102, 9: 103, 4: 77}
    log = spark.createDataFrame([(1, "upsert", 1, "a"), (2, "upsert", 2, "b"), (3, "clear", None, None), (4, "upsert", 2, "c"), (5, "upsert", 3, "d"), (6, "delete", 3, None), (7, "upsert", 2, "e")], "seq long, kind string, key long, payload string")
    state = {(x.key, x.seq, x.payload) for x in mutate.wal_fold(log).collect()}
    assert state == {(2, 7, "e")}
    for at in range(8):
        assert {(x.key, x.seq, x.payload) for x in mutate.wal_fold(mutate.compact(log, at)).collect()} == state


def test_pages_cover_the_list(spark):
    c = concepts(spark, [(k, "Topic" if k % 2 else "Paper", f"n{k % 4}") for k in range(17)])
    pages = [r.id for k in range(0, 17, 5) for r in g.concept_page(c, ONTO, offset=k, limit=5).collect()]
    assert pages == [r.id for r in c.orderBy("concept_type", "name", "id").collect()]


def test_empty_graph(spark):
    c = concepts(spark, [])
    r = relations(spark, [("authored", 1, 2)]).limit(0)
    sub = traverse.expand(c, r, ONTO, seeds(spark, 1))
    assert (sub.nodes.count(), sub.edges.count()) == (0, 0)
