"""Stored edges and the search from both ends against a plain queue."""

from __future__ import annotations

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from kgspark.operators import stored, traverse
from kgspark.operators.ontology import ConceptType, Ontology, RelationType
from kgspark.operators.stored import StoredEdges

ONTOLOGY = Ontology([ConceptType("N")], [RelationType("a", "N", "N"), RelationType("b", "N", "N", symmetric=True)])


def graph(spark, seed, nodes, edges):
    draw = random.Random(seed)
    rows = [(1000 + k, draw.choice("ab"), draw.randrange(nodes), draw.randrange(nodes), 1.0, 1000 + k) for k in range(edges)]
    draw.shuffle(rows)
    concepts = spark.createDataFrame([(k, "N", f"n{k}", "") for k in range(nodes)], "id long, concept_type string, name string, description string")
    return concepts, spark.createDataFrame(rows, "id long, relation_type string, source long, target long, weight double, seq long"), sorted(rows)


def queue_path(rows, source, target, depth):
    """The path that a queue finds first: a node's outgoing edges in order, then its incoming ones."""
    came, todo = {source: None}, deque([(source, 0)])
    while todo:
        node, d = todo.popleft()
        if node == target:
            out = []
            while came[node] is not None:
                before, edge, kind = came[node]
                out.append((edge, kind, node))
                node = before
            return [(k + 1, *x) for k, x in enumerate(reversed(out))]
        if d < depth:
            for edge, kind, other in [(r[0], r[1], r[3]) for r in rows if r[2] == node] + [(r[0], r[1], r[2]) for r in rows if r[3] == node]:
                if other not in came:
                    came[other] = (node, edge, kind)
                    todo.append((other, d + 1))
    return []


@pytest.mark.parametrize("seed, edges", [(1, 45), (2, 70)])
def test_paths_are_those_of_a_queue(spark, tmp_path, seed, edges):
    concepts, relations, rows = graph(spark, seed, 40, edges)
    kept = StoredEdges.write(relations, f"{tmp_path}/edges")
    draw = random.Random(seed)
    for n in range(3):
        source, target = draw.sample(range(40), 2)
        want = queue_path(rows, source, target, 6)
        for edges_of in (kept, relations) if n == 0 else (kept,):
            got = traverse.shortest_path(concepts, edges_of, ONTOLOGY, source, target).orderBy("step").collect()
            assert [tuple(r) for r in got] == want
    far = traverse.shortest_path(concepts, kept, ONTOLOGY, rows[0][2], rows[0][3], max_depth=1).count()
    assert far == (rows[0][2] != rows[0][3])


def test_relations_touching_nodes_come_once(spark, tmp_path, monkeypatch):
    _, relations, rows = graph(spark, 5, 12, 60)
    kept = StoredEdges.write(relations, f"{tmp_path}/edges")
    nodes = spark.createDataFrame([(3,), (4,), (3,)], "id long")
    want = sorted(r[0] for r in rows if {r[2], r[3]} & {3, 4})
    assert sorted(r.id for r in kept.touching(nodes).collect()) == want
    monkeypatch.setattr(stored, "NAMED", 1)  # more nodes than a filter names are joined
    assert sorted(r.id for r in kept.touching(nodes).collect()) == want
    assert kept.touching(nodes.limit(0)).count() == 0


def test_expansion_of_stored_edges_is_that_of_the_table(spark, tmp_path):
    concepts, relations, _ = graph(spark, 9, 60, 150)
    kept = StoredEdges.write(relations, f"{tmp_path}/edges")
    seeds = spark.createDataFrame([(7, 0), (8, 1)], "id long, ord int")
    for spec in (traverse.Expansion(max_depth=2, max_nodes=20), traverse.Expansion(max_depth=2, relation_types=("a",), direction="Outgoing")):
        a, b = (traverse.expand(concepts, r, ONTOLOGY, seeds, spec) for r in (relations, kept))
        for part in ("nodes", "edges"):
            assert sorted(map(tuple, getattr(a, part).collect())) == sorted(map(tuple, getattr(b, part).collect()))


def test_edges_read_in_place_are_those_at_the_nodes(spark, sf, monkeypatch):
    from kgspark.plans import encode, registry

    kg = encode.Graph(spark, sf)
    ids = [registry.CUSTOMER7, registry.NATION3, 5 * encode.BASE + 6, 4 * encode.BASE + 2, 6 * encode.BASE + 8]
    nodes = spark.createDataFrame([(i,) for i in ids], "id long")
    want = sorted(map(tuple, kg.relations.filter(F.col("source").isin(ids) | F.col("target").isin(ids)).collect()))
    assert sorted(map(tuple, kg.touching(nodes).collect())) == want
    monkeypatch.setattr(encode, "NAMED", 2)
    assert sorted(map(tuple, kg.touching(nodes).collect())) == want
    assert registry.QUERIES["transitive_enrich"](spark, sf).count() == 6
    assert not any(name == "edges" for _, name, _ in encode._STORED)


def test_a_requested_subgraph_without_a_limit_is_whole(spark):
    from kgspark.operators import retrieve

    ids = spark.range(1, 2102)
    concepts = ids.selectExpr("id", "'T' AS concept_type", "'n' AS name", "'' AS description")
    edges = ids.filter("id > 1").selectExpr("id", "'r' AS relation_type", "CAST(1 AS LONG) AS source", "id AS target", "CAST(1 AS DOUBLE) AS weight", "id AS seq")
    index = retrieve.Index(concepts, None, None, None, None)
    ontology = Ontology([ConceptType("T")], [RelationType("r", "T", "T")])
    for limit, n in ((None, 2101), (2000, 2000)):
        assert retrieve.requested_subgraph(index, edges, ontology, (1,), limit=limit).nodes.count() == n
