"""Bounded traversals as relational steps: expansion, shortest path, closure and enrichment.

A loop on the driver composes one join per hop; frontiers stay distributed.  The order in which a queue would visit
nodes is kept by ranks: the key of an edge is (rank of its node, direction, type, virtual, seq).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.plans.lineage import cut, settle

from .graph import edge_view
from .ontology import Ontology
from .stored import StoredEdges, around, whole


@dataclass(frozen=True)
class Expansion:
    """What to follow and how far."""

    max_depth: int = 2
    relation_types: tuple[str, ...] = ()
    concept_types: tuple[str, ...] = ()
    direction: str = "Both"
    max_nodes: int = 64
    subsume_concept_types: bool = True


@dataclass
class Subgraph:
    """nodes: id, depth, visit_rank.  edges: relation_id, relation_type, source, target."""

    nodes: DataFrame
    edges: DataFrame
    notes: dict = field(default_factory=dict)


def allowed_types(ontology: Ontology, types: tuple[str, ...], subsume: bool) -> list[str]:
    return sorted({d for t in types for d in (ontology.descendants(t) if subsume else [t])})


KEY = ("parent_rank", "dir", "type_pos", "virt", "seq", "edge_id")


#: Rows of a frontier, or of what it meets, that are broadcast once counted; more are joined by a shuffle.
SMALL = 10_000


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= SMALL else df


def expand(concepts: DataFrame, relations: DataFrame | StoredEdges, ontology: Ontology, seeds: DataFrame, spec: Expansion = Expansion()) -> Subgraph:
    """Breadth-first expansion from seeds (id, ord); of stored edges each hop reads those around its frontier.

    Seeds are never filtered and are outside the cap.  When the cap is met, the edge that found the last node and all
    later ones are left out.  Each relation is emitted once, by its smallest key.
    """
    key = F.struct(*KEY)
    ranked = seeds.groupBy("id").agg(F.min("ord").alias("ord")).join(concepts.select("id"), "id", "left_semi")
    visited = settle(ranked.select("id", F.lit(0).alias("depth"), F.row_number().over(Window.orderBy("ord", "id")).alias("visit_rank")).withColumn("found_by", F.lit(None).cast("struct<parent_rank:int,dir:int,type_pos:int,virt:int,seq:bigint,edge_id:bigint>")))
    seeded = n = n_frontier = visited.count()
    allowed = allowed_types(ontology, spec.concept_types, spec.subsume_concept_types) if spec.concept_types else None
    emitted = None
    for depth in range(spec.max_depth if seeded < spec.max_nodes else 0):
        if not n_frontier:
            break
        frontier = visited.filter(F.col("depth") == depth).select(F.col("id").alias("node"), F.col("visit_rank").alias("parent_rank"))
        near = around(relations, frontier.select(F.col("node").alias("id")))
        view = edge_view(near, ontology, list(spec.relation_types) or None, spec.direction).withColumnRenamed("id", "edge_id")
        met = settle(view.join(_small(frontier, n_frontier), "node"))
        neighbors = settle(met.select("neighbor").distinct())
        targets = concepts.select(F.col("id").alias("neighbor"), "concept_type")
        targets = targets if allowed is None else targets.filter(F.col("concept_type").isin(allowed))
        n_met = neighbors.count()
        present = settle(targets.select("neighbor").join(_small(neighbors, n_met), "neighbor").distinct())
        steps = met.join(_small(present, n_met), "neighbor", "left_semi").withColumn("key", key)
        fresh = steps.join(visited.select(F.col("id").alias("neighbor")), "neighbor", "left_anti").groupBy("neighbor").agg(F.min("key").alias("found_by"))
        # no more nodes than the cap has room for can count, so the global order is that of a bounded top-k
        fresh = fresh.orderBy("found_by").limit(max(0, spec.max_nodes - n) + 1)
        order = F.row_number().over(Window.orderBy("found_by")) + n
        before = n
        visited = settle(visited.unionByName(fresh.select(F.col("neighbor").alias("id"), F.lit(depth + 1).alias("depth"), order.alias("visit_rank"), "found_by")))
        emitted = steps if emitted is None else emitted.unionByName(steps)
        n = visited.count()
        n_frontier = n - before
        if before + 1 > spec.max_nodes or n >= spec.max_nodes:
            break
    nodes = visited.filter(F.col("visit_rank") <= max(spec.max_nodes, seeded)).select("id", "depth", "visit_rank")
    if emitted is None:
        none = whole(relations).limit(0).select(F.col("id").alias("relation_id"), "relation_type", "source", "target")
        return Subgraph(nodes, none)
    last = visited.filter(F.col("visit_rank") == spec.max_nodes).select("found_by", "depth").first()
    edges = emitted
    if last is not None and last["found_by"] is not None:
        k = last["found_by"]
        edges = edges.filter(key < F.struct(*[F.lit(k[c]).alias(c) for c in KEY]))
    edges = edges.groupBy("edge_id").agg(F.min_by(F.struct("relation_type", "source", "target"), "key").alias("e"))
    return Subgraph(nodes, edges.select(F.col("edge_id").alias("relation_id"), "e.relation_type", "e.source", "e.target"))


def shortest_path(concepts: DataFrame, relations: DataFrame | StoredEdges, ontology: Ontology, source: int, target: int, max_depth: int = 6) -> DataFrame:
    """step, relation_id, relation_type, concept_id along a path of fewest hops in either direction; no rows if none.

    Untyped, so declared inverses add nothing.  Of equal paths the one that a queue finds first: earlier nodes first,
    outgoing edges before incoming, in order of insertion.

    Sets of nodes grow from both ends, the smaller one by a hop at a time, until they meet.  Then only nodes on some
    shortest path are ordered: the node that first finds one of these is itself one, so their order is the queue's.
    """
    spark = concepts.sparkSession
    empty = spark.createDataFrame([], "step int, relation_id long, relation_type string, concept_id long")
    if concepts.filter(F.col("id").isin(source, target)).select("id").distinct().count() < len({source, target}):
        raise KeyError("no such concept")
    if source == target:
        return empty

    def view_of(nodes: DataFrame, n: int) -> DataFrame:
        """The edges seen from the nodes (id)."""
        view = edge_view(around(relations, nodes), ontology).withColumnRenamed("id", "edge_id")
        return view.join(_small(nodes.select(F.col("id").alias("node")), n), "node", "left_semi")

    def beside(nodes: DataFrame, n: int) -> DataFrame:
        return view_of(nodes, n).select(F.col("neighbor").alias("id")).distinct()

    # levels of nodes (id, as a table and its size) from either end
    sides = [[(settle(spark.createDataFrame([(end,)], "id long")), 1)] for end in (source, target)]
    seen = [levels[0][0] for levels in sides]
    while True:
        if len(sides[0]) + len(sides[1]) - 2 >= max_depth:
            return empty
        k = 0 if sides[0][-1][1] <= sides[1][-1][1] else 1
        fresh = settle(beside(*sides[k][-1]).join(seen[k], "id", "left_anti"))
        n = fresh.count()
        if not n:
            return empty
        sides[k].append((fresh, n))
        seen[k] = seen[k].unionByName(fresh)
        meeting = settle(fresh.join(sides[1 - k][-1][0], "id", "left_semi"))
        if n_met := meeting.count():
            break

    # the nodes on shortest paths, by their distance from the source
    a, hops = len(sides[0]) - 1, len(sides[0]) + len(sides[1]) - 2
    on_path = {a: (meeting, n_met)}
    for level in [*range(a - 1, -1, -1), *range(a + 1, hops + 1)]:
        held = sides[0][level][0] if level < a else sides[1][hops - level][0]
        nodes = settle(held.join(beside(*on_path[level + 1 if level < a else level - 1]), "id", "left_semi"))
        on_path[level] = (nodes, nodes.count())

    ranked = [spark.createDataFrame([(source, 1, None, None, None)], "id long, rank int, parent long, edge_id long, relation_type string")]
    for level in range(hops):
        nodes, n = on_path[level]
        ranks = ranked[-1].select(F.col("id").alias("node"), F.col("rank").alias("parent_rank"))
        later, n_later = on_path[level + 1]
        steps = view_of(nodes, n).join(_small(ranks, n), "node").join(_small(later.withColumnRenamed("id", "neighbor"), n_later), "neighbor", "left_semi").withColumn("key", F.struct(*KEY))
        found = steps.groupBy("neighbor").agg(F.min("key").alias("key"), F.min_by(F.struct("node", "edge_id", "relation_type"), "key").alias("by"))
        found = found.select(F.col("neighbor").alias("id"), "key", F.col("by.node").alias("parent"), F.col("by.edge_id").alias("edge_id"), F.col("by.relation_type").alias("relation_type"))
        if n_later <= SMALL:
            ranked.append(settle(found.withColumn("rank", F.row_number().over(Window.orderBy("key"))).select("id", "rank", "parent", "edge_id", "relation_type")))
        else:
            ranked.append(_ranked(found))
    back, here = [], target
    for level in reversed(ranked[1:]):
        row = level.filter(F.col("id") == here).first()
        back.append((here, row["edge_id"], row["relation_type"]))
        here = row["parent"]
    return spark.createDataFrame([(i + 1, e, t, c) for i, (c, e, t) in enumerate(reversed(back))], empty.schema)


def _ranked(level: DataFrame) -> DataFrame:
    """rank by key without one task sorting all: counts of ranges of a range-partitioned sort give each range's start."""
    parts = cut(level.repartitionByRange("key").sortWithinPartitions("key").withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("__part").agg(F.count("*").alias("n")).withColumn("__start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("__part").orderBy("key"))
    return cut(parts.join(F.broadcast(starts), "__part").withColumn("rank", (F.col("__start") + inside).cast("int")).select("id", "rank", "parent", "edge_id", "relation_type"))


def closure(relations: DataFrame | StoredEdges, ontology: Ontology, seeds: DataFrame, relation_type: str, max_depth: int) -> DataFrame:
    """seed, id, depth of what is reached over one relation type in either direction, declared inverses included.

    seeds: id.  The seed itself is left out; each node has its smallest depth.
    """
    view = edge_view(whole(relations), ontology, [relation_type]).select("node", "neighbor").distinct()
    reached = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth"))
    for depth in range(max_depth):
        frontier = reached.filter(F.col("depth") == depth).select("seed", F.col("id").alias("node"))
        fresh = frontier.join(view, "node").select("seed", F.col("neighbor").alias("id")).distinct().join(reached.select("seed", "id"), ["seed", "id"], "left_anti")
        reached = cut(reached.unionByName(fresh.withColumn("depth", F.lit(depth + 1))))
    return reached.filter("depth > 0")


def enrich_transitive(subgraph: Subgraph, seeds: DataFrame, relations: DataFrame | StoredEdges, ontology: Ontology, depth: int = 3, most: int = 16, enabled: bool = True) -> DataFrame:
    """Nodes of a subgraph and up to ``most`` more that transitive relations reach from its seeds (id, ord).

    Additions are taken by seed, relation type name, hops and id; their depth is the seed's plus one.
    """
    nodes = subgraph.nodes.select("id", "depth")
    types = sorted(r.name for r in ontology.relation_types if r.transitive)
    if not enabled or not types:
        return nodes
    parts = [closure(relations, ontology, seeds.select("id"), t, depth).withColumn("type_pos", F.lit(k)) for k, t in enumerate(types)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    ranked = found.withColumnRenamed("depth", "hops").join(seeds.select(F.col("id").alias("seed"), "ord"), "seed")
    ranked = ranked.join(nodes.select("id"), "id", "left_anti").join(nodes.select(F.col("id").alias("seed"), F.col("depth").alias("seed_depth")), "seed")
    first = ranked.groupBy("id").agg(F.min(F.struct("ord", "type_pos", "hops", "id")).alias("key"), F.min_by("seed_depth", F.struct("ord", "type_pos", "hops", "id")).alias("seed_depth"))
    added = first.orderBy("key").limit(most).select("id", (F.col("seed_depth") + 1).alias("depth"))
    return nodes.unionByName(added)


def default_seeds(concepts: DataFrame, ontology: Ontology, limit: int, concept_types: tuple[str, ...] = ()) -> DataFrame:
    """id, ord of the first concepts in (type, name, id) order, of all types or of the given ones with subtypes."""
    rows = concepts
    if concept_types:
        rows = rows.filter(F.col("concept_type").isin(allowed_types(ontology, concept_types, True)))
    top = rows.orderBy("concept_type", "name", "id").limit(max(1, min(limit, 2000)))
    return top.select("id", F.row_number().over(Window.orderBy("concept_type", "name", "id")).alias("ord"))
