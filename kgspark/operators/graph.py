"""Lookups, pages, edge views and degrees of a graph of concepts and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions import text

from .ontology import Ontology

#: Rows of a page if not said otherwise, and at most.
CONCEPT_PAGE, CONCEPT_PAGE_MOST = 200, 5000
RELATION_PAGE, RELATION_PAGE_MOST = 100, 1000


def by_id(rows: DataFrame, node: int) -> DataFrame:
    return rows.filter(F.col("id") == node)


def find_by_name(concepts: DataFrame, concept_type: str, name: str) -> DataFrame:
    """Exact type, name in any case."""
    return concepts.filter((F.col("concept_type") == concept_type) & (F.lower("name") == name.lower()))


def of_type(concepts: DataFrame, ontology: Ontology, concept_type: str, subtypes: bool = True) -> DataFrame:
    """Concepts of a type and, if wanted, of all below it; none if the type is unknown.

    The names come from the ontology, so the filter reaches the scan.
    """
    names = ontology.descendants(concept_type) if subtypes else [concept_type]
    return concepts.filter(F.col("concept_type").isin(names) if names else F.lit(False))


def name_contains(concepts: DataFrame, needle: str) -> DataFrame:
    return concepts.filter(F.contains(F.lower("name"), F.lit(needle.lower())))


def name_trigrams(concepts: DataFrame) -> DataFrame:
    """gram, id: the derived search table; write it bucketed by gram where searches repeat."""
    return concepts.select(F.explode(text.trigrams(F.col("name"))).alias("gram"), "id")


def search_by_trigrams(concepts: DataFrame, grams: DataFrame, needle: str) -> DataFrame:
    """Concepts whose name has every trigram of the needle and then the needle itself."""
    wanted = sorted({needle.lower()[i : i + 3] for i in range(len(needle) - 2)})
    if not wanted:
        return name_contains(concepts, needle)
    candidates = grams.filter(F.col("gram").isin(wanted)).groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted))
    return name_contains(concepts.join(candidates.select("id"), "id", "left_semi"), needle)


def relations_where(relations: DataFrame, source: int | None = None, target: int | None = None, relation_type: str | None = None) -> DataFrame:
    wanted = {"source": source, "target": target, "relation_type": relation_type}
    for column, value in wanted.items():
        if value is not None:
            relations = relations.filter(F.col(column) == value)
    return relations


def page(rows: DataFrame, order: list[Column | str], offset: int, limit: int, most: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(min(limit, most))


def concept_page(concepts: DataFrame, ontology: Ontology, concept_type: str | None = None, subtypes: bool = False, needle: str = "", offset: int = 0, limit: int = CONCEPT_PAGE) -> DataFrame:
    """One page of concepts.

    Order: (type, name, id) over all types and for searches of three characters and more, else (name, id).
    """
    rows = concepts if concept_type is None else of_type(concepts, ontology, concept_type, subtypes)
    rows = name_contains(rows, needle) if needle else rows
    order = ["concept_type", "name", "id"] if concept_type is None or len(needle) >= 3 else ["name", "id"]
    return page(rows, order, offset, limit, CONCEPT_PAGE_MOST)


def relation_page(relations: DataFrame, offset: int = 0, limit: int = RELATION_PAGE, **where) -> DataFrame:
    return page(relations_where(relations, **where), ["id"], offset, limit, RELATION_PAGE_MOST)


def page_with_total(concepts: DataFrame, ontology: Ontology, concept_type: str, offset: int, limit: int) -> DataFrame:
    """A page whose rows carry the number of all rows: an aggregate of one row beside a bounded top-k."""
    rows = of_type(concepts, ontology, concept_type)
    total = rows.agg(F.count("*").alias("total"))
    return page(rows, ["name", "id"], offset, limit, CONCEPT_PAGE_MOST).join(F.broadcast(total))


def with_ends(relations: DataFrame, concepts: DataFrame) -> DataFrame:
    """Relations with the names of both ends; those without an end are left out."""
    names = concepts.select("id", "name")
    source = names.select(F.col("id").alias("source"), F.col("name").alias("source_name"))
    target = names.select(F.col("id").alias("target"), F.col("name").alias("target_name"))
    return relations.join(source, "source").join(target, "target")


def outgoing(relations: DataFrame, node: int) -> DataFrame:
    return relations.filter(F.col("source") == node)


def incoming(relations: DataFrame, node: int) -> DataFrame:
    return relations.filter(F.col("target") == node)


def typed_edges(relations: DataFrame, ontology: Ontology, types: list[str]) -> DataFrame:
    """Stored relations of the types, and those of a type's declared inverse turned round and renamed.

    Adds type_pos (place of the type in ``types``) and virt (1 for a turned edge), which give the order of edges.
    """
    inverse = {r.name: r.inverse_of for r in ontology.relation_types}
    columns = ["id", "relation_type", "source", "target", "weight", "seq"]
    parts = []
    for k, t in enumerate(types):
        parts.append(relations.filter(F.col("relation_type") == t).select(*columns, F.lit(k).alias("type_pos"), F.lit(0).alias("virt")))
        if inverse.get(t) and inverse[t] != t:
            turned = relations.filter(F.col("relation_type") == inverse[t])
            parts.append(turned.select("id", F.lit(t).alias("relation_type"), F.col("target").alias("source"), F.col("source").alias("target"), "weight", "seq", F.lit(k).alias("type_pos"), F.lit(1).alias("virt")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edge_view(relations: DataFrame, ontology: Ontology, types: list[str] | None = None, direction: str = "Both") -> DataFrame:
    """node, neighbor and the edge seen from node: dir 0 along the edge, 1 against it."""
    edges = typed_edges(relations, ontology, types) if types else relations.select("id", "relation_type", "source", "target", "weight", "seq", F.lit(0).alias("type_pos"), F.lit(0).alias("virt"))
    rest = ["id", "relation_type", "source", "target", "type_pos", "virt", "seq"]
    out = edges.select(F.col("source").alias("node"), F.col("target").alias("neighbor"), F.lit(0).alias("dir"), *rest)
    back = edges.select(F.col("target").alias("node"), F.col("source").alias("neighbor"), F.lit(1).alias("dir"), *rest)
    return {"Outgoing": out, "Incoming": back, "Both": out.unionByName(back)}[direction]


def neighbors(relations: DataFrame, ontology: Ontology, node: int) -> DataFrame:
    return edge_view(relations, ontology).filter(F.col("node") == node).select("node", "neighbor", F.col("id").alias("relation_id"), "dir")


def degrees(relations: DataFrame) -> DataFrame:
    """Outgoing edges by source and type."""
    return relations.groupBy("source", "relation_type").agg(F.count("*").alias("degree"))


def resolve_named(named: DataFrame, concepts: DataFrame) -> DataFrame:
    """Endpoints of relations given by (type, name in any case): source_id, target_id, null where none is found."""
    keyed = concepts.select("concept_type", F.lower("name").alias("key"), "id")
    for end in ("source", "target"):
        side = keyed.select(F.col("concept_type").alias(f"{end}_type"), F.col("key").alias(f"__{end}_key"), F.col("id").alias(f"{end}_id"))
        named = named.withColumn(f"__{end}_key", F.lower(f"{end}_name")).join(side, [f"{end}_type", f"__{end}_key"], "left").drop(f"__{end}_key")
    return named


def dangling(relations: DataFrame, concepts: DataFrame) -> DataFrame:
    """Relations of which an end is no concept."""
    ids = concepts.select("id")
    no_source = relations.join(ids.withColumnRenamed("id", "source"), "source", "left_anti").select("id", F.lit("source").alias("missing"))
    no_target = relations.join(ids.withColumnRenamed("id", "target"), "target", "left_anti").select("id", F.lit("target").alias("missing"))
    return no_source.unionByName(no_target)


def graph_stats(concepts: DataFrame, relations: DataFrame, ontology: Ontology, rules: DataFrame | None = None, actions: DataFrame | None = None) -> DataFrame:
    """One row of counts of instances and of declared types."""
    counts = concepts.agg(F.count("*").alias("concepts")).join(F.broadcast(relations.agg(F.count("*").alias("relations"))))
    for name, rows in (("rules", rules), ("actions", actions)):
        counts = counts.withColumn(name, F.lit(0).cast("long")) if rows is None else counts.join(F.broadcast(rows.agg(F.count("*").alias(name))))
    types = {"concept_types": ontology.concept_types, "relation_types": ontology.relation_types, "rule_types": ontology.rule_types, "action_types": ontology.action_types}
    return counts.withColumns({k: F.lit(len(v)).cast("long") for k, v in types.items()})


def metrics_text(stats: DataFrame) -> DataFrame:
    """One gauge line for each column of a row of statistics."""
    gauges = F.array(*[F.struct(F.lit(c).alias("gauge"), F.col(c).cast("long").alias("value")) for c in stats.columns])
    lines = stats.select(F.explode(gauges).alias("g")).select("g.gauge", "g.value")
    return lines.select("gauge", F.concat(F.lit("ontology_"), "gauge", F.lit(" "), F.col("value").cast("string")).alias("line"))
