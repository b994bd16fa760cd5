"""Checks of concepts and relations against the ontology, as tables of violations.

Judged as if rows came one after another (seq): up to the first violation every earlier row was accepted, so counts of
all earlier rows equal counts of accepted ones, and the first violation is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.plans.lineage import cut

from .ontology import Ontology


def concept_violations(batch: DataFrame, ontology: Ontology) -> DataFrame:
    """seq, check_no, code: the first failed check of each concept of a batch (seq, concept_type, name, keys).

    Order of checks: type known, properties allowed, required ones there, no disjoint type with the name, no other of
    the type with the name.  ``keys`` are property names.  Lists are not inherited from parent types.
    """
    spark = batch.sparkSession
    types = spark.createDataFrame(
        [(c.name, list(c.properties) if c.properties is not None else None, list(c.required_properties)) for c in ontology.concept_types], "concept_type string, allowed array<string>, required array<string>"
    )
    rows = batch.join(F.broadcast(types), "concept_type", "left").withColumn("key", F.lower("name"))
    unknown = F.col("required").isNull()
    not_allowed = F.col("allowed").isNotNull() & (F.size(F.array_except("keys", "allowed")) > 0)
    missing = F.size(F.array_except("required", "keys")) > 0
    code = F.when(unknown, 1).when(not_allowed, 2).when(missing, 3)
    checked = rows.select("seq", "concept_type", "key", code.alias("check_no"))
    earlier = disjoint_violations(batch, ontology).select("seq", F.lit(4).alias("n4"))
    again = duplicate_names(batch).select("seq", F.lit(5).alias("n5"))
    joined = checked.join(earlier, "seq", "left").join(again, "seq", "left")
    first = joined.select("seq", F.coalesce("check_no", "n4", "n5").alias("check_no")).filter("check_no IS NOT NULL")
    names = F.array(*[F.lit(x) for x in ("UnknownConceptType", "UnknownProperty", "MissingRequiredProperty", "DisjointTypeViolation", "DuplicateConcept")])
    return first.withColumn("code", F.element_at(names, F.col("check_no").cast("int")))


def disjoint_violations(batch: DataFrame, ontology: Ontology) -> DataFrame:
    """Rows whose name an earlier row of a disjoint type has: seq, concept_type, name and that type, smallest first."""
    pairs = F.broadcast(ontology.disjoint_table(batch.sparkSession))
    first = batch.groupBy(F.col("concept_type").alias("other_type"), F.lower("name").alias("key")).agg(F.min("seq").alias("first_seq"))
    joined = batch.withColumn("key", F.lower("name")).join(pairs, "concept_type").join(first, ["other_type", "key"])
    return joined.filter("first_seq < seq").groupBy("seq", "concept_type", "name").agg(F.min("other_type").alias("other_type"))


def duplicate_names(batch: DataFrame) -> DataFrame:
    """Rows whose (type, name in any case) an earlier row has: seq, concept_type, name, first_seq."""
    first = batch.groupBy("concept_type", F.lower("name").alias("key")).agg(F.min("seq").alias("first_seq"), F.count("*").alias("n")).filter("n > 1")
    return batch.withColumn("key", F.lower("name")).join(first, ["concept_type", "key"]).filter("seq > first_seq").select("seq", "concept_type", "name", "first_seq")


def edge_violations(relations: DataFrame, concepts: DataFrame, ontology: Ontology) -> DataFrame:
    """id, code of relations with a missing end, an unknown type or an end outside the type's domain or range."""
    spark = relations.sparkSession
    types = F.broadcast(ontology.relation_table(spark).select(F.col("name").alias("relation_type"), "domain", "range"))
    ends = concepts.select("id", "concept_type")
    rows = relations.join(ends.select(F.col("id").alias("source"), F.col("concept_type").alias("source_type")), "source", "left")
    rows = rows.join(ends.select(F.col("id").alias("target"), F.col("concept_type").alias("target_type")), "target", "left").join(types, "relation_type", "left")
    closure = F.broadcast(ontology.type_closure(spark))
    fits = lambda a, d, c: closure.select(F.col("ancestor").alias(a), F.col("descendant").alias(d), F.lit(True).alias(c))
    rows = rows.join(fits("domain", "source_type", "in_domain"), ["domain", "source_type"], "left").join(fits("range", "target_type", "in_range"), ["range", "target_type"], "left")
    code = (
        F.when(F.col("source_type").isNull() | F.col("target_type").isNull(), "UnknownConcept")
        .when(F.col("domain").isNull(), "UnknownRelationType")
        .when(F.col("in_domain").isNull() | F.col("in_range").isNull(), "SchemaViolation")
    )
    return rows.select("id", code.alias("code")).filter("code IS NOT NULL")


def cardinality_violations(relations: DataFrame, ontology: Ontology) -> DataFrame:
    """id, side of relations that would be a second of their type at their source or target.

    At most one leaves a source if the type is OneToOne, ManyToOne or functional; at most one enters a target if it is
    OneToOne or OneToMany.  relations: id, relation_type, source, target, seq and, if there, is_inverse: inverse rows
    count for later ones and are not judged.
    """
    spark = relations.sparkSession
    types = ontology.relation_table(spark).select(F.col("name").alias("relation_type"), (F.col("cardinality").isin("OneToOne", "ManyToOne") | F.col("functional")).alias("one_out"), F.col("cardinality").isin("OneToOne", "OneToMany").alias("one_in"))
    rows = relations if "is_inverse" in relations.columns else relations.withColumn("is_inverse", F.lit(False))
    rows = rows.join(F.broadcast(types.filter("one_out OR one_in")), "relation_type")
    out = []
    for end, limited in (("source", "one_out"), ("target", "one_in")):
        first = rows.filter(limited).groupBy("relation_type", end).agg(F.min("seq").alias("first_seq"), F.count("*").alias("n")).filter("n > 1")
        out.append(rows.filter(limited).join(first, ["relation_type", end]).filter("seq > first_seq AND NOT is_inverse").select("id", F.lit(end).alias("side")))
    return out[0].unionByName(out[1])


def accepted_before_first(batch: DataFrame, violations: DataFrame) -> DataFrame:
    """Rows before the first violation (seq): what a strict ingest has applied when it stops."""
    first = violations.agg(F.min("seq").alias("first"))
    return batch.join(F.broadcast(first)).filter(F.col("first").isNull() | (F.col("seq") < F.col("first"))).drop("first")


def quarantine(relations: DataFrame, ontology: Ontology) -> DataFrame:
    """Relations that a lenient ingest accepts, one after another.

    Types limited at one end only keep the first of each end, a plain aggregate.  For OneToOne a relation is refused
    for an accepted one only: rounds accept every relation that is first at both its ends and drop what shares an end
    with it, until none is left.
    """
    limits = {r.name: (r.cardinality in ("OneToOne", "ManyToOne") or r.functional, r.cardinality in ("OneToOne", "OneToMany")) for r in ontology.relation_types}
    both = [t for t, (a, b) in limits.items() if a and b]
    out = relations.filter(F.col("relation_type").isin([t for t, x in limits.items() if not any(x)] or [""]))
    for end, k in (("source", 0), ("target", 1)):
        only = [t for t, x in limits.items() if x[k] and not x[1 - k]]
        if only:
            rows = relations.filter(F.col("relation_type").isin(only))
            first = rows.groupBy("relation_type", end).agg(F.min("seq").alias("first_seq"))
            out = out.unionByName(rows.join(first, ["relation_type", end]).filter("seq = first_seq").select(*relations.columns))
    left = relations.filter(F.col("relation_type").isin(both)) if both else None
    while left is not None:
        # a relation that is first at both its ends is accepted whatever becomes of the others; its ends' others fall
        at_source = left.groupBy("relation_type", "source").agg(F.min("seq").alias("s1"))
        at_target = left.groupBy("relation_type", "target").agg(F.min("seq").alias("s2"))
        marked = left.join(at_source, ["relation_type", "source"]).join(at_target, ["relation_type", "target"])
        won = cut(marked.filter("seq = s1 AND seq = s2").select(*relations.columns))
        if won.isEmpty():
            break
        out = out.unionByName(won)
        left = cut(left.join(won.select("relation_type", "source"), ["relation_type", "source"], "left_anti").join(won.select("relation_type", "target"), ["relation_type", "target"], "left_anti").select(*relations.columns))
    return out
