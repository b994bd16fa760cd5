"""Rule and action instances: checks before they are added, pages, sparse updates, removal.

rules: id, rule_type, name, when, then, applies_to (array of concept ids), strict, description.
actions: id, action_type, name, subject, object (a concept id or null), effect, description.
Their types are declared in the ontology; the engine keeps them and never evaluates them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ontology import Ontology


def _checked(refs: DataFrame, rows: DataFrame, kind: str, declared: list[str], concepts: DataFrame) -> DataFrame:
    """id, code, missing: rows of an undeclared type, else the concepts they name that are not there.

    refs: id, ref.  A row whose type is unknown is not looked at further.
    """
    known = F.col(kind).isin(declared) if declared else F.lit(False)
    unknown = rows.filter(~F.coalesce(known, F.lit(False))).select("id", F.lit("UnknownRelationType").alias("code"), F.lit(None).cast("long").alias("missing"))
    lost = refs.join(concepts.select(F.col("id").alias("ref")), "ref", "left_anti")
    return unknown.unionByName(lost.select("id", F.lit("UnknownConcept").alias("code"), F.col("ref").alias("missing")))


def rule_violations(rules: DataFrame, concepts: DataFrame, ontology: Ontology) -> DataFrame:
    """id, code, missing of rules that may not be added: one row for each concept in ``applies_to`` that is not there."""
    declared = [t.name for t in ontology.rule_types]
    refs = rules.filter(F.col("rule_type").isin(declared)).select("id", F.explode(F.array_distinct("applies_to")).alias("ref"))
    return _checked(refs, rules, "rule_type", declared, concepts)


def action_violations(actions: DataFrame, concepts: DataFrame, ontology: Ontology) -> DataFrame:
    """id, code, missing of actions that may not be added: subject and, where there is one, object must be there."""
    declared = [t.name for t in ontology.action_types]
    ends = F.array_distinct(F.array_compact(F.array("subject", "object")))
    refs = actions.filter(F.col("action_type").isin(declared)).select("id", F.explode(ends).alias("ref"))
    return _checked(refs, actions, "action_type", declared, concepts)


def page(rows: DataFrame, kind: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rules or actions in the order of type, name and id; all of them without a limit."""
    ordered = rows.orderBy(kind, "name", "id").offset(offset)
    return ordered if limit is None else ordered.limit(limit)


def _one_each(patches: DataFrame, fields: list[str]) -> DataFrame:
    """The patches by id; two of one id raise, so that no row is changed twice or given twice."""
    twice = F.raise_error(F.concat(F.lit("more than one patch of id "), F.col("id").cast("string")))
    only = F.when(F.count("*") > 1, twice).otherwise(F.any_value(F.struct(*fields)))
    return patches.groupBy("id").agg(only.alias("__p")).select("id", "__p.*")


def update(rows: DataFrame, patches: DataFrame, fields: list[str]) -> DataFrame:
    """Rows with the fields that a patch of their id gives.

    patches: id, and for each field ``has_<field>`` (boolean) and ``new_<field>``; two patches of one id raise.  A field
    that is given as null is cleared; one that is not given stays.
    """

    def patched(c: str) -> Column:
        return F.when(F.col(f"has_{c}"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)

    joined = rows.join(_one_each(patches, [f"{p}_{c}" for c in fields for p in ("has", "new")]), "id", "left")
    return joined.select(*[patched(c) if c in fields else F.col(c) for c in rows.columns])


def remove(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose id is not among those of ``gone``."""
    return rows.join(gone.select("id"), "id", "left_anti").select(*rows.columns)


def update_relations(relations: DataFrame, patches: DataFrame) -> DataFrame:
    """Relations with the weights of their patches (id, new_weight; null leaves the weight); nothing else may change.

    Two patches of one id raise.
    """
    joined = relations.join(_one_each(patches, ["new_weight"]), "id", "left")
    return joined.select(*[F.coalesce("new_weight", "weight").cast(relations.schema["weight"].dataType).alias("weight") if c == "weight" else F.col(c) for c in relations.columns])


def newest_first(rows: DataFrame, at: str, key: str, limit: int | None = None) -> DataFrame:
    """Rows by falling time, ties by falling key; only the first ``limit`` if there is one."""
    ordered = rows.orderBy(F.col(at).desc(), F.col(key).desc())
    return ordered if limit is None else ordered.limit(limit)
