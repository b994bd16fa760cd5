"""Schema of a graph: concept types in a single-parent hierarchy, relation types with domain, range and cardinality."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

CARDINALITIES = ("OneToOne", "OneToMany", "ManyToOne", "ManyToMany")


@dataclass(frozen=True)
class ConceptType:
    """properties: allowed names, None for any; required names must be there."""

    name: str
    parent: str | None = None
    properties: tuple[str, ...] | None = None
    required_properties: tuple[str, ...] = ()
    disjoint_with: tuple[str, ...] = ()
    description: str = ""


@dataclass(frozen=True)
class RelationType:
    name: str
    domain: str
    range: str
    cardinality: str = "ManyToMany"
    symmetric: bool = False
    transitive: bool = False
    functional: bool = False
    inverse_of: str | None = None
    description: str = ""


@dataclass(frozen=True)
class RuleType:
    name: str
    when: str
    then: str
    applies_to: tuple[str, ...] = ()
    strict: bool = False
    description: str = ""


@dataclass(frozen=True)
class ActionType:
    name: str
    subject: str
    object: str | None = None
    parameters: tuple[str, ...] = ()
    effect: str = ""
    description: str = ""


class OntologyError(ValueError):
    """The ontology contradicts itself."""


@dataclass
class Ontology:
    """Small enough for the driver; its tables are the broadcast side of joins."""

    concept_types: list[ConceptType] = field(default_factory=list)
    relation_types: list[RelationType] = field(default_factory=list)
    rule_types: list[RuleType] = field(default_factory=list)
    action_types: list[ActionType] = field(default_factory=list)

    def __post_init__(self) -> None:
        parents = {c.name: c.parent for c in self.concept_types}
        for name in parents:
            seen, at = set(), name
            while at is not None:
                if at in seen:
                    raise OntologyError(f"parents of {name} form a cycle")
                seen.add(at)
                at = parents.get(at)
        for r in self.relation_types:
            if r.domain not in parents or r.range not in parents:
                raise OntologyError(f"{r.name}: unknown domain or range")
            if r.cardinality not in CARDINALITIES:
                raise OntologyError(f"{r.name}: unknown cardinality {r.cardinality}")
            if r.inverse_of == "" or (r.inverse_of == r.name and not r.symmetric):
                raise OntologyError(f"{r.name}: only a symmetric relation is its own inverse")

    def is_subtype(self, name: str, ancestor: str) -> bool:
        parents = {c.name: c.parent for c in self.concept_types}
        at: str | None = name
        while at is not None:
            if at == ancestor:
                return True
            at = parents.get(at)
        return False

    def descendants(self, name: str) -> list[str]:
        """Sorted types below ``name``, itself included; empty if unknown."""
        names = [c.name for c in self.concept_types]
        return sorted(c for c in names if self.is_subtype(c, name)) if name in names else []

    def with_disjoint_pairs(self) -> dict[str, set[str]]:
        """Disjointness holds both ways, whichever side states it."""
        out: dict[str, set[str]] = {c.name: set(c.disjoint_with) for c in self.concept_types}
        for c in self.concept_types:
            for other in c.disjoint_with:
                out.setdefault(other, set()).add(c.name)
        return out

    def invalid_inverses(self) -> list[tuple[str, str]]:
        """(relation type, reason) where an inverse is unknown or does not mirror domain and range."""
        by_name = {r.name: r for r in self.relation_types}
        out = []
        for r in self.relation_types:
            if r.inverse_of is not None:
                other = by_name.get(r.inverse_of)
                if other is None:
                    out.append((r.name, "unknown inverse"))
                elif (other.domain, other.range) != (r.range, r.domain):
                    out.append((r.name, "not mirrored"))
        return sorted(out)

    def type_closure(self, spark: SparkSession) -> DataFrame:
        rows = [(c.name, d) for c in self.concept_types for d in self.descendants(c.name)]
        return spark.createDataFrame(rows, "ancestor string, descendant string")

    def relation_table(self, spark: SparkSession) -> DataFrame:
        rows = [tuple(asdict(r).values()) for r in self.relation_types]
        return spark.createDataFrame(rows, "name string, domain string, range string, cardinality string, symmetric boolean, transitive boolean, functional boolean, inverse_of string, description string")

    def disjoint_table(self, spark: SparkSession) -> DataFrame:
        rows = [(a, b) for a, others in sorted(self.with_disjoint_pairs().items()) for b in sorted(others)]
        return spark.createDataFrame(rows, "concept_type string, other_type string")
