"""The driver tables as a property graph: concepts, relations and the ontology they follow.

Ids are global and never zero: type code * 10**13 + key + 1.  ``seq`` is the order in which a relation was added.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgspark.operators.ontology import ActionType, ConceptType, Ontology, RelationType, RuleType
from kgspark.operators.stored import NAMED

from .lineage import settle, shared_dir, spread

BASE = 10_000_000_000_000

#: Relations of line items: table code * LINE_BASE + order key * LINES + number in the order.
LINE_BASE, LINES = 10**18, 100_000
#: The columns that tell an order's line items apart; rows that agree in all of them are alike.
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")

ONTOLOGY = Ontology(
    [
        ConceptType("Place", description="somewhere"),
        ConceptType("Region", parent="Place"),
        ConceptType("Nation", parent="Place"),
        ConceptType("Party", description="who buys or sells"),
        ConceptType("Customer", parent="Party", disjoint_with=("Supplier",)),
        ConceptType("Supplier", parent="Party", disjoint_with=("Customer",)),
        ConceptType("Part"),
        ConceptType("Order"),
        ConceptType("Document"),
    ],
    [
        RelationType("in_region", "Nation", "Region", "ManyToOne", transitive=True, functional=True),
        RelationType("located_in", "Party", "Nation", "ManyToOne", functional=True),
        RelationType("placed_by", "Order", "Customer", "ManyToOne", functional=True),
        RelationType("placed", "Customer", "Order", "OneToMany", inverse_of="placed_by"),
        RelationType("contains_part", "Order", "Part"),
        RelationType("shipped_by", "Order", "Supplier"),
        RelationType("related_to", "Part", "Part", symmetric=True),
    ],
)
#: The same with rule and action types, for the queries about their instances.
RULED = Ontology(
    ONTOLOGY.concept_types,
    ONTOLOGY.relation_types,
    [RuleType("credit", "a party owes", "hold its orders", ("Party",), strict=True), RuleType("duty", "goods cross a border", "pay duty", ("Nation",))],
    [ActionType("audit", "Supplier", "Nation", effect="a report"), ActionType("remind", "Customer", effect="a letter")],
)


_STORED: dict[tuple[str, str, str], object] = {}


def node_id(code: int, key: Column | str) -> Column:
    return F.lit(code * BASE + 1).cast("long") + (F.col(key) if isinstance(key, str) else key).cast("long")


@dataclass
class Graph:
    """Concepts and relations of one scale factor; scans are narrow and pruned by what is asked of them."""

    spark: SparkSession
    sf_dir: str
    ontology: Ontology = field(default_factory=lambda: ONTOLOGY)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stored(self, name: str, write: Callable[[str], object]):
        """What ``write`` makes of a path, once for this session and version of the tables (names, sizes and times of files)."""
        files = self.spark.read.format("binaryFile").load(f"{self.sf_dir}/*.parquet").select("path", "length", "modificationTime").orderBy("path").collect()
        version = hashlib.sha256(repr([tuple(r) for r in files]).encode()).hexdigest()[:16]
        key = (self.spark.sparkContext.applicationId, name, version)
        if key not in _STORED:
            _STORED[key] = write(f"{shared_dir(self.spark)}/{name}-{version}-{uuid.uuid4().hex[:8]}")
        return _STORED[key]

    def _concepts(self, name: str, code: int, kind: str, key: str, label: Column, description: Column, dealt: bool = False) -> DataFrame:
        rows = spread(self.table(name)) if dealt else self.table(name)
        return rows.select(node_id(code, key).alias("id"), F.lit(kind).alias("concept_type"), label.alias("name"), description.alias("description"))

    @cached_property
    def rules(self) -> DataFrame:
        """A rule for each customer, on it and its nation; some are of no declared type or name a concept that is not there."""
        k, nation = F.col("c_custkey"), F.col("c_nationkey")
        kind = F.when(k % 41 == 0, "unknown").when(k % 2 == 0, "credit").otherwise("duty")
        nation = F.when(k % 13 == 0, node_id(2, nation + 100)).otherwise(node_id(2, nation))
        return self.table("customer").select(
            node_id(21, k).alias("id"), kind.alias("rule_type"), F.concat(F.lit("rule-"), (k % 500).cast("string")).alias("name"), F.lit("balance < 0").alias("when"),
            F.lit("hold").alias("then"), F.array(node_id(3, k), nation).alias("applies_to"), (k % 3 == 0).alias("strict"), F.col("c_mktsegment").alias("description"),
        )

    @cached_property
    def actions(self) -> DataFrame:
        """An action for each order on its customer, with the customer's order or none as object; some ends are not there."""
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        kind = F.when(k % 43 == 0, "unknown").when(k % 2 == 0, "audit").otherwise("remind")
        subject = F.when(k % 17 == 0, node_id(19, c)).otherwise(node_id(3, c))
        target = F.when(k % 3 == 0, F.lit(None).cast("long")).when(k % 19 == 0, node_id(19, k)).otherwise(node_id(6, k))
        return self.table("orders").select(
            node_id(22, k).alias("id"), kind.alias("action_type"), F.concat(F.lit("action-"), (k % 900).cast("string")).alias("name"), subject.alias("subject"),
            target.alias("object"), F.lit("done").alias("effect"), F.col("o_orderpriority").alias("description"),
        )

    @cached_property
    def concepts(self) -> DataFrame:
        """id, concept_type, name, description."""
        return self._every_concept(False)

    @cached_property
    def dealt_concepts(self) -> DataFrame:
        """The same with the long texts of a small table dealt over the cores, for work on all of them."""
        return self._every_concept(True)

    def _every_concept(self, dealt: bool) -> DataFrame:
        none = F.lit("")
        parts = [
            self._concepts("region", 1, "Region", "r_regionkey", F.col("r_name"), none),
            self._concepts("nation", 2, "Nation", "n_nationkey", F.col("n_name"), none),
            self._concepts("customer", 3, "Customer", "c_custkey", F.col("c_name"), F.col("c_mktsegment")),
            self._concepts("supplier", 4, "Supplier", "s_suppkey", F.col("s_name"), none),
            self._concepts("part", 5, "Part", "p_partkey", F.concat("p_name", F.lit(" #"), F.col("p_partkey").cast("string")), F.concat_ws(" ", "p_brand", "p_type")),
            self._concepts("orders", 6, "Order", "o_orderkey", F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string")), F.col("o_orderpriority")),
            self._concepts("documents", 7, "Document", "doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), F.coalesce("text", F.lit("")), dealt),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _edges(self, name: str, code: int, kind: str, key: Column, source: Column, target: Column, weight: Column | None = None) -> DataFrame:
        weight = F.lit(1.0) if weight is None else weight
        i = node_id(code, key)
        return self.table(name).select(i.alias("id"), F.lit(kind).alias("relation_type"), source.alias("source"), target.alias("target"), weight.cast("double").alias("weight"), i.alias("seq"))

    @cached_property
    def relations(self) -> DataFrame:
        """id, relation_type, source, target, weight, seq; an order's line items are numbered in the order of all their columns."""
        return self._relations_with(self.table("lineitem"))

    def touching(self, nodes: DataFrame) -> DataFrame:
        """Each relation that has an end among the nodes (id), once, read from the tables where they lie.

        Only the line items of orders that have one at these nodes are numbered, so that no others are shuffled.
        """
        lines = self.table("lineitem")
        ends = {"l_orderkey": 6, "l_partkey": 5, "l_suppkey": 4}
        few = [r[0] for r in nodes.select("id").limit(NAMED + 1).collect()]
        if len(few) <= NAMED:
            among = lambda c: c.isin(few)
            at = among(node_id(6, "l_orderkey")) | among(node_id(5, "l_partkey")) | among(node_id(4, "l_suppkey"))
            orders = settle(lines.filter(at).select("l_orderkey").distinct())
            return self._relations_with(lines.join(orders, "l_orderkey", "left_semi")).filter(among(F.col("source")) | among(F.col("target")))
        ids = settle(nodes.select("id").distinct())
        met = [lines.select("l_orderkey", node_id(code, key).alias("id")).join(ids, "id", "left_semi").select("l_orderkey") for key, code in ends.items()]
        orders = settle(met[0].union(met[1]).union(met[2]).distinct())
        near = self._relations_with(lines.join(orders, "l_orderkey", "left_semi"))
        source, target = ids.withColumnRenamed("id", "source"), ids.withColumnRenamed("id", "target")
        out, into = near.join(source, "source", "left_semi"), near.join(target, "target", "left_semi").join(source, "source", "left_anti")
        return out.select(near.columns).unionByName(into.select(near.columns))

    def _relations_with(self, lines: DataFrame) -> DataFrame:
        number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER))
        line = F.col("l_orderkey").cast("long") * LINES + number

        def wide(kind: str, code: int, target: Column, weight: Column) -> DataFrame:
            i = F.lit(code * LINE_BASE) + line
            return lines.select(i.alias("id"), F.lit(kind).alias("relation_type"), node_id(6, "l_orderkey").alias("source"), target.alias("target"), weight.cast("double").alias("weight"), i.alias("seq"))

        parts = [
            self._edges("nation", 11, "in_region", F.col("n_nationkey"), node_id(2, "n_nationkey"), node_id(1, "n_regionkey")),
            self._edges("customer", 12, "located_in", F.col("c_custkey"), node_id(3, "c_custkey"), node_id(2, "c_nationkey")),
            self._edges("supplier", 13, "located_in", F.col("s_suppkey"), node_id(4, "s_suppkey"), node_id(2, "s_nationkey")),
            self._edges("orders", 14, "placed_by", F.col("o_orderkey"), node_id(6, "o_orderkey"), node_id(3, "o_custkey")),
            wide("contains_part", 1, node_id(5, "l_partkey"), F.col("l_quantity")),
            wide("shipped_by", 2, node_id(4, "l_suppkey"), F.lit(1.0)),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    @cached_property
    def type_closure(self) -> DataFrame:
        return self.ontology.type_closure(self.spark)


#: The same graph for DuckDB: common table expressions to put in front of a query.
SQL_GRAPH = """concepts AS (
  SELECT CAST(10000000000001 + r_regionkey AS BIGINT) AS id, 'Region' AS concept_type, r_name AS name, '' AS description FROM region
  UNION ALL SELECT CAST(20000000000001 + n_nationkey AS BIGINT), 'Nation', n_name, '' FROM nation
  UNION ALL SELECT CAST(30000000000001 + c_custkey AS BIGINT), 'Customer', c_name, c_mktsegment FROM customer
  UNION ALL SELECT CAST(40000000000001 + s_suppkey AS BIGINT), 'Supplier', s_name, '' FROM supplier
  UNION ALL SELECT CAST(50000000000001 + p_partkey AS BIGINT), 'Part', p_name || ' #' || p_partkey, p_brand || ' ' || p_type FROM part
  UNION ALL SELECT CAST(60000000000001 + o_orderkey AS BIGINT), 'Order', 'Order#' || o_orderkey, o_orderpriority FROM orders
  UNION ALL SELECT CAST(70000000000001 + doc_id AS BIGINT), 'Document', 'doc-' || doc_id, coalesce(text, '') FROM documents
), line AS (
  SELECT *, CAST(l_orderkey AS BIGINT) * 100000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS k FROM lineitem
), relations AS (
  SELECT CAST(110000000000001 + n_nationkey AS BIGINT) AS id, 'in_region' AS relation_type, CAST(20000000000001 + n_nationkey AS BIGINT) AS source, CAST(10000000000001 + n_regionkey AS BIGINT) AS target, CAST(1.0 AS DOUBLE) AS weight FROM nation
  UNION ALL SELECT CAST(120000000000001 + c_custkey AS BIGINT), 'located_in', CAST(30000000000001 + c_custkey AS BIGINT), CAST(20000000000001 + c_nationkey AS BIGINT), 1.0 FROM customer
  UNION ALL SELECT CAST(130000000000001 + s_suppkey AS BIGINT), 'located_in', CAST(40000000000001 + s_suppkey AS BIGINT), CAST(20000000000001 + s_nationkey AS BIGINT), 1.0 FROM supplier
  UNION ALL SELECT CAST(140000000000001 + o_orderkey AS BIGINT), 'placed_by', CAST(60000000000001 + o_orderkey AS BIGINT), CAST(30000000000001 + o_custkey AS BIGINT), 1.0 FROM orders
  UNION ALL SELECT CAST(1000000000000000000 + k AS BIGINT), 'contains_part', CAST(60000000000001 + l_orderkey AS BIGINT), CAST(50000000000001 + l_partkey AS BIGINT), CAST(l_quantity AS DOUBLE) FROM line
  UNION ALL SELECT CAST(2000000000000000000 + k AS BIGINT), 'shipped_by', CAST(60000000000001 + l_orderkey AS BIGINT), CAST(40000000000001 + l_suppkey AS BIGINT), 1.0 FROM line
)"""

#: Concept types with every type below them, themselves included.
SQL_CLOSURE = """parents(name, parent) AS (
  VALUES ('Place', NULL), ('Region', 'Place'), ('Nation', 'Place'), ('Party', NULL), ('Customer', 'Party'), ('Supplier', 'Party'), ('Part', NULL), ('Order', NULL), ('Document', NULL)
), closure(ancestor, descendant) AS (
  SELECT name, name FROM parents UNION ALL SELECT c.ancestor, p.name FROM closure c JOIN parents p ON p.parent = c.descendant
)"""
