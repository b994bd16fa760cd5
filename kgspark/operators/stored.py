"""Edges written once for a version of the graph and laid out by their ends, so that a traversal reads what it touches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Nodes that are named in a filter, which prunes files and pages; more are joined.
NAMED = 1000
_COLUMNS = ("id", "relation_type", "source", "target", "weight", "seq")


@dataclass
class StoredEdges:
    """The same relations twice: ranges of the source, sorted by it, and ranges of the target, sorted by that."""

    by_source: DataFrame
    by_target: DataFrame

    @staticmethod
    def write(relations: DataFrame, path: str) -> StoredEdges:
        for end in ("source", "target"):
            relations.select(*_COLUMNS).repartitionByRange(end).sortWithinPartitions(end, "seq").write.parquet(f"{path}/{end}")
        return StoredEdges.open(relations.sparkSession, path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> StoredEdges:
        return StoredEdges(spark.read.parquet(f"{path}/source"), spark.read.parquet(f"{path}/target"))

    def touching(self, nodes: DataFrame) -> DataFrame:
        """Each relation that has an end among the nodes (id), once."""
        few = [r[0] for r in nodes.select("id").limit(NAMED + 1).collect()]
        if len(few) <= NAMED:
            out = self.by_source.filter(F.col("source").isin(few))
            return out.unionByName(self.by_target.filter(F.col("target").isin(few) & ~F.col("source").isin(few)))
        ids = nodes.select("id").distinct()
        out = self.by_source.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
        into = self.by_target.join(ids.withColumnRenamed("id", "target"), "target", "left_semi").join(ids.withColumnRenamed("id", "source"), "source", "left_anti")
        return out.select(*_COLUMNS).unionByName(into.select(*_COLUMNS))


@dataclass
class ReadEdges:
    """Relations read where they lie, for requests too few to pay for storing them: all, and those that touch nodes (id)."""

    every: DataFrame
    touching: Callable[[DataFrame], DataFrame]


def whole(relations: DataFrame | StoredEdges | ReadEdges) -> DataFrame:
    if isinstance(relations, ReadEdges):
        return relations.every
    return relations.by_source if isinstance(relations, StoredEdges) else relations


def around(relations: DataFrame | StoredEdges | ReadEdges, nodes: DataFrame) -> DataFrame:
    """The relations that have an end among the nodes (id); of a plain table all, for a join with the nodes to choose from."""
    return relations if isinstance(relations, DataFrame) else relations.touching(nodes)
