"""Changes to a graph as new versions of its tables: ids, patches, deletions, symmetric twins, ingest and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.plans.lineage import cut

from .ontology import Ontology


def dense_numbers(rows: DataFrame, order: list[Column | str], name: str, start: int = 0) -> DataFrame:
    """Numbers rows start+1, start+2, ... in order, without one task sorting them all.

    Ranges of a range-partitioned sort are counted, and each begins where those before it end.
    """
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    parts = cut(parts.withColumn("__at", F.monotonically_increasing_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("__part").agg(F.count("*").alias("n")).withColumn("__start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("__part").orderBy("__at"))
    return parts.join(F.broadcast(starts), "__part").withColumn(name, (F.col("__start") + inside + start).cast("long")).drop("__part", "__at", "__start")


def allocate_ids(batch: DataFrame, high_water: int) -> DataFrame:
    """Ids above the highest seen, in order of seq, for rows whose id is 0; others keep theirs."""
    fresh = dense_numbers(batch.filter("id = 0").drop("id"), ["seq"], "id", high_water)
    return batch.filter("id <> 0").unionByName(fresh)


def symmetric_twins(relations: DataFrame, ontology: Ontology) -> DataFrame:
    """The inverse of each stored relation of a symmetric type, but for self-loops: source and target swapped."""
    names = [r.name for r in ontology.relation_types if r.symmetric]
    rows = relations.filter(F.col("relation_type").isin(names or [""]) & (F.col("source") != F.col("target")))
    return rows.select("id", "relation_type", F.col("target").alias("source"), F.col("source").alias("target"), "weight")


def apply_patches(concepts: DataFrame, patches: DataFrame) -> DataFrame:
    """Concepts with name and description replaced where the patch (id, new_name, new_description) has one."""
    joined = concepts.join(patches, "id", "left")
    return joined.select("id", "concept_type", F.coalesce("new_name", "name").alias("name"), F.coalesce("new_description", "description").alias("description"))


def cascade_delete(concepts: DataFrame, relations: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Concepts and relations without the given ids and all their edges."""
    kept = concepts.join(gone, "id", "left_anti")
    edges = relations.join(gone.select(F.col("id").alias("source")), "source", "left_anti").join(gone.select(F.col("id").alias("target")), "target", "left_anti")
    return kept, edges


def delete_relations(relations: DataFrame, gone: DataFrame) -> DataFrame:
    """Relations without the given ids; a symmetric twin has an id of its own and stays."""
    return relations.join(gone, "id", "left_anti")


def export_relations(relations: DataFrame, ontology: Ontology) -> DataFrame:
    """Each relation id once, and of a symmetric type one relation a pair: the one first seen by (source, seq)."""
    names = [r.name for r in ontology.relation_types if r.symmetric]
    plain = relations.filter(~F.col("relation_type").isin(names or [""]))
    pairs = relations.filter(F.col("relation_type").isin(names or [""]))
    first = F.min_by(F.struct(*[c for c in relations.columns]), F.struct("source", "seq", "id"))
    one = pairs.groupBy("relation_type", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(first.alias("r")).select("r.*")
    return plain.unionByName(one)


def ingest(records: DataFrame, known: DataFrame) -> DataFrame:
    """How each named relation of a stream of records fares: applied, deferred (applied on the retry) or unresolved.

    records: seq, kind (concept or named_relation), concept_key, source_key, target_key; known: key of the concepts
    that are there before.  A relation whose ends come later is retried once after all records.
    """
    first = records.filter("kind = 'concept'").groupBy(F.col("concept_key").alias("key")).agg(F.min("seq").alias("at"))
    keys = known.select("key", F.lit(-1).cast("long").alias("at")).unionByName(first).groupBy("key").agg(F.min("at").alias("at"))
    rows = records.filter("kind = 'named_relation'")
    for end in ("source", "target"):
        rows = rows.join(keys.select(F.col("key").alias(f"{end}_key"), F.col("at").alias(f"{end}_at")), f"{end}_key", "left")
    ready = (F.col("source_at") < F.col("seq")) & (F.col("target_at") < F.col("seq"))
    found = F.col("source_at").isNotNull() & F.col("target_at").isNotNull()
    return rows.select("seq", F.when(ready, "applied").when(found, "deferred").otherwise("unresolved").alias("status"))


def wal_fold(log: DataFrame) -> DataFrame:
    """The state that a log leaves: the last row of each key after the last clear, but for deletions.

    log: seq, kind (upsert, delete or clear), key, payload.  One aggregate by key, no ordering of the whole log.
    """
    cleared = log.filter("kind = 'clear'").agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("cleared"))
    rows = log.filter("kind <> 'clear'").join(F.broadcast(cleared)).filter("seq > cleared")
    last = rows.groupBy("key").agg(F.max_by(F.struct("kind", "seq", "payload"), "seq").alias("r"))
    return last.filter("r.kind = 'upsert'").select("key", F.col("r.seq").alias("seq"), F.col("r.payload").alias("payload"))


def compact(log: DataFrame, at: int) -> DataFrame:
    """A log that folds to the same state: the state at ``at`` as upserts, then what came later."""
    state = wal_fold(log.filter(F.col("seq") <= at)).select("seq", F.lit("upsert").alias("kind"), "key", "payload")
    return state.unionByName(log.filter(F.col("seq") > at).select("seq", "kind", "key", "payload"))
