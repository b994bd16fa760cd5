"""Readers of graph records: JSON lines, triples, tables; and their writers."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.operators.ontology import Ontology

# Kinds of records (fixed values).
KINDS = ("concept", "relation", "named_relation", "ontology", "concept_type_decl", "relation_type_decl", "rule_type_decl", "action_type_decl", "rule", "action")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, line: lines of text files; line_no rises in a file and need not be dense."""
    return spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def parse_jsonl(lines: DataFrame) -> DataFrame:
    """line_no, kind, payload (VARIANT) of lines (line_no, line); blank lines and those that begin with # are passed over.

    A line that is no JSON, or has an unknown kind, is an error.
    """
    rows = lines.filter((F.trim("line") != "") & ~F.ltrim(F.col("line")).startswith("#"))
    parsed = rows.select("line_no", F.parse_json("line").alias("payload"))
    kind = F.variant_get("payload", "$.kind", "string")
    checked = F.when(kind.isin(*KINDS), kind).otherwise(F.raise_error(F.concat(F.lit("unknown record kind: "), F.coalesce(kind, F.lit("none")))))
    return parsed.select("line_no", checked.cast("string").alias("kind"), "payload")


def concepts_of(records: DataFrame) -> DataFrame:
    """The concept records' fields."""
    get = lambda path, kind: F.try_variant_get("payload", path, kind)
    return records.filter("kind = 'concept'").select("line_no", get("$.id", "bigint").alias("id"), get("$.concept_type", "string").alias("concept_type"), get("$.name", "string").alias("name"), F.coalesce(get("$.description", "string"), F.lit("")).alias("description"))


def named_relations_of(records: DataFrame) -> DataFrame:
    """The named relations' fields; weight 1 if none is given."""
    get = lambda path, kind: F.try_variant_get("payload", path, kind)
    names = ("relation_type", "source_type", "source_name", "target_type", "target_name")
    return records.filter("kind = 'named_relation'").select("line_no", *[get(f"$.{c}", "string").alias(c) for c in names], F.coalesce(get("$.weight", "double"), F.lit(1.0)).alias("weight"))


def parse_triples(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(concepts: file, first_seq, concept_type, name; relations: file, seq, relation_type and ends) of triple lines.

    lines: file, line_no, line of the form ``Type:Name predicate Type:Name``; # begins a comment; other lines are
    errors.  A concept is emitted once a file, where it first stands.
    """
    bare = lines.withColumn("t", F.trim(F.split_part("line", F.lit("#"), F.lit(1)))).filter("t <> ''")
    parts = bare.withColumn("p", F.split("t", r"\s+"))
    ok = (F.size("p") == 3) & F.contains(F.get("p", F.lit(0)), F.lit(":")) & F.contains(F.get("p", F.lit(2)), F.lit(":"))
    parts = parts.withColumn("p", F.when(ok, F.col("p")).otherwise(F.raise_error(F.concat(F.lit("not a triple: "), "t")).cast("array<string>")))
    kind = lambda c: F.substring_index(c, ":", 1)
    name = lambda c: F.substr(c, F.instr(c, ":") + 1)
    s, o = F.get("p", F.lit(0)), F.get("p", F.lit(2))
    relations = parts.select("file", (F.col("line_no") * 3 + 2).alias("seq"), F.get("p", F.lit(1)).alias("relation_type"), kind(s).alias("source_type"), name(s).alias("source_name"), kind(o).alias("target_type"), name(o).alias("target_name"), F.lit(1.0).alias("weight"))
    ends = parts.select("file", F.explode(F.array(F.struct((F.col("line_no") * 3).alias("seq"), s.alias("e")), F.struct((F.col("line_no") * 3 + 1).alias("seq"), o.alias("e")))).alias("x"))
    concepts = ends.groupBy("file", kind(F.col("x.e")).alias("concept_type"), name(F.col("x.e")).alias("name")).agg(F.min("x.seq").alias("first_seq"))
    return concepts, relations


def read_table(spark: SparkSession, path: str, concept_type: str, separator: str = ",") -> DataFrame:
    """Concepts from CSV files with a header that has ``name``; other columns but ``description`` are properties.

    Rows of another width or without a name are errors; empty cells are dropped.
    """
    raw = spark.read.csv(path, header=True, sep=separator, quote='"', escape='"', mode="FAILFAST", ignoreLeadingWhiteSpace=False)
    return table_concepts(raw, concept_type)


def table_concepts(raw: DataFrame, concept_type: str) -> DataFrame:
    """concept_type, name, description, properties (map) of a table of text columns."""
    by_lower = {c.lower().strip(): c for c in raw.columns}
    if "name" not in by_lower:
        raise ValueError("the header has no name column")
    name = F.trim(F.col(f"`{by_lower['name']}`"))
    checked = F.when(F.coalesce(name, F.lit("")) != "", name).otherwise(F.raise_error(F.lit("a row has no name")).cast("string"))
    description = F.coalesce(F.col(f"`{by_lower['description']}`"), F.lit("")) if "description" in by_lower else F.lit("")
    others = [c for low, c in by_lower.items() if low not in ("name", "description")]
    entries = F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").cast("string").alias("value")) for c in others]) if others else F.array().cast("array<struct<key:string,value:string>>")
    properties = F.map_from_entries(F.filter(entries, lambda e: F.coalesce(e["value"], F.lit("")) != ""))
    return raw.select(F.lit(concept_type).alias("concept_type"), checked.alias("name"), description.alias("description"), properties.alias("properties"))


def unpivot_properties(concepts: DataFrame) -> DataFrame:
    return concepts.select("name", F.explode("properties").alias("key", "value"))


def export_records(ontology: Ontology, concepts: DataFrame, relations: DataFrame, rules: DataFrame | None = None, actions: DataFrame | None = None) -> dict[str, DataFrame]:
    """value (a JSON record with its kind) by kind, in the order in which the records can be read back: the ontology first."""
    spark = concepts.sparkSession
    head = spark.createDataFrame([(json.dumps({"kind": "ontology", **asdict(ontology)}),)], "value string")
    rows = {"concept": concepts, "relation": relations, "rule": rules, "action": actions}
    lines = {kind: df.select(F.to_json(F.struct(F.lit(kind).alias("kind"), *df.columns)).alias("value")) for kind, df in rows.items() if df is not None}
    return {"ontology": head} | lines


def write_jsonl(ontology: Ontology, concepts: DataFrame, relations: DataFrame, path: str, rules: DataFrame | None = None, actions: DataFrame | None = None) -> None:
    """One record a line, in folders whose names sort in the order in which they can be read back."""
    for k, (kind, lines) in enumerate(export_records(ontology, concepts, relations, rules, actions).items()):
        lines.write.text(f"{path}/{k}-{kind}")
