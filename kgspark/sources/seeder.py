"""A folder of graph files read into a graph, source after source in the order in which each may need those before it.

An ontology, records of ``seed.jsonl``, other record files, triples, a folder of texts for each type, workbooks, and the
records of ``relations.jsonl`` last.  Each is one stream of records, in the files' own order, with a retry of its own.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgspark.functions import text
from kgspark.operators.ingest import RECORD, Ingested, State, ingest_records
from kgspark.operators.mutate import dense_numbers
from kgspark.plans.lineage import settle

from . import directives, documents, records

_FIELDS = {f.split()[0]: f.split()[1] for f in RECORD.split(", ")}
#: Classes of sources in the order in which they are read.
CLASSES = ("ontology", "seed", "records", "triples", "texts", "workbook", "relations")


def _as_records(rows: DataFrame, order: list, **fields: Column) -> DataFrame:
    """The columns of RECORD, with seq in the order of ``order``."""
    taken = rows.select(*order, *[fields.get(c, F.lit(None)).cast(t).alias(c) for c, t in _FIELDS.items() if c != "seq"])
    numbered = dense_numbers(taken, [c for c in taken.columns if c not in _FIELDS], "seq")
    return numbered.select(*_FIELDS)


def jsonl_records(lines: DataFrame) -> DataFrame:
    """RECORD columns of JSON lines (at, line): one record a line, in the order of ``at``."""
    parsed = records.parse_jsonl(lines.withColumnRenamed("at", "line_no")).withColumnRenamed("line_no", "at")
    get = lambda name, kind="string": F.try_variant_get("payload", f"$.{name}", kind)
    raw = F.to_json("payload")
    kind = F.col("kind")
    typed = F.coalesce(get("concept_type"), get("relation_type"), get("rule_type"), get("action_type"))
    declares = kind.endswith("_decl") | (kind == "ontology")
    return _as_records(
        parsed, ["at"], kind=kind, id=F.coalesce(get("id", "bigint"), F.lit(0)), type=typed, name=get("name"), description=get("description"),
        properties=F.from_json(F.to_json(F.try_variant_get("payload", "$.properties", "variant")), "map<string,string>"), source=get("source", "bigint"), target=get("target", "bigint"),
        source_type=get("source_type"), source_name=get("source_name"), target_type=get("target_type"), target_name=get("target_name"), weight=get("weight", "double"), when=get("when"), then=get("then"),
        applies_to=F.when(kind == "rule", F.from_json(F.to_json(F.try_variant_get("payload", "$.applies_to", "variant")), "array<bigint>")), strict=get("strict", "boolean"), subject=F.when(kind == "action", get("subject", "bigint")),
        object=F.when(kind == "action", get("object", "bigint")), effect=get("effect"), declared=F.when(declares, raw),
    )


def triple_records(lines: DataFrame) -> DataFrame:
    """RECORD columns of triple lines (file, line_no, line): each subject and object once, where it first stands."""
    concepts, relations = records.parse_triples(lines)
    columns = ["at", "kind", "type", "name", "source_type", "source_name", "target_type", "target_name", "weight"]
    pick = lambda df, kind, **more: df.select(*[(more[c] if c in more else F.lit(kind) if c == "kind" else F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in columns if c != "weight"], F.lit(1.0).alias("weight"))
    rows = pick(concepts, "concept", at=F.col("first_seq"), type=F.col("concept_type")).unionByName(pick(relations, "named_relation", at=F.col("seq"), type=F.col("relation_type")))
    return _as_records(rows, ["at"], **{c: F.col(c) for c in columns if c != "at"}, id=F.lit(0))


def text_folder_records(spark: SparkSession, path: str, concept_type: str, extensions: tuple[str, ...] = ("txt", "md")) -> DataFrame:
    """RECORD columns of the texts in a folder, each a concept of the type with what its directives declare; the last name first."""
    files = spark.read.format("binaryFile").load(path).select("path", "content").filter(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*extensions))
    read = settle(documents.bodies(files))
    rows = directives.text_records(read.select(F.col("path").alias("doc"), F.lit(concept_type).alias("type"), "name", "body"))
    renamed = rows.withColumnRenamed("doc", "__doc")
    order = [F.col("__doc"), F.col("line_no"), F.col("m"), F.col("part")]
    taken = renamed.select(*order, *[F.col(c) for c in _FIELDS if c != "seq"])
    return dense_numbers(taken, [F.col("__doc").desc(), "line_no", "m", "part"], "seq").select(*_FIELDS)


def workbook_records(spark: SparkSession, path: str, concept_type: str) -> DataFrame:
    """RECORD columns of a workbook's rows, in their order."""
    rows = documents.read_sheets(spark, path, concept_type).withColumn("at", F.monotonically_increasing_id())
    return _as_records(rows, ["at"], kind=F.lit("concept"), id=F.lit(0), type=F.col("concept_type"), name=F.col("name"), description=F.col("description"), properties=F.col("properties"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, at, line of a file, in its order wherever it is cut."""
    rows = spark.read.text(path).select(F.lit(path).alias("file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__n"), F.col("value").alias("line"))
    first = rows.groupBy("__start").agg(F.min("__n").alias("__first"), F.count("*").alias("n"))
    begin = F.coalesce(F.sum("n").over(Window.orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row for each cut of the file
    return rows.join(F.broadcast(first.withColumn("begin", begin)), "__start").select("file", (F.col("begin") + F.col("__n") - F.col("__first")).alias("at"), "line")


def sources_of(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(class, path) of what a folder holds, in the order in which it is read; empty and other files are passed over."""
    base = path.rstrip("/")
    base = base if re.match(r"^[a-z0-9+.-]+:", base) else os.path.abspath(base)
    bare = re.sub(r"^[a-z0-9+.-]+:(//[^/]*)?", "", base)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select(F.substring_index("path", f"{bare}/", -1).alias("rel"))
    # top-level names only, whatever the number of files below them
    names = sorted({r[0] for r in listed.select(F.substring_index("rel", "/", 2).alias("n")).select(F.when(F.contains("n", F.lit("/")), F.concat(F.split_part("n", F.lit("/"), F.lit(1)), F.lit("/"))).otherwise(F.col("n")).alias("n")).distinct().collect()})
    out = []
    for name in names:
        end = name.rsplit(".", 1)[-1].lower()
        if name.endswith("/"):
            kind = "texts"
        elif name == "ontology.json":
            kind = "ontology"
        elif end in ("jsonl", "ndjson"):
            kind = {"seed.jsonl": "seed", "relations.jsonl": "relations"}.get(name, "records")
        else:
            kind = {"triples": "triples", "xlsx": "workbook", "ods": "workbook"}.get(end)
        if kind:
            out.append((kind, f"{base}/{name.rstrip('/')}"))
    return sorted(out, key=lambda x: (CLASSES.index(x[0]), x[1]))


def _concept_type(spark: SparkSession, name: str) -> str:
    return spark.range(1).select(text.infer_concept_type(F.lit(name))).first()[0]


def seed(spark: SparkSession, path: str, state: State | None = None) -> tuple[State, dict[str, int]]:
    """The graph after all sources of a folder, and how many records of each sort were applied; a failure raises."""
    state = state or State.empty(spark)
    totals: dict[str, int] = {}
    for kind, source in sources_of(spark, path):
        name = source.rsplit("/", 1)[-1]
        if kind == "ontology":
            whole = spark.read.text(source, wholetext=True)
            stream = whole.select(F.lit(0).cast("long").alias("seq"), F.lit("ontology").alias("kind"), F.col("value").alias("declared"))
            stream = stream.select(*[F.col(c) if c in stream.columns else F.lit(None).cast(t).alias(c) for c, t in _FIELDS.items()])
        elif kind in ("seed", "records", "relations"):
            stream = jsonl_records(_lines(spark, source).select("at", "line"))
        elif kind == "triples":
            stream = triple_records(_lines(spark, source).withColumnRenamed("at", "line_no"))
        elif kind == "texts":
            stream = text_folder_records(spark, source, _concept_type(spark, name))
        else:
            stream = workbook_records(spark, source, _concept_type(spark, name.rsplit(".", 1)[0]))
        got: Ingested = ingest_records(stream, state)
        if got.error:
            raise ValueError(f"{source}: {got.error} at record {got.failed_at}")
        state = got.state
        for sort, n in got.counts.items():
            totals[sort] = totals.get(sort, 0) + (0 if kind == "ontology" else n)
    return state, totals
