"""Readers of documents: charset, language, office files and directives in free text."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions import text
from kgspark.plans.lineage import ship_package

from . import charset, language

_WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

def docx_text(data: bytes) -> str:
    """Paragraphs of a word-processor file; breaks and tabs kept, runs of blank lines made one."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out: list[str] = []
    for element in root.iter():
        tag = element.tag.removeprefix(_WORD_NS)
        out.append({"t": element.text or "", "br": "\n", "tab": "\t"}.get(tag, ""))
        if tag == "p" and out:
            out.append("\n")
    # a paragraph's end follows its runs: iter() is in document order, so ends are put before the next paragraph's text
    joined = "".join(out)
    return re.sub(r"\n[ \t]*\n[ \t\n]*", "\n\n", joined).strip()


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"
_OFFICE_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_TABLE = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"
_OFFICE = "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}"
_TEXT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"


def _first_sheet(z: zipfile.ZipFile) -> str:
    """The part of a workbook that its first sheet in order is kept in."""
    names = set(z.namelist())
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= names:
        first = next(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_SHEET}sheet"), None)
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(f"{_REL}Relationship")}
        if first is not None and (target := targets.get(first.get(f"{_OFFICE_REL}id"))):
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if part in names:
                return part
    return sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: (len(n), n))[0]


def _xlsx_cells(z: zipfile.ZipFile) -> list[dict[int, object]]:
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        # phonetic readings beside a text are not part of it
        shared = ["".join(t.text or "" for run in [si, *si.findall(f"{_SHEET}r")] for t in run.findall(f"{_SHEET}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
    sheet = ElementTree.fromstring(z.read(_first_sheet(z)))

    def column(ref: str) -> int:
        n = 0
        for ch in re.match(r"[A-Z]+", ref)[0]:
            n = n * 26 + ord(ch) - 64
        return n

    rows = []
    for row in sheet.iter(f"{_SHEET}row"):
        cells: dict[int, object] = {}
        for k, c in enumerate(row.iter(f"{_SHEET}c"), 1):
            kind, v = c.get("t"), c.find(f"{_SHEET}v")
            inline = "".join(t.text or "" for t in c.iter(f"{_SHEET}t"))
            raw = v.text if v is not None else None
            value: object = shared[int(raw)] if kind == "s" else inline if kind == "inlineStr" else raw == "1" if kind == "b" else raw if kind in ("str", "e", "d") else float(raw) if raw is not None else None
            if value not in (None, ""):
                cells[column(c.get("r")) if c.get("r") else k] = value
        rows.append(cells)
    return rows


def _ods_cells(z: zipfile.ZipFile) -> list[dict[int, object]]:
    table = next(ElementTree.fromstring(z.read("content.xml")).iter(f"{_TABLE}table"))
    rows: list[dict[int, object]] = []
    for row in table.iter(f"{_TABLE}table-row"):
        cells: dict[int, object] = {}
        at = 1
        for c in row:
            if c.tag not in (f"{_TABLE}table-cell", f"{_TABLE}covered-table-cell"):
                continue
            kind = c.get(f"{_OFFICE}value-type")
            shown = "\n".join("".join(p.itertext()) for p in c.findall(f"{_TEXT}p"))
            value: object = c.get(f"{_OFFICE}boolean-value") == "true" if kind == "boolean" else float(c.get(f"{_OFFICE}value", "0")) if kind in ("float", "currency", "percentage") else shown
            times = int(c.get(f"{_TABLE}number-columns-repeated", "1"))
            if value != "":
                cells |= {at + k: value for k in range(times)}
            at += times
        # rows that are repeated without content fill a sheet to its end
        rows += [dict(cells) for _ in range(int(row.get(f"{_TABLE}number-rows-repeated", "1")) if cells else 1)]
    return rows


def sheet_rows(data: bytes) -> list[dict[str, object]]:
    """Rows of a workbook's first sheet (XLSX or ODS) by header; numbers and booleans typed, empty cells left out, nameless rows skipped."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        rows = _ods_cells(z) if "content.xml" in z.namelist() else _xlsx_cells(z)
    if not rows:
        return []
    header = {k: str(v).strip() for k, v in rows[0].items()}
    header = {k: v.lower() if v.lower() in ("name", "description") else v for k, v in header.items()}
    named = ({header[k]: v for k, v in r.items() if header.get(k)} for r in rows[1:])
    return [r for r in named if str(r.get("name", "")).strip()]


def read_documents(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("txt", "md")) -> DataFrame:
    """name (file stem), body, encoding, lang and is_binary of the files in a folder with one of the extensions, in any case."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    files = files.filter(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*extensions))
    return decoded(files)


def bodies(files: DataFrame) -> DataFrame:
    """path, name, body and encoding of (path, content)."""
    schema = pa.schema([("path", pa.string()), ("name", pa.string()), ("body", pa.string()), ("encoding", pa.string())])

    def run(batches):
        for batch in batches:
            paths = batch.column("path").to_pylist()
            read = [(docx_text(c), "docx") if p.lower().endswith(".docx") else charset.decode(c)[:2] for p, c in zip(paths, batch.column("content").to_pylist(), strict=True)]
            names = [re.sub(r"\.[^.]*$", "", p.rstrip("/").rsplit("/", 1)[-1]) for p in paths]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (paths, names, [b for b, _ in read], [e for _, e in read])], schema=schema)

    ship_package(files.sparkSession)
    return files.select("path", "content").mapInArrow(run, "path string, name string, body string, encoding string")


def decoded(files: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """name, body, encoding, lang, is_binary of (path, content); the language by the given profiles or those of the samples."""
    told = language.detected(bodies(files), "body", language.sample_profiles(files.sparkSession) if profiles is None else profiles)
    return told.select("name", "body", "encoding", "lang", text.looks_binary(F.col("body")).alias("is_binary"))


def read_sheets(spark: SparkSession, path: str, concept_type: str) -> DataFrame:
    """concept_type, name, description and properties (map of text) of the rows of workbooks."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def shown(v: object) -> str:
        return {True: "true", False: "false"}[v] if isinstance(v, bool) else f"{v:g}" if isinstance(v, float) and v == int(v) and abs(v) < 1e15 and len(f"{v:g}") < 16 and "e" not in f"{v:g}" else str(v)

    def run(frames):
        for f in frames:
            out = [(str(r["name"]).strip(), r["description"] if isinstance(r.get("description"), str) else "", {k: shown(v) for k, v in r.items() if k not in ("name", "description")}) for c in f["content"] for r in sheet_rows(bytes(c))]
            yield pd.DataFrame(out, columns=["name", "description", "properties"])

    ship_package(spark)
    return files.mapInPandas(run, "name string, description string, properties map<string,string>").withColumn("concept_type", F.lit(concept_type))


def directives(docs: DataFrame) -> DataFrame:
    """id, line_no, tag, rest of the directives in documents (id, body)."""
    return docs.select("id", F.explode(text.directive_lines(F.col("body"))).alias("d")).select("id", "d.*")


def declared_concepts(found: DataFrame) -> DataFrame:
    """id, concept_type, name of ``@concept Type:Name`` lines; others are passed over."""
    rows = found.filter("tag = 'concept'").withColumn("m", F.regexp_extract("rest", r"^([A-Za-z0-9_]+)\s*:\s*(.+)$", 1)).filter("m <> ''")
    return rows.select("id", F.col("m").alias("concept_type"), F.trim(F.regexp_extract("rest", r"^([A-Za-z0-9_]+)\s*:\s*([^|]+)", 2)).alias("name"))


def mentions(found: DataFrame) -> DataFrame:
    """Each distinct (type, name) that a document declares, as an edge type ``mentions_<type>``."""
    return declared_concepts(found).distinct().select("id", "concept_type", "name", F.concat(F.lit("mentions_"), F.lower("concept_type")).alias("relation_type"))
