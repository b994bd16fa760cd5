"""Directives in free text as typed records: each line that begins with a tag declares a type, a concept or a relation.

::

    @concept_type Name -- description
    @concept Type:Name -- description
    @relation_type predicate: Source -> Target [symmetric]
    @relation Type:Name -predicate-> Type:Name
    @rule [strict] name [on Type, Type]: when condition then consequence
    @action name: Subject [-> Object] [(parameter, parameter)] [=> effect]

The grammar is one pass of regular expressions over a line's rest, as Columns; lines that do not follow it are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions import text
from kgspark.operators.ingest import RECORD

_FIELDS = {f.split()[0]: f.split()[1] for f in RECORD.split(", ")}
_STRUCT = "struct<" + ",".join(f"`{c}`:{t}" for c, t in _FIELDS.items() if c != "seq") + ">"


def _record(kind: str, **fields: Column) -> Column:
    """One record; fields that are not given are null."""
    given = {"kind": F.lit(kind)} | fields
    return F.struct(*[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in _FIELDS.items() if c != "seq"])


def _declared(kind: str, **fields: Column) -> Column:
    """The declaration of a type; its fields as JSON, nulls left out."""
    return _record(f"{kind}_type_decl", declared=F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])))


def _concept_type(name: Column) -> Column:
    return _declared("concept", name=name, description=F.lit(""))


def _group(c: Column, pattern: str, n: int) -> Column:
    return F.trim(F.regexp_extract(c, pattern, n))


def _list(c: Column) -> Column:
    """The parts between commas, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


_HEAD = r"^(.*?)(?:--(.*))?$"
_TYPED = r"^\s*([^:]*):(.*)$"
_RELATION_TYPE = r"^([^:]+):(.*?)->(.*?)(\[symmetric\])?\s*$"
_RELATION = r"^([^:]+):((?:(?! -).)+) -((?:(?!-> ).)+)-> ([^:]+):(.+)$"
_RULE = r"^\s*(strict\s+)?([^:]*?)(?: on ([^:]*))?:(.*)$"
_THEN = r"(?i)^(.*?) then (.*)$"
_ACTION = r"^([^:]+):(.*)$"


def records_of(tag: Column, rest: Column) -> Column:
    """The records that a directive stands for, in order; an empty array for one that does not follow the grammar."""
    none = F.array().cast(f"array<{_STRUCT}>")
    whole = lambda *records: F.array(*records).cast(f"array<{_STRUCT}>")
    head, about = _group(rest, _HEAD, 1), _group(rest, _HEAD, 2)
    concept_type = F.when(head != "", whole(_declared("concept", name=head, description=about)))

    kind, name = _group(head, _TYPED, 1), _group(head, _TYPED, 2)
    concept = F.when((kind != "") & (name != ""), whole(_concept_type(kind), _record("concept", id=F.lit(0), type=kind, name=name, description=about)))

    predicate, source, target, mark = (_group(rest, _RELATION_TYPE, n) for n in (1, 2, 3, 4))
    relation_type = F.when((predicate != "") & (source != "") & (target != ""), whole(_declared("relation", name=predicate, domain=source, range=target, symmetric=mark != "")))

    st, sn, verb, tt, tn = (_group(rest, _RELATION, n) for n in (1, 2, 3, 4, 5))
    stated = (verb != "") & (st != "") & (sn != "") & (tt != "") & (tn != "")
    relation = F.when(stated, whole(_declared("relation", name=verb, domain=st, range=tt), _record("named_relation", type=verb, source_type=st, source_name=sn, target_type=tt, target_name=tn, weight=F.lit(1.0))))

    rule_name, scope, body = _group(rest, _RULE, 2), _list(F.regexp_extract(rest, _RULE, 3)), _group(rest, _RULE, 4)
    parted = F.regexp_like(body, F.lit(_THEN))
    when = F.when(parted, F.trim(F.regexp_replace(_group(body, _THEN, 1), "^when ", ""))).otherwise("")
    then = F.when(parted, _group(body, _THEN, 2)).otherwise(body)
    rule_type = _declared("rule", name=rule_name, when=when, then=then, applies_to=scope, strict=F.regexp_extract(rest, _RULE, 1) != "")
    rule = F.when((rule_name != "") & F.contains(rest, F.lit(":")), F.concat(F.transform(scope, _concept_type).cast(f"array<{_STRUCT}>"), whole(rule_type)))

    action_name, plan = _group(rest, _ACTION, 1), _group(rest, _ACTION, 2)
    effect = F.when(F.contains(plan, F.lit("=>")), F.trim(F.substr(plan, F.instr(plan, "=>") + 2))).otherwise("")
    ends = F.trim(F.substring_index(plan, "=>", 1))
    parameters = _list(F.regexp_extract(ends, r"\((.*)\)", 1))
    ends = F.trim(F.regexp_replace(ends, r"\(.*\)", ""))
    subject = F.trim(F.substring_index(ends, "->", 1))
    to = F.nullif(F.when(F.contains(ends, F.lit("->")), F.trim(F.substr(ends, F.instr(ends, "->") + 2))), F.lit(""))
    action_type = _declared("action", name=action_name, subject=subject, object=to, parameters=parameters, effect=effect)
    with_object = F.when(to.isNotNull(), whole(_concept_type(to))).otherwise(none)
    action = F.when((action_name != "") & (subject != ""), F.concat(whole(_concept_type(subject)), with_object, whole(action_type)))

    by_tag = {"concept_type": concept_type, "concept": concept, "relation_type": relation_type, "relation": relation, "rule": rule, "action": action}
    out = none
    for word, records in by_tag.items():
        out = F.when(tag == word, F.coalesce(records, none)).otherwise(out)
    return out


def text_records(docs: DataFrame) -> DataFrame:
    """doc, line_no, part and the columns of RECORD but seq, of documents (doc, type, name, body); in the order of these three.

    A document is declared and stated first, its text as description (bounded; a note in place of binary content); then
    its directives, line by line; then a relation to each thing that its concepts and relations name, under a type of its
    own for each of their types.
    """
    told = text.bounded_description(F.col("body"))
    stated = F.array(_concept_type(F.col("type")), _record("concept", id=F.lit(0), type=F.col("type"), name=F.col("name"), description=told)).cast(f"array<{_STRUCT}>")
    first = docs.select("doc", F.lit(0).alias("line_no"), F.posexplode(stated).alias("part", "r"))
    lines = docs.select("doc", "type", "name", F.explode(text.directive_lines(F.col("body"))).alias("d"))
    parsed = lines.select("doc", "type", "name", "d.line_no", F.posexplode(records_of(F.col("d.tag"), F.col("d.rest"))).alias("part", "r"))
    named = F.filter(
        F.array(F.struct(F.when(F.col("r.kind") == "concept", F.col("r.type")).otherwise(F.col("r.source_type")).alias("t"), F.when(F.col("r.kind") == "concept", F.col("r.name")).otherwise(F.col("r.source_name")).alias("n")), F.struct(F.col("r.target_type").alias("t"), F.col("r.target_name").alias("n"))),
        lambda x: x["n"].isNotNull(),
    )
    mentions = parsed.filter(F.col("r.kind").isin("concept", "named_relation")).select("doc", "type", "name", F.explode(named).alias("m")).distinct()
    verb = F.concat(F.lit("mentions_"), F.lower("m.t"))
    linked = F.array(
        _declared("relation", name=verb, domain=F.col("type"), range=F.col("m.t")),
        _record("named_relation", type=verb, source_type=F.col("type"), source_name=F.col("name"), target_type=F.col("m.t"), target_name=F.col("m.n"), weight=F.lit(1.0)),
    ).cast(f"array<{_STRUCT}>")
    # mentions come after all lines, in the order of their names, which stand in for the number of a line
    last = mentions.select("doc", "m", F.posexplode(linked).alias("part", "r"))
    columns = [F.col("doc"), F.col("line_no"), F.lit(None).cast("struct<t:string,n:string>").alias("m"), F.col("part"), F.col("r.*")]
    out = first.select(columns).unionByName(parsed.select(columns))
    end = F.lit((1 << 31) - 1).alias("line_no")
    return out.unionByName(last.select("doc", end, "m", "part", "r.*"))
