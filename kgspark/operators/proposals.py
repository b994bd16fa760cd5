"""Proposals that a model draws from documents: flattened, merged, held against the graph and applied after review.

Items of all six kinds stand in one table (columns of ITEM).  ``type`` is that of a concept, relation, rule or action;
``source_ref`` and ``target_ref`` are the ends of a relation, or the subject and object of an action.  A ref is a
client_ref or ``Type:Name``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.functions.text import strip_fences
from kgspark.plans.lineage import settle

from .ingest import END, History, State, _base_history, _few
from .ontology import Ontology

#: Kinds of items in the order in which they are applied, and how refs name them (fixed values).
KINDS = {"concept_type": "ct", "relation_type": "rt", "concept": "c", "relation": "r", "rule": "ru", "action": "a"}
#: What a model's reply is read as; fields that are missing are null.
REPLY = (
    "concept_types array<struct<name: string, description: string, properties: array<string>, parent: string, confidence: double>>,"
    " relation_types array<struct<name: string, domain: string, range: string, symmetric: boolean, description: string, confidence: double>>,"
    " concepts array<struct<concept_type: string, name: string, description: string, properties: array<array<string>>, evidence: string, confidence: double>>,"
    " relations array<struct<relation_type: string, source_ref: string, target_ref: string, weight: double, evidence: string, confidence: double>>,"
    " rules array<struct<rule_type: string, name: string, when: string, then: string, applies_to: array<string>, strict: boolean, description: string, evidence: string, confidence: double>>,"
    " actions array<struct<action_type: string, name: string, subject_ref: string, object_ref: string, parameters: array<array<string>>, effect: string, description: string, evidence: string, confidence: double>>"
)
ITEM = {
    "file_no": "long", "chunk": "long", "item": "int", "kind": "string", "client_ref": "string", "type": "string", "name": "string", "description": "string", "properties": "map<string,string>",
    "property_names": "array<string>", "parent": "string", "domain": "string", "range": "string", "symmetric": "boolean", "source_ref": "string", "target_ref": "string", "weight": "double", "when": "string",
    "then": "string", "applies_to": "array<string>", "strict": "boolean", "effect": "string", "evidence": "string", "confidence": "double",
}
_ORDER = ("file_no", "chunk", "item")
#: Type declarations that one proposal may make; they are folded on the driver.
MAX_TYPES = 100_000
#: A ref that is used more often is looked up where its uses lie, so that no task gets them all.
HOT = 10_000
#: Rows that follow one another and are numbered together: 2 to this power at most.
RUN = 16


def _pairs(c: Column) -> Column:
    """A map of [key, value] pairs; the last value of a key counts."""
    keys = F.array_distinct(F.transform(c, lambda p: F.get(p, F.lit(0))))
    last = lambda k: F.get(F.element_at(F.filter(c, lambda p: F.get(p, F.lit(0)).eqNullSafe(k)), -1), F.lit(1))
    keys = F.filter(keys, lambda k: k.isNotNull())
    return F.map_from_arrays(keys, F.transform(keys, last))


def as_items(df: DataFrame) -> DataFrame:
    """``df`` with all columns of ITEM, null where it has none."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in ITEM.items()])


def parse_replies(replies: DataFrame) -> DataFrame:
    """Items of model replies (file_no, chunk, reply).

    A reply may stand in a code fence; one that is no JSON has no items.  Items are named c{chunk}-{kind}-{number}.
    """
    parsed = replies.select("file_no", "chunk", F.from_json(strip_fences(F.col("reply")), REPLY).alias("r"))
    # one reading of a reply gives its items of all kinds; an outer explode, since a plain one would parse again to filter
    lists = F.concat(*[F.coalesce(F.transform(f"r.{kind}s", _item_of(kind)), F.array().cast(_ITEMS)) for kind in KINDS])
    rows = parsed.select("file_no", "chunk", F.explode_outer(lists).alias("x")).filter("x.kind IS NOT NULL")
    return rows.select(*[(F.col(c) if c in ("file_no", "chunk") else F.col(f"x.{c}")).cast(t).alias(c) for c, t in ITEM.items()])


_ITEMS = "array<struct<" + ",".join(f"`{c}`:{t}" for c, t in ITEM.items() if c not in ("file_no", "chunk")) + ">>"


def _item_of(kind: str) -> Callable[[Column, Column], Column]:
    """An entry of a reply's list of a kind, and its number, as an item."""
    none = F.lit(None)

    def item(x: Column, n: Column) -> Column:
        ref = F.concat(F.lit("c"), F.coalesce(F.col("chunk").cast("int").cast("string"), F.lit("null")), F.lit(f"-{KINDS[kind]}-"), n.cast("string"))
        fields = {
            "concept_type": lambda: {"name": x["name"], "description": x["description"], "property_names": x["properties"], "parent": x["parent"]},
            "relation_type": lambda: {"name": x["name"], "domain": x["domain"], "range": x["range"], "symmetric": x["symmetric"], "description": x["description"]},
            "concept": lambda: {"type": x["concept_type"], "name": x["name"], "description": x["description"], "properties": _pairs(x["properties"]), "evidence": x["evidence"]},
            "relation": lambda: {"type": x["relation_type"], "source_ref": x["source_ref"], "target_ref": x["target_ref"], "weight": x["weight"], "evidence": x["evidence"]},
            "rule": lambda: {"type": x["rule_type"], "name": x["name"], "when": x["when"], "then": x["then"], "applies_to": x["applies_to"], "strict": x["strict"], "description": x["description"], "evidence": x["evidence"]},
            "action": lambda: {"type": x["action_type"], "name": x["name"], "source_ref": x["subject_ref"], "target_ref": x["object_ref"], "properties": _pairs(x["parameters"]), "effect": x["effect"], "description": x["description"], "evidence": x["evidence"]},
        }[kind]()
        given = {"item": n, "kind": F.lit(kind), "client_ref": ref, "confidence": F.coalesce(x["confidence"], F.lit(0.0))} | fields
        return F.struct(*[given.get(c, none).cast(t).alias(c) for c, t in ITEM.items() if c not in ("file_no", "chunk")])

    return item


def _kept(items: DataFrame, by: list[Column], best: Column) -> DataFrame:
    """One item of each key, the one with the largest ``best``."""
    keys = [f"__k{k}" for k in range(len(by))]
    rows = items.withColumns(dict(zip(keys, by, strict=True)))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*items.columns), best).alias("r")).select("r.*")


def merge_chunks(items: DataFrame) -> DataFrame:
    """The items of each file with those that chunks repeat once: concept types of a name and concepts of a type and trimmed
    name in any case keep the most confident, of equals the first; relation types of a name the first; others all."""
    kind = F.col("kind")
    # one pass over the kinds that merge: a key names its kind, and relation types are all equally sure
    sure = F.when(kind != "relation_type", F.col("confidence"))
    name = F.when(kind == "concept", F.lower(F.trim("name"))).otherwise(F.col("name"))
    kept = _kept(items.filter(kind.isin("concept_type", "relation_type", "concept")), [F.col("file_no"), kind, F.when(kind == "concept", F.col("type")), name], F.struct(sure, -F.col("chunk"), -F.col("item")))
    return kept.unionByName(items.filter(kind.isin("relation", "rule", "action")))


def merge_concepts(items: DataFrame) -> DataFrame:
    """One concept for each (type, trimmed name in any case) of a file: the most confident, of equals the first.

    items: chunk, item, client_ref, concept_type, name, description, confidence.
    """
    key = [F.col("concept_type"), F.lower(F.trim("name")).alias("key")]
    best = F.max_by(F.struct("client_ref", "name", "description", "confidence"), F.struct("confidence", -F.col("chunk"), -F.col("item")))
    return items.groupBy(*key).agg(best.alias("b"), F.count("*").alias("n_merged")).select("concept_type", "key", "b.client_ref", "b.name", "b.description", "b.confidence", "n_merged")


def _is_graph_ref(c: Column) -> Column:
    return F.contains(c, F.lit(":")) & ~F.coalesce(F.regexp_like(c, F.lit("^f[0-9]+/")), F.lit(False))


def lead_on(links: DataFrame, hops: int = 4) -> DataFrame:
    """ref, end: where each ref leads after at most ``hops`` links (ref, to; one a ref), a power of two, by pointer jumping."""
    jump = links.filter("ref <> to").select("ref", F.col("to").alias("end"))
    for _ in range(hops.bit_length() - 1):
        on = jump.select(F.col("ref").alias("end"), F.col("end").alias("__on"))
        jump = settle(jump.join(on, "end", "left").select("ref", F.coalesce("__on", "end").alias("end")))
    return jump


def merge_files(items: DataFrame) -> DataFrame:
    """The items of several files (numbered from 0) as one proposal.

    Refs get a file prefix; of items with the same natural key (types by name, concepts by type and trimmed name in any
    case, relations by type and ends, rules and actions by type and name) the first stays, and refs to others lead to
    it, on through at most four links.  Refs to nothing in their file, and ``Type:Name``, stay as they are.
    """
    prefixed = lambda c: F.concat(F.lit("f"), F.col("file_no").cast("string"), F.lit("/"), c)
    rows = items.withColumn("client_ref", prefixed(F.col("client_ref")))
    local = rows.select("file_no", F.col("client_ref").alias("__to")).distinct()
    first = -F.col("file_no"), -F.col("chunk"), -F.col("item")
    by = {"concept_type": ["name"], "relation_type": ["name"], "concept": ["type", F.lower(F.trim("name"))], "rule": ["type", "name"], "action": ["type", "name"]}

    def settled(kind: str, df: DataFrame, keys: list) -> tuple[DataFrame, DataFrame]:
        """The first of each key, and links from the others to it."""
        columns = [F.col(k) if isinstance(k, str) else k for k in keys]
        names = [f"__k{k}" for k in range(len(columns))]
        keyed = df.withColumns(dict(zip(names, columns, strict=True)))
        firsts = keyed.groupBy(*names).agg(F.max_by(F.struct(*df.columns), F.struct(*first)).alias("r"))
        same = F.lit(True)
        for n in names:
            same = same & F.col(f"k.{n}").eqNullSafe(F.col(f"f.{n}"))
        again = keyed.alias("k").join(firsts.alias("f"), same).filter(F.col("k.client_ref") != F.col("f.r.client_ref"))
        again = again.select(F.lit(kind).alias("kind"), *[f"k.{c}" for c in _ORDER], F.col("k.client_ref").alias("ref"), F.col("f.r.client_ref").alias("to"))
        return firsts.select("r.*"), again

    kept, links = {}, []
    for kind, keys in by.items():
        kept[kind], more = settled(kind, rows.filter(F.col("kind") == kind), keys)
        links.append(more)
    link_rows = links[0]
    for more in links[1:]:
        link_rows = link_rows.unionByName(more)
    phase = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    canonical = lead_on(settle(link_rows.groupBy("ref").agg(F.max_by("to", F.struct("file_no", phase, "chunk", "item")).alias("to"))))

    def rewritten(df: DataFrame, column: str) -> DataFrame:
        """Local refs prefixed, then led on."""
        with_local = df.withColumn("__to", F.when(~_is_graph_ref(F.col(column)), prefixed(F.col(column))))
        known = with_local.join(local.withColumn("__known", F.lit(True)), ["file_no", "__to"], "left")
        named = known.withColumn(column, F.when(F.col("__known"), F.col("__to")).otherwise(F.col(column))).drop("__to", "__known")
        return named.join(canonical.withColumnsRenamed({"ref": column, "end": "__end"}), column, "left").withColumn(column, F.coalesce("__end", column)).drop("__end")

    ends = rewritten(rewritten(rows.filter("kind = 'relation'"), "source_ref"), "target_ref").select(rows.columns)
    kept["relation"] = settled("relation", ends, ["type", "source_ref", "target_ref"])[0]
    kept["action"] = rewritten(rewritten(kept["action"], "source_ref"), "target_ref").select(rows.columns)
    scoped = kept["rule"].select("client_ref", "file_no", F.posexplode("applies_to").alias("__n", "__ref"))
    scopes = rewritten(scoped, "__ref").groupBy("client_ref").agg(F.array_sort(F.collect_list(F.struct("__n", "__ref"))).alias("__s"))
    kept["rule"] = kept["rule"].join(scopes, "client_ref", "left").withColumn("applies_to", F.coalesce(F.col("__s.__ref"), "applies_to")).select(rows.columns)
    out = kept["concept_type"]
    for kind in list(KINDS)[1:]:
        out = out.unionByName(kept[kind])
    return out


def _typed_key(ref: Column) -> tuple[Column, Column]:
    """Type and lower-case name of a Type:Name ref, nulls for others."""
    has = F.contains(ref, F.lit(":"))
    return F.when(has, F.substring_index(ref, ":", 1)), F.when(has, F.lower(F.substr(ref, F.instr(ref, ":") + 1)))


def conflicts(items: DataFrame, ontology: Ontology, graph: DataFrame) -> DataFrame:
    """kind, client_ref, conflict, detail: types and concepts that exist, relations and actions with a dangling end.

    A ref may name a proposed concept (its client_ref, or its type and name by case) or one of the graph (id, concept_type,
    name) by type and name in any case.  The source or subject is named before the target or object; rules are never
    flagged.
    """
    spark = items.sparkSession
    declared = [("concept_type", x.name) for x in ontology.concept_types] + [("relation_type", x.name) for x in ontology.relation_types]
    types = F.broadcast(spark.createDataFrame(declared, "kind string, name string"))
    found = items.join(types, ["kind", "name"]).select("kind", "client_ref", F.lit("exists").alias("conflict"), F.col("name").alias("detail"))
    keyed = graph.groupBy(F.col("concept_type").alias("type"), F.lower("name").alias("key")).agg(F.min("id").alias("id"))
    concepts = items.filter("kind = 'concept'").withColumn("key", F.lower("name"))
    exists = concepts.join(keyed, ["type", "key"]).select("kind", "client_ref", F.lit("exists").alias("conflict"), F.col("id").cast("string").alias("detail"))
    proposed = concepts.select(F.col("client_ref").alias("ref")).union(concepts.select(F.concat_ws(":", "type", "name"))).distinct().withColumn("__p", F.lit(True))
    ends = items.filter("kind IN ('relation', 'action')").select("kind", "client_ref", F.explode(F.array(F.struct(F.lit(0).alias("n"), F.col("source_ref").alias("ref")), F.struct(F.lit(1).alias("n"), F.col("target_ref").alias("ref")))).alias("e"))
    ends = ends.select("kind", "client_ref", "e.n", "e.ref").filter("ref IS NOT NULL OR kind = 'relation' OR n = 0")
    kind, key = _typed_key(F.col("ref"))
    missing = ends.join(proposed, "ref", "left").withColumns({"__type": kind, "__key": key}).join(keyed.select(F.col("type").alias("__type"), F.col("key").alias("__key"), "id"), ["__type", "__key"], "left").filter("__p IS NULL AND id IS NULL")
    dangling = missing.groupBy("kind", "client_ref").agg(F.lit("dangling_ref").alias("conflict"), F.coalesce(F.min_by("ref", "n"), F.lit("")).alias("detail"))
    return found.unionByName(exists).unionByName(dangling)


@dataclass
class Applied:
    """The graph after a reviewed proposal; kind, client_ref, outcome (created, merged, skipped or failed), id and code of each item."""

    state: State
    report: DataFrame


def accepted_in_order(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """at of the rows that are accepted one after another: none may check a slot that an accepted one before it holds.

    rows: at, checked and held (arrays of strings); taken: slots held before all.  Each round decides every row that is the
    first to hold all it checks, and those that these leave out.
    """
    left = rows.select("at", "checked", "held")
    accepted = left.select("at").limit(0)
    blocked = left.select("at", F.explode("checked").alias("slot")).join(taken.select("slot"), "slot", "left_semi").select("at").distinct()
    left = settle(left.join(blocked, "at", "left_anti"))
    while not left.isEmpty():
        first = left.select("at", F.explode("held").alias("slot")).groupBy("slot").agg(F.min("at").alias("first"))
        checks = left.select("at", F.explode_outer("checked").alias("slot")).join(first, "slot", "left")
        won = settle(checks.groupBy("at").agg(F.min(F.col("slot").isNull() | (F.col("first") >= F.col("at"))).alias("ok")).filter("ok").select("at"))
        accepted = accepted.unionByName(won)
        held = left.join(won, "at").select(F.col("at").alias("by"), F.explode("held").alias("slot")).groupBy("slot").agg(F.min("by").alias("by"))
        left = left.join(won, "at", "left_anti")
        out = left.select("at", F.explode("checked").alias("slot")).join(held, "slot").filter("by < at").select("at").distinct()
        left = settle(left.join(out, "at", "left_anti"))
    return settle(accepted)


def _ontology_after(types: DataFrame, ontology: Ontology) -> tuple[History, Ontology]:
    """The ontology with the accepted types (kind, pos and their fields), the last of each name."""
    columns = ["kind", "pos", "name", "description", "property_names", "parent", "domain", "range", "symmetric"]
    last = types.groupBy("kind", "name").agg(F.max_by(F.struct(*columns), "pos").alias("r")).select("r.*").limit(MAX_TYPES + 1).collect()
    if len(last) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} types in a proposal")
    h = _base_history(ontology)
    for r in sorted(last, key=lambda r: (r.kind != "concept_type", r.pos)):
        fields = {"name": r.name, "description": r.description or ""}
        if r.kind == "concept_type":
            h.apply("concept_type_decl", fields | {"properties": r.property_names or None, "parent": r.parent}, 0)
        else:
            h.apply("relation_type_decl", fields | {"domain": r.domain, "range": r.range, "symmetric": bool(r.symmetric)}, 0)
    h = h.closed()
    return h, h.ontology_at(END)


def _claims(there: DataFrame, asks: DataFrame, disjoint: DataFrame) -> DataFrame:
    """key, type, there, claim, apart_from: the concept of the graph with a name, else the pos at which one is first made,
    and the pos after which a disjoint type has the name (-1 if the graph's has).

    there: type, key, id; asks: type, key, pos of concepts that could be made by themselves; disjoint: type, apart.
    """
    none = F.lit(None).cast("long")
    rows = there.select("key", "type", F.col("id").alias("there"), none.alias("pos")).unionByName(asks.select("key", "type", none.alias("there"), "pos"))
    each = settle(rows.filter("key IS NOT NULL AND type IS NOT NULL").groupBy("key", "type").agg(F.min("pos").alias("pos"), F.min("there").alias("there")))
    # only where types that exclude others share a name does one claim hang on another
    related = F.broadcast(disjoint.select("type").union(disjoint.select(F.explode("apart"))).distinct())
    shared = _few(settle(each.join(related, "type", "left_semi").groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")))
    free = each.join(shared, "key", "left_anti").select("key", "type", "there", F.when(F.col("there").isNull(), F.col("pos")).otherwise(-1).alias("claim"), none.alias("apart_from"))
    # one entry a type, so an array has no more than there are types
    entry = F.struct("pos", "type", "there", F.coalesce("apart", F.array().cast("array<string>")).alias("apart"))
    named = each.join(shared, "key", "left_semi").join(disjoint, "type", "left").groupBy("key").agg(F.array_sort(F.collect_list(entry)).alias("es"))
    held = F.transform(F.filter("es", lambda e: e["there"].isNotNull()), lambda e: e["type"])
    start = F.struct(held.alias("held"), F.array().cast("array<string>").alias("won"))
    add = lambda acc, e: F.struct(F.concat(acc["held"], F.array(e["type"])).alias("held"), F.concat(acc["won"], F.array(e["type"])).alias("won"))
    step = lambda acc, e: F.when(F.arrays_overlap(acc["held"], e["apart"]), acc).otherwise(add(acc, e))
    named = named.withColumn("won", F.aggregate(F.filter("es", lambda e: e["there"].isNull()), start, step)["won"])
    claim = lambda e: F.when(e["there"].isNotNull(), -1).when(F.array_contains("won", e["type"]), e["pos"])
    others = lambda e: F.filter("es", lambda o: F.array_contains(e["apart"], o["type"]))
    after = lambda e: F.struct(e["type"].alias("type"), e["there"].alias("there"), claim(e).alias("claim"), F.array_min(F.transform(others(e), claim)).alias("apart_from"))
    return free.unionByName(named.select("key", F.explode(F.transform("es", after)).alias("e")).select("key", "e.*"))


def _numbered(rows: DataFrame, start: int) -> tuple[DataFrame, int]:
    """``rows`` (pos, sub and a flag ``counts``) with new_id, from ``start`` on in order for those that count, and the next id.

    Rows that follow one another are numbered together, those that count before others; each run goes on where those
    before it end.
    """
    run = F.shiftright("pos", RUN)
    ordered = rows.withColumn("__run", run).repartition("__run").sortWithinPartitions("__run", F.col("counts").desc(), "pos", "sub")
    rows = settle(ordered.withColumn("__n", F.monotonically_increasing_id()))
    earlier = Window.orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("__run").agg(F.min("__n").alias("__first"), F.count_if("counts").alias("n"))
    # one row for each run
    runs = settle(runs.select("__run", "__first", "n", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) + F.lit(start).cast("long")).alias("__start")))
    new = F.when(F.col("counts"), F.col("__start") + F.col("__n") - F.col("__first"))
    named = rows.join(F.broadcast(runs.drop("n")), "__run").withColumn("new_id", new).drop("__run", "__n", "__first", "__start")
    return named, start + (runs.agg(F.sum("n")).first()[0] or 0)


def _found(asked: DataFrame, named: DataFrame, owners: DataFrame) -> DataFrame:
    """ref, n, id, of_kind: the concept that each ref (used n times) names: one just applied, else one by type and name in
    any case, or none.

    named: ref, pos, id, type; owners: key, type, id.
    """
    last = named.groupBy("ref").agg(F.max_by(F.struct("id", "type"), "pos").alias("r"))
    kind, key = _typed_key(F.col("ref"))
    refs = settle(asked.join(last.hint("shuffle_hash"), "ref", "left").select("ref", "n", "r.id", F.coalesce("r.type", kind).alias("of_kind"), key.alias("key")))
    left = F.col("id").isNull() & F.col("key").isNotNull()
    wanted = _few(settle(refs.filter(left).select(F.col("of_kind").alias("type"), "key").distinct()))
    ids = owners.join(wanted, ["key", "type"]).groupBy("key", "type").agg(F.min("id").alias("id"))
    ids = _few(settle(ids.withColumnRenamed("type", "of_kind")))
    more = refs.filter(left).drop("id").join(ids, ["key", "of_kind"], "left")
    columns = ["ref", "n", "id", "of_kind"]
    return settle(refs.filter(~left).select(columns).unionByName(more.select(columns)))


def _resolved(rows: DataFrame, column: str, found: DataFrame, hot: DataFrame, to: str) -> DataFrame:
    """``rows`` with the id and type of the concept that a ref names; refs that many use (hot) and nulls stay where they lie."""
    names = lambda df: df.select(F.col("ref").alias(column), F.col("id").alias(to), F.col("of_kind").alias(f"{to}_kind"))
    often = F.broadcast(names(hot).withColumn("__hot", F.lit(True)))
    here = rows.join(often, column, "left").filter(F.col(column).isNull() | F.col("__hot")).drop("__hot")
    rest = rows.filter(F.col(column).isNotNull()).join(F.broadcast(hot.select(F.col("ref").alias(column))), column, "left_anti")
    return here.unionByName(rest.join(names(found).hint("shuffle_hash"), column, "left"))


def apply_proposal(items: DataFrame, decisions: DataFrame, state: State, lang: str | None = None, default: str = "skip", strict: bool = False) -> Applied:
    """Apply the items (columns of ITEM) that a reviewer lets through: types, then concepts, relations, rules and actions.

    decisions: client_ref, action (create_new, merge or skip), one a ref; ``default`` holds for others.  A concept to merge
    that is there gets the name, and the description and properties that are not empty; one whose properties do not fit
    fails and keeps name and description.  Others are created, with ``lang`` as a property.  What refers to a concept that
    failed or was skipped, and is not in the graph, fails in turn; a rule loses such a scope and an action such an
    object.  Under ``strict`` the first failure ends it: later items are not in the report.

    Items get a number (pos) in the order in which they are applied, and keep all that their result needs as they are
    judged, so that ids and outcomes are joined to no row again.
    """
    spark = items.sparkSession
    phase = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    # tables with one row a key are hashed, so that the rows that they are joined to are not sorted
    chosen = decisions.select("client_ref", F.col("action").alias("__action")).hint("shuffle_hash")
    rows = as_items(items).drop("evidence", "confidence").withColumn("phase", phase).join(chosen, "client_ref", "left")
    rows = rows.withColumn("action", F.coalesce("__action", F.lit(default))).drop("__action")
    rows = rows.repartitionByRange("phase", *_ORDER).sortWithinPartitions("phase", *_ORDER)
    rows = settle(rows.drop("phase", *_ORDER).withColumn("pos", F.monotonically_increasing_id()))
    goes = F.coalesce(F.col("action") != "skip", F.lit(False)) & F.col("kind").isin(*KINDS)
    live = rows.filter(goes)
    of = lambda k: live.filter(F.col("kind") == k)
    empty_map, empty_list = F.create_map().cast("map<string,string>"), F.array().cast("array<string>")
    reported = ["pos", "kind", "client_ref", "outcome", "id", "code"]
    none = F.lit(None).cast("string")
    skipped = rows.filter(~F.coalesce(goes, F.lit(False))).withColumns({"outcome": F.lit("skipped"), "id": none, "code": none}).select(reported)

    # types
    known = spark.createDataFrame([(x.name,) for x in state.ontology.concept_types], "name string").union(of("concept_type").select("name")).distinct()
    fits = lambda c: known.select(F.col("name").alias(c), F.lit(True).alias(f"__{c}"))
    checked = of("relation_type").join(fits("domain"), "domain", "left").join(fits("range"), "range", "left").withColumn("ok", F.col("__domain").isNotNull() & F.col("__range").isNotNull())
    checked = settle(of("concept_type").withColumn("ok", F.lit(True)).unionByName(checked.select(*live.columns, "ok")))
    report_types = checked.withColumns({"outcome": F.when(F.col("ok"), "created").otherwise("failed"), "id": F.when(F.col("ok"), F.col("name")), "code": F.when(~F.col("ok"), "UnknownConceptType")}).select(reported)
    accepted_types = checked.filter("ok")
    if strict and (stop := checked.filter("NOT ok").agg(F.min("pos")).first()[0]) is not None:
        accepted_types = accepted_types.filter((F.col("kind") == "concept_type") | (F.col("pos") < stop))
    history, ontology = _ontology_after(accepted_types, state.ontology)
    types = history.table(spark, "concept_type_decl").filter(F.col("until") == END).select(F.col("name").alias("type"), "allowed", "required", F.lit(True).alias("known"))
    apart = {}
    for a, b, _, until in history.pairs["disjoint"]:
        if until == END:
            apart.setdefault(a, []).append(b)
    disjoint = F.broadcast(spark.createDataFrame([(k, v) for k, v in apart.items()], "type string, apart array<string>"))

    # concepts: whether each could be created or updated by itself, then who comes first to a name
    there = state.concepts.select(F.col("concept_type").alias("type"), F.lower("name").alias("key"), "id")
    given = F.coalesce("properties", empty_map)
    full = given
    if lang:
        full = F.when(F.map_contains_key(given, "lang"), given).otherwise(F.map_concat(F.create_map(F.lit("lang"), F.lit(lang)), given))
    concepts = of("concept").select("pos", "kind", "client_ref", "type", "name", "description", "action", F.lower("name").alias("key"), given.alias("given"), full.alias("full")).join(types, "type", "left")
    code = lambda m: F.when(F.col("known").isNull(), 1).when(F.col("allowed").isNotNull() & (F.size(F.array_except(F.map_keys(m), "allowed")) > 0), 2).when(F.size(F.array_except("required", F.map_keys(m))) > 0, 3)
    concepts = concepts.withColumns({"bad_create": code(F.col("full")), "bad_update": F.when(F.size("given") > 0, code(F.col("given")))}).drop("known", "allowed", "required")
    judged = concepts.join(_claims(there, concepts.filter("bad_create IS NULL"), disjoint).hint("shuffle_hash"), ["key", "type"], "left")
    before = F.col("there").isNotNull() | F.coalesce(F.col("claim") < F.col("pos"), F.lit(False))
    update = before & (F.col("action") == "merge")
    n = F.when(update, F.col("bad_update")).otherwise(F.coalesce("bad_create", F.when(F.col("apart_from") < F.col("pos"), 4), F.when(before, 5)))
    judged = judged.withColumns({"update": update, "n": n}).drop("action", "bad_create", "bad_update", "apart_from")
    # a name that is taken is found out after the counter has moved
    counts = ~F.col("update") & F.coalesce(F.col("n") == 5, F.lit(True))
    judged, next_id = _numbered(judged.withColumns({"counts": counts, "sub": F.lit(0)}), state.next_id)
    codes = F.array(*[F.lit(x) for x in ("UnknownConceptType", "InvalidProperty", "MissingRequiredProperty", "DisjointTypeViolation", "DuplicateConcept")])

    # what each concept is now; one that merges into another of the proposal has its id
    created = judged.filter("NOT update AND n IS NULL").drop("there", "claim")
    onto = judged.filter("update AND there IS NOT NULL").withColumn("new_id", F.col("there")).select(created.columns)
    ids = created.select(F.col("pos").alias("claim"), F.col("new_id").alias("__id"))
    late = judged.filter("update AND there IS NULL").join(ids, "claim").withColumn("new_id", F.col("__id")).select(created.columns)
    changes = created.unionByName(onto).unionByName(late)
    outcome = F.when(F.col("n").isNotNull(), "failed").when(F.col("update"), "merged").otherwise("created")
    tried = changes.unionByName(judged.filter("NOT update AND n IS NOT NULL").select(created.columns))
    report_concepts = tried.withColumns({"outcome": outcome, "id": F.when(F.col("n").isNull(), F.col("new_id").cast("string")), "code": F.get(codes, F.col("n") - 1)}).select(reported)

    # what the refs name, each looked up once
    used = F.when(F.col("kind") == "rule", F.col("applies_to")).otherwise(F.array("source_ref", "target_ref"))
    asked = live.filter("kind IN ('relation', 'rule', 'action')").select(F.explode(used).alias("ref")).filter("ref IS NOT NULL").groupBy("ref").agg(F.count("*").alias("n"))
    done = changes.filter("n IS NULL").select("client_ref", "type", "name", "pos", F.col("new_id").alias("id"))
    done = done.select(F.explode(F.array("client_ref", F.concat_ws(":", "type", "name"))).alias("ref"), "pos", "id", "type")
    found = _found(asked, done, there.unionByName(created.select("type", "key", F.col("new_id").alias("id"))))
    hot = settle(found.filter(F.col("n") > HOT))
    resolved = lambda df, column, to: _resolved(df, column, found, hot, to)

    # relations, checked against the types and then one after another where a type allows only one
    columns = ["pos", "kind", "client_ref", "type", "name", "description", "weight", "effect"]
    ends = resolved(resolved(live.filter("kind IN ('relation', 'action')").select(*columns, "source_ref", "target_ref"), "source_ref", "source"), "target_ref", "target")
    ends = settle(ends.drop("source_ref", "target_ref"))
    limits = history.table(spark, "relation_type_decl").filter(F.col("until") == END).select(F.col("name").alias("type"), "one_out", "one_in", "symmetric", "domain", "range")
    relations = ends.filter("kind = 'relation'").join(limits, "type", "left")
    above = history.pair_table(spark, "above").filter(F.col("until") == END)
    for kind, limit, name in (("source_kind", "domain", "in_domain"), ("target_kind", "range", "in_range")):
        relations = relations.join(above.select(F.col("a").alias(limit), F.col("b").alias(kind), F.lit(True).alias(name)), [limit, kind], "left")
    bad = F.when(F.col("source").isNull() | F.col("target").isNull(), "DanglingRef").when(F.col("domain").isNull(), "UnknownRelationType").when(F.col("in_domain").isNull() | F.col("in_range").isNull(), "SchemaViolation")
    relations = relations.withColumn("code", bad)
    slot = lambda side, end: F.concat_ws("|", F.lit(side), "type", F.col(end).cast("string"))
    alone = F.col("code").isNull() & (F.col("one_out") | F.col("one_in"))
    limited = relations.filter(alone)
    own = F.array_compact(F.array(F.when(F.col("one_out"), slot("o", "source")), F.when(F.col("one_in"), slot("i", "target"))))
    twin = F.when(F.col("symmetric"), F.array_compact(F.array(F.when(F.col("one_out"), slot("o", "target")), F.when(F.col("one_in"), slot("i", "source"))))).otherwise(empty_list)
    old = state.relations.withColumnRenamed("relation_type", "type").join(limits, "type")
    passed = accepted_in_order(limited.select(F.col("pos").alias("at"), own.alias("checked"), F.concat(own, twin).alias("held")), old.select(F.explode(own).alias("slot")))
    again = F.when(F.col("__ok").isNull(), "CardinalityViolation")
    limited = limited.join(passed.select(F.col("at").alias("pos"), F.lit(True).alias("__ok")), "pos", "left").withColumn("code", again).drop("__ok")
    relations = relations.filter(~F.coalesce(alone, F.lit(False))).unionByName(limited)
    turned = F.col("code").isNull() & F.coalesce(F.col("symmetric"), F.lit(False)) & (F.col("source") != F.col("target"))
    relations = relations.withColumn("sub", F.explode(F.when(turned, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    back = F.col("sub") == 1
    swapped = {"source": F.when(back, F.col("target")).otherwise(F.col("source")), "target": F.when(back, F.col("source")).otherwise(F.col("target"))}

    # rules and actions
    declared = lambda ts: F.broadcast(spark.createDataFrame([(t.name, True) for t in ts], "type string, declared boolean"))
    rules = of("rule").join(declared(state.ontology.rule_types), "type", "left").withColumn("code", F.when(F.col("declared").isNull(), "UnknownRelationType"))
    scoped = resolved(of("rule").select("pos", F.posexplode("applies_to").alias("n", "ref")), "ref", "to").filter("to IS NOT NULL")
    scopes = scoped.groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("n", "to"))).alias("__s"))
    rules = rules.join(scopes, "pos", "left").withColumn("scope", F.coalesce(F.col("__s.to"), F.array().cast("array<long>")))
    actions = ends.filter("kind = 'action'").join(declared(state.ontology.action_types), "type", "left")
    actions = actions.withColumn("code", F.when(F.col("source").isNull(), "DanglingRef").when(F.col("declared").isNull(), "UnknownRelationType"))

    # one counter over all that was made
    fields = {"sub": "int", "code": "string", "source": "long", "target": "long", "when": "string", "then": "string", "scope": "array<long>", "strict": "boolean"}

    def later(df: DataFrame) -> DataFrame:
        more = [(F.col(c) if c in df.columns else F.lit(0 if c == "sub" else None)).cast(t).alias(c) for c, t in fields.items()]
        return df.select(*columns, *more)

    made = later(relations.withColumns(swapped)).unionByName(later(rules)).unionByName(later(actions))
    made, next_id = _numbered(made.withColumn("counts", F.col("code").isNull()), next_id)
    main = made.filter("sub = 0").withColumns({"outcome": F.when(F.col("counts"), "created").otherwise("failed"), "id": F.col("new_id").cast("string")}).select(reported)
    report = skipped.unionByName(report_types).unionByName(report_concepts).unionByName(main)
    if strict and (failed := report.filter("outcome = 'failed'").agg(F.min("pos")).first()[0]) is not None:
        upto = F.col("pos") <= failed
        report, changes, made, judged = report.filter(upto), changes.filter(upto), made.filter(upto), judged.filter(upto)
        next_id = max(state.next_id, (judged.select("new_id").union(made.select("new_id")).agg(F.max("new_id")).first()[0] or 0) + 1)

    # the graph after it
    base = state.concepts.unionByName(changes.filter("NOT update AND n IS NULL").select(F.col("new_id").alias("id"), F.col("type").alias("concept_type"), "name", F.coalesce("description", F.lit("")).alias("description"), F.col("full").alias("properties")))
    filled = F.when(F.coalesce("description", F.lit("")) != "", F.col("pos"))
    fitting = F.when((F.size("given") > 0) & F.col("n").isNull(), F.col("pos"))
    last = changes.filter("update").groupBy(F.col("new_id").alias("id")).agg(F.max_by("name", "pos").alias("__n"), F.max_by("description", filled).alias("__d"), F.max_by("given", fitting).alias("__p"))
    merged = base.join(last.hint("shuffle_hash"), "id", "left").select("id", "concept_type", F.coalesce("__n", "name").alias("name"), F.coalesce("__d", "description").alias("description"), F.coalesce("__p", "properties").alias("properties"))
    new = lambda kind: made.filter("counts").filter(F.col("kind") == kind).drop("id").withColumnRenamed("new_id", "id")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    added = new("relation").select("id", F.col("type").alias("relation_type"), "source", "target", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    new_rules = new("rule").select("id", F.col("type").alias("rule_type"), "name", text("when"), text("then"), F.col("scope").alias("applies_to"), F.coalesce("strict", F.lit(False)).alias("strict"), text("description"))
    new_actions = new("action").select("id", F.col("type").alias("action_type"), "name", F.col("source").alias("subject"), F.col("target").alias("object"), text("effect"), text("description"))
    after = State(ontology, settle(merged), settle(state.relations.unionByName(added)), settle(state.rules.unionByName(new_rules)), settle(state.actions.unionByName(new_actions)), next_id)
    return Applied(after, report.select("kind", "client_ref", "outcome", "id", "code"))
