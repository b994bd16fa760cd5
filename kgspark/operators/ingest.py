"""Records of all ten kinds applied to a graph, as if one after another, with one retry and one counter of ids.

A record has a time: its place in the stream if what it needs is there by then, else that place in the retry that
follows the stream.  What is there at a time is known from the times of other records, so a stream is not walked: each
level (types, names, ids, references) is a join or an aggregate over the one before.

* Types of an ontology are few.  Their history is folded on the driver from the first declaration of each, and from the
  declarations that differ from the one before of their name.
* The first concept with a name holds it for good.  A relation by names waits for both.
* Ids come from one counter, which an explicit id lifts above itself: the id of the f-th new row is f plus the largest of
  ``e + 1 - f(e)`` over the explicit ids e before it, a prefix sum and a prefix maximum over ranges of time.
* The first row that fails a check ends the stream; what came before stays.  Until then all earlier rows were accepted, so
  checks against all earlier rows are exact.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from kgspark.plans.lineage import settle, ship_package

from .ontology import CARDINALITIES, ActionType, ConceptType, Ontology, RelationType, RuleType

#: The columns of a stream of records.  ``type`` is that of a concept, relation, rule or action; ``declared`` is the JSON
#: of a declaration or an ontology.  An id of 0 or null asks for a new one.
RECORD = (
    "seq long, kind string, id long, type string, name string, description string, properties map<string,string>, source long, target long, source_type string, source_name string,"
    " target_type string, target_name string, weight double, when string, then string, applies_to array<long>, strict boolean, subject long, object long, effect string, declared string"
)
CONCEPT = "id long, concept_type string, name string, description string, properties map<string,string>"
RELATION = "id long, relation_type string, source long, target long, weight double"
RULE = "id long, rule_type string, name string, when string, then string, applies_to array<long>, strict boolean, description string"
ACTION = "id long, action_type string, name string, subject long, object long, effect string, description string"

#: What a record's time gains when it is applied on the retry, and a time after all.
RETRY, END = 1 << 60, 1 << 62
#: Most rows of a table that is sent to every task.
FEW = 100_000
#: How often types may change: beyond this the history is no ontology's.
MAX_CHANGES = 100_000
_DECLARED = {"concept_type_decl": ConceptType, "relation_type_decl": RelationType, "rule_type_decl": RuleType, "action_type_decl": ActionType}
_LISTS = {"concept_types": "concept_type_decl", "relation_types": "relation_type_decl", "rule_types": "rule_type_decl", "action_types": "action_type_decl"}


@dataclass
class State:
    """A graph: its ontology, its tables and the next id."""

    ontology: Ontology
    concepts: DataFrame
    relations: DataFrame
    rules: DataFrame
    actions: DataFrame
    next_id: int = 1

    @staticmethod
    def empty(spark: SparkSession, ontology: Ontology | None = None) -> State:
        return State(ontology or Ontology(), *(spark.createDataFrame([], s) for s in (CONCEPT, RELATION, RULE, ACTION)))


@dataclass
class Ingested:
    """The graph after a stream, how many records of each sort were applied, and the failure that ended it, if one did."""

    state: State
    counts: dict[str, int]
    error: str | None = None
    failed_at: int | None = None


def declaration(kind: str, fields: dict):
    """The type that a JSON object declares; unknown fields are passed over, missing ones have their defaults."""
    cls = _DECLARED[kind]
    known = {k: tuple(v) if isinstance(v, list) else v for k, v in fields.items() if k in cls.__dataclass_fields__ and v is not None}
    if cls is RuleType:
        known = {"when": "", "then": ""} | known
    return cls(**known)


@dataclass
class History:
    """Which types there were when: spans (kind, name, type, from, to] of times, and pairs of types likewise."""

    spans: list = field(default_factory=list)
    pairs: dict[str, list] = field(default_factory=lambda: {"above": [], "disjoint": []})
    error: tuple[int, str] | None = None
    _open: dict = field(default_factory=dict)
    _open_pairs: dict = field(default_factory=lambda: {"above": {}, "disjoint": {}})

    def known(self, kind: str, name: str | None) -> bool:
        return (kind, name) in self._open

    def put(self, kind: str, x, at: int) -> None:
        old = self._open.get((kind, x.name))
        if old and old[0] == x:
            return
        if old:
            self.spans.append((kind, x.name, *old, at))
        self._open[kind, x.name] = (x, at)

    def _drop(self, key: tuple[str, str], at: int) -> None:
        self.spans.append((*key, *self._open.pop(key), at))

    def _pairs(self, at: int) -> None:
        types = {n: x for (k, n), (x, _) in self._open.items() if k == "concept_type_decl"}
        above, disjoint = set(), {(n, o) for n, x in types.items() for o in x.disjoint_with}
        for name in types:
            up: str | None = name
            while up is not None and (up, name) not in above:
                above.add((up, name))
                up = types[up].parent if up in types else None
        for what, now in (("above", above), ("disjoint", disjoint)):
            held = self._open_pairs[what]
            for pair in [p for p in held if p not in now]:
                self.pairs[what].append((*pair, held.pop(pair), at))
            held.update({p: at for p in now if p not in held})

    def apply(self, kind: str, fields: dict, at: int) -> None:
        """One declaration whose types are known, or a whole ontology, which takes the place of all there was."""
        if kind == "ontology":
            lists = {_LISTS[k]: list(v.values() if isinstance(v, dict) else v) for k, v in fields.items() if k in _LISTS and v}
            types = {(k, d["name"]): declaration(k, d) for k, v in lists.items() for d in v}
            for key in [k for k in self._open if k not in types]:
                self._drop(key, at)
            for (k, _), x in types.items():
                self.put(k, x, at)
            self._pairs(at)
            return
        x = declaration(kind, fields)
        if kind == "concept_type_decl":
            types = {n: y for (k, n), (y, _) in self._open.items() if k == kind}
            back = [n for n, y in types.items() if x.name in y.disjoint_with and n not in x.disjoint_with and n != x.name]
            x = replace(x, disjoint_with=(*x.disjoint_with, *sorted(back)))
            self.put(kind, x, at)
            for other in x.disjoint_with:
                if other in types and other != x.name and x.name not in types[other].disjoint_with:
                    self.put(kind, replace(types[other], disjoint_with=(*types[other].disjoint_with, x.name)), at)
            self._pairs(at)
        elif kind == "relation_type_decl" and (x.inverse_of == "" or (x.inverse_of == x.name and not x.symmetric)):
            self.error = self.error or (at, "UnknownRelationType")
        elif kind == "relation_type_decl" and x.cardinality not in CARDINALITIES:
            self.error = self.error or (at, "SchemaViolation")
        else:
            self.put(kind, x, at)

    def closed(self) -> History:
        """The same with all that is open lasting for ever."""
        spans = self.spans + [(*k, x, since, END) for k, (x, since) in self._open.items()]
        pairs = {w: self.pairs[w] + [(*p, since, END) for p, since in held.items()] for w, held in self._open_pairs.items()}
        return History(spans, pairs, self.error)

    def table(self, spark: SparkSession, kind: str) -> DataFrame:
        """name, since, until and what the checks need of the types of a kind."""
        rows = []
        for k, name, x, since, until in self.spans:
            if k == kind and since < until:
                r = x if kind == "relation_type_decl" else None
                c = x if kind == "concept_type_decl" else None
                limits = (r.cardinality in ("OneToOne", "ManyToOne") or r.functional, r.cardinality in ("OneToOne", "OneToMany"), r.symmetric, r.domain, r.range) if r else (None,) * 5
                rows.append((name, since, until, *limits, list(c.properties) if c and c.properties is not None else None, list(c.required_properties) if c else None))
        schema = "name string, since long, until long, one_out boolean, one_in boolean, symmetric boolean, domain string, range string, allowed array<string>, required array<string>"
        return F.broadcast(spark.createDataFrame(rows, schema))

    def pair_table(self, spark: SparkSession, what: str) -> DataFrame:
        return F.broadcast(spark.createDataFrame([p for p in self.pairs[what] if p[2] < p[3]], "a string, b string, since long, until long"))

    def ontology_at(self, at: int) -> Ontology:
        live = [(k, x) for k, _, x, since, until in self.spans if since < at <= until]
        lists = {v: sorted((x for k, x in live if k == v), key=lambda x: x.name) for v in _LISTS.values()}
        return Ontology(*lists.values())


def _during(at: Column | str) -> Column:
    at = F.col(at) if isinstance(at, str) else at
    return (F.col("since") < at) & (at <= F.col("until"))


def _base_history(ontology: Ontology) -> History:
    h = History()
    for kind, types in zip(_DECLARED, (ontology.concept_types, ontology.relation_types, ontology.rule_types, ontology.action_types), strict=True):
        for x in types:
            h.apply(kind, {f: getattr(x, f) for f in x.__dataclass_fields__}, -1)
    h.error = None
    return h


def _folded(declared: DataFrame, ontology: Ontology, replaced: list) -> History:
    """The history of declarations (at, kind, name, declared) whose types are known at their time."""
    epoch = F.size(F.filter(F.array(*[F.lit(r.seq) for r in replaced]).cast("array<long>"), lambda s: s < F.col("at")))
    known = declared.withColumn("epoch", epoch)
    each = known.groupBy("kind", "name").agg(F.min("declared").alias("a"), F.max("declared").alias("b"))
    changing = each.filter("a <> b").select("kind", "name")
    first = known.join(changing, ["kind", "name"], "left_anti").groupBy("kind", "name", "epoch").agg(F.min("at").alias("at"), F.first("declared").alias("declared"))
    rows = [(r.at, r.kind, r.declared) for r in first.collect()]
    before = Window.partitionBy("kind", "name").orderBy("at")
    turns = known.join(changing, ["kind", "name"], "left_semi").withColumn("same", (F.lag("declared").over(before) == F.col("declared")) & (F.lag("epoch").over(before) == F.col("epoch")))
    other = turns.filter(~F.coalesce("same", F.lit(False))).select("at", "kind", "declared").limit(MAX_CHANGES + 1).collect()
    if len(other) > MAX_CHANGES:
        raise ValueError(f"types change their declaration more than {MAX_CHANGES} times")
    rows += [tuple(r) for r in other] + [(r.seq, "ontology", r.declared) for r in replaced]
    h = _base_history(ontology)
    for at, kind, text in sorted(rows):
        h.apply(kind, json.loads(text), at)
    return h


def schema_history(records: DataFrame, ontology: Ontology) -> tuple[History, DataFrame]:
    """The types through a stream, and seq and at of every declaration that is applied."""
    spark = records.sparkSession
    rows = records.filter(F.col("kind").isin("ontology", *_DECLARED)).select("seq", "kind", "declared", F.get_json_object("declared", "$.name").alias("name"))
    replaced = rows.filter("kind = 'ontology'").orderBy("seq").collect()
    concept_types = rows.filter("kind = 'concept_type_decl'").withColumn("at", F.col("seq"))
    types = _folded(concept_types, ontology, replaced).closed().table(spark, "concept_type_decl").select(F.col("name").alias("ref"), "since", "until")
    parsed = F.from_json("declared", "domain string, range string, subject string, object string, applies_to array<string>")
    later = rows.filter(F.col("kind").isin(*list(_DECLARED)[1:])).withColumn("p", parsed)
    refs = F.when(F.col("kind") == "relation_type_decl", F.array("p.domain", "p.range")).when(F.col("kind") == "rule_type_decl", F.coalesce("p.applies_to", F.array().cast("array<string>")))
    refs = refs.otherwise(F.concat(F.array("p.subject"), F.array_compact(F.array("p.object"))))
    asked = later.select("seq", F.explode(F.array_distinct(F.transform(refs, lambda x: F.coalesce(x, F.lit(""))))).alias("ref")).join(types, "ref", "left")
    seen = lambda at: F.coalesce(F.max(_during(at)), F.lit(False))
    each = asked.groupBy("seq", "ref").agg(seen(F.col("seq")).alias("ok_now"), seen(F.col("seq") + RETRY).alias("ok_late"))
    ready = each.groupBy("seq").agg(F.min("ok_now").alias("ok_now"), F.min("ok_late").alias("ok_late"))
    timed = later.join(ready, "seq", "left").withColumn("at", F.when(F.coalesce("ok_now", F.lit(True)), F.col("seq")).when(F.col("ok_late"), F.col("seq") + RETRY)).filter("at IS NOT NULL")
    columns = ["seq", "at", "kind", "name", "declared"]
    applied = settle(concept_types.select(columns).unionByName(timed.select(columns)).unionByName(rows.filter("kind = 'ontology'").withColumn("at", F.col("seq")).select(columns)))
    return _folded(applied.filter("kind <> 'ontology'"), ontology, replaced).closed(), applied.select("seq", "at")


def allocate(events: DataFrame, start: int, order: tuple[str, ...] = ("at", "sub")) -> DataFrame:
    """``events`` (id and the columns of ``order``) with new_id: their own id, or for 0 the counter's at their time, from
    ``start`` on.

    Ranges of time are numbered apart, each in one pass over its rows as they are written in order; each goes on where
    those before it end.
    """
    ship_package(events.sparkSession)

    def numbered(batches):
        f, m = 0, -END  # new rows so far, and the largest reach of an explicit id
        for batch in batches:
            ids = batch.column("id").fill_null(-1).to_numpy()
            fresh = (ids == 0).astype(np.int64)
            before = f + np.cumsum(fresh) - fresh
            reach = np.maximum.accumulate(np.concatenate(([m], np.where(ids > 0, ids + 1 - before, -END))))
            f, m = f + int(fresh.sum()), int(reach[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before), pa.array(reach[:-1])], [*batch.schema.names, "__f", "__m"])

    ordered = events.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    schema = StructType([*ordered.schema.fields, StructField("__f", LongType()), StructField("__m", LongType())])
    rows = settle(ordered.mapInArrow(numbered, schema))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.when(F.col("id") > 0, F.col("id") + 1 - F.col("__f"))
    parts = rows.groupBy("__part").agg(F.max(F.col("__f") + (F.col("id") == 0).cast("long")).alias("n"), F.max(reach).alias("m"))
    parts = parts.withColumn("__n0", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("__m0", F.max(F.col("m") - F.col("__n0")).over(earlier))
    # one row for each range
    joined = rows.join(F.broadcast(settle(parts.select("__part", "__n0", "__m0"))), "__part")
    reach = F.greatest(F.lit(start).cast("long"), "__m0", F.col("__m") - F.col("__n0"))
    new = F.when(F.col("id") > 0, F.col("id")).otherwise(F.col("__n0") + F.col("__f") + reach)
    return joined.withColumn("new_id", new).drop("__part", "__f", "__m", "__n0", "__m0")


def _few(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if its counted rows are at most FEW, else left to a shuffle join."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def _claims(concepts: DataFrame, state: State) -> DataFrame:
    """type, key, claim_at, claim_id: the first concept of each (type, name in any case); claim_id is 0 if it is new.
    claims: how many concepts of the stream and the graph have the name."""
    there = state.concepts.select("concept_type", F.lower("name").alias("key"), F.lit(-1).cast("long").alias("at"), "id")
    rows = there.unionByName(concepts.select(F.col("type").alias("concept_type"), F.lower("name").alias("key"), "at", "id"))
    return rows.groupBy("concept_type", "key").agg(F.min("at").alias("claim_at"), F.min_by("id", F.struct("at", "id")).alias("claim_id"), F.count("*").alias("claims"))


def _named(records: DataFrame, claims: DataFrame) -> DataFrame:
    """Relations by names with the claims of both ends; at is null where one never comes."""
    rows = records.filter("kind = 'named_relation'").select("seq", "type", "weight", "source_type", "source_name", "target_type", "target_name")
    for end in ("source", "target"):
        held = claims.select(F.col("concept_type").alias(f"{end}_type"), F.col("key").alias("__key"), F.col("claim_at").alias(f"{end}_at"), F.col("claim_id").alias(f"{end}_claim"))
        rows = rows.withColumn("__key", F.lower(f"{end}_name")).join(held, [f"{end}_type", "__key"], "left").drop("__key", f"{end}_type", f"{end}_name")
    both = F.col("source_at").isNotNull() & F.col("target_at").isNotNull()
    return rows.withColumn("at", F.when(both, F.when(F.greatest("source_at", "target_at") < F.col("seq"), F.col("seq")).otherwise(F.col("seq") + RETRY)))


def _waiting(rows: DataFrame, refs: Column, types: DataFrame, known: DataFrame) -> DataFrame:
    """Rules or actions with the time at which their type and all concepts they name are there; dropped if never."""
    asked = rows.select("seq", F.explode(refs).alias("ref")).join(known.select(F.col("id").alias("ref"), "first_at"), "ref", "left")
    far = F.lit(END).cast("long")
    last = asked.groupBy("seq").agg(F.max(F.coalesce("first_at", far)).alias("last"))
    typed = rows.select("seq", "type").join(types.select(F.col("name").alias("type"), "since", "until"), "type", "left")
    ready = typed.groupBy("seq").agg(F.coalesce(F.max(_during("seq")), F.lit(False)).alias("ok_now"), F.coalesce(F.max(_during(F.col("seq") + RETRY)), F.lit(False)).alias("ok_late"))
    joined = rows.join(ready, "seq").join(last, "seq", "left").withColumn("last", F.coalesce("last", F.lit(-1).cast("long")))
    at = F.when(F.col("ok_now") & (F.col("last") < F.col("seq")), F.col("seq")).when(F.col("ok_late") & (F.col("last") < far), F.col("seq") + RETRY)
    return joined.withColumn("at", at).filter("at IS NOT NULL").drop("ok_now", "ok_late", "last")


def _events(records: DataFrame, state: State, history: History, named: DataFrame, fresh: DataFrame | None, fresh_relations: DataFrame | None) -> DataFrame:
    """at, sub, seq, what, id of all that takes or gives an id, in one table; ``fresh``: concepts with new ids (id, first_at)."""
    spark = records.sparkSession
    known = state.concepts.select("id", F.lit(-1).cast("long").alias("first_at")).unionByName(records.filter("kind = 'concept' AND id > 0").select("id", F.col("seq").alias("first_at")))
    if fresh is not None:
        known = known.unionByName(fresh)
    known = known.groupBy("id").agg(F.min("first_at").alias("first_at"))
    rules = _waiting(records.filter("kind = 'rule'"), F.array_distinct(F.coalesce("applies_to", F.array().cast("array<long>"))), history.table(spark, "rule_type_decl"), known)
    actions = _waiting(records.filter("kind = 'action'"), F.concat(F.array(F.coalesce("subject", F.lit(0).cast("long"))), F.array_compact(F.array("object"))), history.table(spark, "action_type_decl"), known)
    given = records.filter("kind = 'relation'").withColumn("at", F.col("seq"))
    # an id that a relation has already is not given again
    taken = state.relations.select("id", F.lit(-1).cast("long").alias("first_at")).unionByName(given.filter("id > 0").select("id", F.col("at").alias("first_at")))
    if fresh_relations is not None:
        taken = taken.unionByName(fresh_relations)
    taken = taken.groupBy("id").agg(F.min("first_at").alias("first_at"))
    given = given.join(taken, "id", "left").withColumn("id", F.when(F.col("first_at") < F.col("at"), 0).otherwise(F.col("id")).cast("long"))
    one = lambda df, what: df.select("at", F.lit(0).alias("sub"), "seq", F.lit(what).alias("what"), "id")
    same = (F.col("source_at") == F.col("target_at")) & (F.col("source_claim") == F.col("target_claim"))
    columns = ["at", "seq", "id", "type", "loop"]
    by_name = named.filter("at IS NOT NULL").withColumn("id", F.lit(0).cast("long")).withColumn("loop", same).select(columns)
    relations = given.withColumn("loop", F.col("source").eqNullSafe(F.col("target"))).select(columns).unionByName(by_name)
    types = history.table(spark, "relation_type_decl").select(F.col("name").alias("type"), "since", "until", "symmetric")
    twins = relations.join(types, "type").filter(_during("at") & F.col("symmetric") & ~F.col("loop")).select("at", F.lit(1).alias("sub"), "seq", F.lit("twin").alias("what"), F.lit(0).cast("long").alias("id"))
    concepts = records.filter("kind = 'concept'").withColumn("at", F.col("seq"))
    out = one(concepts, "concept").unionByName(one(relations, "relation")).unionByName(twins)
    return out.unionByName(one(rules, "rule")).unionByName(one(actions, "action"))


def _timed(records: DataFrame, state: State, history: History, named: DataFrame) -> DataFrame:
    """The events with their ids.  Where a record names an id that another was given by the counter, the times follow from
    the ids and the ids from the times: rounds go on until both agree; what comes earlier agrees first."""
    asked = records.select(F.explode(F.array_compact(F.flatten(F.array(F.array("source", "target", "subject", "object"), F.coalesce("applies_to", F.array().cast("array<long>")))))).alias("id"))
    given = records.filter("kind = 'relation' AND id > 0").select("id")
    fresh = fresh_relations = before = None
    while True:
        events = allocate(_events(records, state, history, named, fresh, fresh_relations), state.next_id)
        fresh = events.filter("what = 'concept' AND id = 0").select(F.col("new_id").alias("id"), F.col("at").alias("first_at")).join(asked, "id", "left_semi")
        fresh_relations = events.filter("what IN ('relation', 'twin') AND id = 0").select(F.col("new_id").alias("id"), F.col("at").alias("first_at")).join(given, "id", "left_semi")
        if before is None:
            fresh, fresh_relations = settle(fresh), settle(fresh_relations)
            if fresh.isEmpty() and fresh_relations.isEmpty():
                return events
        now = tuple(events.agg(F.count("*"), F.sum(F.xxhash64("at", "sub", "new_id", "what").cast("decimal(38,0)"))).first())
        if now == before:
            return events
        if before is not None:
            fresh, fresh_relations = settle(fresh), settle(fresh_relations)
        before = now


def _spans(given: DataFrame, state: State) -> DataFrame:
    """id, at, until: how long each version of a concept lasts, those of the graph (at = -1) and of the stream (id, at)."""
    there = state.concepts.select("id", F.lit(-1).cast("long").alias("at"))
    following = F.lead("at").over(Window.partitionBy("id").orderBy("at"))
    return there.unionByName(given).withColumn("until", F.coalesce(following, F.lit(END).cast("long")))


def _concept_failures(concepts: DataFrame, claims: DataFrame, history: History) -> DataFrame:
    """at, code of concepts (at, id, type, key, keys) that fail: the first of their checks."""
    spark = concepts.sparkSession
    # a type has one span at a time; one that has none at the time is as unknown as one without
    types = history.table(spark, "concept_type_decl").select("name", "since", "until", "allowed", "required")
    rows = concepts.select("at", "type", "keys").join(types, (F.col("type") == F.col("name")) & _during("at"), "left")
    wrong = F.when(F.col("since").isNull(), 1).when(F.col("allowed").isNotNull() & (F.size(F.array_except("keys", "allowed")) > 0), 2).when(F.size(F.array_except("required", "keys")) > 0, 3)
    found = rows.select("at", wrong.alias("n")).filter("n IS NOT NULL")
    if history.pairs["disjoint"]:
        pairs = history.pair_table(spark, "disjoint").select(F.col("a").alias("type"), F.col("b").alias("concept_type"), "since", "until")
        apart = concepts.select("at", "type", "key").join(pairs, "type").filter(_during("at")).join(claims, ["concept_type", "key"]).filter("claim_at < at").select("at", F.lit(4).alias("n"))
        found = found.unionByName(apart)
    # only names that stand more than once can be given twice
    shared = _few(claims.filter("claims > 1").select(F.col("concept_type").alias("type"), "key", "claim_at", "claim_id"))
    again = settle(concepts.select("at", "id", "type", "key").join(shared, ["type", "key"]))
    firsts = again.filter("at = claim_at").select("type", "key", F.col("id").alias("first_id"))
    held = F.when(F.col("claim_id") > 0, F.col("claim_id")).otherwise(F.col("first_id"))
    twice = again.join(firsts, ["type", "key"], "left").filter(F.col("claim_at") < F.col("at")).filter(held != F.col("id")).select("at", F.lit(5).alias("n"))
    names = F.array(*[F.lit(x) for x in ("UnknownConceptType", "InvalidProperty", "MissingRequiredProperty", "DisjointTypeViolation", "DuplicateConcept")])
    first = found.unionByName(twice).groupBy("at").agg(F.min("n").alias("n"))
    return first.select("at", F.element_at(names, F.col("n")).alias("code"))


def _relation_failures(relations: DataFrame, twins: DataFrame, state: State, versions: DataFrame, history: History) -> DataFrame:
    """at, code of relations (at, type, source, target) that fail; twins and the graph's relations are only counted.

    Versions of a concept, types of a name and pairs of types have one span at a time, so each join gives a row one partner
    at most and keeps it where it lies.
    """
    spark = relations.sparkSession
    rows = relations.select("at", "type", "source", "target")
    spans = lambda df: df.withColumnsRenamed({"since": "__since", "until": "__until"})
    here = (F.col("__since") < F.col("at")) & (F.col("at") <= F.col("__until"))
    for end in ("source", "target"):
        kinds = spans(versions).select(F.col("id").alias("__id"), F.col("type").alias(f"{end}_kind"), "__since", "__until")
        rows = rows.join(kinds, (F.col(end) == F.col("__id")) & here, "left").drop("__id", "__since", "__until")
    types = spans(history.table(spark, "relation_type_decl")).select("name", "__since", "__until", "one_out", "one_in", "domain", "range")
    rows = rows.join(types, (F.col("type") == F.col("name")) & here, "left").drop("name", "__since", "__until")
    above = spans(history.pair_table(spark, "above"))
    for kind, limit, name in (("source_kind", "domain", "in_domain"), ("target_kind", "range", "in_range")):
        fits = above.withColumn(name, F.lit(True))
        rows = rows.join(fits, (F.col(limit) == F.col("a")) & (F.col(kind) == F.col("b")) & here, "left").drop("a", "b", "__since", "__until")
    n = (
        F.when(F.col("source_kind").isNull() | F.col("target_kind").isNull(), "UnknownConcept")
        .when(F.col("domain").isNull(), "UnknownRelationType")
        .when(F.col("in_domain").isNull() | F.col("in_range").isNull(), "SchemaViolation")
    )
    failures = rows.select("at", n.alias("code")).filter("code IS NOT NULL")
    there = state.relations.select(F.lit(-1).cast("long").alias("at"), F.col("relation_type").alias("type"), "source", "target")
    every = there.unionByName(relations.select("at", "type", "source", "target")).unionByName(twins.select("at", "type", "source", "target"))
    for end, limit, cardinalities in (("source", "one_out", ("OneToOne", "ManyToOne")), ("target", "one_in", ("OneToOne", "OneToMany"))):
        names = {name for kind, name, x, _, _ in history.spans if kind == "relation_type_decl" and (x.cardinality in cardinalities or (end == "source" and x.functional))}
        if not names:
            continue
        firsts = every.filter(F.col("type").isin(*names)).groupBy("type", end).agg(F.min("at").alias("first_at"), F.count("*").alias("n")).filter("n > 1")
        limited = relations.filter(F.col("type").isin(*names)).select("at", "type", end).join(_few(settle(firsts)), ["type", end]).filter("first_at < at")
        limits = types.select("name", "__since", "__until", limit)
        again = limited.join(limits, (F.col("type") == F.col("name")) & here).filter(limit).select("at", F.lit("CardinalityViolation").alias("code"))
        failures = failures.unionByName(again)
    return failures


def _last(old: DataFrame, new: DataFrame) -> DataFrame:
    """The last version of each id; ``new`` has its time in ``at``."""
    rows = old.withColumn("at", F.lit(-1).cast("long")).unionByName(new.select(*old.columns, "at"))
    return rows.groupBy("id").agg(F.max_by(F.struct(*old.columns), "at").alias("r")).select("r.*")


def ingest_records(records: DataFrame, state: State) -> Ingested:
    """Apply a stream of records (columns of RECORD, seq unique and not negative) to a graph.

    ontology replaces the ontology; a type declaration is added, those of relations, rules and actions once the concept
    types they name are there; a concept is inserted, or replaced if it brings a known id; a relation is added; one by
    names once both are there; a rule or action is inserted or replaced once its type and concepts are there.  What is
    not ready is retried once, in order, after the stream; a relation by names that is still not ready ends it, other
    kinds are passed over.  Of a symmetric type the inverse is added with an id of its own.  Empty streams change nothing.
    """
    spark = records.sparkSession
    records = settle(records.withColumn("id", F.coalesce("id", F.lit(0).cast("long"))).withColumn("weight", F.coalesce("weight", F.when(F.col("kind") == "named_relation", 1.0).otherwise(0.0))))
    history, declared = schema_history(records, state.ontology)
    inserted = records.filter("kind = 'concept'").withColumn("at", F.col("seq"))
    claims = settle(_claims(inserted, state))
    named = settle(_named(records, claims))
    events = _timed(records, state, history, named)
    ids = events.filter("what <> 'twin'").select("seq", "at", "what", F.col("new_id"))
    of = lambda what: ids.filter(F.col("what") == what).select("seq", "at", F.col("new_id").alias("__id"))
    new_ids = events.filter("what = 'concept'").select(F.col("at").alias("first_at"), F.col("new_id").alias("first_id"))
    spans = _spans(new_ids.select(F.col("first_id").alias("id"), F.col("first_at").alias("at")), state)
    properties = F.coalesce("properties", F.create_map().cast("map<string,string>"))
    wanted = records.filter("kind = 'concept'").select(F.col("seq").alias("at"), "type", "name", F.lower("name").alias("key"), F.coalesce("description", F.lit("")).alias("description"), properties.alias("properties"))
    concepts = settle(wanted.join(spans.filter("at >= 0"), "at").withColumn("keys", F.map_keys("properties")))
    by_name = named.filter("at IS NOT NULL").drop("at", "source", "target")
    for end in ("source", "target"):
        end_ids = new_ids.select(F.col("first_at").alias(f"{end}_at"), F.col("first_id").alias("__first"))
        by_name = by_name.join(end_ids, f"{end}_at", "left").withColumn(end, F.when(F.col(f"{end}_claim") > 0, F.col(f"{end}_claim")).otherwise(F.col("__first"))).drop("__first")
    columns = ["seq", "type", "source", "target", "weight"]
    relations = settle(records.filter("kind = 'relation'").select(columns).unionByName(by_name.select(columns)).join(of("relation"), "seq").withColumnRenamed("__id", "id"))
    twin_ids = events.filter("what = 'twin'").select("seq", F.col("new_id").alias("__id"))
    twins = relations.drop("id").join(twin_ids, "seq").select("seq", "at", F.col("__id").alias("id"), "type", F.col("target").alias("source"), F.col("source").alias("target"), "weight")
    standing = settle(state.concepts.join(spans.filter("at < 0").select("id", "until"), "id"))
    versions = standing.select("id", F.col("concept_type").alias("type"), F.lit(-1).cast("long").alias("since"), "until").unionByName(concepts.select("id", "type", F.col("at").alias("since"), "until"))

    failures = _concept_failures(concepts, claims, history).unionByName(_relation_failures(relations, twins, state, versions, history))
    failures = failures.unionByName(named.filter("at IS NULL").select((F.col("seq") + RETRY).alias("at"), F.lit("UnknownNamed").alias("code")))
    worst = failures.agg(F.min(F.struct("at", "code")).alias("f")).first().f
    ends = [(worst.at, worst.code)] if worst else []
    ends += [history.error] if history.error else []
    stop, code = min(ends) if ends else (END, None)

    before = F.col("at") < stop
    typed = lambda df, name: df.withColumnRenamed("type", name)
    instances = {}
    for kind, there, name in (("rule", state.rules, "rule_type"), ("action", state.actions, "action_type")):
        rows = typed(records.filter(F.col("kind") == kind).join(of(kind), "seq").withColumn("id", F.col("__id")).withColumn("strict", F.coalesce("strict", F.lit(False))), name)
        rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("description", "when", "then", "effect")}).withColumn("applies_to", F.coalesce("applies_to", F.array().cast("array<long>")))
        instances[kind] = settle(rows.filter(before).select(*there.columns, "at"))
    added = relations.filter(before).unionByName(twins.filter(before).select(relations.columns))
    kept = typed(concepts.filter(before), "concept_type")
    counts = {
        "concepts": kept.count(),
        "relations": relations.filter(before).count(),
        "ontology_updates": declared.filter(before).count(),
        "rules": instances["rule"].count(),
        "actions": instances["action"].count(),
    }
    top = events.filter(before).agg(F.max("new_id")).first()[0]
    after = State(
        history.ontology_at(min(stop, END - 1)),
        # the last version of each is the one that outlasts what is applied
        settle(standing.unionByName(kept.select(standing.columns)).filter(F.col("until") >= stop).select(state.concepts.columns)),
        settle(state.relations.unionByName(typed(added, "relation_type").select(state.relations.columns))),
        settle(_last(state.rules, instances["rule"])),
        settle(_last(state.actions, instances["action"])),
        max(state.next_id, (top or 0) + 1),
    )
    return Ingested(after, counts, code, None if code is None else stop % RETRY)
