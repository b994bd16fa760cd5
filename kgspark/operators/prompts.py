"""Grounded prompts as ordered text, their byte budget, and answers held against them."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgspark.functions import text
from kgspark.plans.lineage import settle, ship_package

from .ontology import Ontology

#: Bytes of facts in a prompt.
BUDGET = 6000


class LanguageModel(Protocol):
    """What answers a prompt."""

    def generate(self, system: str, context: str, question: str) -> str: ...


class Echo:
    """A model that repeats the question: deterministic, for tests and offline use."""

    def generate(self, system: str, context: str, question: str) -> str:
        return f"[echo] {question}"


def static_lines(ontology: Ontology, spark: SparkSession) -> DataFrame:
    """section, line_no, line: the ontology, sorted by name so that equal ontologies give equal bytes."""
    by_name = lambda types: enumerate(sorted(types, key=lambda t: t.name), 1)
    rows = [("concept_types", n, f"- {c.name} :: {c.description or '(no description)'}") for n, c in by_name(ontology.concept_types)]
    for n, r in by_name(ontology.relation_types):
        flags = "".join(f" [{x}]" for x in ("symmetric", "transitive") if getattr(r, x)) + (f" [inverse: {r.inverse_of}]" if r.inverse_of else "")
        rows.append(("relation_types", n, f"- ({r.domain}) -[{r.name}]-> ({r.range}){flags}"))
    for n, r in by_name(ontology.rule_types):
        rows.append(("rules", n, f"- [{'MUST' if r.strict else 'SHOULD'}] {r.name} ({','.join(r.applies_to) or '*'}): when {r.when or '-'} then {r.then or '-'}"))
    for n, a in by_name(ontology.action_types):
        detail = (f" [{', '.join(a.parameters)}]" if a.parameters else "") + (f" => {a.effect}" if a.effect else "")
        rows.append(("actions", n, f"- {a.name}: ({a.subject}) -> ({a.object or '-'}){detail}"))
    return spark.createDataFrame(rows, "section string, line_no int, line string")


def fact_lines(edges: DataFrame, concepts: DataFrame, budget: int = BUDGET) -> DataFrame:
    """fact_no, line: sentences of a subgraph's edges in order of id, as many as fit the budget in bytes.

    edges: relation_id, relation_type, source, target.  Edges without an end are left out.  A line has 20 bytes at least,
    so no more than a twentieth of the budget in lines is ordered.
    """
    names = concepts.select("id", "name")
    rows = edges.join(names.select(F.col("id").alias("source"), F.col("name").alias("a")), "source").join(names.select(F.col("id").alias("target"), F.col("name").alias("b")), "target")
    verb = text.humanize(F.col("relation_type"))
    raw = F.concat("a", F.lit(" -["), "relation_type", F.lit("]-> "), "b")
    line = F.concat(F.lit("- #"), F.col("source").cast("string"), F.lit(" "), "a", F.lit(" — "), verb, F.lit(" "), "b", F.lit(".   (raw: "), raw, F.lit(")"))
    order = Window.orderBy("relation_id")
    first = rows.select("relation_id", line.alias("line")).orderBy("relation_id").limit(budget // 20 + 1)
    lines = first.withColumn("fact_no", F.row_number().over(order))
    used = F.sum(F.octet_length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("used", used).filter(F.col("used") <= budget).select("fact_no", "line")


#: Bytes of a query's context, and what closes one that was cut.
CONTEXT_BUDGET, CUT_MARK = 12_000, "\n…[truncated]\n"


def query_context(scored: DataFrame, nodes: DataFrame, edges: DataFrame, concepts: DataFrame, ontology: Ontology, budget: int = CONTEXT_BUDGET) -> DataFrame:
    """context: one row, the best concepts, the subgraph and its facts as text of at most ``budget`` bytes and a mark if it was cut.

    scored: id, score, lexical, vector.  nodes: id, depth, visit_rank.  edges: relation_id, relation_type, source, target.
    A relation type's description stands for its humanised name.  Concepts outside nodes give no line.  A line has ten
    bytes at least, so no section sorts or gathers more than a tenth of the budget in lines.
    """
    most = budget // 10 + 1
    spark = concepts.sparkSession
    held = nodes.join(concepts.select("id", "concept_type", "name", "description"), "id")
    three = lambda c: F.format_string("%.3f", F.col(c).cast("double"))
    scores = F.concat(F.lit(" [score="), three("score"), F.lit(" lex="), three("lexical"), F.lit(" vec="), three("vector"), F.lit("]"))
    top = scored.join(held, "id").select(F.lit(1).alias("part"), (-F.col("score")).cast("double").alias("at"), "id", F.concat(F.lit("- ("), "concept_type", F.lit(") "), "name", scores).alias("line"))
    described = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(" — "), "description")).otherwise(F.lit(""))
    around = held.select(F.lit(3).alias("part"), F.col("visit_rank").cast("double").alias("at"), "id", F.concat(F.lit("- #"), F.col("id").cast("string"), F.lit(" ["), F.col("depth").cast("string"), F.lit("] ("), "concept_type", F.lit(") "), "name", described).alias("line"))
    verb = text.humanize(F.col("relation_type"))
    for r in ontology.relation_types:
        if r.description:
            verb = F.when(F.col("relation_type") == r.name, F.lit(r.description)).otherwise(verb)
    ends = edges.join(held.select(F.col("id").alias("source"), F.col("name").alias("a")), "source").join(held.select(F.col("id").alias("target"), F.col("name").alias("b")), "target")
    fact = F.concat(F.lit("- #"), F.col("source").cast("string"), F.lit(" "), "a", F.lit(" — "), verb, F.lit(" "), "b", F.lit(".   (raw: "), "a", F.lit(" -["), "relation_type", F.lit("]-> "), "b", F.lit(")"))
    facts = ends.select(F.lit(5).alias("part"), F.lit(0.0).alias("at"), F.col("relation_id").alias("id"), fact.alias("line"))
    heads = [(2, "\n# Subgraph\n# Each line: `#<id> [depth] (Type) Name — description`. Cite the `#<id>` tokens verbatim in your answer."), (4, "\n# Facts")]
    heads = [(0, "# Top concepts")] * (not scored.isEmpty()) + heads
    lines = spark.createDataFrame([(part, 0.0, 0, line) for part, line in heads], "part int, at double, id long, line string")
    for section in (top, around, facts):
        lines = lines.unionByName(section.orderBy("at", "id").limit(most))
    # each line is cut to what the whole may hold, so that the row that joins them stays bounded
    row = F.struct("part", "at", "id", F.concat(F.substring("line", 1, budget), F.lit("\n")).alias("line"), (F.octet_length("line") + 1).alias("n"))
    gathered = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["line"]), "").alias("whole"), F.sum(F.octet_length("line") + 1).alias("n"))
    # a byte that continues a character moves the cut back to its start
    data = F.encode("whole", "UTF-8")
    kept = F.coalesce(*[F.when(~F.hex(F.substring(data, budget + 1 - k, 1)).rlike("^[89AB]"), F.substring(data, 1, budget - k)) for k in range(4)])
    return gathered.select(F.when(F.col("n") <= budget, F.col("whole")).otherwise(F.concat(F.decode(kept, "UTF-8"), F.lit(CUT_MARK))).alias("context"))


def cited(answers: DataFrame) -> DataFrame:
    """answer_id, cited_ids (as text) and answer of raw answers (answer_id, raw)."""
    return answers.select("answer_id", F.array_join(F.transform(text.cited_ids(F.col("raw")), lambda x: x.cast("string")), ",").alias("cited_ids"), text.answer_text(F.col("raw")).alias("answer"))


def citation_validity(answers: DataFrame, allowed: DataFrame) -> DataFrame:
    """answer_id, n_valid, n_invalid: cited ids that are, and are not, among the allowed ones (id)."""
    ids = answers.select("answer_id", F.explode_outer(text.cited_ids(F.col("raw"))).alias("id"))
    marked = ids.join(allowed.select("id").distinct().withColumn("ok", F.lit(1)), "id", "left")
    valid = F.count(F.when(F.col("ok") == 1, 1))
    return marked.groupBy("answer_id").agg(valid.alias("n_valid"), (F.count("id") - valid).alias("n_invalid"))


class ModelError(RuntimeError):
    """A model gave no answer."""


def answer(prompts: DataFrame, make: Callable[[], LanguageModel] = Echo, lenient: bool = False) -> DataFrame:
    """prompt_id, raw of prompts (prompt_id, system, context, question), each batch answered by a model of its task.

    lenient: whether a prompt that the model fails has a null answer, and does not end the job.
    """

    def run(batches):
        model = make()

        def asked(s, c, q):
            try:
                return model.generate(s, c, q)
            except ModelError:
                if not lenient:
                    raise
                return None

        for b in batches:
            b["raw"] = [asked(s, c, q) for s, c, q in zip(b["system"], b["context"], b["question"], strict=True)]
            yield b[["prompt_id", "raw"]]

    ship_package(prompts.sparkSession)
    return prompts.select("prompt_id", "system", "context", "question").mapInPandas(run, "prompt_id long, raw string")


def _judged(answers: DataFrame, allowed: DataFrame) -> DataFrame:
    """prompt_id, raw, valid and invalid: the cited ids that are, and are not, among those allowed for the prompt."""
    ids = answers.select("prompt_id", "raw", F.explode_outer(text.cited_ids(F.col("raw"))).alias("id"))
    marked = ids.join(allowed.select("prompt_id", "id").distinct().withColumn("ok", F.lit(True)), ["prompt_id", "id"], "left")
    listed = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("id"))))
    return marked.groupBy("prompt_id").agg(F.any_value("raw").alias("raw"), listed(F.col("ok")).alias("valid"), listed(F.col("ok").isNull() & F.col("id").isNotNull()).alias("invalid"))


def _listed(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda i: F.concat(F.lit("#"), i.cast("string"))), ", ")


def answer_cited(prompts: DataFrame, allowed: DataFrame, make: Callable[[], LanguageModel] = Echo, retries: int = 1) -> DataFrame:
    """prompt_id, raw, answer, cited (the allowed ids among those cited) and n_asked of prompts, whose ids are unique.

    allowed: prompt_id, id.  A prompt whose answer cites an id that is not allowed is asked again, at most ``retries``
    times, with its answer and the ids that it may cite; only these rows go back to the model.  A new answer takes the
    place of the old one if it cites nothing else, or more allowed ids.  A retry that the model fails (ModelError) leaves
    the answer.
    """
    ids = allowed.groupBy("prompt_id").agg(F.array_sort(F.collect_set("id")).alias("may"))
    kept = settle(_judged(answer(prompts, make), allowed).withColumn("n_asked", F.lit(1)))
    for _ in range(retries):
        failed = kept.filter(F.size("invalid") > 0)
        if failed.isEmpty():
            break
        again = prompts.join(failed.select("prompt_id", "raw", "invalid"), "prompt_id").join(ids, "prompt_id", "left")
        may = F.coalesce(_listed(F.col("may")), F.lit(""))
        note = F.concat(F.lit("Not in the context: "), _listed(F.col("invalid")), F.lit(". Answer again in the same form and cite only: "), may)
        asked = again.withColumn("question", F.concat_ws("\n\n", "question", "raw", note)).select(prompts.columns)
        retried = _judged(answer(asked, make, lenient=True).filter("raw IS NOT NULL"), allowed)
        new = retried.select("prompt_id", *[F.col(c).alias(f"new_{c}") for c in ("raw", "valid", "invalid")])
        better = (F.size("new_invalid") == 0) | (F.size("new_valid") > F.size("valid"))
        joined = kept.join(new, "prompt_id", "left")
        swap = lambda c: F.when(F.col("new_raw").isNotNull() & better, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
        kept = settle(joined.select("prompt_id", swap("raw"), swap("valid"), swap("invalid"), (F.col("n_asked") + (F.size("invalid") > 0).cast("int")).alias("n_asked")))
    return kept.select("prompt_id", "raw", text.answer_text(F.col("raw")).alias("answer"), F.col("valid").alias("cited"), "n_asked")


def echo(prompts: DataFrame) -> DataFrame:
    """What ``Echo`` answers, as an expression."""
    return prompts.select("prompt_id", F.concat(F.lit("[echo] "), "question").alias("raw"))


def token_usage(usage: DataFrame) -> DataFrame:
    """Adds input, output, cache creation (0) and cache read tokens; of two fields for cached tokens the hit count comes first."""
    cached = F.coalesce("prompt_cache_hit_tokens", "cached_tokens", F.lit(0))
    return usage.withColumns({"input_tokens": F.col("prompt_tokens"), "output_tokens": F.col("completion_tokens"), "cache_creation_input_tokens": F.lit(0).cast("long"), "cache_read_input_tokens": cached.cast("long")})
