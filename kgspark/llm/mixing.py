"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a word target; as many complete epochs as fit come first, then a weighted sample
without replacement fills the rest: every document draws an exponential key scaled by its quality
weight, and documents are taken in key order until the prefix sum of their sizes meets the budget.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACED_WORD, settle, small

#: Weights dealt to the sources in order, repeating.
SOURCE_WEIGHTS = (1, 2, 3)
#: A source gives at most so many times its own size.
MAX_EPOCHS = 3


def quality_weight(text: Column) -> Column:
    """Between 0.05 and 1: one less the share of symbol characters, which prose seldom has."""
    n = F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.length(F.translate(text, "#*$%&|<>", "")) / n, F.lit(0.05))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = SOURCE_WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes: source, source_size.  Adds target: shares by weight of the sum of sizes, none above max_epochs x size.

    Sources in code point order, null last, take the weights in turn.  Targets that would exceed their cap stop
    there and the excess goes to the others by weight.  With sources ordered by cap / weight those that stop are a
    prefix, so one running sum finds the level.  The windows hold one row per source.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("__rank", F.row_number().over(everything) - 1)
    dealt = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("__w", dealt).withColumn("__cap", (F.col("source_size") * max_epochs).cast("double"))
    by_level = Window.orderBy(F.col("__cap") / F.col("__w"), "__rank")
    before, whole = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / (F.sum("__w").over(whole) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)))
    levels = ranked.withColumn("__level", level).withColumn("__open", F.col("__cap") / F.col("__w") >= F.col("__level"))
    final = F.first(F.when(F.col("__open"), F.col("__level")), ignorenulls=True).over(whole)
    return levels.withColumn("target", F.least(F.col("__cap"), F.col("__w") * F.coalesce(final, F.lit(float("inf"))))).select("source", "source_size", "target")


_OUT = ("size", "source_size", "target", "epochs", "partial")


def mix(docs: DataFrame) -> DataFrame:
    """Adds size, source_size, target, epochs (complete ones) and partial (words of the fractional selection).

    docs: doc_id, text, source and any other columns, which are kept, but for those named like an added one, which
    are replaced.  Null text: size 0.  Null source: a source of its own, last in order.  Documents of size 0 take
    nothing.  The document at the budget's end gives the words that are still wanted.  Equal rows have equal keys
    and are interchangeable; the same input gives the same mix.  No rows in, no rows out.
    """
    mixed = _select(docs.withColumns(_measures()))
    return mixed.drop(*_OUT).withColumnsRenamed({f"__{c}": c for c in _OUT})


def _measures() -> dict[str, Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|mix|"), text))
    uniform = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return {"__size": F.regexp_count(text, F.lit(SPACED_WORD)).cast("long"), "__key": -F.log(uniform) / quality_weight(text)}


def _select(rows: DataFrame) -> DataFrame:
    """rows: doc_id, source, __size, __key and others.  Adds the columns of ``mix`` with names that begin with ``__``.

    Keys are spread over buckets in key order; sums per bucket find the one in which a source's budget ends, and
    only that bucket's rows are sorted.  Buckets are equal steps of the key's logarithm, as many to a unit as the root
    of the rows: whatever the weights, an exponential key falls into one of them with a chance of at most 1 / e of a
    step, so both the table of sums and the buckets that are sorted grow as that root.
    """
    steps = max(16, math.isqrt(rows.count()))
    rows = rows.withColumn("__bucket", F.floor(F.log("__key") * steps))
    sums = settle(rows.groupBy("source", "__bucket").agg(F.sum("__size").alias("__sum")))
    targets = settle(source_targets(sums.groupBy("source").agg(F.sum("__sum").alias("source_size"))))
    targets = targets.withColumns({"__budget": F.round("target").cast("long"), "__source_size": F.col("source_size"), "__target": F.col("target")})
    epochs = F.when(F.col("__source_size") > 0, F.expr("__budget div __source_size")).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("__epochs", epochs).withColumn("__rest", F.col("__budget") - F.col("__epochs") * F.col("__source_size"))
    running = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(running), F.lit(0))).withColumnRenamed("source", "__s")
    cut = starts.join(small(targets), F.col("__s").eqNullSafe(F.col("source"))).filter("__before <= __rest")
    cut = cut.groupBy("__s", "__source_size", "__target", "__epochs", "__rest").agg(F.max("__bucket").alias("__cut"), F.max_by("__before", "__bucket").alias("__from"))
    joined = rows.join(small(settle(cut)), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    whole = F.when(F.col("__bucket") < F.col("__cut"), F.col("__size")).otherwise(F.lit(0)).cast("long")
    outside = joined.filter("__bucket <> __cut").withColumn("__partial", whole)
    order = Window.partitionBy("source").orderBy("__key", "doc_id", "__size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("__rest") - F.col("__from") - F.coalesce(F.sum("__size").over(order), F.lit(0))
    inside = joined.filter("__bucket = __cut").withColumn("__partial", F.greatest(F.least(left, F.col("__size")), F.lit(0)).cast("long"))
    return outside.unionByName(inside).drop("__key", "__bucket", "__cut", "__from", "__rest")


def mix_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes, repeats counted) of every document."""
    measured = settle(docs.withColumns(_measures()).select("doc_id", "source", "__size", "__key"))
    taken = F.col("__epochs") * F.col("__size") + F.col("__partial")
    return _select(measured).select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), taken.alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, with the columns of ``docs`` as they are.

    Each is there once per epoch, and once more if at least half of it is in the fractional selection; documents
    without words are there once.
    """
    copies = F.col("__epochs") + F.when((F.col("__partial") > 0) & (F.col("__partial") * 2 >= F.col("__size")), 1).otherwise(0)
    copies = F.when(F.col("__size") == 0, F.lit(1)).otherwise(copies).cast("int")
    chosen = _select(docs.withColumns(_measures()))
    return chosen.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), copies))).select(*docs.columns)
