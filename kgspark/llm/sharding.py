"""Hierarchical weighted hash tree: region, rack and shard levels, DataFrame functions only.

A row descends from the root.  At each level every child of the node that it has reached draws an exponential number
from a hash of the row's key and the child's path, divided by the weight of all shards below the child; the smallest
wins.  So a child gets rows by the weight of its subtree, and the cost is the number of children met and not of shards.

A draw depends on the key, the path and the child's own weight alone.  If a shard's weight grows, rows move only into
the nodes on its path: at the root into its region, in the region into its rack, in the rack into the shard.  Rows that
stay outside these subtrees do not move, and a shard that comes as a region of its own takes rows only into itself.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, small


@dataclass(frozen=True)
class Leaf:
    """One shard, the labels of its region and of its rack in the region, and its weight."""

    shard: int
    region: int
    rack: int
    weight: float = 1.0


def even_tree(n_shards: int, racks: int = 2, shards: int = 4) -> list[Leaf]:
    """Shards 0 to n-1 of weight 1: ``shards`` a rack, ``racks`` a region."""
    return [Leaf(i, i // (racks * shards), i // shards % racks) for i in range(n_shards)]


def grown(tree: list[Leaf], by: int = 1, weight: float = 1.0) -> list[Leaf]:
    """The tree with ``by`` more shards, each in a region of its own, so that rows move only into the new shards."""
    shard, region = max((x.shard for x in tree), default=-1) + 1, max((x.region for x in tree), default=-1) + 1
    return [*tree, *(Leaf(shard + k, region + k, 0, weight) for k in range(by))]


def _number(digest: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")


def _drawn(name: Column, path: Column, children: Column) -> Column:
    """The place, among ``children`` (label, weight), of the one with the smallest weighted draw, and its path."""

    def draw(child: Column, k: Column) -> Column:
        at = F.concat(path, F.lit("/"), child["label"])
        uniform = (_number(F.md5(F.concat(name, at)), 1, 13) + 0.5) / float(1 << 52)
        return F.struct((-F.log(uniform) / child["weight"]).alias("drawn"), k.alias("k"), at.alias("path"))

    return F.array_min(F.transform(children, draw))


def _known(groups: Iterable[tuple[object, float]]) -> Column:
    return F.array(*[F.struct(F.lit(str(label)).alias("label"), F.lit(float(weight)).alias("weight")) for label, weight in groups])


def _below(leaves: list[Leaf], level: str) -> list[list[Leaf]]:
    """The leaves of each child, children in the order of their labels."""
    labels = sorted({getattr(x, level) for x in leaves})
    return [[x for x in leaves if getattr(x, level) == label] for label in labels]


def _weights(children: list[list[Leaf]], level: str) -> Column:
    return _known((getattr(c[0], level), sum(x.weight for x in c)) for c in children)


def _descended(df: DataFrame, name: str, leaves: list[Leaf], column: str) -> DataFrame:
    """Add the shard of each row, drawn level after level."""
    regions = _below(leaves, "region")
    racks = [_below(r, "rack") for r in regions]
    shards = [[_below(k, "shard") for k in r] for r in racks]
    first = _drawn(F.col(name), F.lit(""), _weights(regions, "region"))
    second = _drawn(F.col(name), F.col("__1.path"), F.get(F.array(*(_weights(r, "rack") for r in racks)), F.col("__1.k")))
    of_rack = F.get(F.get(F.array(*(F.array(*(_weights(k, "shard") for k in r)) for r in shards)), F.col("__1.k")), F.col("__2.k"))
    third = _drawn(F.col(name), F.col("__2.path"), of_rack)
    numbers = F.array(*(F.array(*(F.array(*(F.lit(c[0].shard) for c in k)) for k in r)) for r in shards))
    shard = F.get(F.get(F.get(numbers, F.col("__1.k")), F.col("__2.k")), F.col("__3.k"))
    return df.withColumn("__1", first).withColumn("__2", second).withColumn("__3", third).withColumn(column, shard).drop("__1", "__2", "__3")


def assign(df: DataFrame, key: str, trees: dict[str, list[Leaf]]) -> DataFrame:
    """Add a column of shards for each named tree.

    Weights are any numbers above 0; shards of weight 0 get no rows.  A tree without shards is refused.  A null key is a
    key like any other (all such rows share a shard).  Rows with the same key share a shard.  Columns of ``df`` are kept.
    """
    out = df.withColumn("__name", F.coalesce(F.col(key).cast("string"), F.lit("null")))
    for column, tree in trees.items():
        live = [x for x in tree if x.weight > 0]
        if not live or len({x.shard for x in live}) < len(live):
            raise ValueError("a tree needs shards, each once, of a weight above 0")
        out = _descended(out, "__name", live, column)
    return out.drop("__name")


def with_slots(df: DataFrame, shard: str, n_shards: int, order: list[str], rows_per_group: int = 1024, slot: str = "slot") -> DataFrame:
    """Number each shard's rows without gaps from 0.

    Rows are numbered inside hash groups of about ``rows_per_group`` rows of a shard, each starting where the
    groups before it end, so no task sorts a whole shard.  Order inside a shard: hash group, then ``order``.
    Rows equal in all of ``order`` are interchangeable.
    """
    groups = max(1, -(-df.count() // (n_shards * rows_per_group)))
    rows = df.withColumn("__group", _number(F.md5(F.concat_ws("|", *order)), 1, 8) % groups)
    counts = rows.groupBy(shard, "__group").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(shard).orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    starts = small(settle(counts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")))
    inside = Window.partitionBy(shard, "__group").orderBy(*order)
    return rows.withColumn("__at", F.row_number().over(inside) - 1).join(starts, [shard, "__group"]).withColumn(slot, (F.col("__start") + F.col("__at")).cast("long")).drop("__group", "__at", "__start")


def shard_documents(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (with one more shard) of every row.

    The shards form an even tree; the one more comes as a region of its own.  Null text: size 1 and the checksum of no bytes.  Null or repeated doc_ids: see ``assign``.  Empty
    input: no rows.  Other columns of ``docs`` are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    tree = even_tree(n_shards)
    placed = settle(assign(rows, "doc_id", {"shard": tree, "grown_shard": grown(tree)}))
    slots = with_slots(placed, "shard", n_shards, ["doc_id", "text_crc32", "size"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
