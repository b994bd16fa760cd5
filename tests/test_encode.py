"""Ids of the graph are unique, whatever the size of the tables."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kgspark.operators import rules
from kgspark.plans.encode import Graph


def assert_unique(df):
    n, distinct, least = df.agg(F.count("*"), F.count_distinct("id"), F.min("id")).first()
    assert n == distinct and least > 0


@pytest.mark.parametrize("scale", ["0.001", "0.01", "0.1"])
def test_ids_of_the_tables(spark, scale):
    if not Path(f"/root/testdata/sf{scale}").exists():
        pytest.skip("driver tables are not here")
    kg = Graph(spark, f"/root/testdata/sf{scale}")
    assert_unique(kg.relations.select("id"))
    assert_unique(kg.concepts.select("id"))


def test_ids_of_large_keys_and_repeated_lines(spark, tmp_path):
    """Keys as at a scale factor of 100,000, lines that agree in their number, part and supplier, and wholly equal ones."""
    order = F.col("id") % 40 * 15_000_000_000
    lines = spark.range(400).select(
        order.alias("l_orderkey"), (F.col("id") % 3 * 9_999_999_999).alias("l_partkey"), (F.col("id") % 2 * 999_999_999).alias("l_suppkey"), (F.col("id") % 2).cast("int").alias("l_linenumber"),
        (F.col("id") % 5).cast("double").alias("l_quantity"), *[F.lit(0.5).alias(c) for c in ("l_extendedprice", "l_discount", "l_tax")], F.lit("R").alias("l_returnflag"), F.lit("F").alias("l_linestatus"),
        F.lit("1995-01-01").cast("timestamp").alias("l_shipdate"),
    )
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    for table, key, other in (("nation", "n_nationkey", "n_regionkey"), ("customer", "c_custkey", "c_nationkey"), ("supplier", "s_suppkey", "s_nationkey"), ("orders", "o_orderkey", "o_custkey")):
        spark.range(50).select((F.col("id") * 3_000_000_000).alias(key), F.lit(1).cast("long").alias(other)).write.parquet(f"{tmp_path}/{table}.parquet")
    relations = Graph(spark, str(tmp_path)).relations
    assert relations.count() == 400 * 2 + 200
    assert_unique(relations.select("id"))


def test_two_patches_of_one_relation_raise(spark):
    relations = spark.createDataFrame([(1, "t", 2, 3, 1.0)], "id long, relation_type string, source long, target long, weight double")
    patches = spark.createDataFrame([(1, 2.0), (1, 3.0)], "id long, new_weight double")
    assert rules.update_relations(relations, patches.limit(1)).first().weight == 2.0
    with pytest.raises(Exception, match="more than one patch of id 1"):
        rules.update_relations(relations, patches).collect()
