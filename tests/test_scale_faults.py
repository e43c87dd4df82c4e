"""Stores that are opened again, deep trees, long chains, first numbers of a feed, ranks."""

import pytest
from pyspark.sql import functions as F

from lamina.functions.ranking import ranked
from lamina.operators import resolve, tree
from lamina.sources.store import Column, Reference, Store, TableConfig
from lamina.streaming import sync


def test_a_store_opens_its_folder(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "name string, kind string")
    config = TableConfig("things", "components", (Column("name"), Column("kind", ref=Reference("kinds", "kind"), title="Kind")))
    first = Store(spark, str(tmp_path))
    first.create_table(config)
    first.create_table(TableConfig("empties", "components", (Column("x"),)))
    assert first.upsert("things", rows).count() == 2
    again = Store(spark, str(tmp_path))
    assert again.config("things") == config and again.table("things").count() == 2 and again.table("empties").count() == 0
    again.upsert("things", rows)
    again.create_table(TableConfig("things", "components", (Column("more", "integer"),)))
    third = Store(spark, str(tmp_path))
    assert third.table("things").count() == 2 and [c.key for c in third.config("things").columns] == ["name", "kind", "more"]


def test_merkle_of_a_deep_tree(spark):
    n = 12
    edges = spark.createDataFrame([(str(k), str(k + 1)) for k in range(n)], "parent string, child string")
    hashed = {r.id: r.hash for r in tree.merkle(edges, spark.createDataFrame([(str(k), f"t{k}") for k in range(n + 1)], "id string, text string")).collect()}
    assert len(hashed) == n + 1 and len(set(hashed.values())) == n + 1
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "parent string, child string")
    with pytest.raises(ValueError, match="do not form trees"):
        tree.merkle(loop, spark.createDataFrame([("a", "x"), ("b", "y")], "id string, text string"))


def test_chains_of_more_than_a_million_rows(spark):
    layers = spark.range(600_000).select(F.col("id").alias("_hash"), F.when(F.col("id") % 3 > 0, F.col("id") - 1).alias("base"))
    assert resolve.chains(layers).count() == 1_200_000


def test_a_first_number_above_one_is_a_gap(spark):
    log = spark.createDataFrame([("a", 3, 1), ("a", 4, 2), ("b", 1, 3), ("b", 10_000, 4)], "c string, seq long, at long")
    found = sync.gaps(log, "c", "seq", ["at"])
    assert sorted(map(tuple, found.collect())) == [("a", 0, 3), ("b", 1, 10_000)]
    whole = spark.range(1, 10_001).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("c"), F.col("id").alias("seq"))
    filled = sync.gap_fill(whole, found, "c", "seq")
    assert {r.c: (r.n, r.low, r.high) for r in filled.groupBy("c").agg(F.count("*").alias("n"), F.min("seq").alias("low"), F.max("seq").alias("high")).collect()} == {"a": (2, 1, 2), "b": (9998, 2, 9999)}


def test_ranks_are_those_of_all_rows(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("x"), F.rand(1).alias("y"))
    out = ranked(rows, [F.col("x").desc()], "place")
    got = [r.place for r in out.orderBy(F.desc("x")).collect()]
    assert got == list(range(1, 5001))
