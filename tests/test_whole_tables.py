"""Operators over more rows than one task or Spark's default limits would bear."""

from lamina.functions import nested
from lamina.operators import resolve


def test_chains_have_no_row_limit(spark):
    links = spark.createDataFrame([(n, n - 1 if n else None) for n in range(20)], "_hash long, base long")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "30")
    try:
        assert resolve.chains(links).count() == 210
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_merged_maps_are_reduced_by_key_before_they_are_built(spark):
    rows = [("a", n, {str(n % 3): n, "x": -n}, [n]) for n in range(50)] + [("b", 1, {}, [7]), ("b", 0, None, []), (None, 2, {"k": None}, [1]), (None, 1, {"k": 5}, [2])]
    values = spark.createDataFrame(rows, "path string, ord long, m map<string,long>, l array<long>").repartition(3)
    merged = nested.merge_by_path(values, arrays=["l"], maps=["m"])
    assert merged.columns == ["path", "l", "m"]
    assert {r.path: (r.l, r.m) for r in merged.collect()} == {"a": (list(range(50)), {"0": 48, "1": 49, "2": 47, "x": -49}), "b": ([7], {}), None: ([1 + 1, 1], {"k": None})}
    plan = nested.merge_by_path(values, maps=["m"])._jdf.queryExecution().optimizedPlan().toString()
    assert "max(" in plan and "aggregate(" not in plan
