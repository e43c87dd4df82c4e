"""Nested inserts, cascades of stores, charts, numbers and maxima within groups, operator labels."""

import pytest
from pyspark.sql import functions as F

from lamina.functions.predicates import LABELS, OPERATORS, operators, string_predicate
from lamina.functions.ranking import greatest_before, numbered
from lamina.operators import cakes, history
from lamina.sources.store import Cascade, Chart, Column, Member, Reference, Store, TableConfig, from_chart
from lamina.streaming import sync


@pytest.fixture
def store(spark):
    out = Store(spark)
    out.create_table_with_history(TableConfig("wheels", "components", (Column("size", "integer"),)))
    out.create_table_with_history(TableConfig("cars", "components", (Column("brand"), Column("wheels", "jsonArray", Reference("wheels")))))
    out.create_table_with_history(TableConfig("owners", "components", (Column("who"), Column("car", ref=Reference("cars")))))
    return out


def test_children_are_written_first_and_once(spark, store):
    kind = "who string, car struct<brand:string,wheels:array<struct<size:int>>>"
    rows = spark.createDataFrame([("Ann", ("VW", [(15,), (16,), None])), ("Bo", ("VW", [(15,), (16,)])), ("Cy", None), ("Di", ("Ka", None))], kind)
    made = history.insert_nested(store, "/owners", rows, origin="me")
    assert list(made) == ["wheels", "cars", "owners"] and None not in made.values()
    assert {t: store.table(t).count() for t in made} == {"wheels": 2, "cars": 2, "owners": 4}
    sizes = {r["_hash"]: r["size"] for r in store.table("wheels").collect()}
    held = {r["_hash"]: (r.brand, r.wheels and [sizes[w] for w in r.wheels]) for r in store.table("cars").collect()}
    owners = {r.who: held.get(r.car) for r in store.table("owners").collect()}
    assert owners == {"Ann": ("VW", [15, 16]), "Bo": ("VW", [15, 16]), "Cy": None, "Di": ("Ka", None)}
    # hashes are those of the rows as they are stored
    for name in made:
        store.import_tables({name: store.table(name)})
    history.insert_nested(store, "/owners", rows, previous=[made["owners"]])
    assert store.table("owners").count() == 4 and store.table("ownersInsertHistory").count() == 2
    with pytest.raises(ValueError, match="refers by"):
        store.create_table(TableConfig("keys", "components", (Column("to", ref=Reference("owners", "who")),)))
        history.insert_nested(store, "/keys", spark.createDataFrame([(("x",),)], "to struct<who:string>"))


def test_cascade_reads_writes_and_dumps_by_flag(spark, tmp_path):
    config = TableConfig("colors", "components", (Column("name"),))
    a, b, c = (Store(spark) for _ in range(3))
    for s in (a, b, c):
        s.create_table(config)
    b.upsert("colors", spark.createDataFrame([("red",)], "name string"))
    c.upsert("colors", spark.createDataFrame([("blue",)], "name string"))
    both = Cascade((Member(a, dump=False), Member(b, write=False), Member(c, read=False, write=False)))
    assert [r.name for r in both.read_rows("colors", {"name": "red"}).collect()] == ["red"] and both.read_rows("colors", {"name": "blue"}).count() == 0
    both.upsert("colors", spark.createDataFrame([("red",), ("green",)], "name string"))
    assert (a.table("colors").count(), b.table("colors").count()) == (2, 1) and both.table("colors").count() == 2
    both.dump(str(tmp_path / "out"))
    assert {r.name for r in spark.read.json(str(tmp_path / "out/colors")).collect()} == {"red", "blue"}
    with pytest.raises(KeyError):
        both.table("other")


def test_chart_with_groups_in_groups(spark):
    rows = spark.createDataFrame([("v1", 4, ("a", 1)), ("v2", 4, ("b", 1)), ("v3", None, None)], "vin string, doors int, x struct<k:string,n:int>")
    components, layers = from_chart(rows, Chart("vin", {"general": {"doors": ("doors", "string"), "inner": {"n": "x.n", "deep": {"k": "x.k"}}}}))
    assert {k: v.count() for k, v in components.items()} == {"deep": 3, "inner": 3, "general": 3}
    joined = layers["general"].join(components["general"].withColumnRenamed("_hash", "ref"), "ref").join(components["inner"].withColumnRenamed("_hash", "inner"), "inner").join(components["deep"].withColumnRenamed("_hash", "deep"), "deep")
    assert sorted((r.slice, r.doors, r.n, r.k) for r in joined.collect()) == [("v1", "4", 1, "a"), ("v2", "4", 1, "b"), ("v3", None, None, None)]


def test_one_hot_group_over_many_partitions(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 10 > 0, F.lit("hot")).otherwise(F.concat(F.lit("c"), F.col("id") % 7)).alias("c"), F.col("id").alias("at"), ((F.col("id") * 7919) % 4001).alias("v"))
    rows = rows.unionByName(spark.createDataFrame([(None, 1, 5), (None, 2, 3)], "c string, at long, v long"))
    got = {(r.c, r["at"]): (r.n, r.top) for r in greatest_before(numbered(rows, ["c"], [F.col("at")], "n"), ["c"], [F.col("at")], "v", "top").collect()}
    want, seen = {}, {}
    for r in sorted(rows.collect(), key=lambda r: r["at"]):
        n, top = seen.get(r.c, (0, None))
        want[(r.c, r["at"])] = (n + 1, top)
        seen[r.c] = (n + 1, r.v if top is None else max(top, r.v))
    assert got == want


def test_ids_that_name_one_cake(spark):
    own = Store(spark)
    own.create_table(TableConfig("xCake", "cakes", id="k"), spark.createDataFrame([("a", {"l": "1"}), ("b", {"l": "1"}), ("b", {"l": "2"}), (None, {})], "k string, layers map<string,string>"))
    assert [r.k for r in cakes.single(own, "xCake").collect()] == ["a"]


def test_outgoing_leaves_out_what_is_known(spark):
    refs = spark.createDataFrame([("/a", "x", 1), ("/a", "x", 2), ("/a", "y", 3), ("/b", "x", 4)], "route string, r string, n long")
    sent, got = spark.createDataFrame([("/a", "y")], "route string, r string"), spark.createDataFrame([("/b", "z")], "route string, r string")
    assert sorted(r.n for r in sync.outgoing(refs, ["n"], sent, got).collect()) == [1, 4]


def test_labels_and_patterns(spark):
    assert all(set(OPERATORS[k]) <= set(names) for k in OPERATORS for names in LABELS.values())
    assert operators("number", "de")["between"] == "zwischen" and list(operators("unknown")) == list(OPERATORS["string"])
    rows = spark.createDataFrame([("ab",)], "x string")
    # valid in one dialect alone: Python takes (?P<n>a), Java does not
    for pattern, n in [("(?P<n>a)", 0), ("([", 0), ("^a", 1), ("'", 0)]:
        assert rows.where(string_predicate(F.col("x"), rows.schema["x"].dataType, "regExp", pattern)).count() == n


def test_conflicts_are_forwarded_until_the_end(store):
    observers, heard = sync.Observers(), []

    def fails(found):
        heard.append(found["branches"])
        raise RuntimeError("no")

    observers.forward_conflicts(store, "cars", fails)
    observers.register("/cars", heard.append)
    history.append(store, "cars", "a", "/cars")
    history.append(store, "cars", "b", "/cars")
    assert len(heard) == 1 and len(heard[0]) == 2 and len(observers.errors) == 1
    observers.tear_down()
    history.append(store, "cars", "c", "/cars")
    assert len(heard) == 1 and not observers.callbacks and not observers.ends
