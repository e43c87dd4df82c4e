"""Import of several tables, transitive where, merged where, conflicts, stored edits, tree lookups, unique arrays."""

import pytest
from pyspark.sql import functions as F

from lamina.functions import nested
from lamina.functions.predicates import ColumnFilter, RowFilter
from lamina.operators import cakes, edits, history, traverse, tree
from lamina.plans.selection import RowSort, Selection, SetValue
from lamina.sources.store import Column, Reference, Store, TableConfig
from lamina.streaming import sync


@pytest.fixture
def store(spark):
    out = Store(spark)
    out.create_table(TableConfig("makers", "components", (Column("name"), Column("land"))))
    out.create_table(TableConfig("cars", "components", (Column("brand"), Column("doors", "integer"), Column("maker", ref=Reference("makers")))))
    out.create_table(TableConfig("owners", "components", (Column("who"), Column("cars", "jsonArray", Reference("cars")))))
    return out


def test_import_checks_hashes_types_and_references(spark, store):
    makers = spark.createDataFrame([("VW", "DE"), ("Ford", "US")], "name string, land string")
    maker = {r.name: r["_hash"] for r in store.import_tables({"makers": makers})["makers"].collect()}
    cars = spark.createDataFrame([("Audi", 4, maker["VW"]), ("Ka", 2, maker["Ford"])], "brand string, doors int, maker string")
    new = store.import_tables({"cars": cars})["cars"]
    car = {r.brand: r["_hash"] for r in new.collect()}
    store.import_tables({"owners": spark.createDataFrame([("Ann", [car["Audi"], car["Ka"]]), ("Bo", [car["Ka"]])], "who string, cars array<string>")})
    assert store.import_tables({"cars": cars})["cars"].count() == 0
    # over two references, one of them an array
    assert [r.who for r in traverse.where_on_references(store, "owners", {"land": "DE"}).collect()] == ["Ann"]
    assert [r.who for r in traverse.where_on_references(store, "owners", {"cars.makers.name": "Ford", "doors": 4}).collect()] == []
    with pytest.raises(KeyError):
        traverse.where_on_references(store, "owners", {"nowhere": 1})
    assert store.read_rows("cars", {"brand": "Audi", "doors": 4}, {"brand": "Ka", "doors": 2}).count() == 1
    assert store.read_row("cars", car["Ka"], {"doors": 4}).count() == 0
    for bad, what in [
        ({"cars": spark.createDataFrame([("X", 1, "nobody")], "brand string, doors int, maker string")}, "no row of"),
        ({"cars": spark.createDataFrame([("X", "1", None)], "brand string, doors string, maker string")}, "must be integer"),
        ({"makers": spark.createDataFrame([("wrong", "Y", "Z")], "_hash string, name string, land string")}, "not the hash"),
        ({"makers": spark.createDataFrame([("Y", "Z")], "name string, city string")}, "columns not in"),
    ]:
        with pytest.raises(ValueError, match=what):
            store.import_tables(bad)
    assert store.table("makers").count() == 2
    found = cakes.child_refs(store, "owners").collect()
    assert {(r.child_table, r.ref) for r in found} == {("cars", car["Audi"]), ("cars", car["Ka"])} and len(found) == 3


def test_observers_hear_of_branches(store):
    store.create_history(store.config("makers"))
    heard = []
    history.observe_conflicts(store, "makers", heard.append)
    first = history.append(store, "makers", "a", "/makers")
    history.append(store, "makers", "b", "/makers", previous=[first])
    assert heard == []
    history.append(store, "makers", "c", "/makers", previous=[first])
    assert len(heard) == 1 and heard[0]["type"] == "dagBranch" and len(heard[0]["branches"]) == 2
    history.unobserve_conflicts(store, "makers")
    history.append(store, "makers", "d", "/makers", previous=[first])
    assert len(heard) == 1


def test_edits_are_stored_and_restored(store):
    edits.create_tables(store, "carCake")
    head = edits.MultiEdit(edits.Edit("pick", Selection.from_routes(["carLayer/brand"])))
    head = head.then(edits.Edit("audi", RowFilter((ColumnFilter("carLayer/brand", "equals", "Audi"),))))
    first = edits.save(store, "carCake", head, "cake1")
    longer = head.then(edits.Edit("sort", RowSort((("carLayer/brand", "asc"),)))).then(edits.Edit("set", SetValue("carLayer/brand", "Opel")))
    second = edits.save(store, "carCake", longer, "cake1", [first])
    assert store.table("carCakeMultiEdits").count() == 4
    assert edits.restore(store, "carCake", second).hash == longer.hash and edits.restore(store, "carCake", head.hash).oldest_first() == head.oldest_first()
    with pytest.raises(ValueError):
        edits.restore(store, "carCake", "none")


def test_tree_lookup(spark):
    nodes = spark.createDataFrame(tree.nodes_of({"a": {"x": 1, "y": 2}, "b": 3}), tree.NODE_SCHEMA)
    in_order = lambda df: [r.path for r in df.orderBy("place").collect()]
    assert in_order(tree.find(nodes, {"id": "root"})) == [["root"]]
    assert in_order(tree.find(nodes, {"id": "root"}, [])) == [["root", "a", "x"], ["root", "a", "y"], ["root", "a"], ["root", "b"], ["root"]]
    assert in_order(tree.find(nodes, {"id": "root"}, ["root", "a"])) == [["root", "a", "x"], ["root", "a", "y"], ["root", "a"], ["root"]]
    assert in_order(tree.find(nodes, {"id": "root"}, ["other"])) == [] and in_order(tree.find(nodes, {"id": "none"}, [])) == []
    with pytest.raises(ValueError, match="several trees"):
        tree.find(nodes, {"isParent": False})


def test_unique_at_every_depth(spark):
    rows = spark.createDataFrame([("h", [("a", [("x", 1), ("x", 2)]), ("a", []), (None, []), (None, [])]), ("h", [])], "_hash string, data array<struct<_hash:string,inner:array<struct<_hash:string,n:int>>>>")
    (row,) = nested.unique(rows.limit(1).union(rows.limit(1))).collect()
    assert [x["_hash"] for x in row.data] == ["a", None, None] and [x.n for x in row.data[0].inner] == [1]


def test_equal_json_has_one_form(spark):
    texts = ['{"b": 1, "a": {"_hash": "q", "c": [1, 2]}}', '{"a":{"c":[1,2]},"b":1,"_hash":"zz"}', '{"B":"\\"_hash\\":1","_hash":"r"}', "no json", None]
    forms = [r.f for r in spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string").select("k", nested.same_json(F.col("x")).alias("f")).orderBy("k").collect()]
    assert forms[0] == forms[1] == '{"a":{"c":[1,2]},"b":1}' and "_hash" in forms[2] and '"r"' not in forms[2] and forms[3:] == [None, None]


def test_chained_rows_and_several_inputs(spark):
    first, second = cakes.chained([{"add": {"v1": "r"}}, {"add": {"v2": "r"}}])
    assert "base" not in first and second["base"] == first["_hash"] and first["_hash"] != second["_hash"]
    one, two = spark.createDataFrame([("r1", 1)], "r string, seq long"), spark.createDataFrame([("r1",)], "r string")
    assert sorted(map(tuple, sync.incoming(one, two).collect()), key=str) == [("r1", 1), ("r1", None)]
