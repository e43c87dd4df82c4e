"""Inserts of sets, layers, cakes and cells, and routes with slices, on a small cube."""

import pytest
from pyspark.sql import functions as F

from lamina.operators import cakes
from lamina.plans.selection import Selection
from lamina.sources.store import Column, Reference, Store, TableConfig


@pytest.fixture(scope="module")
def cube(spark):
    store = Store(spark)
    cakes.create_layers(store, "carSliceId", sets=True)
    cakes.create_layers(store, "carLayer")
    cakes.create_cakes(store, "carCake")
    store.create_table_with_history(TableConfig("cars", "components", (Column("brand"),)))
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    first, _ = cakes.insert_slices(store, "carSliceId", "add", frame([("v1", 0), ("v2", 1)], "slice string, pos long"))
    both, _ = cakes.insert_slices(store, "carSliceId", "addMore", frame([("v3",), ("v3",), (None,)], "slice string"), first)
    refs = {"sliceIdsTable": "carSliceId", "sliceIdsRow": both}
    empty, _ = cakes.insert_cake(store, "carCake", "add", {}, **refs)
    one = cakes.insert_through(store, f"/carCake@{empty}/carLayer/cars", frame([("v1", "Audi"), ("v2", "BMW"), ("v3", "Audi")], "slice string, brand string"), "me")
    two = cakes.insert_through(store, f"/carCake@{one['carCake']}/carLayer/cars", frame([("v2", "Tesla")], "slice string, brand string"))
    return {"store": store, "first": first, "both": both, "empty": empty, "one": one, "two": two, "frame": frame}


def cells(store, route, **more):
    return sorted((r.slice, r.t2.brand) for r in cakes.get(store, route, **more).paths.collect())


def test_cells_written_through_a_route_lie_over_those_before(cube):
    store = cube["store"]
    at = lambda made: f"/carCake@{made['carCake']}/carLayer/cars"
    assert cells(store, at(cube["one"])) == [("v1", "Audi"), ("v2", "BMW"), ("v3", "Audi")]
    assert cells(store, at(cube["two"])) == [("v1", "Audi"), ("v2", "Tesla"), ("v3", "Audi")]
    assert store.table("cars").count() == 3 and cakes.get(store, at(cube["empty"] and {"carCake": cube["empty"]})).paths.count() == 0


def test_previous_names_what_the_route_refers_to(cube):
    store = cube["store"]
    rows = {r.carCakeRef: r for r in store.table("carCakeInsertHistory").collect()}
    new, old = rows[cube["two"]["carCake"]], rows[cube["one"]["carCake"]]
    assert new.previous == [old.timeId] and old.origin == "me" and old.previous == [rows[cube["empty"]].timeId]
    again = cakes.get(store, f"/carCake@{old.timeId}/carLayer/cars")
    assert {r["_hash"] for r in again.relational["carCake"].collect()} == {cube["one"]["carCake"]}


def test_slices_of_call_and_segment(cube):
    store, ref = cube["store"], cube["two"]["carCake"]
    assert cells(store, f"/carCake@{ref}/carLayer/cars", slices=["v2", "no such slice"]) == [("v2", "Tesla")]
    assert cells(store, f"/carCake@{ref}/carLayer/cars(v3)", slices=["v2"]) == []  # the layer gives v2 alone, its segment's child asks for v3
    assert cells(store, f"/carCake(v3)@{ref}/carLayer/cars", slices=["v2"]) == [("v3", "Audi")]
    assert cells(store, f"/carCake@{ref}/carLayer/cars", slices=["none"]) == []
    assert cakes.get(store, "/cars", slices=["v1"]).last.count() == 0 and cakes.get(store, "/cars").last.count() == 3


def test_a_reference_to_a_cake_switches_slices(cube):
    store, ref = cube["store"], cube["two"]["carCake"]
    shelves = cube["frame"]([("s1", [(ref, ["v1"])]), ("s2", [(ref, ["v2", "v3"])]), ("s3", None)], "id string, cakes array<struct<ref:string,sliceIds:array<string>>>")
    store.create_table(TableConfig("shelves", "components", (Column("id"), Column("cakes", "jsonArray", Reference("carCake"))), "id"), shelves)
    paths = cakes.get(store, "/shelves/carCake/carLayer/cars").paths
    assert sorted((r.t0.id, r.slice, r.t3.brand) for r in paths.collect()) == [("s1", "v1", "Audi"), ("s2", "v2", "Tesla"), ("s2", "v3", "Audi")]
    audi = cakes.get(store, "/shelves/carCake/carLayer/cars", {"carCake": {"carLayer": {"cars": {"brand": "Tesla"}}}})
    assert [r.id for r in audi.relational["shelves"].collect()] == ["s2"]


def test_nested_and_cells(cube):
    found = cakes.get(cube["store"], f"/carCake@{cube['two']['carCake']}/carLayer/cars/brand", slices=["v1"])
    (tree,) = found.nested().collect()
    assert {k: v.brand for k, v in tree.layers.carLayer["add"].items()} == {"v1": "Audi"}
    (cell,) = found.cells().collect()
    assert cell.value == "Audi" and cell.path[1:2] + cell.path[3:5] == ["layers", "add", "v1"] and cell.path[-1] == "brand"


def test_view_of_one_cake(cube):
    view = cakes.cake_view(cube["store"], "carCake", cube["two"]["carCake"], Selection.from_routes(["carLayer/brand"]))
    assert [(r.slice_id, r.brand) for r in view.rows.orderBy("ord").collect()] == [("v1", ["Audi"]), ("v2", ["Tesla"]), ("v3", ["Audi"])]
    with pytest.raises(ValueError, match="not found"):
        cakes.cake_view(cube["store"], "carCake", "none", Selection())


def test_removal_and_errors(cube):
    store, frame = cube["store"], cube["frame"]
    layer = cube["two"]["carLayer"]
    less, _ = cakes.insert_layer(store, "carLayer", "remove", frame([("v1", "any")], "slice string, ref string"), layer)
    assert {r.slice for r in cakes.held(store, "carLayer", frame([(less,)], "root string")).collect()} == {"v2", "v3"}
    assert store.read_row("carLayer", less).first().componentsTable == "cars"
    same, _ = cakes.insert_layer(store, "carLayer", "remove", frame([("v1", "any")], "slice string, ref string"), layer)
    assert same == less and store.read_row("carLayer", less).count() == 1
    with pytest.raises(ValueError, match="does not exist"):
        cakes.insert_slices(store, "carSliceId", "add", frame([("x",)], "slice string"), "no such base")
    with pytest.raises(ValueError, match="more than one ref"):
        cakes.insert_layer(store, "carLayer", "add", frame([("v1", "a"), ("v1", "b")], "slice string, ref string"))
    with pytest.raises(ValueError, match="one ref"):
        cakes.insert_cake(store, "carCake", "add", {"carLayer": ["a", "b"]})
    for bad in (lambda: cakes.insert_cake(store, "carCake", "remove", {}), lambda: cakes.insert_layer(store, "carLayer", "put", frame([], "slice string, ref string")), lambda: cakes.insert_components(store, "cars", "remove", frame([("x",)], "brand string"))):
        with pytest.raises(ValueError, match="not supported"):
            bad()
    with pytest.raises(ValueError, match="take no references"):
        cakes.insert_components(store, "cars", "add", frame([("x",)], "brand string"), refs={"base": "x"})


def test_filters(cube):
    store = cube["store"]
    assert [r["_hash"] for r in cakes.cakes_with(store, "carCake", "carLayer", cube["one"]["carLayer"]).collect()] == [cube["one"]["carCake"]]
    assert [r["_hash"] for r in cakes.sets_with(store, "carSliceId", "v3").collect()] == [cube["both"]]
    tesla = store.table("cars").where("brand = 'Tesla'").select(F.col("_hash").alias("ref"))
    assert cube["two"]["carLayer"] in {r.root for r in cakes.layers_with(store, "carLayer", tesla).collect()}
    inline = Store(store.spark)
    inline.create_table(TableConfig("mapLayer", "layers"), cube["frame"]([("a", None, {"v1": "r1", "_x": "y"}), ("b", "a", {"v2": "r2"})], "_hash string, base string, add map<string,string>"))
    assert sorted(map(tuple, cakes.held(inline, "mapLayer").collect())) == [("a", "v1", "r1"), ("b", "v1", "r1"), ("b", "v2", "r2")]
