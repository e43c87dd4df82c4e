"""A small layered cube: cars by slice, in three chained sets, with general and technical layers."""

import pytest
from pyspark.sql import functions as F

from lamina.functions.predicates import ColumnFilter, RowFilter
from lamina.operators import edits, history, resolve, traverse
from lamina.operators.view import View
from lamina.plans.route import bind, parse
from lamina.plans.selection import RowSort, Selection, SetValue
from lamina.sources.store import Column, Reference, Store, TableConfig, cascade

BRANDS = ["Volkswagen", "Volkswagen", "Audi", "Audi", "BMW", "BMW", "Tesla", "Tesla", "Ford", "Chevrolet", "Nissan", "Hyundai"]
ELECTRIC = [False, False, True, True, True, False, True, True, True, True, True, True]
TECHNICAL = [0, 1, 2, 2, 4, 5, 6, 2, 7, 8, 9, 10]
LENGTHS = [[4000], [4100], [4500, 4700], [4700], [4200], [4300], [4150], [4800], [3900], [4900], [4600]]
WORKSHOP = {1: "A", 3: "B", 5: "A", 7: "C", 9: "B"}
STEPS = [range(0, 8), range(8, 10), range(10, 12)]


@pytest.fixture(scope="module")
def cars(spark):
    sets = spark.createDataFrame([(f"set{n}", f"set{n - 1}" if n else None, [f"VIN{k + 1}" for k in step], []) for n, step in enumerate(STEPS)], "_hash string, base string, add array<string>, remove array<string>")
    layers = spark.createDataFrame([(f"layer{n}", f"layer{n - 1}" if n else None) for n in range(3)], "_hash string, base string")
    own = lambda refs: spark.createDataFrame([(f"layer{n}", f"VIN{k + 1}", refs[k], "add") for n, step in enumerate(STEPS) for k in step], "member string, slice string, ref long, op string")
    general = spark.createDataFrame([(n, b, e) for n, (b, e) in enumerate(zip(BRANDS, ELECTRIC, strict=True))], "id long, brand string, isElectric boolean")
    technical = spark.createDataFrame([(n, x, WORKSHOP.get(n)) for n, x in enumerate(LENGTHS)], "id long, length array<long>, workshop string")
    last = spark.createDataFrame([("layer2",)], "root string")
    slices = resolve.resolve_slices(sets).where("root = 'set2'").select(F.col("slice").alias("slice_id"), "ord")
    held = lambda refs: resolve.resolve_layers(layers, own(refs), roots=last).select(F.col("slice").alias("slice_id"), "ref")
    return {"sets": sets, "layers": layers, "slices": slices, "by": {"general": (held(list(range(12))), general), "technical": (held(TECHNICAL), technical)}}


def view(cars, *routes):
    return View.build(cars["slices"], cars["by"], Selection.from_routes(list(routes)))


def test_slices_in_insertion_order(cars):
    assert [r.slice_id for r in cars["slices"].orderBy("ord").collect()] == [f"VIN{n}" for n in range(1, 13)]


def test_view_of_brand(cars):
    rows = view(cars, "general/brand").rows.orderBy("ord").collect()
    assert [r.brand for r in rows] == [[b] for b in BRANDS]


def test_filter_and_sort(cars):
    audi = view(cars, "general/brand").filter(RowFilter((ColumnFilter("general/brand", "equals", "Audi"),)))
    assert [r.slice_id for r in audi.rows.orderBy("ord").collect()] == ["VIN3", "VIN4"]
    down = view(cars, "general/brand").sort(RowSort((("general/brand", "desc"),)))
    assert [r.brand[0] for r in down.rows.orderBy("ord").collect()] == sorted(BRANDS, reverse=True)


def test_missing_property_is_a_null_value_and_arrays_are_flattened(cars):
    rows = {r.slice_id: r for r in view(cars, "technical/workshop", "technical/length", "technical/nothing").rows.collect()}
    assert rows["VIN1"].workshop == [None] and rows["VIN2"].workshop == ["A"] and rows["VIN3"].length == [4500, 4700] and rows["VIN3"].nothing == [None]


def test_edit_log_replays_once_oldest_first(cars):
    base = view(cars, "general/brand", "general/isElectric", "technical/length")
    session = edits.EditSession(base)
    session.edit(edits.Edit("long", RowFilter((ColumnFilter("general/isElectric", "equals", True, "boolean"), ColumnFilter("technical/length", "greaterThan", 4100, "number")))))
    session.edit(edits.Edit("sort", RowSort((("general/brand", "asc"),))))
    seen = session.edit(edits.Edit("set", SetValue("general/brand", "Opel")))
    assert [r.slice_id for r in seen.rows.orderBy("ord").collect()][:3] == ["VIN3", "VIN4", "VIN5"]
    assert {tuple(r.brand) for r in seen.rows.collect()} == {("Opel",)}
    route, components, entries = session.publish()
    assert route == "general/brand" and components.count() == 1 and entries.count() == seen.df.count()
    copy = session.clone()
    assert copy.view.rows.count() == seen.rows.count() and copy.head.hash == session.head.hash
    assert [edits.Edit.from_model(m.edit.model()).hash for m in session.log] == [m.edit.hash for m in session.log]


def test_publish_needs_one_edited_column(cars):
    session = edits.EditSession(view(cars, "general/brand"))
    with pytest.raises(ValueError, match="exactly one"):
        session.publish()


def test_overlay_publish_keeps_other_properties(cars):
    v = view(cars, "general/brand").set_value(SetValue("general/brand", "Opel"))
    components, entries = v.publish("general/brand", cars["by"]["general"])
    assert set(components.columns) == {"id", "brand", "isElectric"} and entries.count() == 12


def test_removal_beats_addition_and_readding_counts(spark):
    layers = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], "_hash string, base string")
    own = spark.createDataFrame([("a", "x", "1", "add"), ("a", "y", "1", "add"), ("b", "x", None, "remove"), ("b", "y", "2", "add"), ("b", "z", "2", "add"), ("b", "z", None, "remove"), ("c", "x", "3", "add")], "member string, slice string, ref string, op string")
    got = {(r.root, r.slice, r.ref) for r in resolve.resolve_layers(layers, own).collect()}
    assert got == {("a", "x", "1"), ("a", "y", "1"), ("b", "y", "2"), ("c", "y", "2"), ("c", "x", "3")}


def test_chain_deeper_than_the_default_limit(spark):
    rows = spark.createDataFrame([(f"{n:03d}", f"{n - 1:03d}" if n else None) for n in range(130)], "_hash string, base string")
    root = spark.createDataFrame([("129",)], "root string")
    assert resolve.chains(rows, roots=root).count() == 130


def test_dangling_base_is_an_error(cars, spark):
    resolve.check_bases(cars["layers"])
    with pytest.raises(ValueError, match="does not exist"):
        resolve.check_bases(spark.createDataFrame([("a", "nowhere")], "_hash string, base string"))


def test_routes():
    r = parse("/carCake(VIN1,VIN2)@abc/generalLayer/general@1700000000000:AbCd/brand")
    assert r.segments[0].slices == ("VIN1", "VIN2") and r.segments[0].ref == "abc" and r.segments[2].by_time
    bound = bind(r, {"carCake", "generalLayer", "general"})
    assert bound.prop == "brand" and str(bound).endswith("/brand")
    for bad in ("", "/a b", "/a(/b"):
        with pytest.raises(ValueError, match="invalid"):
            parse(bad)
    with pytest.raises(ValueError, match="unknown table"):
        bind(parse("/x/general"), {"general"})


def test_store_upsert_extends_and_is_idempotent(spark, tmp_path):
    store = Store(spark, str(tmp_path / "tables"))
    config = TableConfig("colors", "components", (Column("name"),))
    store.create_table_with_history(config)
    rows = spark.createDataFrame([("red",), ("blue",), ("red",)], "name string")
    assert store.upsert("colors", rows).count() == 2
    new, when = history.insert(store, "/colors", rows)
    assert store.table("colors").count() == 2 and when is not None
    store.create_table(TableConfig("colors", "components", (Column("name"), Column("code"))))
    store.upsert("colors", spark.createDataFrame([("green", "g")], "name string, code string"))
    assert store.read_rows("colors", {"code": None}).count() == 2 and store.read_row("colors", "none").count() == 0
    with pytest.raises(ValueError, match="columns not in table"):
        store.upsert("colors", spark.createDataFrame([(1,)], "other long"))
    with pytest.raises(KeyError):
        store.table("missing")
    store.dump(str(tmp_path / "dump"))
    assert spark.read.json(str(tmp_path / "dump/colors")).count() == 3


@pytest.mark.parametrize(("key", "kind"), [("Colors", "components"), ("colors", "layers"), ("a b", "components"), ("x", "unknown")])
def test_table_names(key, kind):
    with pytest.raises(ValueError):
        TableConfig(key, kind).check()


def test_cascade_prefers_the_first_store(spark):
    one, two = spark.createDataFrame([("a", 1)], "_hash string, v long"), spark.createDataFrame([("a", 2), ("b", 2)], "_hash string, v long")
    assert {(r._hash, r.v) for r in cascade([one, two]).collect()} == {("a", 1), ("b", 2)}


def test_where_on_references_and_slices(spark):
    store = Store(spark)
    store.create_table(TableConfig("dims", "components", (Column("height"),)), spark.createDataFrame([("d0", 1400), ("d1", 1450), ("d2", 1600)], "_hash string, height long"))
    store.create_table(TableConfig("cars", "components", (Column("dims", "jsonArray", Reference("dims")),)), spark.createDataFrame([("c0", ["d0"]), ("c1", ["d1"]), ("c2", ["d1", "d2"]), ("c3", [])], "_hash string, dims array<string>"))
    assert {r["_hash"] for r in traverse.where_on_references(store, "cars", {"height": 1450}).collect()} == {"c1", "c2"}
    found = traverse.get(store, "/cars/dims/height", {"dims": {"height": [1400, 1600]}})
    assert {r["_hash"] for r in found.relational["cars"].collect()} == {"c0", "c2"}
    assert {(tuple(r.path), r.value) for r in found.cells().collect()} == {(("cars:c0", "dims:d0", "height"), "1400"), (("cars:c2", "dims:d2", "height"), "1600")}
    assert {r["_hash"]: len(r.children) for r in found.nested().collect()} == {"c0": 1, "c2": 1}
    assert traverse.get(store, "/cars@c1/dims", {"dims": {}}).last.collect()[0]["_hash"] == "d1"
    with pytest.raises(ValueError, match="no reference"):
        traverse.get(store, "/dims/dims")


def test_where_on_any_column_that_refers_to_a_table(spark):
    store = Store(spark)
    store.create_table(TableConfig("people", "components", (Column("city"),)), spark.createDataFrame([("p0", "Rome"), ("p1", "Oslo"), ("p2", "Oslo")], "_hash string, city string"))
    columns = (Column("billing", "string", Reference("people")), Column("shipping", "string", Reference("people")))
    store.create_table(TableConfig("orders", "components", columns), spark.createDataFrame([("o0", "p0", "p0"), ("o1", "p1", "p0"), ("o2", "p0", "p2"), ("o3", None, "p1"), ("o4", "p1", "p1")], "_hash string, billing string, shipping string"))
    assert sorted(r["_hash"] for r in traverse.where_on_references(store, "orders", {"city": "Oslo"}).collect()) == ["o1", "o2", "o3", "o4"]
    assert sorted(r["_hash"] for r in traverse.where_on_references(store, "orders", {"people.city": "Rome"}).collect()) == ["o0", "o1", "o2"]
    with pytest.raises(ValueError, match="several columns"):
        traverse.get(store, "/people/orders")
    assert {r["_hash"] for r in traverse.get(store, "/people@p2/orders", through={"orders": "shipping"}).last.collect()} == {"o2"}


def test_history_forks(spark):
    kinds = "timeId string, ref string, previous array<string>"
    forked = spark.createDataFrame([("1:a", "A", []), ("2:b", "B", ["1:a"]), ("3:c", "C", ["1:a"])], kinds)
    assert history.conflict(forked, "t")["branches"] == ["2:b", "3:c"]
    merged = forked.unionByName(spark.createDataFrame([("4:d", "D", ["2:b", "3:c"])], kinds))
    assert history.conflict(merged, "t") is None and history.conflict(forked.limit(0), "t") is None
    assert history.refs_of_times(merged, "ref", spark.createDataFrame([("3:c",)], "timeId string")).first().ref == "C"
    assert history.as_of(merged, "ref", 3).first().ref == "C"
