import pytest
from pyspark.sql import functions as F

from lamina.functions.predicates import ColumnFilter, RowFilter, as_boolean, as_number, expression
from lamina.operators.view import View
from lamina.plans.selection import RowSort, Selection, SetValue, ViewColumn


def view(spark, rows, kinds="a double, b string, c boolean"):
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], f"id long, {kinds}")
    names = [k.split()[0] for k in kinds.split(", ")]
    return View.of(df, {f"t/{n}": n for n in names}, "id", F.col("id"))


def kept(v):
    return sorted(r.slice_id for r in v.df.collect())


ROWS = [(2.0, "bar", False), (42.0, "foo", True), (7.0, "foo", True), (42.0, "foo", False), (42.0, "foo", True)]


def test_number_filter(spark):
    v = view(spark, [(2.0, "2", True), (42.0, "5", True), (7.0, "42", True), (42.0, "8", True)])
    assert kept(v.filter(RowFilter((ColumnFilter("t/a", "equals", 42, "number"),)))) == [1, 3]


def test_and_or(spark):
    both = (ColumnFilter("t/a", "equals", 42, "number"), ColumnFilter("t/b", "equals", "foo"), ColumnFilter("t/c", "equals", True, "boolean"))
    assert kept(view(spark, ROWS).filter(RowFilter(both))) == [1, 4]
    rows = [(2.0, "bar", False), (42.0, "fooA", True), (7.0, "fooB", True), (42.0, "fooC", False), (2.0, "xyz", True)]
    some = (ColumnFilter("t/a", "equals", 42, "number"), ColumnFilter("t/b", "startsWith", "foo"), ColumnFilter("t/c", "equals", True, "boolean"))
    assert kept(view(spark, rows).filter(RowFilter(some, "or"))) == [1, 2, 3, 4]


def test_two_filters_of_one_column_both_count(spark):
    two = (ColumnFilter("/t/a", "greaterThan", 5, "number"), ColumnFilter("t/a", "lessThan", 10, "number"))
    assert kept(view(spark, ROWS).filter(RowFilter(two))) == [2]


def test_unknown_column_is_an_error(spark):
    with pytest.raises(ValueError, match="no such columns"):
        view(spark, ROWS).filter(RowFilter((ColumnFilter("t/z", "equals", 1),)))


@pytest.mark.parametrize(
    ("operator", "search", "case", "expected"),
    [("equals", "a b", False, [0, 1]), ("equals", "AB", True, [1]), ("notEquals", "ab", False, [2]), ("regExp", "^a.$", False, [0, 1]), ("regExp", "([", False, []), ("contains", "", False, [0, 1, 2, 3]), ("notContains", "b", False, [2])],
)
def test_text_filters(spark, operator, search, case, expected):
    v = view(spark, [("a B",), ("AB",), ("c",), (None,)], "b string")
    assert kept(v.filter(RowFilter((ColumnFilter("t/b", operator, search, "string", case),)))) == expected


@pytest.mark.parametrize(("text", "expected"), [("v > 3 and v < 10", [1]), ("7", [1]), ("not v > 3", [0]), ("w > 3", []), ("__import__('os')", []), ("v", []), ("", [0, 1, 2, 3])])
def test_expression(spark, text, expected):
    df = spark.createDataFrame([(0, 2.0), (1, 7.0), (2, 42.0), (3, None)], "id long, v double")
    assert [r.id for r in df.where(expression(F.col("v"), text)).orderBy("id").collect()] == expected


def test_searches():
    assert [as_number(x) for x in ("12 pieces", "", "x", 0, None)] == [12.0, None, None, 0.0, None]
    assert [as_boolean(x) for x in ("True", "ja", "yes", "nein", "f", "0", "17", None, "x")] == [True, True, True, False, False, False, True, None, False]


def test_text_in_boolean_cells(spark):
    v = view(spark, [("yes",), ("NO",), ("false",), (None,)], "b string")
    assert kept(v.filter(RowFilter((ColumnFilter("t/b", "equals", True, "boolean"),)))) == [0]
    assert kept(v.filter(RowFilter((ColumnFilter("t/b", "notEquals", True, "boolean"),)))) == [1, 2]


def test_sort_is_stable_and_nulls_have_a_place(spark):
    people = view(spark, [("Charlie", 20), ("Alice", 25), ("Bob", 30), ("Alice", 30), (None, 1)], "name string, age long")
    ordered = people.sort(RowSort((("t/name", "asc"), ("t/age", "desc")))).rows.orderBy("ord").collect()
    assert [(r.name[0], r.age[0]) for r in ordered] == [(None, 1), ("Alice", 30), ("Alice", 25), ("Bob", 30), ("Charlie", 20)]
    assert [r.ord for r in ordered] == [1, 2, 3, 4, 5]


def test_pending_values_accumulate_and_keep_the_base(spark):
    v = view(spark, ROWS).set_values([SetValue("t/b", "Opel"), SetValue("t/b", "BMW")])
    assert v.rows.where("slice_id = 1").first().b == ["Opel", "BMW"]
    assert v.changed("t/b").where("slice_id = 1").first().before == ["foo"]
    narrowed = v.select(Selection((ViewColumn("t/b", "b"),)))
    assert narrowed.rows.where("slice_id = 1").first().b == ["Opel", "BMW"]


def test_selection_models():
    s = Selection.from_routes(["x/a", "y/a", "x/a", "z/b"])
    assert s.aliases == ["a", "a1", "b"] and s.index("y/a") == s.index("a1") == s.index(["y", "a"]) == 1 and s.index("q", -1) == -1
    assert Selection.merge([s, Selection.from_routes(["z/b", "z/c"])]).routes == ["x/a", "y/a", "z/b", "z/c"]
    with pytest.raises(ValueError, match="not unique"):
        Selection((ViewColumn("x/a", "a"), ViewColumn("y/a", "a")))
    with pytest.raises(ValueError, match="camel"):
        Selection.from_routes(["X/a b"])
