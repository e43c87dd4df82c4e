"""The engine's operators over the driver's tables, one query per operator; the SQL of each is in lamina.oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.functions import nested
from lamina.functions.hashing import quoted, row_hash, text_hash, with_hash
from lamina.functions.predicates import ColumnFilter, RowFilter, number_predicate, string_predicate
from lamina.operators import cakes, edits, history, resolve, traverse, tree
from lamina.operators.view import View, ranked
from lamina.plans.selection import RowSort, Selection, SetValue
from lamina.sources.store import Cascade, Chart, Column, Member, Reference, Store, TableConfig, cascade, decompose, from_chart, layer_maps
from lamina.streaming import sync


def millis() -> SparkColumn:
    """Milliseconds of an event, whatever the session's time zone; microseconds are rounded, halves away from zero, as SQL's epoch_ms does."""
    return F.expr("round(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts), -3) div 1000")


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TABLES = {
    "region": ("r_regionkey", {}),
    "nation": ("n_nationkey", {"n_regionkey": ("region", "r_regionkey")}),
    "customer": ("c_custkey", {"c_nationkey": ("nation", "n_nationkey")}),
    "supplier": ("s_suppkey", {"s_nationkey": ("nation", "n_nationkey")}),
    "part": ("p_partkey", {}),
    "orders": ("o_orderkey", {"o_custkey": ("customer", "c_custkey")}),
    "lineitem": ("l_orderkey", {"l_orderkey": ("orders", "o_orderkey"), "l_partkey": ("part", "p_partkey"), "l_suppkey": ("supplier", "s_suppkey")}),
}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(spark: SparkSession, sf_dir: str) -> Store:
    """The star schema as component tables that refer to one another by key."""
    out = Store(spark)
    for name, (id_, refs) in TABLES.items():
        rows = t(spark, sf_dir, name)
        columns = tuple(Column(c, "string", Reference(*refs[c]) if c in refs else None) for c in rows.columns)
        out.create_table(TableConfig(name, "components", columns, id_), rows)
    return out


def shown(column: str) -> SparkColumn:
    """An array as text, in a fixed order and with its nulls, so that results compare as plain rows."""
    return F.array_join(F.array_sort(F.transform(column, lambda x: F.coalesce(x.cast("string"), F.lit("null")))), "|")


# ---------------------------------------------------------------- storage

@query
def s1_scan(spark, sf_dir):
    return store(spark, sf_dir).table("region")


@query
def s3_point_lookup(spark, sf_dir):
    return store(spark, sf_dir).read_row("orders", 7).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query
def s4_eq_scan(spark, sf_dir):
    return store(spark, sf_dir).read_rows("orders", {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}).select("o_orderkey", "o_custkey", "o_totalprice")


@query
def s5_upsert_dedup(spark, sf_dir):
    own = Store(spark)
    own.create_table(TableConfig("texts", "components", (Column("text"),)))
    texts = t(spark, sf_dir, "documents").select("text")
    own.upsert("texts", texts)
    own.upsert("texts", texts)
    return own.table("texts").agg(F.count("*").alias("n_rows"), F.countDistinct("text").alias("n_texts"))


@query
def s8_catalog(spark, sf_dir):
    own = store(spark, sf_dir)
    counts = None
    for name, rows in own.tables().items():
        part = rows.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_key"), F.lit(own.content_type(name)).alias("content_type"), "n_rows")
        counts = part if counts is None else counts.unionByName(part)
    return counts


@query
def s12_cascade(spark, sf_dir):
    s = t(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    first = s.where("s_suppkey % 3 <> 0")
    second = s.where("s_suppkey % 2 = 0").withColumn("s_name", F.concat(F.lit("second "), "s_name"))
    return cascade([first, second], "s_suppkey").select("s_suppkey", "s_name", F.col("priority").cast("long").alias("store"))


@query
def s12_first_store(spark, sf_dir):
    """Suppliers of a nation from the first store that has any; the third store is never read."""
    s = t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    stores = []
    for rows in (s.where("s_nationkey > 5"), s.where("s_suppkey % 2 = 0"), s):
        own = Store(spark)
        own.create_table(TableConfig("supplier", "components", (Column("s_suppkey"), Column("s_nationkey")), "s_suppkey"), rows)
        stores.append(own)
    held = Cascade((Member(stores[0]), Member(stores[1], write=False), Member(stores[2], read=False)))
    return held.read_rows("supplier", {"s_nationkey": 3}).unionByName(held.read_rows("supplier", {"s_nationkey": 8}))


@query
def s13_chart(spark, sf_dir):
    """Parts by a chart: columns renamed and cast, sizes as records of their own."""
    chart = Chart("p_partkey", {"kind": {"brand": "p_brand", "measure": {"size": ("p_size", "number")}}, "names": {"name": "p_name"}}, frozenset({"names"}))
    components, layers = from_chart(t(spark, sf_dir, "part"), chart)
    if set(layers) != {"kind"}:
        raise ValueError("names must have no layer")
    kinds, measures = components["kind"].withColumnRenamed("_hash", "ref"), components["measure"].withColumnRenamed("_hash", "measure")
    return layers["kind"].join(kinds, "ref").join(measures, "measure").select(F.col("slice").alias("p_partkey"), "ref", "brand", "measure", "size")


@query
def s13_decompose(spark, sf_dir):
    components, layers = decompose(t(spark, sf_dir, "part"), "p_partkey", {"kind": ["p_brand", "p_type"], "size": ["p_size"]})
    return layers["kind"].join(components["kind"], layers["kind"].ref == components["kind"]["_hash"]).select(F.col("slice").alias("p_partkey"), "ref", "p_brand", "p_type")


@query
def s13_layer_map(spark, sf_dir):
    _, layers = decompose(t(spark, sf_dir, "nation"), "n_nationkey", {"name": ["n_name"]})
    with_region = layers["name"].join(t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("slice"), "n_regionkey"), "slice")
    return layer_maps(with_region, "n_regionkey").select("n_regionkey", F.explode("add").alias("slice", "ref"))


@query
def hash_row(spark, sf_dir):
    n = t(spark, sf_dir, "nation")
    return n.select("n_nationkey", row_hash(n.schema).alias("row_hash"))


@query
def n7_text_hash(spark, sf_dir):
    return t(spark, sf_dir, "customer").select("c_custkey", text_hash(F.col("c_name")).alias("name_hash"))


# ---------------------------------------------------------------- references

@query
def c2_partial_match(spark, sf_dir):
    return store(spark, sf_dir).read_rows("customer", {"c_mktsegment": "BUILDING", "c_nationkey": 3}).select("c_custkey", "c_name")


@query
def c3_id_and_filter(spark, sf_dir):
    own = store(spark, sf_dir)
    return own.read_row("orders", 7, {"o_orderstatus": "O"}).unionByName(own.read_row("orders", 10, {"o_orderstatus": "F"})).select("o_orderkey", "o_orderstatus")


@query
def c4_where_and_filter(spark, sf_dir):
    """The filter's nation takes the place of the where's."""
    return store(spark, sf_dir).read_rows("customer", {"c_mktsegment": "BUILDING", "c_nationkey": 3}, {"c_nationkey": 4}).select("c_custkey", "c_nationkey")


@query
def c5_where_on_ref(spark, sf_dir):
    return traverse.where_on_references(store(spark, sf_dir), "orders", {"c_mktsegment": "BUILDING", "o_orderstatus": "F"}).select("o_orderkey", "o_custkey")


@query
def c6_ref_in_list(spark, sf_dir):
    return traverse.where_on_references(store(spark, sf_dir), "orders", {"c_mktsegment": ["BUILDING", "MACHINERY"]}).select("o_orderkey")


@query
def c6_child_name(spark, sf_dir):
    return traverse.where_on_references(store(spark, sf_dir), "customer", {"nation.n_regionkey": [1, 2]}).select("c_custkey", "c_nationkey")


@query
def c7_transitive_where(spark, sf_dir):
    """Lines by a column that lies four references away, beside one that is two away."""
    return traverse.where_on_references(store(spark, sf_dir), "lineitem", {"r_name": "ASIA", "c_mktsegment": "BUILDING"}).select("l_orderkey", "l_linenumber")


#: Lines that one task groups into orders, about: what a task holds must not grow with the table.
GROUPED = 500_000


def order_parts(spark, sf_dir) -> DataFrame:
    lines = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    # the number of rows comes from the files' footers
    parts = max(spark.sparkContext.defaultParallelism, -(-lines.count() // GROUPED))
    return lines.repartition(parts, "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("parts"))


@query
def c9_contains(spark, sf_dir):
    own = Store(spark)
    own.create_table(TableConfig("baskets", "components", (Column("l_orderkey"), Column("parts", "jsonArray")), "l_orderkey"), order_parts(spark, sf_dir))
    return cakes.components_with(own, "baskets", "parts", 17).select("l_orderkey", F.size("parts").cast("long").alias("n_parts"))


@query
def c5_where_on_ref_array(spark, sf_dir):
    own = store(spark, sf_dir)
    own.create_table(TableConfig("baskets", "components", (Column("l_orderkey"), Column("parts", "jsonArray", Reference("part", "p_partkey"))), "l_orderkey"), order_parts(spark, sf_dir))
    return traverse.where_on_references(own, "baskets", {"p_size": 10}).select("l_orderkey")


@query
def c10_child_refs(spark, sf_dir):
    return traverse.edges(order_parts(spark, sf_dir), "l_orderkey", "parts", "part").select(F.col("parent").alias("l_orderkey"), "child_table", F.col("column").alias("ref_column"), "ref")


@query
def c12_cake_child_refs(spark, sf_dir):
    own = Store(spark)
    rows = t(spark, sf_dir, "nation").select("n_nationkey", F.create_map(F.lit("nameLayer"), "n_name", F.lit("regionLayer"), F.col("n_regionkey").cast("string"), F.lit("_internal"), F.lit("x")).alias("layers"))
    own.create_table(TableConfig("nationCake", "cakes", id="n_nationkey"), rows)
    return cakes.child_refs(own, "nationCake").select(F.col("parent").alias("n_nationkey"), F.col("child_table").alias("layer"), "ref")


@query
def c13_overlay_map(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    keyed = lambda rows: rows.groupBy(F.col("o_custkey").alias("c")).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct(F.col("o_orderpriority").alias("k"), F.lit("x").alias("v"))))).alias("m"))
    base = keyed(o.where("o_orderstatus = 'F'")).withColumn("m", F.transform_values("m", lambda k, v: F.lit("base"))).withColumnRenamed("m", "base")
    own = keyed(o.where("o_orderstatus = 'O'")).withColumn("m", F.transform_values("m", lambda k, v: F.lit("own"))).withColumnRenamed("m", "own")
    both = base.join(own, "c", "full")
    return both.select("c", F.explode(resolve.overlay(F.col("base"), F.col("own"), F.array(F.lit("5-LOW")))).alias("k", "v"))


def year_layers(spark, sf_dir, with_removes: bool) -> tuple[DataFrame, DataFrame]:
    """One layer per order year, based on the year before; it adds each customer's latest order of the year."""
    o = t(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate"))
    years = o.select("y").distinct()
    layers = years.select(F.col("y").cast("string").alias("_hash"), F.lag(F.col("y").cast("string")).over(Window.orderBy("y")).alias("base"))
    latest = o.groupBy("y", "o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey")).alias("x"))
    op = F.when(F.col("x.o_orderstatus") == "P", "remove").otherwise("add") if with_removes else F.lit("add")
    own = latest.select(F.col("y").cast("string").alias("member"), F.col("o_custkey").alias("slice"), F.col("x.o_orderkey").alias("ref"), op.alias("op"))
    return layers, own


@query
def c15_layer_chain(spark, sf_dir):
    return resolve.resolve_layers(*year_layers(spark, sf_dir, False)).select(F.col("root").alias("y"), F.col("slice").alias("c"), "ref")


@query
def c15_layer_remove(spark, sf_dir):
    return resolve.resolve_layers(*year_layers(spark, sf_dir, True)).select(F.col("root").alias("y"), F.col("slice").alias("c"), "ref")


@query
def c18_layer_contains(spark, sf_dir):
    wanted = t(spark, sf_dir, "orders").where("o_orderkey % 100 = 7").select(F.col("o_orderkey").alias("ref"))
    return cakes.layers_with(year_cakes(spark, sf_dir), "orderLayer", wanted).select(F.col("root").alias("y"), "ref")


@query
def c16_layer_child_refs(spark, sf_dir):
    found = cakes.child_refs(year_cakes(spark, sf_dir), "orderLayer")
    return found.select(F.col("parent").alias("y"), "child_table", "ref", F.get("slice_ids", F.lit(0)).alias("slice"))


def year_sets(spark, sf_dir) -> DataFrame:
    """Slice sets of a year: customers of urgent orders join, those of low ones leave."""
    o = t(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate"))
    joined = o.where("o_orderpriority = '1-URGENT'").groupBy("y").agg(F.array_sort(F.collect_set("o_custkey")).alias("add"))
    left = o.where("o_orderpriority = '5-LOW' and o_orderstatus = 'F'").groupBy("y").agg(F.array_sort(F.collect_set("o_custkey")).alias("remove"))
    years = o.select("y").distinct().select("y", F.lag("y").over(Window.orderBy("y")).alias("b"))
    empty = F.array().cast("array<bigint>")
    return years.join(joined, "y", "left").join(left, "y", "left").select(F.col("y").cast("string").alias("_hash"), F.col("b").cast("string").alias("base"), F.coalesce("add", empty).alias("add"), F.coalesce("remove", empty).alias("remove"))


@query
def c20_slice_chain(spark, sf_dir):
    return resolve.resolve_slices(year_sets(spark, sf_dir), ordered=False).select(F.col("root").alias("y"), F.col("slice").alias("c"))


@query
def c20_slice_order(spark, sf_dir):
    """Positions in insertion order, base first, of the last year's set."""
    sets = year_sets(spark, sf_dir)
    last = sets.agg(F.max("_hash").alias("_hash"))
    return resolve.resolve_slices(sets, roots=last).select(F.col("slice").alias("c"), F.col("ord").cast("long").alias("ord"))


@query
def c22_slice_contains(spark, sf_dir):
    return cakes.sets_with(year_cakes(spark, sf_dir), "customerSliceId", "5").select(F.col("_hash").alias("y"))


# ---------------------------------------------------------------- routes

@query
def r2_route_2hop(spark, sf_dir):
    return traverse.get(store(spark, sf_dir), "/orders/customer", {"o_orderpriority": "1-URGENT"}).last.select("c_custkey", "c_name")


@query
def r2_route_4hop(spark, sf_dir):
    found = traverse.get(store(spark, sf_dir), "/lineitem/orders/customer/nation/region/r_name", {"l_returnflag": "R"})
    return found.property_values().select(F.col("id").alias("r_regionkey"), F.col("value").alias("r_name"))


@query
def r3_nested_where(spark, sf_dir):
    where = {"o_orderstatus": "O", "customer": {"c_mktsegment": "HOUSEHOLD", "nation": {"n_regionkey": 2}}}
    return traverse.get(store(spark, sf_dir), "/orders/customer/nation", where).relational["orders"].select("o_orderkey", "o_custkey")


@query
def r4_ref_override(spark, sf_dir):
    return traverse.get(store(spark, sf_dir), "/customer@5/nation", {"c_mktsegment": "no such segment"}).last.select("n_nationkey", "n_name")


@query
def r5_child_filter(spark, sf_dir):
    return traverse.get(store(spark, sf_dir), "/lineitem/part", {"l_quantity": 50.0}).last.select("p_partkey", "p_name")


@query
def r6_semi_parent(spark, sf_dir):
    own = store(spark, sf_dir)
    return traverse.get(own, "/region/nation/customer", {"nation": {"customer": {"c_mktsegment": "BUILDING"}}}).relational["nation"].select("n_nationkey", "n_regionkey")


@query
def r7_slice_filter(spark, sf_dir):
    """Years whose resolved slice set holds one of the requested customers."""
    sets = year_sets(spark, sf_dir)
    members = resolve.resolve_slices(sets, ordered=False).select("root", F.col("slice").cast("string").alias("slice"))
    return traverse.overlapping(sets, "_hash", members.select(F.col("root"), "slice"), ["1", "2", "3", "50"]).select(F.col("_hash").alias("y"))


@query
def r8_slice_propagation(spark, sf_dir):
    """Orders refer to lines with slices (line numbers); the slices of the reference hold below it."""
    lines = t(spark, sf_dir, "lineitem")
    cakes = lines.where("l_linenumber <= 2").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.struct(F.col("l_partkey").alias("ref"), F.array(F.col("l_linenumber").cast("string")).alias("sliceIds")))).alias("items"))
    found = traverse.edges(cakes, "l_orderkey", "items", "part")
    below = found.withColumn("slices", traverse.propagated(None, F.col("slice_ids"), F.lit(None), False))
    return below.where(F.arrays_overlap("slices", F.array(F.lit("2")))).select(F.col("parent").alias("l_orderkey"), "ref", F.array_join("slices", ",").alias("slices"))


@query
def r10_layer_map(spark, sf_dir):
    held = resolve.resolve_layers(*year_layers(spark, sf_dir, False))
    maps = layer_maps(held, "root")
    return maps.select(F.col("root").alias("y"), F.explode("add").alias("slice", "ref"))


@query
def r11_cake_layers(spark, sf_dir):
    """Cakes with what their layer holds nested under `layers`: the orders of each year that are open."""
    found = cakes.get(year_cakes(spark, sf_dir), "/yearCake/orderLayer/orders", {"orderLayer": {"orders": {"o_orderstatus": "O"}}}).nested()
    layer = found.select("cake", F.col("layers.orderLayer.ref").alias("layer"), F.explode("layers.orderLayer.add").alias("slice", "o"))
    return layer.select("cake", "layer", "slice", F.col("o.o_orderkey").alias("o_orderkey"))


@query
def r12_nested_component(spark, sf_dir):
    tree_ = traverse.get(store(spark, sf_dir), "/customer/nation/region", {"c_mktsegment": "BUILDING"}).nested()
    inner = tree_.select("c_custkey", F.explode("children").alias("n"))
    return inner.select("c_custkey", F.col("n.n_name").alias("n_name"), F.explode("n.children").alias("r")).select("c_custkey", "n_name", F.col("r.r_name").alias("r_name"))


@query
def r13_through(spark, sf_dir):
    own = store(spark, sf_dir)
    return traverse.get(own, "/lineitem/supplier", {"l_linenumber": 1, "l_returnflag": "A"}, through={"supplier": "l_suppkey"}).last.select("s_suppkey", "s_name")


@query
def r15_property(spark, sf_dir):
    return traverse.get(store(spark, sf_dir), "/customer/c_name", {"c_mktsegment": "MACHINERY"}).property_values().select(F.col("id").alias("c_custkey"), F.col("value").alias("c_name"))


@query
def r17_result_dedup(spark, sf_dir):
    return traverse.get(store(spark, sf_dir), "/lineitem/orders/customer/nation", {"l_linenumber": 3}).last.select("n_nationkey", "n_name")


@query
def r19_cells(spark, sf_dir):
    cells = traverse.get(store(spark, sf_dir), "/nation/region/r_name").cells()
    return cells.select(F.array_join("path", "/").alias("path"), "value")


@query
def r20_missing_null(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    return e.select("event_id", traverse.property_of(e, "props.k").cast("long").alias("k"), traverse.property_of(e, "props.missing").alias("missing"))


@query
def r26_deep_equality(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    wanted = e.agg(F.min_by("props", "event_id").alias("p")).select(text_hash(nested.same_json(F.col("p"))).alias("h"))
    return e.select("event_id", text_hash(nested.same_json(F.col("props"))).alias("h")).join(F.broadcast(wanted), "h", "left_semi").select("event_id")


# ---------------------------------------------------------------- cakes

SLICES = ["1", "2", "3", "50"]


def year_cakes(spark, sf_dir) -> Store:
    """The star schema with a cake for each order year: its customers' set and a layer of their latest orders.

    Sets and layers are based on those of the year before; their entries are rows.
    """
    out = store(spark, sf_dir)
    layers, own = year_layers(spark, sf_dir, True)
    o = t(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("string").alias("member"), F.col("o_custkey").cast("string").alias("slice"), F.col("o_custkey").alias("pos"), "o_orderpriority", "o_orderstatus")
    joined, left = o.where("o_orderpriority = '1-URGENT'").withColumn("op", F.lit("add")), o.where("o_orderpriority = '5-LOW' and o_orderstatus = 'F'").withColumn("op", F.lit("remove"))
    cakes.create_layers(out, "customerSliceId", sets=True)
    cakes.create_layers(out, "orderLayer")
    cakes.create_cakes(out, "yearCake")
    out.frames["customerSliceId"] = layers
    out.frames[cakes.entries_key("customerSliceId")] = with_hash(joined.unionByName(left).select("member", "slice", F.col("slice").alias("ref"), "pos", "op").distinct())
    out.frames["orderLayer"] = layers.select("_hash", "base", F.lit("customerSliceId").alias("sliceIdsTable"), F.col("_hash").alias("sliceIdsTableRow"), F.lit("orders").alias("componentsTable"))
    out.frames[cakes.entries_key("orderLayer")] = with_hash(own.select("member", F.col("slice").cast("string").alias("slice"), "ref", F.lit(0).cast("long").alias("pos"), "op"))
    out.frames["yearCake"] = layers.select(F.concat(F.lit("cake"), "_hash").alias("_hash"), F.create_map(F.lit("orderLayer"), F.col("_hash")).alias("layers"), F.lit("customerSliceId").alias("sliceIdsTable"), F.col("_hash").alias("sliceIdsRow"), F.lit(None).cast("string").alias("id"))
    return out


@query
def c14_cake_filter(spark, sf_dir):
    return cakes.cakes_with(year_cakes(spark, sf_dir), "yearCake", "orderLayer", "1995").select("_hash", "sliceIdsRow")


@query
def c17_layer_insert(spark, sf_dir):
    """A new layer on the last year's: urgent orders of that year go, then all customers of nation 3 get order 1."""
    own = year_cakes(spark, sf_dir)
    last = own.table("orderLayer").agg(F.max("_hash")).first()[0]
    o = own.table("orders").where((F.year("o_orderdate").cast("string") == last) & (F.col("o_orderpriority") == "1-URGENT"))
    gone, _ = cakes.insert_layer(own, "orderLayer", "remove", o.groupBy(F.col("o_custkey").alias("slice")).agg(F.max("o_orderkey").alias("ref")), last)
    put, _ = cakes.insert_layer(own, "orderLayer", "add", own.table("customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("slice"), F.lit(1).alias("ref")), gone)
    return cakes.held(own, "orderLayer", spark.createDataFrame([(put,)], "root string")).select(F.col("slice").cast("long").alias("c"), F.col("ref").cast("long").alias("ref"))


@query
def c21_slice_insert(spark, sf_dir):
    """Two sets by insert: all customers, then without those of nation 3."""
    own = year_cakes(spark, sf_dir)
    customers = own.table("customer").select(F.col("c_custkey").alias("slice"), "c_nationkey")
    whole, _ = cakes.insert_slices(own, "customerSliceId", "add", customers.select("slice"))
    less, _ = cakes.insert_slices(own, "customerSliceId", "remove", customers.where("c_nationkey = 3").select("slice"), whole)
    return cakes.held(own, "customerSliceId", spark.createDataFrame([(less,)], "root string")).select(F.col("slice").cast("long").alias("c"))


@query
def r7_route_slices(spark, sf_dir):
    """Orders that four customers have in cakes whose sets hold one of them."""
    paths = cakes.get(year_cakes(spark, sf_dir), "/yearCake/orderLayer/orders", slices=SLICES).paths
    return paths.select(F.col("t0._hash").alias("cake"), "slice", F.col("t2.o_orderkey").alias("o_orderkey"))


@query
def r8_route_switch(spark, sf_dir):
    """Customers refer to the cake of their first year for themselves alone: below, only their own slice holds."""
    own = year_cakes(spark, sf_dir)
    first = own.table("orders").groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("y"))
    visits = first.select(F.col("o_custkey").alias("v_custkey"), F.array(F.struct(F.concat(F.lit("cake"), F.col("y").cast("string")).alias("ref"), F.array(F.col("o_custkey").cast("string")).alias("sliceIds"))).alias("cakes"))
    own.create_table(TableConfig("visits", "components", (Column("v_custkey"), Column("cakes", "jsonArray", Reference("yearCake"))), "v_custkey"), visits)
    paths = cakes.get(own, "/visits/yearCake/orderLayer/orders").paths
    return paths.select(F.col("t0.v_custkey").alias("c"), F.col("t1._hash").alias("cake"), "slice", F.col("t3.o_orderkey").alias("o_orderkey"))


@query
def r10_route_layer(spark, sf_dir):
    """All slices of all layers, each with its order."""
    found = cakes.get(year_cakes(spark, sf_dir), "/orderLayer/orders/o_orderstatus")
    return found.paths.select(F.col("t0._hash").alias("y"), "slice", F.col("t1.o_orderkey").alias("ref"), F.col("t1.o_orderstatus").alias("o_orderstatus"))


@query
def r11_cake_cells(spark, sf_dir):
    """Cells of every cake with the slice in their path."""
    cells = cakes.get(year_cakes(spark, sf_dir), "/yearCake/orderLayer/orders/o_orderpriority", {"orderLayer": {"orders": {"o_orderstatus": "F"}}}).cells()
    return cells.select(F.array_join("path", "/").alias("path"), "value")


@query
def j6_cake_view(spark, sf_dir):
    """The view of one cake, found by its ref, in the order of its set."""
    view = cakes.cake_view(year_cakes(spark, sf_dir), "yearCake", "cake1995", Selection.from_routes(["orderLayer/o_orderstatus", "orderLayer/o_totalprice"]))
    return view.rows.select(F.col("slice_id").cast("long").alias("c"), F.get("o_orderstatus", F.lit(0)).alias("o_orderstatus"), F.get("o_totalprice", F.lit(0)).alias("o_totalprice"))


@query
def h1_insert_through(spark, sf_dir):
    """Customers' segments as cells of a cake; those of BUILDING are then written anew through the cake's route."""
    own = Store(spark)
    cakes.create_layers(own, "customerSliceId", sets=True)
    cakes.create_layers(own, "segmentLayer")
    cakes.create_cakes(own, "segmentCake")
    own.create_table_with_history(TableConfig("segments", "components", (Column("name"),)))
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("slice"), F.col("c_mktsegment").alias("name"))
    whole, _ = cakes.insert_slices(own, "customerSliceId", "add", c.select("slice"))
    first, _ = cakes.insert_cake(own, "segmentCake", "add", {}, sliceIdsTable="customerSliceId", sliceIdsRow=whole)
    made = cakes.insert_through(own, f"/segmentCake@{first}/segmentLayer/segments", c)
    new = cakes.insert_through(own, f"/segmentCake@{made['segmentCake']}/segmentLayer/segments", c.where("name = 'BUILDING'").withColumn("name", F.lit("HOUSES")))
    cells = cakes.get(own, f"/segmentCake@{new['segmentCake']}/segmentLayer/segments/name").paths
    return cells.select(F.col("slice").cast("long").alias("c_custkey"), F.col("t2.name").alias("name"))


@query
def h1_nested_insert(spark, sf_dir):
    """Customers that hold their nation, and that its region, as rows: three tables, read back over their references."""
    own = Store(spark)
    own.create_table_with_history(TableConfig("regions", "components", (Column("name"),)))
    own.create_table_with_history(TableConfig("nations", "components", (Column("name"), Column("region", ref=Reference("regions")))))
    own.create_table_with_history(TableConfig("people", "components", (Column("custkey", "integer"), Column("nations", "jsonArray", Reference("nations")))))
    c, n, r = (t(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    wide = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    region = F.struct(F.col("r_name").alias("name"))
    rows = wide.select(F.col("c_custkey").alias("custkey"), F.array(F.struct(F.col("n_name").alias("name"), region.alias("region"))).alias("nations"))
    made = history.insert_nested(own, "/people", rows)
    found = traverse.get(own, "/people/nations/regions").joined
    return found.select(F.col("t0.custkey").alias("c_custkey"), F.col("t1.name").alias("n_name"), F.col("t2.name").alias("r_name"), F.lit(len(made)).cast("long").alias("n_tables"))


# ---------------------------------------------------------------- views

VIEW = Selection.from_routes(["orderLayer/o_orderstatus", "orderLayer/o_totalprice", "orderLayer/o_orderpriority", "customerLayer/c_mktsegment", "customerLayer/c_acctbal"])


def order_view(spark, sf_dir, selection: Selection = VIEW) -> View:
    """A slice for each order; its own row and its customer's are two layers."""
    o = t(spark, sf_dir, "orders")
    slices = o.select(F.col("o_orderkey").alias("slice_id"), F.col("o_orderkey").alias("ord"))
    layers = {
        "orderLayer": (o.select(F.col("o_orderkey").alias("slice_id"), F.col("o_orderkey").alias("ref")), o.withColumnRenamed("o_orderkey", "id")),
        "customerLayer": (o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("slice_id"), F.col("o_custkey").alias("ref")), t(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "id")),
    }
    return View.build(slices, layers, selection)


def flat_view(spark, sf_dir) -> View:
    o = t(spark, sf_dir, "orders")
    return View.of(o, {f"orders/{c}": c for c in ("o_orderstatus", "o_totalprice", "o_orderpriority")}, "o_orderkey", F.col("o_orderkey"))


def first_values(view: View) -> DataFrame:
    return view.rows.select("slice_id", *(F.get(c, F.lit(0)).alias(c) for c in view.selection.aliases))


@query
def j1_slice_view(spark, sf_dir):
    view = order_view(spark, sf_dir, Selection.from_routes(["orderLayer/o_orderstatus", "orderLayer/o_orderpriority"]))
    return first_values(view)


@query
def j2_multi_layer(spark, sf_dir):
    return first_values(order_view(spark, sf_dir))


def line_view(spark, sf_dir) -> View:
    lines = t(spark, sf_dir, "lineitem")
    o = t(spark, sf_dir, "orders")
    refs = lines.select(F.col("l_orderkey").alias("slice_id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("ref"))
    part = t(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id").withColumn("p_maybe", F.when(F.col("p_size") > 25, F.col("p_brand")))
    return View.build(o.select(F.col("o_orderkey").alias("slice_id"), F.col("o_orderkey").alias("ord")), {"partLayer": (refs, part)}, Selection.from_routes(["partLayer/p_size", "partLayer/p_maybe"]))


@query
def j3_multi_value(spark, sf_dir):
    return line_view(spark, sf_dir).rows.select("slice_id", shown("p_size").alias("sizes"))


@query
def j4_missing_cells(spark, sf_dir):
    return line_view(spark, sf_dir).rows.select("slice_id", F.size("p_maybe").cast("long").alias("n_values"), shown("p_maybe").alias("brands"))


@query
def j5_deep_view(spark, sf_dir):
    found = traverse.get(store(spark, sf_dir), "/region/nation/customer/orders", {"nation": {"customer": {"c_mktsegment": "FURNITURE", "orders": {"o_orderstatus": "P"}}}})
    return found.joined.select(F.col("t0.r_name").alias("r_name"), F.col("t1.n_name").alias("n_name"), F.col("t2.c_custkey").alias("c_custkey"), F.col("t3.o_orderkey").alias("o_orderkey"))


@query
def j6_cake_unique(spark, sf_dir):
    """Lines as cakes named by their order: those that can be told by that name."""
    own = Store(spark)
    lines = t(spark, sf_dir, "lineitem").select("l_orderkey", F.create_map(F.lit("partLayer"), F.col("l_partkey").cast("string")).alias("layers"))
    own.create_table(TableConfig("lineCake", "cakes", id="l_orderkey"), lines)
    return cakes.single(own, "lineCake").select("l_orderkey", F.element_at("layers", F.lit("partLayer")).alias("part"))


@query
def v6_select(spark, sf_dir):
    view = order_view(spark, sf_dir).select(Selection.from_routes(["customerLayer/c_mktsegment", "orderLayer/o_orderstatus"]))
    return first_values(view)


@query
def v7_filter_and(spark, sf_dir):
    rows = RowFilter((ColumnFilter("orderLayer/o_totalprice", "greaterThan", 100000, "number"), ColumnFilter("customerLayer/c_mktsegment", "equals", "building")))
    return first_values(order_view(spark, sf_dir).filter(rows)).select("slice_id", "o_totalprice", "c_mktsegment")


@query
def v9_filter_or(spark, sf_dir):
    rows = RowFilter((ColumnFilter("orderLayer/o_orderpriority", "startsWith", "1"), ColumnFilter("customerLayer/c_acctbal", "lessThan", 0, "number")), "or")
    return first_values(order_view(spark, sf_dir).filter(rows)).select("slice_id", "o_orderpriority", "c_acctbal")


@query
def v10_no_filter(spark, sf_dir):
    return first_values(flat_view(spark, sf_dir).filter(RowFilter())).select("slice_id")


@query
def v8_any_value(spark, sf_dir):
    return line_view(spark, sf_dir).filter(RowFilter((ColumnFilter("partLayer/p_size", "equals", 10, "number"),))).rows.select("slice_id", shown("p_size").alias("sizes"))


@query
def v13_sort_single(spark, sf_dir):
    view = order_view(spark, sf_dir, Selection.from_routes(["customerLayer/c_mktsegment"])).sort(RowSort((("customerLayer/c_mktsegment", "asc"),)))
    return view.df.select("slice_id", "ord")


@query
def v13_sort_multi(spark, sf_dir):
    view = order_view(spark, sf_dir).sort(RowSort((("customerLayer/c_mktsegment", "desc"), ("orderLayer/o_totalprice", "asc"))))
    return view.df.select("slice_id", "ord")


@query
def v15_set_value(spark, sf_dir):
    view = order_view(spark, sf_dir).set_value(SetValue("customerLayer/c_mktsegment", "NEW"))
    return view.rows.select("slice_id", shown("c_mktsegment").alias("segment"))


@query
def v16_set_values(spark, sf_dir):
    view = order_view(spark, sf_dir).set_values([SetValue("orderLayer/o_orderpriority", "A"), SetValue("orderLayer/o_orderpriority", "B")])
    return view.rows.select("slice_id", F.array_join("o_orderpriority", "|").alias("priorities"))


@query
def v17_rows(spark, sf_dir):
    view = order_view(spark, sf_dir).set_value(SetValue("orderLayer/o_orderstatus", "X"))
    return view.rows.select("slice_id", F.array_join("o_orderstatus", "|").alias("status"), F.array_join("c_mktsegment", "|").alias("segment"))


@query
def v18_changed_rows(spark, sf_dir):
    view = order_view(spark, sf_dir).filter(RowFilter((ColumnFilter("orderLayer/o_orderstatus", "equals", "F"),))).set_value(SetValue("customerLayer/c_mktsegment", "NEW"))
    return view.changed("customerLayer/c_mktsegment").select("slice_id", F.array_join("before", "|").alias("before"), F.array_join("after", "|").alias("after"))


@query
def v18_publish(spark, sf_dir):
    view = order_view(spark, sf_dir).filter(RowFilter((ColumnFilter("orderLayer/o_orderstatus", "equals", "F"),))).set_value(SetValue("orderLayer/o_orderpriority", "9-NEW"))
    components, entries = view.publish("orderLayer/o_orderpriority")
    return entries.join(components, entries.ref == components.id).select("slice_id", F.col("id").alias("component"), F.array_join("o_orderpriority", "|").alias("o_orderpriority"))


@query
def v19_row_hash(spark, sf_dir):
    view = order_view(spark, sf_dir, Selection.from_routes(["orderLayer/o_orderstatus", "customerLayer/c_mktsegment"]))
    return view.hashed.select("slice_id", "row_hash")


@query
def v20_shape(spark, sf_dir):
    view = order_view(spark, sf_dir)
    return view.df.agg(F.count("*").alias("row_count")).select("row_count", F.lit(view.column_count()).cast("long").alias("column_count"), F.lit(",".join(view.layer_routes)).alias("layers"))


# ---------------------------------------------------------------- predicates

def _number(name: str, table: str, column: str, operator: str, search: object) -> None:
    def run(spark, sf_dir):
        key = TABLES[table][0]
        return t(spark, sf_dir, table).where(number_predicate(F.col(column), operator, search)).select(key, column)

    QUERIES[name] = run


def _text(name: str, table: str, column: str, operator: str, search: object, match_case: bool = False) -> None:
    def run(spark, sf_dir):
        rows = t(spark, sf_dir, table)
        return rows.where(string_predicate(F.col(column), rows.schema[column].dataType, operator, search, match_case)).select(TABLES[table][0], column)

    QUERIES[name] = run


_number("p1_eq", "part", "p_size", "equals", 10)
_number("p1_ne", "part", "p_size", "notEquals", 10)
_number("p2_gt", "orders", "o_totalprice", "greaterThan", 200000)
_number("p2_ge", "part", "p_size", "greaterThanOrEquals", 40)
_number("p2_lt", "orders", "o_totalprice", "lessThan", 5000)
_number("p2_le", "part", "p_size", "lessThanOrEquals", 3)
_number("p3_text_number", "part", "p_size", "equals", "12 pieces")
_number("p3_empty", "part", "p_size", "equals", "")
_number("p4_expression", "part", "p_size", "expression", "v > 10 and v * 2 < 50")
_number("p4_digits", "part", "p_size", "expression", "7")
_number("p4_invalid", "part", "p_size", "expression", "w > 10")
_number("p14_between", "part", "p_size", "between", (5, 8))
_text("p5_eq", "customer", "c_mktsegment", "equals", "building")
_text("p5_ne", "customer", "c_mktsegment", "notEquals", "Building")
_text("p6_starts", "part", "p_name", "startsWith", "Blue a")
_text("p6_ends", "part", "p_name", "endsWith", "Anvil")
_text("p6_contains", "part", "p_name", "contains", "E A")
_text("p6_not_contains", "part", "p_name", "notContains", "blue")
_text("p7_regex", "part", "p_name", "regExp", "^[bg].*[ln]$")
_text("p7_invalid", "part", "p_name", "regExp", "([")
_text("p8_number_text", "part", "p_size", "equals", "12")
_text("p8_double_text", "supplier", "s_acctbal", "contains", "99")
_text("p9_space_case", "part", "p_name", "contains", "A N V", False)
_text("p9_match_case", "customer", "c_mktsegment", "equals", "BUILDING", True)


def _flags(name: str, operator: str, search: object) -> None:
    def run(spark, sf_dir):
        f = ColumnFilter("toxic", operator, search, "boolean")
        rows = t(spark, sf_dir, "labels")
        return rows.where(f.value_matches(F.col("toxic"), rows.schema["toxic"].dataType)).select("doc_id", "toxic")

    QUERIES[name] = run


_flags("p10_bool_eq", "equals", True)
_flags("p10_bool_ne", "notEquals", "yes")
_flags("p11_bool_words", "equals", "nein")


# ---------------------------------------------------------------- nested values

@query
def n1_prune(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", nested.prune(F.col("props"), ["k"]).alias("pruned"), nested.prune(F.col("props"), ["none"]).alias("empty"))


@query
def n2_set_path(spark, sf_dir):
    n = t(spark, sf_dir, "nation").select("n_nationkey", F.struct(F.struct(F.col("n_name").alias("name"), F.lit("stale").alias("_hash")).alias("inner")).alias("v"))
    out = n.select("n_nationkey", nested.set_field(n, "v", ["inner", "name"], F.lit("set")).alias("v"))
    return out.select("n_nationkey", F.to_json("v").alias("v"))


@query
def n3_merge(spark, sf_dir):
    e = t(spark, sf_dir, "events").select(F.col("event_type").alias("path"), F.col("event_id").alias("ord"), F.array("user_id", F.col("event_id") % 10).alias("users"))
    return nested.merged_elements(e, "users")


@query
def n3_merge_maps(spark, sf_dir):
    e = t(spark, sf_dir, "events").select(F.col("event_type").alias("path"), F.col("event_id").alias("ord"), F.create_map((F.col("user_id") % 7).cast("string"), F.col("event_id").cast("string")).alias("m"))
    return nested.merge_by_path(e, maps=["m"]).select("path", F.explode("m").alias("k", "v"))


@query
def n4_make_unique(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", text_hash(F.col("text")).alias("h"))
    return d.groupBy("h").agg(F.min("doc_id").alias("doc_id"))


@query
def n4_nested_unique(spark, sf_dir):
    """Orders with their lines as an array: of lines with one supplier the first stays."""
    line = F.struct("l_linenumber", F.col("l_suppkey").cast("string").alias("_hash"))
    orders = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return nested.unique(orders).select("l_orderkey", F.explode("lines").alias("x")).select("l_orderkey", F.col("x._hash").alias("supplier"), F.col("x.l_linenumber").alias("l_linenumber"))


@query
def n5_merge_tables(spark, sf_dir):
    a = t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation_key"))
    b = t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation_key"))
    return a.unionByName(b).dropDuplicates(["nation_key"])


@query
def n10_overlap(spark, sf_dir):
    o = order_parts(spark, sf_dir)
    return o.where(F.arrays_overlap("parts", F.array(*(F.lit(x).cast("long") for x in (1, 2, 3, 5, 8))))).select("l_orderkey")


# ---------------------------------------------------------------- trees

def geography(spark, sf_dir) -> DataFrame:
    """world > region > nation > supplier, as nodes whose hash is their key."""
    r, n, s = t(spark, sf_dir, "region"), t(spark, sf_dir, "nation"), t(spark, sf_dir, "supplier")
    key = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    none = F.array().cast("array<string>")
    suppliers = s.select(key("s", "s_suppkey").alias("_hash"), F.col("s_name").alias("id"), F.lit(False).alias("isParent"), none.alias("children"), F.concat(F.lit('{"value":'), quoted(F.col("s_name")), F.lit("}")).alias("meta"))
    of_nation = s.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list(key("s", "s_suppkey"))).alias("children"))
    nations = n.join(of_nation, "n_nationkey", "left").select(key("n", "n_nationkey").alias("_hash"), F.col("n_name").alias("id"), F.lit(True).alias("isParent"), F.coalesce("children", none).alias("children"), F.lit(None).cast("string").alias("meta"))
    of_region = n.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list(key("n", "n_nationkey"))).alias("children"))
    regions = r.join(of_region, "r_regionkey", "left").select(key("r", "r_regionkey").alias("_hash"), F.col("r_name").alias("id"), F.lit(True).alias("isParent"), F.coalesce("children", none).alias("children"), F.lit(None).cast("string").alias("meta"))
    world = r.agg(F.array_sort(F.collect_list(key("r", "r_regionkey"))).alias("children")).select(F.lit("w").alias("_hash"), F.lit("world").alias("id"), F.lit(True).alias("isParent"), "children", F.lit(None).cast("string").alias("meta"))
    return world.unionByName(regions).unionByName(nations).unionByName(suppliers)


@query
def c24_tree_expand(spark, sf_dir):
    return tree.expand(geography(spark, sf_dir)).select(F.array_join("path", "/").alias("path"), F.col("depth").cast("long").alias("depth"))


@query
def c24_tree_path(spark, sf_dir):
    nodes = geography(spark, sf_dir)
    return tree.expand(nodes, path=["world", "ASIA"]).select(F.array_join("path", "/").alias("path"))


@query
def c25_roots(spark, sf_dir):
    return tree.roots(geography(spark, sf_dir)).select(F.col("_hash").alias("root"), "id")


@query
def c25_nested_object(spark, sf_dir):
    return tree.nested(geography(spark, sf_dir).where("not _hash like 's%'")).select(text_hash(F.col("value")).alias("value_hash"))


@query
def c26_tree_cells(spark, sf_dir):
    return tree.cells(geography(spark, sf_dir)).select(F.array_join("path", "/").alias("path"), "meta")


@query
def c27_tree_child_refs(spark, sf_dir):
    return tree.child_edges(geography(spark, sf_dir))


@query
def n8_merkle(spark, sf_dir):
    r, n = t(spark, sf_dir, "region"), t(spark, sf_dir, "nation")
    edges = n.select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"))
    texts = r.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("text")).unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("text")))
    return tree.merkle(edges, texts)


# ---------------------------------------------------------------- history

def event_history(spark, sf_dir) -> DataFrame:
    """Each user's events as a chain; links of every eleventh event skip one, which opens a fork."""
    e = t(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    own = lambda c: F.format_string("%020d", c)
    back = F.when(F.col("event_id") % 11 == 0, F.lag("event_id", 2).over(w)).otherwise(F.lag("event_id", 1).over(w))
    linked = e.select("user_id", "event_id", "event_type", millis().alias("ms"), back.alias("b"))
    return linked.select("user_id", own(F.col("event_id")).alias("timeId"), F.col("event_type").alias("ref"), "ms", F.when(F.col("b").isNull(), F.array().cast("array<string>")).otherwise(F.array(own(F.col("b")))).alias("previous"))


@query
def h5_forks(spark, sf_dir):
    return history.forks(event_history(spark, sf_dir), ["user_id"]).select("user_id", F.size("branches").cast("long").alias("n_branches"), F.array_join("branches", ",").alias("branches"))


@query
def h5_linear(spark, sf_dir):
    return history.tips(event_history(spark, sf_dir), per=["user_id"]).groupBy("user_id").agg(F.count("*").alias("n_tips")).where("n_tips = 1").select("user_id")


@query
def h6_sorted(spark, sf_dir):
    h = event_history(spark, sf_dir).select("timeId")
    return ranked(h, [F.col("timeId").desc()], "place").select("timeId", "place")


@query
def h7_rows_of_ref(spark, sf_dir):
    return history.rows_of_ref(event_history(spark, sf_dir), "ref", "purchase").select("timeId", "user_id")


@query
def h8_row_of_time(spark, sf_dir):
    return history.row_of_time(event_history(spark, sf_dir), f"{17:020d}").select("timeId", "user_id", "ref")


@query
def h9_timeids(spark, sf_dir):
    h = event_history(spark, sf_dir)
    return history.time_ids(h, "ref", h.select("ref").distinct().where("ref like 'p%'")).select("ref", "timeId")


@query
def h10_time_travel(spark, sf_dir):
    h = event_history(spark, sf_dir)
    ids = t(spark, sf_dir, "events").where("event_id % 50 = 3").select(F.format_string("%020d", "event_id").alias("timeId"))
    return history.refs_of_times(h, "ref", ids)


@query
def h10_as_of(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    h = e.select("user_id", F.concat(millis().cast("string"), F.lit(":"), F.col("event_id").cast("string")).alias("timeId"), F.col("event_id").alias("ref"))
    middle = e.agg(F.min(millis()).alias("a"), F.max(millis()).alias("b")).first()
    return history.as_of(h, "ref", (middle.a + middle.b) // 2, "user_id").select("user_id", "ref")


@query
def d1_by_time(spark, sf_dir):
    h = event_history(spark, sf_dir).select("timeId", "user_id")
    return ranked(h, [F.col("timeId").asc()], "place").select("timeId", "user_id", "place")


@query
def d2_latest_first(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", F.concat(millis().cast("string"), F.lit(":"), F.col("event_id").cast("string")).alias("timeId"))
    return ranked(e, [history.stamp("timeId").desc(), F.col("event_id").asc()], "place").select("event_id", "place")


# ---------------------------------------------------------------- edits

def order_edits() -> edits.MultiEdit:
    chain = edits.MultiEdit(edits.Edit("columns", VIEW))
    chain = chain.then(edits.Edit("open", RowFilter((ColumnFilter("orderLayer/o_orderstatus", "equals", "O"), ColumnFilter("orderLayer/o_totalprice", "greaterThan", 150000, "number")))))
    chain = chain.then(edits.Edit("order", RowSort((("orderLayer/o_totalprice", "desc"),))))
    chain = chain.then(edits.Edit("set", SetValue("orderLayer/o_orderpriority", "0-NOW")))
    chain = chain.then(edits.Edit("few", Selection.from_routes(["orderLayer/o_orderpriority", "customerLayer/c_mktsegment"])))
    return chain


def edited(view: View) -> DataFrame:
    return view.rows.select("slice_id", "ord", F.array_join("o_orderpriority", "|").alias("priority"), F.array_join("c_mktsegment", "|").alias("segment"))


@query
def e3_replay(spark, sf_dir):
    return edited(edits.replay(order_view(spark, sf_dir), order_edits()))


@query
def e4_restored(spark, sf_dir):
    """The same edits, stored in two steps and restored from the timeline."""
    own, chain = Store(spark), order_edits()
    edits.create_tables(own, "orderCake")
    first = edits.save(own, "orderCake", chain.previous, "orders")
    last = edits.save(own, "orderCake", chain, "orders", [first])
    return edited(edits.replay(order_view(spark, sf_dir), edits.restore(own, "orderCake", last)))


@query
def e3_chain_order(spark, sf_dir):
    """Conversations as chains of edits: each turn's previous is the turn before."""
    c = t(spark, sf_dir, "conversations").select("conv_id", "turn", "role").distinct()
    one = c.groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    key = lambda turn: F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    links = one.select("conv_id", "turn", "role", before.alias("b")).select(key(F.col("turn")).alias("_hash"), F.col("role").alias("edit"), F.when(F.col("b").isNotNull(), key(F.col("b"))).alias("previous"))
    ends = links.join(links.select(F.col("previous").alias("_hash")), "_hash", "left_anti").select("_hash")
    return edits.chain_order(links, ends).select("root", F.col("position").cast("long").alias("position"), "edit")


# ---------------------------------------------------------------- change feed

def feed(spark, sf_dir) -> DataFrame:
    e = t(spark, sf_dir, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    sent = e.select("event_id", "ts", "user_id", F.concat_ws(":", "event_type", (F.col("event_id") % 200).cast("string")).alias("r"), seq.cast("long").alias("seq"))
    return sent.select("*", F.concat(F.lit("peer"), (F.col("user_id") % 5).cast("string")).alias("o"))


@query
def t3_outgoing(spark, sf_dir):
    """Refs that peers have to send: what they sent or received before is left out."""
    f = feed(spark, sf_dir).withColumnRenamed("o", "route")
    return sync.outgoing(f.where("event_id % 3 = 2"), ["ts", "event_id"], f.where("event_id % 3 = 0"), f.where("event_id % 3 = 1")).select("event_id", "route", "r")


@query
def t9_bootstrap(spark, sf_dir):
    """A client that joins late: each route's latest ref, then what comes; every ref once."""
    f = feed(spark, sf_dir).select(F.col("o").alias("route"), "ts", "event_id", "r")
    held, live = f.where("event_id % 4 > 0"), f.where("event_id % 4 = 0")
    both = sync.incoming(live, sync.bootstrap(held, ["ts", "event_id"]))
    return sync.first_seen(both, ["route", "r"], ["ts", "event_id"]).select("event_id", "route", "r")


@query
def t4_enrich(spark, sf_dir):
    refs = feed(spark, sf_dir).select(F.col("o").alias("route"), "r", F.col("event_id").alias("ord"))
    return sync.enrich(refs, "me", causal=True).select("route", "o", "r", "seq")


@query
def t5_dedup(spark, sf_dir):
    return sync.first_seen(feed(spark, sf_dir), ["r"], ["ts", "event_id"]).select("event_id", "r")


@query
def t6_origin(spark, sf_dir):
    return sync.not_from(feed(spark, sf_dir), "peer3").select("event_id", "o")


@query
def t7_gaps(spark, sf_dir):
    seen = feed(spark, sf_dir).where("event_id % 7 <> 0")
    return sync.gaps(seen, "user_id", "seq", ["ts", "event_id"])


@query
def t8_gap_fill(spark, sf_dir):
    log = feed(spark, sf_dir).select("event_id", "user_id", "seq", "ts")
    asked = sync.gaps(log.where("event_id % 7 <> 0"), "user_id", "seq", ["ts", "event_id"])
    return sync.gap_fill(log, asked, "user_id", "seq").select("event_id", "user_id", "seq")


@query
def t11_unacked(spark, sf_dir):
    log = feed(spark, sf_dir)
    sent = log.select("event_id", F.col("ts").alias("sent_at"))
    acks = log.where("event_id % 3 <> 0").select("event_id", (F.col("ts") + F.expr("INTERVAL 1 SECOND") * (F.col("event_id") % 20)).alias("acked_at"))
    return sync.unacked(sent, acks, "event_id", "sent_at", "acked_at").select("event_id")


@query
def t13_predecessors(spark, sf_dir):
    h = event_history(spark, sf_dir)
    return sync.predecessors(h.select("timeId", "previous"), h, "timeId", "ref").select("timeId", F.array_join("p", ",").alias("p"))
