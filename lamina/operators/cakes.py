"""Cakes, layers and slice sets of a store: their entries as rows, routes through them, inserts.

A cake row has `sliceIdsTable`, `sliceIdsRow` and a map `layers` (layer table -> layer). A layer row has
`base`, `sliceIdsTable`, `sliceIdsTableRow`, `componentsTable`; a slice set has `base`. What they add and
remove is held as rows of a companion table `<table>Entries` (member, slice, ref, pos, op), so that no
layer has to fit one row; maps and arrays `add` and `remove` in the row itself count as well.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.functions.hashing import HASH, hash_of, row_hash, with_hash
from lamina.operators import history, resolve
from lamina.operators.traverse import edges, property_of, where_on_references
from lamina.operators.view import View
from lamina.plans.route import Route, bind, parse
from lamina.plans.selection import Selection
from lamina.sources.scratch import stored
from lamina.sources.store import Column, Store, TableConfig

OPS = ("add", "remove")


def entries_key(table: str) -> str:
    return f"{table}Entries"


def entries_of(store: Store, table: str) -> DataFrame:
    """(member, slice, ref, pos, op) of a table of layers or slice sets; a set's ref is the slice itself."""
    rows, id_ = store.table(table), store.config(table).id
    parts = []
    if store.has_table(entries_key(table)):
        parts.append(store.table(entries_key(table)).select("member", "slice", "ref", "pos", "op"))
    for op in OPS:
        kind = rows.schema[op].dataType if op in rows.columns else None
        if isinstance(kind, T.MapType):
            own = rows.select(F.col(id_).alias("member"), F.posexplode(op).alias("pos", "slice", "ref"))
        elif isinstance(kind, T.ArrayType):
            own = rows.select(F.col(id_).alias("member"), F.posexplode(op).alias("pos", "slice")).withColumn("ref", F.col("slice"))
        else:
            continue
        parts.append(own.select("member", "slice", "ref", F.col("pos").cast("long").alias("pos"), F.lit(op).alias("op")))
    if not parts:
        return store.spark.createDataFrame([], "member string, slice string, ref string, pos long, op string")
    return reduce(DataFrame.unionByName, parts).where(~F.col("slice").cast("string").startswith("_"))


def held(store: Store, table: str, roots: DataFrame | None = None, slices: DataFrame | None = None) -> DataFrame:
    """(root, slice, ref) that layers or slice sets hold, bases included. roots and slices prune before the chain."""
    return resolve.resolve_layers(_chained(store, table), entries_of(store, table), store.config(table).id, "base", roots, slices)


def _chained(store: Store, table: str) -> DataFrame:
    rows = store.table(table)
    return rows if "base" in rows.columns else rows.withColumn("base", F.lit(None).cast("string"))


def child_refs(store: Store, table: str) -> DataFrame:
    """(parent, child_table, column, ref, slice_ids) by content type: references of components, layers of cakes,
    components of layers for each slice, children of tree nodes; slice sets have none.
    """
    kind, rows, id_ = store.content_type(table), store.table(table), store.config(table).id
    none, no_slices = F.lit(None).cast("string").alias("column"), F.lit(None).cast("array<string>").alias("slice_ids")
    if kind == "cakes":
        spread = rows.select(F.col(id_).alias("parent"), F.explode("layers").alias("child_table", "ref")).where("not startswith(child_table, '_')")
        return spread.select("parent", "child_table", none, "ref", no_slices)
    if kind == "layers":
        to = rows.select(F.col(id_).alias("root"), F.col("componentsTable").alias("child_table"))
        return held(store, table).join(to, "root").select(F.col("root").alias("parent"), "child_table", none, "ref", F.array("slice").alias("slice_ids"))
    if kind == "trees":
        return rows.select(F.col(id_).alias("parent"), F.lit(table).alias("child_table"), none, F.explode("children").alias("ref"), no_slices)
    if kind == "components" and store.config(table).references:
        parts = [edges(rows, id_, c, r.table) for c, r in store.config(table).references.items()]
        return reduce(DataFrame.unionByName, parts)
    return store.spark.createDataFrame([], "parent string, child_table string, column string, ref string, slice_ids array<string>")


def chained(rows: list[dict]) -> list[dict]:
    """Rows in order, each with the hash of the one before as its base, and with its own hash."""
    out: list[dict] = []
    for row in rows:
        own = {**row, **({"base": out[-1][HASH]} if out else {})}
        out.append({HASH: hash_of(own), **own})
    return out


# ---------------------------------------------------------------- filters

def cakes_with(store: Store, table: str, layer_table: str, layer: object) -> DataFrame:
    """Cakes that hold this layer under the layer table's name."""
    return store.table(table).where(F.element_at("layers", F.lit(layer_table)) == F.lit(layer))


def layers_with(store: Store, table: str, refs: DataFrame) -> DataFrame:
    """(root, ref): layers that hold any of refs (ref), bases included; each pair once."""
    return held(store, table).join(refs.select("ref"), "ref", "left_semi").select("root", "ref").distinct()


def sets_with(store: Store, table: str, slice_: object) -> DataFrame:
    """Slice sets that add this slice themselves; bases do not count."""
    own = entries_of(store, table).where((F.col("op") == "add") & (F.col("slice") == F.lit(slice_))).select(F.col("member").alias(store.config(table).id))
    return store.table(table).join(own, store.config(table).id, "left_semi")


def components_with(store: Store, table: str, key: str, value: object) -> DataFrame:
    """Rows whose column equals a value or, where it is an array, or another array column, holds it."""
    rows = store.table(table)
    arrays = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.ArrayType) and not isinstance(f.dataType.elementType, (T.ArrayType, T.StructType, T.MapType))]
    tests = [F.array_contains(a, F.lit(value).cast(rows.schema[a].dataType.elementType)) for a in arrays]
    if key in rows.columns and key not in arrays:
        tests.append(F.col(key) == F.lit(value))
    return rows.where(F.coalesce(reduce(lambda a, b: a | b, tests, F.lit(False)), F.lit(False)))


def slices_meet(store: Store, table: str, wanted: DataFrame) -> DataFrame:
    """(id, slices) of those pairs of a cake or layer and a set of slices whose resolved slices meet.

    Only the wanted slices are followed through the chains of the slice sets.
    """
    rows, config = store.table(table), store.config(table)
    at = "sliceIdsRow" if config.type == "cakes" else "sliceIdsTableRow"
    asked = wanted.select("id", "slices", F.explode("slices").alias("slice"))
    out = None
    # which tables hold the sets is a property of few configurations, not of rows
    for key in (k for k, c in store.configs.items() if c.type == "sliceIds"):
        of_set = rows.where(F.col("sliceIdsTable") == key).select(F.col(config.id).alias("id"), F.col(at).alias("root"))
        pairs = asked.join(of_set, "id")
        hit = pairs.join(held(store, key, of_set.select("root").distinct(), asked.select("slice")).select("root", "slice"), ["root", "slice"], "left_semi").select("id", "slices")
        out = hit if out is None else out.unionByName(hit)
    return wanted.select("id", "slices").where("false") if out is None else out.distinct()


# ---------------------------------------------------------------- views

def one_cake(store: Store, table: str, ref: object):
    """The one cake of a ref; none or several are an error. Two rows are looked at, not all."""
    found = store.read_row(table, ref).limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"cake {ref!r} {'not found' if not found else 'found more than once'} in {table!r}")
    return found[0]


def single(store: Store, table: str) -> DataFrame:
    """Cakes that are found by their id alone; those that share one are what `one_cake` refuses."""
    rows, id_ = store.table(table), store.config(table).id
    return rows.join(rows.groupBy(id_).agg(F.count("*").alias("lamina_n")).where("lamina_n = 1").select(id_), id_, "left_semi")


def cake_view(store: Store, table: str, ref: object, selection: Selection) -> View:
    """A view of one cake's slices over the layers that the selection's columns name."""
    cake = one_cake(store, table, ref)
    sets = cake.sliceIdsTable
    root = store.spark.createDataFrame([(cake.sliceIdsRow,)], "root string")
    members = held(store, sets, root).select(F.col("slice").alias("slice_id"))
    # a set's order is that of its chain, base first
    links = resolve.chains(_chained(store, sets), store.config(sets).id, "base", root)
    own = entries_of(store, sets).where("op = 'add'")
    first = links.join(own, "member").groupBy(F.col("slice").alias("slice_id")).agg(F.min(F.struct((-F.col("depth")).alias("level"), "pos")).alias("at"))
    slices = members.join(first, "slice_id").select("slice_id", F.struct("at.level", "at.pos", F.col("slice_id").cast("string").alias("slice")).alias("ord"))
    layers = {}
    for name in dict.fromkeys(c.layer for c in selection.columns):
        if name not in cake.layers:
            raise KeyError(f"cake {ref!r} has no layer {name!r}")
        layer = store.spark.createDataFrame([(cake.layers[name],)], "root string")
        components = one_value(store, name, cake.layers[name], "componentsTable")
        layers[name] = (held(store, name, layer).select(F.col("slice").alias("slice_id"), "ref"), store.table(components).withColumnRenamed(store.config(components).id, "id"))
    return View.build(slices, layers, selection)


def one_value(store: Store, table: str, ref: object, column: str):
    row = store.read_row(table, ref).select(column).first()
    if row is None or row[0] is None:
        raise ValueError(f"{ref!r} of {table!r} has no {column}")
    return row[0]


# ---------------------------------------------------------------- inserts

def create_layers(store: Store, key: str, *, sets: bool = False) -> None:
    """A table of layers (or slice sets), its entries and its history."""
    names = ("base",) if sets else ("base", "sliceIdsTable", "sliceIdsTableRow", "componentsTable")
    store.create_table_with_history(TableConfig(key, "sliceIds" if sets else "layers", tuple(Column(n) for n in names)))
    columns = (Column("member"), Column("slice"), Column("ref"), Column("pos", "integer"), Column("op"))
    store.create_table(TableConfig(entries_key(key), "components", columns))


def _command(command: str, allowed: tuple[str, ...]) -> str:
    for op in allowed:
        if command.startswith(op):
            return op
    raise ValueError(f"command {command!r} is not supported here; it must start with {' or '.join(allowed)}")


def _base(store: Store, key: str, base: str | None):
    if base is None:
        return None
    row = store.read_row(key, base).first()
    if row is None:
        raise ValueError(f"base {base} does not exist in {key!r}")
    return row


def _content(entries: DataFrame) -> str:
    """A hash of entries that no task has to see in one piece: number of rows and sums of their hashes' halves."""
    h = F.sha2(F.to_json(F.struct("slice", "ref", "pos")), 256)
    part = lambda at: F.sum(F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(38,0)"))
    return hash_of({k: str(v) for k, v in entries.agg(F.count("*").alias("n"), part(1).alias("a"), part(16).alias("b")).first().asDict().items()})


def _insert_entries(store: Store, key: str, op: str, entries: DataFrame, row: dict, origin: str | None, route: str, previous: list[str] | None) -> tuple[str, str]:
    id_ = hash_of({**row, op: _content(entries)})
    store.upsert(entries_key(key), entries.select(F.lit(id_).alias("member"), "slice", "ref", F.col("pos").cast("long").alias("pos"), F.lit(op).alias("op")))
    if store.read_row(key, id_).first() is None:
        names = [c.key for c in store.config(key).columns]
        store.append_hashed(key, store.spark.createDataFrame([(id_, *(row.get(n) for n in names))], ", ".join(f"`{n}` string" for n in (HASH, *names))))
    return id_, history.append(store, key, id_, route, origin, previous)


def insert_slices(store: Store, key: str, command: str, slices: DataFrame, base: str | None = None, origin: str | None = None, route: str = "", previous: list[str] | None = None) -> tuple[str, str]:
    """Add a set that adds, or removes, slices (slice[, pos]) over its base; returns (set, time id).

    The base must exist. Slices without `pos` stand in the order of their names; repeated ones count once.
    """
    op = _command(command, OPS)
    _base(store, key, base)
    pos = F.col("pos") if "pos" in slices.columns else F.lit(0)
    own = slices.where("slice is not null").groupBy(F.col("slice").cast("string").alias("slice")).agg(F.min(pos).alias("pos"))
    return _insert_entries(store, key, op, stored(own.withColumn("ref", F.col("slice")), "entries"), {"base": base}, origin, route or f"/{key}", previous)


def insert_layer(store: Store, key: str, command: str, entries: DataFrame, base: str | None = None, origin: str | None = None, route: str = "", previous: list[str] | None = None, **refs: str) -> tuple[str, str]:
    """Add a layer that adds, or removes, entries (slice, ref) over its base; returns (layer, time id).

    refs (sliceIdsTable, sliceIdsTableRow, componentsTable) not given are those of the base, which must exist.
    Two refs for one slice are an error.
    """
    op = _command(command, OPS)
    below = _base(store, key, base)
    names = ("sliceIdsTable", "sliceIdsTableRow", "componentsTable")
    if unknown := set(refs) - set(names):
        raise ValueError(f"no references of a layer: {sorted(unknown)}")
    own = entries.where("slice is not null and ref is not null").select(F.col("slice").cast("string").alias("slice"), F.col("ref").cast("string").alias("ref")).distinct()
    own = stored(own, "entries")
    twice = own.groupBy("slice").count().where("count > 1").first()
    if twice:
        raise ValueError(f"slice {twice['slice']!r} has more than one ref; a layer holds one")
    row = {"base": base, **{n: refs.get(n, below[n] if below else None) for n in names}}
    return _insert_entries(store, key, op, own.withColumn("pos", F.lit(0)), row, origin, route or f"/{key}", previous)


def insert_cake(store: Store, key: str, command: str, layers: Mapping[str, object], base: str | None = None, origin: str | None = None, route: str = "", previous: list[str] | None = None, **refs: str) -> tuple[str, str]:
    """Add a cake: the base's layers with the given ones laid over them; returns (cake, time id).

    A layer is one ref, or a list of one; more are an error. refs (sliceIdsTable, sliceIdsRow, id) not given are
    those of the base.
    """
    _command(command, ("add",))
    below = _base(store, key, base)
    given = {}
    for name, ref in layers.items():
        if isinstance(ref, (list, tuple)):
            if len(ref) != 1:
                raise ValueError(f"layer {name!r} must have one ref, not {len(ref)}")
            ref = ref[0]
        given[name] = ref
    held_ = {**{k: v for k, v in (below.layers if below else {}).items() if not k.startswith("_")}, **given}
    names = ("sliceIdsTable", "sliceIdsRow", "id")
    values = {n: refs.get(n, below[n] if below and n in below else None) for n in names}
    row = store.spark.createDataFrame([(held_, *values.values())], "layers map<string,string>, sliceIdsTable string, sliceIdsRow string, id string")
    id_ = with_hash(row).first()[HASH]
    store.upsert(key, row)
    return id_, history.append(store, key, id_, route or f"/{key}", origin, previous)


def create_cakes(store: Store, key: str) -> None:
    store.create_table_with_history(TableConfig(key, "cakes", (Column("layers", "json"), Column("sliceIdsTable"), Column("sliceIdsRow"), Column("id"))))


def insert_components(store: Store, key: str, command: str, rows: DataFrame, origin: str | None = None, refs: Mapping[str, str] | None = None, previous: list[str] | None = None) -> tuple[DataFrame, str | None]:
    """Add component rows and their history; any other command, and references of a controller, are errors."""
    _command(command, ("add",))
    if refs:
        raise ValueError(f"components of {key!r} take no references")
    return history.insert(store, f"/{key}", rows, origin, previous)


def previous_of(store: Store, table: str, ref: str | None) -> list[str]:
    """Time ids that a segment's ref stands for: the ref itself if it is one, else those of the row."""
    if ref is None or not store.has_table(f"{table}InsertHistory"):
        return []
    if ":" in ref:
        return [ref]
    # a ref has one row for each time it was written
    found = history.rows_of_ref(store.table(f"{table}InsertHistory"), f"{table}Ref", ref).select("timeId").collect()
    return sorted(r.timeId for r in found)


def insert_through(store: Store, route: str | Route, rows: DataFrame, origin: str | None = None) -> dict[str, str]:
    """Write new cells of a cake, children first: /cake@ref/layer/component with rows (slice, component columns).

    Components come first, then a layer over the cake's present one, then a cake over the present one; each
    has a history row with the route and, as `previous`, the time ids of what its segment refers to. Returns
    the new ref of each table (for the components their time id).
    """
    parsed = route if isinstance(route, Route) else parse(route)
    if len(parsed.segments) != 3 or [store.content_type(t) for t in parsed.tables] != ["cakes", "layers", "components"]:
        raise ValueError(f"not a route from a cake through a layer to its components: {parsed}")
    cake, layer, component = parsed.segments
    if cake.ref is None:
        raise ValueError(f"the cake needs a ref: {parsed}")
    at = dict(zip(parsed.tables, (previous_of(store, s.table, s.ref) for s in parsed.segments), strict=True))
    cake_ref = _ref(store, cake)
    present = one_cake(store, cake.table, cake_ref)
    base = _ref(store, layer) if layer.ref else present.layers.get(layer.table)
    columns = [c for c in rows.columns if c != "slice"]
    hashed = stored(rows.select("slice", row_hash(rows.schema, columns).alias("ref"), *columns), "cells")
    if hashed.where("slice is null").limit(1).count():
        raise ValueError("a cell needs a slice")
    _, made = history.insert(store, str(parsed), hashed.select(*columns), origin, at[component.table])
    refs = {} if base else {"sliceIdsTable": present.sliceIdsTable, "sliceIdsTableRow": present.sliceIdsRow, "componentsTable": component.table}
    layer_ref, _ = insert_layer(store, layer.table, "add", hashed.select("slice", "ref"), base, origin, str(parsed), at[layer.table], **refs)
    new_cake, _ = insert_cake(store, cake.table, "add", {layer.table: layer_ref}, cake_ref, origin, str(parsed), at[cake.table])
    return {cake.table: new_cake, layer.table: layer_ref, component.table: made}


def _ref(store: Store, segment) -> str:
    if not segment.by_time:
        return segment.ref
    row = history.row_of_time(store.table(f"{segment.table}InsertHistory"), segment.ref).first()
    if row is None:
        raise ValueError(f"time {segment.ref!r} is not in the history of {segment.table!r}")
    return row[f"{segment.table}Ref"]


# ---------------------------------------------------------------- routes with slices

def get(store: Store, route: str | Route, where: Mapping[str, object] | str | None = None, slices: list[str] | None = None) -> CakeRoute:
    """Rows that a route reaches through cakes, layers and components, for some slices or for all.

    A segment's own slices win over those from above; below a reference to a cake the reference's slices
    hold, between components none do. Cakes and layers stay if their resolved slices meet those that hold,
    components if the slices of the reference to them do (at the start of a route, where no reference leads
    to them, none stay); other tables are not filtered. A row stays only with a surviving child.
    """
    bound = bind(route if isinstance(route, Route) else parse(route), set(store.configs))
    node: object = where
    levels, links, state = [], [], None
    for n, segment in enumerate(bound.segments):
        config = store.config(segment.table)
        child = bound.tables[n + 1] if n + 1 < len(bound.segments) else None
        own, node = ({config.id: node}, None) if node is not None and not isinstance(node, Mapping) else ({k: v for k, v in (node or {}).items() if k != child}, (node or {}).get(child))
        if segment.ref is not None:
            own = {config.id: _ref(store, segment)}
        rows = where_on_references(store, segment.table, own) if own else store.table(segment.table)
        levels.append(rows)
        ids = rows.select(F.col(config.id).alias("id"))
        fixed = F.array(*map(F.lit, sorted(set(segment.slices)))) if segment.slices else None
        none = F.array().cast("array<string>")
        if n == 0:
            start = fixed if fixed is not None else F.array(*map(F.lit, sorted(set(slices)))) if slices else none
            state = _slice_filter(store, segment.table, ids.select("id", start.alias("slices")))
            if config.type == "components":
                state = state.where(F.size("slices") == 0)
            continue
        found = _links(store, bound.tables[n - 1], segment.table, levels[n - 1], state)
        if fixed is not None:
            found = found.withColumn("below", fixed)
        found = found.join(ids.withColumnRenamed("id", "ref"), "ref", "left_semi")
        if config.type == "components":
            found = found.where((F.size("below") == 0) | F.coalesce(F.arrays_overlap("own", "below"), F.lit(False)))
        elif config.type in ("cakes", "layers"):
            kept = _slice_filter(store, segment.table, found.select(F.col("ref").alias("id"), F.col("below").alias("slices")).distinct())
            found = found.join(kept.select(F.col("id").alias("ref"), F.col("slices").alias("below")), ["ref", "below"], "left_semi")
        # written once: the next hop, the way back and the paths all read it, and the chains above need not run again
        found = stored(found.select("parent", "slices", "slice", "ref", "below"), "links")
        links.append(found)
        state = found.select(F.col("ref").alias("id"), F.col("below").alias("slices")).distinct()
    # back: a link stays only if its child has one below
    for n in range(len(links) - 2, -1, -1):
        deeper = links[n + 1].select(F.col("parent").alias("ref"), F.col("slices").alias("below"))
        links[n] = links[n].join(deeper, ["ref", "below"], "left_semi")
    return CakeRoute(store, bound, levels, links, state)


def _slice_filter(store: Store, table: str, wanted: DataFrame) -> DataFrame:
    """wanted (id, slices) without the cakes and layers whose slices do not meet the wanted ones; none wanted: all stay."""
    if store.content_type(table) not in ("cakes", "layers"):
        return wanted
    return wanted.where(F.size("slices") == 0).unionByName(slices_meet(store, table, wanted.where(F.size("slices") > 0)))


def _links(store: Store, parent: str, child: str, rows: DataFrame, state: DataFrame) -> DataFrame:
    """(parent, slices, slice, ref, own, below) from states (id, slices) of a parent table to its child table.

    own: slices of the reference itself; below: slices that hold in the child unless its segment has its own.
    """
    config, kind = store.config(parent), store.content_type(parent)
    text = lambda c: F.col(c).cast("string")
    if kind == "cakes":
        refs = rows.select(F.col(config.id).alias("id"), F.element_at("layers", F.lit(child)).alias("ref")).where("ref is not null")
        return state.join(refs, "id").select(F.col("id").alias("parent"), "slices", F.lit(None).cast("string").alias("slice"), "ref", F.lit(None).cast("array<string>").alias("own"), F.col("slices").alias("below"))
    if kind == "layers":
        to = rows.where(F.col("componentsTable") == child).select(F.col(config.id).alias("id"))
        at = held(store, parent, to.withColumnRenamed("id", "root")).select(F.col("root").alias("id"), text("slice").alias("slice"), "ref")
        # slices that are not asked for are left out here, before components are read; those asked for are found by equality
        # with the layer's own, since many states may ask one layer for a slice each
        kinds = {r.lamina_all for r in state.select((F.size("slices") == 0).alias("lamina_all")).distinct().collect()}
        if kinds == {True, False}:
            at = stored(at, "held")
        asked = state.where(F.size("slices") > 0).withColumn("slice", F.explode(F.array_distinct("slices"))).join(at, ["id", "slice"])
        whole = state.where(F.size("slices") == 0).join(at, "id")
        at = whole.unionByName(asked) if kinds == {True, False} else whole if True in kinds else asked
        return at.select(F.col("id").alias("parent"), "slices", "slice", "ref", F.array("slice").alias("own"), F.col("slices").alias("below"))
    if kind != "components":
        raise ValueError(f"rows of {parent!r} ({kind}) have no children on a route")
    columns = [c for c, r in config.references.items() if r.table == child]
    if not columns:
        raise ValueError(f"no reference leads from {parent!r} to {child!r}")
    to_cakes = {store.content_type(r.table) == "cakes" for r in config.references.values()}
    if len(to_cakes) > 1 and store.content_type(child) == "cakes":
        raise ValueError(f"{parent!r} refers to cakes and to other tables: slices below {child!r} are not defined")
    every = [_slices_of(rows, c) for c in config.references if _has_slices(rows, c)]
    switched = F.array_sort(F.array_distinct(F.concat(*every))) if every else F.array().cast("array<string>")
    below = switched if store.content_type(child) == "cakes" else F.array().cast("array<string>")
    parts = []
    for c in columns:
        many = isinstance(rows.schema[c].dataType, T.ArrayType)
        spread = rows.select(F.col(config.id).alias("id"), below.alias("below"), F.explode(F.col(c) if many else F.array(c)).alias("e"))
        plain = not _has_slices(rows, c)
        parts.append(spread.select("id", "below", F.col("e" if plain else "e.ref").alias("ref"), (F.lit(None).cast("array<string>") if plain else F.col("e.sliceIds")).alias("own")))
    refs = reduce(DataFrame.unionByName, parts).where("ref is not null").distinct()
    return state.join(refs, "id").select(F.col("id").alias("parent"), "slices", F.lit(None).cast("string").alias("slice"), "ref", "own", "below")


def _has_slices(rows: DataFrame, column: str) -> bool:
    kind = rows.schema[column].dataType
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)


def _slices_of(rows: DataFrame, column: str):
    own = F.flatten(F.transform(F.col(column), lambda e: F.coalesce(e["sliceIds"], F.array().cast("array<string>"))))
    return F.coalesce(own, F.array().cast("array<string>"))


@dataclass
class CakeRoute:
    """What a route through cakes and layers reaches: rows per table, paths with their slices, nested cakes, cells."""

    store: Store
    route: Route
    levels: list[DataFrame]
    links: list[DataFrame]
    ends: DataFrame

    @property
    def relational(self) -> dict[str, DataFrame]:
        """Every table of the route with the rows reached, each once."""
        out = {}
        for n, (table, rows) in enumerate(zip(self.route.tables, self.levels, strict=True)):
            ids = self.links[n].select(F.col("parent").alias("lamina_id")) if n < len(self.links) else self.links[-1].select(F.col("ref").alias("lamina_id")) if self.links else self.ends.select(F.col("id").alias("lamina_id"))
            out[table] = rows.join(ids, F.col(self.store.config(table).id) == F.col("lamina_id"), "left_semi")
        return out

    @property
    def last(self) -> DataFrame:
        return self.relational[self.route.tables[-1]]

    def property_values(self) -> DataFrame:
        """id and the property's value; null where a row lacks it."""
        rows = self.last
        return rows.select(F.col(self.store.config(self.route.tables[-1]).id).alias("id"), property_of(rows, self.route.prop).alias("value"))

    @cached_property
    def paths(self) -> DataFrame:
        """One row per path: a struct column per table (t0, t1, ...) and `slice`, that of the layer passed, else null.

        This is the form for large cakes: one row a cell's component, none of which has to hold a whole layer.
        """
        ids = [self.store.config(t).id for t in self.route.tables]
        none = F.lit(None).cast("string")
        df = self.levels[0].select(F.col(ids[0]).alias("lamina_at"), F.struct("*").alias("t0"))
        if not self.links:
            return df.join(self.ends.select(F.col("id").alias("lamina_at")), "lamina_at", "left_semi").select("t0", none.alias("slice"))
        df = df.withColumn("lamina_slice", none)
        for n, link in enumerate(self.links):
            named = link.select(F.col("parent").alias("lamina_at"), F.col("slices").alias("lamina_in"), F.col("slice").alias("lamina_own"), F.col("ref").alias("lamina_ref"), "below")
            keys = ["lamina_at"] if n == 0 else ["lamina_at", "lamina_in"]
            step = df.join(named, keys).drop("lamina_at", "lamina_in").withColumn("lamina_slice", F.coalesce("lamina_own", "lamina_slice")).drop("lamina_own")
            child = self.levels[n + 1].select(F.col(ids[n + 1]).alias("lamina_ref"), F.struct("*").alias(f"t{n + 1}"))
            df = step.join(child, "lamina_ref").withColumnsRenamed({"lamina_ref": "lamina_at", "below": "lamina_in"})
        return df.select(*(f"t{n}" for n in range(len(ids))), F.col("lamina_slice").alias("slice"))

    def layer_maps(self) -> DataFrame:
        """(t0..., add): for a route that ends cake/layer/component, one map slice -> component a layer.

        A layer has to fit one row here; `paths` has no such bound.
        """
        kinds = [self.store.content_type(t) for t in self.route.tables]
        if kinds[-2:] != ["layers", "components"]:
            raise ValueError(f"{self.route} does not end with a layer and its components")
        n = len(kinds) - 1
        keys = [F.col(f"t{k}.{self.store.config(t).id}").alias(f"k{k}") for k, t in enumerate(self.route.tables[:-1])]
        pairs = F.array_sort(F.collect_list(F.struct("slice", f"t{n}")))
        return self.paths.groupBy(*keys).agg(F.map_from_entries(pairs).alias("add"))

    def nested(self) -> DataFrame:
        """(cake, layers): for a route cake/layer/component, the components' maps under `layers`, by layer table."""
        if [self.store.content_type(t) for t in self.route.tables] != ["cakes", "layers", "components"]:
            raise ValueError(f"{self.route} is not from a cake through a layer to its components")
        maps = self.layer_maps()
        return maps.select(F.col("k0").alias("cake"), F.struct(F.struct(F.col("k1").alias("ref"), "add").alias(self.route.tables[1])).alias("layers"))

    def cells(self) -> DataFrame:
        """(path, value): ids along the path, the slice after its layer, the property; the value as text."""
        parts = []
        for n, table in enumerate(self.route.tables):
            own = F.concat(F.lit(table + ":"), F.col(f"t{n}.{self.store.config(table).id}").cast("string"))
            under = [F.lit("layers")] if self.store.content_type(table) == "cakes" else [F.lit("add"), F.col("slice")] if self.store.content_type(table) == "layers" else []
            parts += [own, *(under if n + 1 < len(self.route.tables) else [])]
        last = len(self.route.tables) - 1
        value = property_of(self.levels[-1], self.route.prop, f"t{last}.")
        return self.paths.select(F.array(*parts, F.lit(self.route.prop)).alias("path"), value.cast("string").alias("value"))
