"""Routes over a store as join chains, with three lazy projections of one result.

Hops follow references between tables. The rows of each table that a route reaches are found by
semi-joins: from the last table back, so that parents without a surviving child go, then forward, so
that only referenced children stay.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.plans.route import Route, bind, parse
from lamina.sources.store import Reference, Store, all_equal


@dataclass(frozen=True)
class Hop:
    """From a parent's columns to the key of the child."""

    columns: tuple[str, ...]
    key: str


def edges(df: DataFrame, key: str, column: str, table: str) -> DataFrame:
    """Child references of a column: parent, child_table, column, ref, slice_ids; each once.

    The column holds a reference, an array of them, or an array of (ref, sliceIds).
    """
    kind = df.schema[column].dataType
    own = F.col(column) if isinstance(kind, T.ArrayType) else F.array(column)
    spread = df.select(F.col(key).alias("parent"), F.explode(own).alias("e"))
    struct = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)
    held = [F.col("e.ref").alias("ref"), F.col("e.sliceIds").alias("slice_ids")] if struct else [F.col("e").alias("ref")]
    # what is the same in all rows takes no memory where they are compared
    once = spread.select("parent", *held).where("ref is not null").dropDuplicates()
    slices = F.col("slice_ids") if struct else F.lit(None).cast("array<string>").alias("slice_ids")
    return once.select("parent", F.lit(table).alias("child_table"), F.lit(column).alias("column"), "ref", slices)


def ref_values(df: DataFrame, column: str) -> Column:
    """A reference column as an array of plain keys."""
    kind = df.schema[column].dataType
    if not isinstance(kind, T.ArrayType):
        return F.array(column)
    return F.transform(column, lambda e: e["ref"]) if isinstance(kind.elementType, T.StructType) else F.col(column)


def where_on_references(store: Store, table: str, where: Mapping[str, object]) -> DataFrame:
    """Rows of a table whose own columns, or those of a table that they refer to, have the values given.

    Own columns win over columns of the same name elsewhere; `child.column` names the other table. A column
    that no table referred to has is looked for in those that they refer to, and so on. All conditions hold
    together, each reference by a semi-join.
    """
    rows, config = store.table(table), store.config(table)
    own = {c: v for c, v in where.items() if c in rows.columns}
    rows = rows.where(all_equal(own)) if own else rows
    per_ref: dict[tuple[str, ...], dict[str, object]] = {}
    for name, value in where.items():
        if name in own:
            continue
        at = [c for c, r in config.references.items() if (name.split(".")[0] == r.table if "." in name else name in store.table(r.table).columns)]
        # else the column lies further off, in a table that these refer to in their turn
        at = at or [c for c, r in config.references.items() if _reaches(store, r.table, name, {table})]
        if not at:
            raise KeyError(f"{name!r} is no column of {table!r} or of what it refers to")
        # all columns that refer to the table count, whichever of them holds the row
        per_ref.setdefault(tuple(c for c in at if config.references[c].table == config.references[at[0]].table), {})[_below(name, config.references[at[0]].table)] = value
    for columns, values in per_ref.items():
        found = where_on_references(store, config.references[columns[0]].table, values)
        keys = {c: found.select(F.col(config.references[c].key).alias("lamina_ref")) for c in columns}
        if len(columns) == 1 and not isinstance(rows.schema[columns[0]].dataType, T.ArrayType):
            rows = rows.join(keys[columns[0]], F.col(columns[0]) == F.col("lamina_ref"), "left_semi")
        else:
            rows = _semi_on_any(rows, config.id, keys)
    return rows


def _below(name: str, table: str) -> str:
    """The name as the referenced table knows it."""
    return name.split(".", 1)[1] if name.startswith(f"{table}.") else name


def _reaches(store: Store, table: str, name: str, seen: set[str]) -> bool:
    """Whether a table, or one that it refers to over any number of references, is named or has the column."""
    if table in seen or not store.has_table(table):
        return False
    if name.split(".")[0] == table if "." in name else name in store.table(table).columns:
        return True
    return any(_reaches(store, r.table, name, seen | {table}) for r in store.config(table).references.values())


def _semi_on_any(rows: DataFrame, id_: str, keys: Mapping[str, DataFrame]) -> DataFrame:
    """Rows with any of a column's keys in one of the columns: equi-joins on elements, not a scan of all pairs."""
    hits = None
    for column, of_column in keys.items():
        own = rows.select(F.col(id_).alias("lamina_id"), F.explode(ref_values(rows, column)).alias("lamina_ref")).join(of_column, "lamina_ref", "left_semi").select("lamina_id")
        hits = own if hits is None else hits.union(own)
    return rows.join(hits.distinct(), F.col(id_) == F.col("lamina_id"), "left_semi")


def overlapping(rows: DataFrame, key: str, members: DataFrame, slices: list[str]) -> DataFrame:
    """Rows (cakes, layers) whose resolved slices (root, slice) meet the requested ones."""
    hit = members.where(F.col("slice").isin(*slices)).select(F.col("root").alias(key)).distinct()
    return rows.join(hit, key, "left_semi")


def propagated(own: list[str] | None, through: Column | None, inherited: Column, component_to_component: bool) -> Column:
    """Slices that hold below a hop: the segment's own, else a cake reference's, else none between components, else inherited."""
    if own:
        return F.array(*map(F.lit, own))
    if through is not None:
        return through
    return F.lit(None).cast("array<string>") if component_to_component else inherited


@dataclass
class Result:
    """One route's rows per table, as tables, nested rows or addressed cells."""

    store: Store
    route: Route
    hops: list[Hop]
    reached: list[DataFrame]

    @property
    def relational(self) -> dict[str, DataFrame]:
        """Every table of the route with the rows reached, each once."""
        return dict(zip(self.route.tables, self.reached, strict=True))

    @property
    def last(self) -> DataFrame:
        return self.reached[-1]

    def property_values(self) -> DataFrame:
        """id and the property's value; null where a row lacks it."""
        id_ = self.store.config(self.route.tables[-1]).id
        return self.last.select(F.col(id_).alias("id"), property_of(self.last, self.route.prop).alias("value"))

    @cached_property
    def joined(self) -> DataFrame:
        """One row per path from the first table to the last: a struct column per table, t0, t1, ..."""
        df = self.reached[0].select(F.struct("*").alias("t0"))
        for n, (hop, child) in enumerate(zip(self.hops, self.reached[1:], strict=True)):
            parent = self.reached[n]
            refs = F.array_distinct(F.concat(*(ref_values(parent, c) for c in hop.columns))) if len(hop.columns) > 1 else None
            if refs is None and not isinstance(parent.schema[hop.columns[0]].dataType, T.ArrayType):
                keyed = df.withColumn("lamina_ref", F.col(f"t{n}.{hop.columns[0]}"))
            else:
                own = F.concat(*(_nested_refs(parent, f"t{n}", c) for c in hop.columns))
                keyed = df.withColumn("lamina_ref", F.explode(F.array_distinct(own)))
            right = child.select(F.col(hop.key).alias("lamina_ref"), F.struct("*").alias(f"t{n + 1}"))
            df = keyed.join(right, "lamina_ref").drop("lamina_ref")
        return df

    def nested(self) -> DataFrame:
        """First-table rows with `children`: an array of the next table's rows, and so on inwards."""
        ids = [self.store.config(t).id for t in self.route.tables]
        df, last = self.joined, len(ids) - 1
        df = df.select(*(F.col(f"t{n}") for n in range(last + 1)), F.col(f"t{last}").alias("lamina_tree"))
        for n in range(last - 1, -1, -1):
            keys = [F.col(f"t{k}.{ids[k]}").alias(f"k{k}") for k in range(n + 1)]
            grouped = df.groupBy(*keys).agg(*(F.first(f"t{k}").alias(f"t{k}") for k in range(n + 1)), F.array_sort(F.collect_set("lamina_tree")).alias("children"))
            fields = [F.col(f"t{n}.{f}").alias(f) for f in self.reached[n].columns]
            df = grouped.select(*(F.col(f"t{k}") for k in range(n + 1)), F.struct(*fields, F.col("children")).alias("lamina_tree"))
        return df.select("lamina_tree.*")

    def cells(self) -> DataFrame:
        """(path array<string>, value): ids along the path and the property, and the property's value as text."""
        ids = [self.store.config(t).id for t in self.route.tables]
        n = len(ids) - 1
        parts = [F.concat(F.lit(t + ":"), F.col(f"t{k}.{ids[k]}").cast("string")) for k, t in enumerate(self.route.tables)]
        value = property_of(self.joined.select(f"t{n}.*"), self.route.prop, f"t{n}.")
        kind = self.joined.select(value.alias("v")).schema["v"].dataType
        if isinstance(kind, T.ArrayType):
            return self.joined.select(F.array(*parts).alias("ids"), F.posexplode_outer(value).alias("k", "value")).select(F.concat("ids", F.array(F.lit(self.route.prop), F.col("k").cast("string"))).alias("path"), F.col("value").cast("string").alias("value"))
        return self.joined.select(F.array(*parts, F.lit(self.route.prop)).alias("path"), value.cast("string").alias("value"))


def _nested_refs(parent: DataFrame, under: str, column: str) -> Column:
    kind = parent.schema[column].dataType
    if not isinstance(kind, T.ArrayType):
        return F.array(F.col(f"{under}.{column}"))
    return F.transform(F.col(f"{under}.{column}"), lambda e: e["ref"]) if isinstance(kind.elementType, T.StructType) else F.col(f"{under}.{column}")


def property_of(df: DataFrame, prop: str | None, prefix: str = "") -> Column:
    """A property by dotted path, into structs or JSON text; null if there is none."""
    if not prop:
        raise ValueError("the route names no property")
    head, _, rest = prop.partition(".")
    if head not in df.columns:
        return F.lit(None).cast("string")
    own = F.col(f"{prefix}{head}")
    if not rest:
        return own
    return F.get_json_object(own, f"$.{rest}") if isinstance(df.schema[head].dataType, T.StringType) else own.getField(rest)


def get(store: Store, route: str | Route, where: Mapping[str, object] | str | None = None, refs: Mapping[str, str] | None = None, through: Mapping[str, str] | None = None) -> Result:
    """Rows that a route reaches.

    where: values of the first table's columns; the name of the next table holds that level's own where; a
    plain value is an id. A ref in the route replaces the where of its level. through: child table ->
    the parent column to follow, where several lead to it.
    """
    bound = bind(route if isinstance(route, Route) else parse(route), set(store.configs))
    tables, hops, levels = bound.tables, [], []
    node: object = where
    for n, segment in enumerate(bound.segments):
        config, rows = store.config(segment.table), store.table(segment.table)
        child = tables[n + 1] if n + 1 < len(tables) else None
        own, below = ({config.id: node}, None) if node is not None and not isinstance(node, Mapping) else ({k: v for k, v in (node or {}).items() if k != child}, (node or {}).get(child))
        if segment.ref is not None:
            ref = (refs or {}).get(segment.ref, segment.ref) if segment.by_time else segment.ref
            own = {config.id: _typed(rows, config.id, ref)}
        levels.append(where_on_references(store, segment.table, own) if own else rows)
        if child:
            hops.append(_hop(store, segment.table, child, (through or {}).get(child)))
        node = below
    # back: a parent stays only with a surviving child
    for n in range(len(hops) - 1, -1, -1):
        keys = levels[n + 1].select(F.col(hops[n].key).alias("lamina_ref"))
        levels[n] = _having(levels[n], store.config(tables[n]).id, hops[n], keys)
    # forward: a child stays only if a surviving parent refers to it
    for n, hop in enumerate(hops):
        parent = levels[n]
        refs_ = [parent.select(F.explode(ref_values(parent, c)).alias("lamina_ref")) if isinstance(parent.schema[c].dataType, T.ArrayType) else parent.select(F.col(c).alias("lamina_ref")) for c in hop.columns]
        keys = refs_[0]
        for more in refs_[1:]:
            keys = keys.union(more)
        levels[n + 1] = levels[n + 1].join(keys, F.col(hop.key) == F.col("lamina_ref"), "left_semi")
    return Result(store, bound, hops, levels)


def _typed(rows: DataFrame, column: str, text: str) -> object:
    return int(text) if isinstance(rows.schema[column].dataType, T.IntegralType) else text


def _hop(store: Store, parent: str, child: str, through: str | None) -> Hop:
    refs = {c: r for c, r in store.config(parent).references.items() if r.table == child and (through is None or c == through)}
    if refs:
        if len({r.key for r in refs.values()}) > 1:
            raise ValueError(f"{parent!r} refers to {child!r} by different keys")
        return Hop(tuple(refs), next(iter(refs.values())).key)
    back: dict[str, Reference] = {c: r for c, r in store.config(child).references.items() if r.table == parent and (through is None or c == through)}
    if not back:
        raise ValueError(f"no reference leads from {parent!r} to {child!r}")
    if len(back) > 1:
        raise ValueError(f"{child!r} refers to {parent!r} by several columns: choose one with through")
    column, ref = next(iter(back.items()))
    return Hop((ref.key,), column)


def _having(rows: DataFrame, id_: str, hop: Hop, keys: DataFrame) -> DataFrame:
    if len(hop.columns) == 1 and not isinstance(rows.schema[hop.columns[0]].dataType, T.ArrayType):
        return rows.join(keys, F.col(hop.columns[0]) == F.col("lamina_ref"), "left_semi")
    hits = None
    for column in hop.columns:
        own = rows.select(F.col(id_).alias("lamina_id"), F.explode(ref_values(rows, column)).alias("lamina_ref")).join(keys, "lamina_ref", "left_semi").select("lamina_id")
        hits = own if hits is None else hits.union(own)
    return rows.join(hits.distinct(), F.col(id_) == F.col("lamina_id"), "left_semi")
