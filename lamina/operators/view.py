"""Slice views: one row per slice, multi-valued cells, lazily filtered, sorted, projected and edited.

A view is a DataFrame of slice_id, ord (its order), and for every column an array of values `c_<n>`;
an edited column has a second array `p_<n>` of pending values. Steps return new views; no data moves
before the view's rows are used.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.functions.ranking import ranked
from lamina.functions.hashing import object_text, row_hash, text_hash
from lamina.functions.predicates import RowFilter
from lamina.plans.selection import RowSort, Selection, SetValue, ViewColumn

SLICE, ORD = "slice_id", "ord"


def _field(name: str):
    return lambda row: row[name]


def cells_of(component: DataFrame, refs: DataFrame, properties: Mapping[str, str]) -> DataFrame:
    """refs (slice_id, ref[, pos]) joined once with component (id, ...) -> slice_id and an array per property.

    A layer without `pos` has one reference per slice, and its cells need no grouping. Else values stand
    in the order of the references. A reference to a row without the property gives null, an array
    property is flattened by one level.
    """
    kinds = {f.name: f.dataType for f in component.schema}
    names = [p for p in properties.values() if p in kinds]
    joined = refs.join(component.select(F.col("id").alias("ref"), *names), "ref")
    single = "pos" not in refs.columns
    if not single:
        joined = joined.groupBy(SLICE).agg(F.array_sort(F.collect_list(F.struct("pos", "ref", *(F.col(n) for n in names)))).alias("held"))
    out = []
    for alias, name in properties.items():
        if name not in kinds:
            none = F.lit(None).cast("string")
            out.append((F.array(none) if single else F.transform("held", lambda _: F.lit(None).cast("string"))).alias(alias))
            continue
        values = F.array(name) if single else F.transform("held", _field(name))
        if isinstance(kinds[name], T.ArrayType):
            # a null array is one null value
            values = F.flatten(F.transform(values, lambda v: F.coalesce(v, F.array(F.lit(None)))))
        out.append(values.alias(alias))
    return joined.select(SLICE, *out)


@dataclass(frozen=True)
class View:
    df: DataFrame
    selection: Selection
    pending: frozenset[str] = frozenset()
    steps: tuple[str, ...] = field(default=())

    # ------------------------------------------------------------ making one

    @classmethod
    def build(cls, slices: DataFrame, layers: Mapping[str, tuple[DataFrame, DataFrame]], selection: Selection) -> View:
        """slices (slice_id, ord) left-joined with every layer once, however many of its columns are selected.

        layers: name -> (refs (slice_id, ref[, pos]), component with an `id`); a column's route is name/property.
        """
        df = slices.select(SLICE, ORD)
        for name in dict.fromkeys(c.layer for c in selection.columns):
            if name not in layers:
                raise KeyError(f"no layer {name!r}; there are {sorted(layers)}")
            refs, component = layers[name]
            own = {f"c_{n}": c.prop for n, c in enumerate(selection.columns) if c.layer == name}
            df = df.join(cells_of(component, refs, own), SLICE, "left")
        empty = [F.coalesce(f"c_{n}", F.array().cast(df.schema[f"c_{n}"].dataType)).alias(f"c_{n}") for n in range(len(selection))]
        return cls(df.select(SLICE, ORD, *empty), selection)

    @classmethod
    def of(cls, df: DataFrame, columns: Mapping[str, str], slice_id: str, ord_: Column) -> View:
        """A view of plain rows: one value a cell."""
        selection = Selection(tuple(ViewColumn(route, route.rsplit("/", 1)[-1]) for route in columns))
        return cls(df.select(F.col(slice_id).alias(SLICE), ord_.alias(ORD), *(F.array(F.col(c)).alias(f"c_{n}") for n, c in enumerate(columns.values()))), selection)

    # ------------------------------------------------------------ reading it

    def _at(self, which: int | str | list[str]) -> int:
        return self.selection.index(which)

    def base(self, which: int | str) -> Column:
        return F.col(f"c_{self._at(which)}")

    def value(self, which: int | str) -> Column:
        """Pending values if there are any, else the base values."""
        n = self._at(which)
        if f"p_{n}" not in self.pending:
            return F.col(f"c_{n}")
        return F.when(F.size(F.coalesce(f"p_{n}", F.array().cast(self.kind(n)))) > 0, F.col(f"p_{n}")).otherwise(F.col(f"c_{n}"))

    def kind(self, which: int | str) -> T.ArrayType:
        return self.df.schema[f"c_{self._at(which)}"].dataType

    @property
    def rows(self) -> DataFrame:
        """slice_id, ord and the visible values under their aliases."""
        return self.df.select(SLICE, ORD, *(self.value(n).alias(c.alias) for n, c in enumerate(self.selection.columns)))

    def row(self, slice_id: object) -> DataFrame:
        return self.rows.where(F.col(SLICE) == F.lit(slice_id))

    @property
    def hashed(self) -> DataFrame:
        """Rows with `row_hash` over their base values, in column order."""
        fields = [T.StructField(f"c_{n:06d}", self.kind(n)) for n in range(len(self.selection))]
        named = self.df.select(SLICE, ORD, *(F.col(f"c_{n}").alias(f.name) for n, f in enumerate(fields)))
        return named.select(SLICE, ORD, row_hash(T.StructType(fields)).alias("row_hash"))

    @property
    def column_types(self) -> dict[str, str]:
        return {c.alias: self.kind(n).elementType.simpleString() for n, c in enumerate(self.selection.columns)}

    def row_count(self) -> int:
        return self.df.count()

    def column_count(self) -> int:
        return len(self.selection)

    @property
    def layer_routes(self) -> list[str]:
        return list(dict.fromkeys(c.layer for c in self.selection.columns))

    def cells(self) -> DataFrame:
        """(slice_id, route, position, value as text) of every value."""
        out = None
        for n, c in enumerate(self.selection.columns):
            part = self.df.select(SLICE, F.lit(c.route).alias("route"), F.posexplode(self.value(n)).alias("position", "value")).withColumn("value", F.col("value").cast("string"))
            out = part if out is None else out.unionByName(part)
        return out

    # ------------------------------------------------------------ steps

    def select(self, selection: Selection) -> View:
        """Project and reorder; a column that is not in the view is an error."""
        at = [self._at(c.route) for c in selection.columns]
        pending = {f"p_{k}": f"p_{n}" for n, k in enumerate(at) if f"p_{k}" in self.pending}
        columns = [F.col(f"c_{k}").alias(f"c_{n}") for n, k in enumerate(at)] + [F.col(old).alias(new) for old, new in pending.items()]
        return View(self.df.select(SLICE, ORD, *columns), selection, frozenset(pending.values()), (*self.steps, "select"))

    def filter(self, rows: RowFilter) -> View:
        cells = {c.route: (self.value(n), self.kind(n)) for n, c in enumerate(self.selection.columns)}
        cells |= {c.alias: cells[c.route] for c in self.selection.columns if c.alias not in cells}
        test = rows.matches(cells)
        return replace(self, df=self.df if test is None else self.df.where(test), steps=(*self.steps, "filter"))

    def sort(self, sort: RowSort) -> View:
        """Order by first values: nulls first ascending and last descending, ties as before."""
        if not sort.by:
            return self
        keys = []
        for route, how in sort.by:
            first = F.get(self.value(route), F.lit(0))
            keys.append(first.asc_nulls_first() if how == "asc" else first.desc_nulls_last())
        # a global order needs a range exchange, not a single task: rank within ranges, then add what ranges before hold
        return replace(self, df=ranked(self.df, keys + [F.col(ORD).asc()], ORD), steps=(*self.steps, "sort"))

    def set_value(self, edit: SetValue) -> View:
        """Pending value on every row that has a cell; base values stay, earlier pending values remain visible."""
        n = self._at(edit.route)
        kind, name = self.kind(n), f"p_{n}"
        values = edit.value if isinstance(edit.value, (list, tuple)) else [edit.value]
        new = F.array(*(F.lit(v).cast(kind.elementType) for v in values))
        before = F.coalesce(name, F.array().cast(kind)) if name in self.pending else F.array().cast(kind)
        changed = F.when(F.size(f"c_{n}") > 0, F.concat(before, new)).otherwise(before)
        return replace(self, df=self.df.withColumn(name, changed), pending=self.pending | {name}, steps=(*self.steps, "set"))

    def set_values(self, edits: list[SetValue]) -> View:
        view = self
        for edit in edits:
            view = view.set_value(edit)
        return view

    def changed(self, which: int | str) -> DataFrame:
        """slice_id, ord, before, after of the rows with a pending value in a column."""
        n = self._at(which)
        if f"p_{n}" not in self.pending:
            return self.df.limit(0).select(SLICE, ORD, F.col(f"c_{n}").alias("before"), F.col(f"c_{n}").alias("after"))
        return self.df.where(F.size(f"p_{n}") > 0).select(SLICE, ORD, F.col(f"c_{n}").alias("before"), F.col(f"p_{n}").alias("after"))

    def publish(self, which: int | str, under: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
        """(new components, new layer entries) of one edited column.

        By default a snapshot: the new layer holds the view's slices only, and components only the edited
        property. With under = (refs, component) of the layer it is an overlay that keeps the other properties.
        """
        n = self._at(which)
        name = self.selection.columns[n].prop
        changed = self.changed(n)
        if under is None:
            rows = changed.select(SLICE, F.col("after").alias(name))
        else:
            refs, component = under
            kept = [c for c in component.columns if c not in ("id", name)]
            rows = changed.select(SLICE, F.col("after").alias(name)).join(refs.select(SLICE, "ref"), SLICE).join(component.select(F.col("id").alias("ref"), *kept), "ref").select(SLICE, name, *kept)
        columns = [c for c in rows.columns if c != SLICE]
        hashed = rows.withColumn("ref", text_hash(object_text(None, T.StructType([f for f in rows.schema.fields if f.name in columns]))))
        return hashed.select(F.col("ref").alias("id"), *columns).dropDuplicates(["id"]), hashed.select(SLICE, "ref")
