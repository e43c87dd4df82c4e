"""Edit log: immutable edits in linked lists, replayed oldest first as transforms of a view."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions.hashing import HASH, hash_of
from lamina.functions.predicates import ColumnFilter, RowFilter
from lamina.operators.history import time_id
from lamina.operators.resolve import chains
from lamina.operators.view import View
from lamina.plans.selection import RowSort, Selection, SetValue
from lamina.sources.store import Column, Store, TableConfig


@dataclass(frozen=True)
class Edit:
    """A named action: a Selection, RowFilter, RowSort or SetValue."""

    name: str
    action: Selection | RowFilter | RowSort | SetValue

    @property
    def type(self) -> str:
        return {Selection: "selection", RowFilter: "filter", RowSort: "sort", SetValue: "setValue"}[type(self.action)]

    def model(self) -> dict:
        return {"name": self.name, "action": {"type": self.type, "data": asdict(self.action)}}

    @property
    def hash(self) -> str:
        return hash_of(self.model())

    @classmethod
    def from_model(cls, model: dict) -> Edit:
        data, kind = model["action"]["data"], model["action"]["type"]
        if kind == "selection":
            return cls(model["name"], Selection.from_routes([c["route"] for c in data["columns"]]))
        if kind == "filter":
            return cls(model["name"], RowFilter(tuple(ColumnFilter(**f) for f in data["filters"]), data["how"]))
        if kind == "sort":
            return cls(model["name"], RowSort(tuple(map(tuple, data["by"]))))
        if kind == "setValue":
            return cls(model["name"], SetValue(**data))
        raise ValueError(f"unknown edit type {kind!r}")


@dataclass(frozen=True)
class MultiEdit:
    """A link of an edit chain; its hash names the whole chain up to it."""

    edit: Edit
    previous: MultiEdit | None = None

    @property
    def hash(self) -> str:
        return hash_of({"edit": self.edit.hash, "previous": self.previous.hash if self.previous else None})

    def then(self, edit: Edit) -> MultiEdit:
        return MultiEdit(edit, self)

    def oldest_first(self) -> list[Edit]:
        out, link = [], self
        while link:
            out.append(link.edit)
            link = link.previous
        return out[::-1]


def apply(view: View, edit: Edit) -> View:
    return {"selection": view.select, "filter": view.filter, "sort": view.sort, "setValue": view.set_value}[edit.type](edit.action)


def replay(view: View, edits: list[Edit] | MultiEdit) -> View:
    """All edits, each once, oldest first."""
    return reduce(apply, edits.oldest_first() if isinstance(edits, MultiEdit) else edits, view)


def chain_order(multi_edits: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Stored links (_hash, edit, previous) -> (root, position, edit): every chain's edits, oldest at position 0."""
    linked = chains(multi_edits, "_hash", "previous", roots).join(multi_edits.select(F.col("_hash").alias("member"), "edit"), "member")
    longest = linked.groupBy("root").agg(F.max("depth").alias("last"))
    return linked.join(longest, "root").select("root", (F.col("last") - F.col("depth")).alias("position"), "edit")


def create_tables(store: Store, cake: str) -> None:
    """Tables of edits, of chain links and of the timeline of a cake."""
    store.create_table(TableConfig(f"{cake}Edits", "edits", (Column("model", "json"),)))
    store.create_table(TableConfig(f"{cake}MultiEdits", "multiEdits", (Column("edit"), Column("previous_"))))
    store.create_table(TableConfig(f"{cake}EditHistory", "editHistory", (Column("timeId"), Column("dataRef"), Column("multiEditRef"), Column("previous"))))


def save(store: Store, cake: str, head: MultiEdit, data_ref: str, previous: list[str] | None = None) -> str:
    """Store a chain and one row of the timeline; links that are held are not stored twice. Returns the time id."""
    links, link = [], head
    while link:
        links.append(link)
        link = link.previous
    models = [(x.edit.hash, json.dumps(x.edit.model(), sort_keys=True)) for x in links]
    store.append_hashed(f"{cake}Edits", store.spark.createDataFrame(sorted(set(models)), f"{HASH} string, model string"))
    rows = [(x.hash, x.edit.hash, x.previous.hash if x.previous else None) for x in links]
    store.append_hashed(f"{cake}MultiEdits", store.spark.createDataFrame(rows, f"{HASH} string, edit string, previous_ string"))
    own = time_id()
    store.upsert(f"{cake}EditHistory", store.spark.createDataFrame([(own, data_ref, head.hash, previous or [])], "timeId string, dataRef string, multiEditRef string, previous array<string>"))
    return own


def restore(store: Store, cake: str, ref: str) -> MultiEdit:
    """The chain of a link's hash, or of a time id of the timeline. A chain is a plan: one row for each edit is read."""
    if ":" in ref:
        row = store.table(f"{cake}EditHistory").where(F.col("timeId") == ref).first()
        if row is None:
            raise ValueError(f"time {ref!r} is not in the edit history of {cake!r}")
        ref = row.multiEditRef
    links = store.table(f"{cake}MultiEdits").withColumnRenamed("previous_", "previous")
    order = chain_order(links, store.spark.createDataFrame([(ref,)], "root string"))
    models = order.join(store.table(f"{cake}Edits").select(F.col(HASH).alias("edit"), "model"), "edit").orderBy("position").collect()
    if not models:
        raise ValueError(f"no edits {ref!r} of {cake!r}")
    head = None
    for row in models:
        head = MultiEdit(Edit.from_model(json.loads(row.model)), head)
    return head


@dataclass
class EditSession:
    """A view under edit: the base view, the head of its chain, and what has been recorded."""

    base: View
    head: MultiEdit | None = None
    log: list[MultiEdit] = field(default_factory=list)
    listeners: list = field(default_factory=list)

    @property
    def view(self) -> View:
        return replay(self.base, self.head) if self.head else self.base

    def edit(self, edit: Edit) -> View:
        self.head = self.head.then(edit) if self.head else MultiEdit(edit)
        self.log.append(self.head)
        for listener in self.listeners:
            listener(self.head)
        return self.view

    def load(self, head: MultiEdit) -> View:
        """Another session's chain replaces this one's."""
        self.head = head
        return self.view

    def clone(self) -> EditSession:
        return replace(self, log=list(self.log), listeners=[])

    def publish(self, under: tuple[DataFrame, DataFrame] | None = None) -> tuple[str, DataFrame, DataFrame]:
        """(route, components, layer entries) of the one column that is edited; any other number is an error."""
        view = self.view
        edited = [n for n in range(len(view.selection)) if f"p_{n}" in view.pending]
        if len(edited) != 1:
            raise ValueError(f"exactly one column must be edited to publish, not {len(edited)}")
        return view.selection.columns[edited[0]].route, *view.publish(edited[0], under)
