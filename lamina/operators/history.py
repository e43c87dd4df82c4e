"""Insert history: (timeId, <table>Ref, route, origin, previous) rows form a DAG by `previous`."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.functions.hashing import hash_of, object_text, text_hash
from lamina.sources.store import Store


def time_id() -> str:
    """Milliseconds, then a nonce: sorts by time as text."""
    return f"{int(time.time() * 1000):013d}:{uuid.uuid4().hex[:4]}"


def stamp(id_: Column | str) -> Column:
    """Milliseconds of a time id."""
    return F.split_part(F.col(id_) if isinstance(id_, str) else id_, F.lit(":"), F.lit(1)).cast("long")


def by_time(history: DataFrame, ascending: bool = True) -> DataFrame:
    return history.orderBy(F.col("timeId").asc() if ascending else F.col("timeId").desc())


def newest_first(history: DataFrame) -> DataFrame:
    return history.orderBy(stamp("timeId").desc(), F.col("timeId").desc())


def rows_of_ref(history: DataFrame, column: str, ref: object) -> DataFrame:
    return history.where(F.col(column) == F.lit(ref))


def row_of_time(history: DataFrame, id_: str) -> DataFrame:
    return history.where(F.col("timeId") == id_)


def time_ids(history: DataFrame, column: str, refs: DataFrame) -> DataFrame:
    """(ref, timeId) for each of refs (ref)."""
    own = history.select("timeId", F.col(column).alias("ref"))
    return own.join(refs.select("ref"), "ref").select("ref", "timeId")


def refs_of_times(history: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Time travel: (timeId, ref) for each of ids (timeId)."""
    return ids.select("timeId").join(history.select("timeId", F.col(column).alias("ref")), "timeId")


def as_of(history: DataFrame, column: str, at: int, per: str | None = None) -> DataFrame:
    """The latest ref at or before a moment, per group if asked for."""
    upto = history.where(stamp("timeId") <= at)
    latest = F.max_by(column, "timeId").alias("ref")
    return upto.groupBy(per).agg(latest) if per else upto.agg(latest)


def tips(history: DataFrame, key: str = "timeId", per: list[str] | None = None) -> DataFrame:
    """Rows that no row names as a predecessor."""
    per = per or []
    named = history.select(*per, F.explode("previous").alias(key))
    return history.join(named, [*per, key], "left_anti")


def forks(history: DataFrame, per: list[str], key: str = "timeId") -> DataFrame:
    """(per, branches) where more than one tip is open."""
    ends = tips(history, key, per)
    return ends.groupBy(*per).agg(F.array_sort(F.collect_list(key)).alias("branches")).where(F.size("branches") > 1)


def conflict(history: DataFrame, table: str) -> dict | None:
    """{table, type, branches} of one table's history if it has more than one tip, else None."""
    open_ = sorted(r.timeId for r in tips(history).select("timeId").collect())
    return {"table": table, "type": "dagBranch", "detectedAt": int(time.time() * 1000), "branches": open_} if len(open_) > 1 else None


def append(store: Store, table: str, ref: str, route: str, origin: str | None = None, previous: list[str] | None = None, id_: str | None = None) -> str:
    """Add one history row and return its time id. Data are written before it: readers trust the history."""
    own = id_ or time_id()
    key = f"{table}InsertHistory"
    row = store.spark.createDataFrame([(own, ref, route, origin, previous or [])], f"timeId string, `{table}Ref` string, route string, origin string, previous array<string>")
    store.upsert(key, row)
    # branches are looked for only where somebody wants to know
    if store.on_conflict.get(table) and (found := conflict(store.table(key), table)):
        for callback in list(store.on_conflict[table]):
            callback(found)
    return own


def observe_conflicts(store: Store, table: str, callback: Callable[[dict], None]) -> None:
    """Call back after each write that leaves the table's history with more than one tip."""
    store.on_conflict.setdefault(table, []).append(callback)


def unobserve_conflicts(store: Store, table: str, callback: Callable[[dict], None] | None = None) -> None:
    """End one callback of a table, or all of them."""
    store.on_conflict[table] = [c for c in store.on_conflict.get(table, []) if callback is not None and c is not callback]


def insert(store: Store, route: str, rows: DataFrame, origin: str | None = None, previous: list[str] | None = None, history: bool = True) -> tuple[DataFrame, str | None]:
    """Append rows to the table that a route names, then its history: (new rows, time id or None).

    The history's ref is the row's hash, or a hash of all new rows where there are several.
    """
    table = route.strip("/").split("/")[-1].split("@")[0]
    new = store.upsert(table, rows)
    if not history or not store.has_table(f"{table}InsertHistory"):
        return new, None
    few = new.select("_hash").limit(2).collect()
    ref = few[0]["_hash"] if len(few) == 1 else _set_hash(new)
    return new, append(store, table, ref, route, origin, previous)


def insert_nested(store: Store, route: str, rows: DataFrame, origin: str | None = None, previous: list[str] | None = None) -> dict[str, str | None]:
    """Append rows whose reference columns hold the child rows themselves (a struct or an array of them).

    Children are written before their parents, which keep their hashes in their place, to any depth. The hashes
    are expressions over the nested columns, so no level waits for another one and none is joined. Every table
    gets a history row; previous is that of the route's own table. Null children stay null, in arrays they go.
    Returns the time id of each table written.
    """
    made: dict[str, str | None] = {}
    table = route.strip("/").split("/")[-1].split("@")[0]
    for column, ref in store.config(table).references.items():
        kind = rows.schema[column].dataType if column in rows.columns else None
        many = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)
        if not many and not isinstance(kind, T.StructType):
            continue
        if ref.key != "_hash":
            raise ValueError(f"{column!r} of {table!r} refers by {ref.key!r}: only rows referred to by hash can be nested")
        children = rows.select((F.explode(column) if many else F.col(column)).alias("child")).where("child is not null").select("child.*")
        made |= insert_nested(store, f"/{ref.table}", children, origin)
    flat = [_stored_value(store, table, f, F.col(f"`{f.name}`"))[0].alias(f.name) for f in rows.schema.fields]
    made[table] = insert(store, route, rows.select(*flat), origin, previous)[1]
    return made


def _stored_value(store: Store, table: str, field: T.StructField, value: Column) -> tuple[Column, T.DataType]:
    """A field as it is stored, and its type: rows in reference columns by their hashes."""
    kind, ref = field.dataType, store.config(table).references.get(field.name)
    if ref and isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), _stored_hash(store, ref.table, value, kind)), T.StringType()
    if ref and isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        present = F.filter(value, lambda x: x.isNotNull())
        return F.transform(present, lambda x: _stored_hash(store, ref.table, x, kind.elementType)), T.ArrayType(T.StringType())
    return value, kind


def _stored_hash(store: Store, table: str, value: Column, kind: T.StructType) -> Column:
    own = {f.name: _stored_value(store, table, f, value.getField(f.name)) for f in kind.fields}
    return text_hash(object_text(F.struct(*(c.alias(n) for n, (c, _) in own.items())), T.StructType([T.StructField(n, k) for n, (_, k) in own.items()])))


def _set_hash(rows: DataFrame) -> str:
    """A hash of many rows that needs no list of them: the sum of their hashes' numbers."""
    n, total = rows.agg(F.count("*"), F.sum(F.xxhash64("_hash").cast("decimal(38,0)"))).first()
    return hash_of({"rows": n, "sum": str(total)})


def insert_tree(store: Store, key: str, nodes: DataFrame, root: str, origin: str | None = None, previous: list[str] | None = None) -> str:
    """Append tree nodes, then one history row for the root."""
    store.upsert(key, nodes)
    return append(store, key, root, f"/{key}@{root}", origin, previous)
