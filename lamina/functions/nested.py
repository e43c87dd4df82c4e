"""Nested values: pruning JSON text to a path, setting a path, and merging by path."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.functions.ranking import numbered


def _field(name: str):
    return lambda row: row[name]


def _escaped(key: str) -> str:
    return json.dumps(key, ensure_ascii=False)


def prune(value: Column, path: Sequence[str]) -> Column:
    """JSON text reduced to what lies at a path, in its objects; a missing key leaves the empty object, null stays null."""
    if not path:
        return F.when(value.isNotNull(), F.lit("{}"))
    out = F.to_json(F.try_variant_get(F.try_parse_json(value), "$." + ".".join(path), "variant"))
    for key in reversed(path):
        out = F.concat(F.lit("{" + _escaped(key) + ":"), out, F.lit("}"))
    return F.when(value.isNotNull(), F.coalesce(out, F.lit("{}")))


def set_field(df: DataFrame, column: str, path: Sequence[str], value: Column) -> Column:
    """A struct column with the field at a path replaced; `_hash` of the container goes, since it no longer holds."""
    own = F.col(column).withField(".".join(path), value)
    inner = df.schema[column].dataType
    for key in path[:-1]:
        inner = inner[key].dataType
    if isinstance(inner, T.StructType) and "_hash" in inner.names:
        own = own.dropFields(".".join([*path[:-1], "_hash"]))
    return own


def set_key(value: Column, key: str, new: Column) -> Column:
    """A map with one key set."""
    rest = F.map_filter(value, lambda k, _: k != key)
    return F.map_concat(rest, F.create_map(F.lit(key), new))


def unique(df: DataFrame) -> DataFrame:
    """Rows with each `_hash` once and, at every depth, arrays of rows with each `_hash` once, the first in place.

    Elements without a hash all stay.
    """
    rows = df.select(*(_unique(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields))
    return rows.dropDuplicates(["_hash"]) if "_hash" in df.columns else rows


def _unique(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        inner = F.struct(*(_unique(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields))
        return F.when(value.isNotNull(), inner)
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        return value
    if isinstance(kind.elementType, T.StructType) and "_hash" in kind.elementType.names:
        hashes = F.transform(value, _field("_hash"))
        value = F.filter(value, lambda x, k: F.coalesce(F.array_position(hashes, x["_hash"]) == k + 1, F.lit(True)))
    return F.transform(value, lambda x: _unique(x, kind.elementType))


def same_json(value: Column) -> Column:
    """JSON text in one form for all equal values: keys sorted, no spaces, without any `_hash`; null where it is no JSON."""
    text = F.to_json(F.try_parse_json(value))
    for pattern in (r'(?<!\\)"_hash":"[^"\\]*",', r',?(?<!\\)"_hash":"[^"\\]*"'):
        text = F.regexp_replace(text, pattern, "")
    return text


def merged_elements(values: DataFrame, array: str, path: str = "path", order: str = "ord") -> DataFrame:
    """(path, position, value): arrays of equal path joined in order, as rows, so that no path has to fit into one task.

    Nulls among the elements stay; null and empty arrays add nothing.
    """
    spread = values.select(path, F.col(order).alias("lamina_ord"), F.posexplode(array).alias("lamina_k", "value"))
    return numbered(spread, [path], [F.col("lamina_ord"), F.col("lamina_k")], "position").select(path, "position", "value")


def merge_by_path(values: DataFrame, path: str = "path", arrays: Sequence[str] = (), maps: Sequence[str] = (), order: str = "ord") -> DataFrame:
    """Values of equal path merged: arrays are joined in order, maps laid over one another, the last winning."""
    joined = [F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, name))), _field(name))).alias(name) for name in arrays]
    parts = [values.groupBy(path).agg(*joined)] if joined or not maps else []
    for name in maps:
        # the last value of each key is found before maps are built, so a path costs its different keys and not all its rows
        entries = values.select(path, order, F.explode_outer(F.map_entries(name)).alias("e"))
        last = entries.groupBy(path, F.col("e.key").alias("k")).agg(F.max(F.struct(F.col(order).alias("o"), F.col("e.value").alias("v"))).alias("at"))
        held = F.collect_list(F.when(F.col("k").isNotNull(), F.struct(F.col("k").alias("key"), F.col("at.v").alias("value"))))
        parts.append(last.groupBy(path).agg(F.map_from_entries(held).alias(name)))
    out = parts[0]
    for n, part in enumerate(parts[1:]):
        right = part.withColumnRenamed(path, f"lamina_path_{n}")
        out = out.join(right, F.col(path).eqNullSafe(F.col(f"lamina_path_{n}"))).drop(f"lamina_path_{n}")
    return out
