"""Content hashes: 22 characters of the URL-safe base64 of a SHA-256 over canonical JSON.

Canonical JSON has sorted keys and no spaces. A nested object stands as its own hash; arrays keep
their order. `_hash` itself is left out. Nulls are left out of objects and kept in arrays.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASH = "_hash"
LENGTH = 22


def text_hash(text: Column) -> Column:
    """Hash of a string column's raw text."""
    return F.substring(F.translate(F.base64(F.unhex(F.sha2(text, 256))), "+/", "-_"), 1, LENGTH)


def number_text(value: Column, kind: T.DataType) -> Column:
    """A number as scripting languages print it: 18 rather than 18.0, 12345678 rather than 1.2345678E7."""
    if not isinstance(kind, (T.DoubleType, T.FloatType)):
        return value.cast("string")
    shown = value.cast("string")
    size = F.abs(value)
    plain = F.regexp_replace(F.regexp_replace(shown.cast("decimal(38,16)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    power = F.regexp_replace(F.regexp_replace(F.lower(shown), r"\.0e", "e"), r"e(\d)", "e+$1")
    return F.when(value == 0, "0").when((size >= 1e-6) & (size < 1e21), plain).otherwise(power)


def _value(column: Column, kind: T.DataType) -> Column:
    """Canonical text of a value; null where the value is null."""
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), quoted(text_hash(object_text(column, kind))))
    if isinstance(kind, T.ArrayType):
        items = F.transform(column, lambda x: F.coalesce(_value(x, kind.elementType), F.lit("null")))
        return F.when(column.isNotNull(), F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")))
    if isinstance(kind, T.MapType):
        entries = F.array_sort(F.transform(F.map_entries(column), lambda e: F.concat(quoted(e["key"]), F.lit(":"), _value(e["value"], kind.valueType))))
        return F.when(column.isNotNull(), quoted(text_hash(F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}")))))
    if isinstance(kind, T.StringType):
        return quoted(column)
    if isinstance(kind, T.BooleanType):
        return column.cast("string")
    if isinstance(kind, T.NumericType):
        return number_text(column, kind)
    return quoted(column.cast("string"))


def quoted(column: Column) -> Column:
    text = F.to_json(F.array(column))
    return F.when(column.isNotNull(), F.substring(text, 2, F.length(text) - 2))


def object_text(column: Column | None, kind: T.StructType) -> Column:
    """Canonical text of a struct column (None: of the whole row)."""
    parts = []
    for field in sorted(kind.fields, key=lambda f: f.name):
        if field.name == HASH:
            continue
        own = F.col(f"`{field.name}`") if column is None else column.getField(field.name)
        parts.append(F.concat(F.lit(json.dumps(field.name, ensure_ascii=False) + ":"), _value(own, field.dataType)))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")) if parts else F.lit("{}")


def row_hash(schema: T.StructType, columns: list[str] | None = None) -> Column:
    """Hash of a row over some of its columns, all of them by default."""
    fields = [f for f in schema.fields if columns is None or f.name in columns]
    return text_hash(object_text(None, T.StructType(fields)))


def with_hash(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """df with a leading `_hash` of its content."""
    names = [c for c in df.columns if c != HASH]
    return df.select(row_hash(df.schema, columns).alias(HASH), *(F.col(f"`{c}`") for c in names))


# ---------------------------------------------------------------- the same for literals of a plan

def _number(value: float) -> str:
    if value == int(value) and abs(value) < 1e21:
        return str(int(value))
    text = repr(value)
    if "e" in text:
        if 1e-6 <= abs(value) < 1e21:
            return f"{value:.25f}".rstrip("0").rstrip(".")
        mantissa, power = text.split("e")
        return f"{mantissa.removesuffix('.0')}e{int(power):+d}"
    return text


def canonical(value: object) -> str:
    if isinstance(value, Mapping):
        inner = ",".join(f"{json.dumps(k, ensure_ascii=False)}:{json.dumps(hash_of(v)) if isinstance(v, Mapping) else canonical(v)}" for k, v in sorted(value.items()) if k != HASH and v is not None)
        return "{" + inner + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(json.dumps(hash_of(v)) if isinstance(v, Mapping) else canonical(v) for v in value) + "]"
    if isinstance(value, float):
        return _number(value)
    return json.dumps(value, ensure_ascii=False)


def hash_of(value: object) -> str:
    """Hash of a JSON-like value; a bare string hashes as its raw text."""
    text = value if isinstance(value, str) else canonical(value)
    return base64.urlsafe_b64encode(hashlib.sha256(text.encode()).digest()).decode()[:LENGTH]
