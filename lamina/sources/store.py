"""Tables of content-addressed rows: configurations, append with deduplication, lookups, cascades."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.functions.hashing import HASH, hash_of, object_text, row_hash, text_hash, with_hash
from lamina.sources.scratch import stored

# Content types with the ending that their tables' names must have, and column types.
ENDINGS = {"cakes": "Cake", "layers": "Layer", "sliceIds": "SliceId", "trees": "Tree"}
CONFIGS = "_tableCfgs"
PLAIN = ("components", "edits", "multiEdits", "editHistory", "insertHistory", "tableCfgs", "revisions", "head")
COLUMN_TYPES = {"string": T.StringType(), "number": T.DoubleType(), "integer": T.LongType(), "boolean": T.BooleanType(), "json": T.StringType(), "jsonArray": T.StringType(), "jsonValue": T.StringType()}

# Spark types that a column's declared type admits on import; the others are JSON text or any array.
CHECKED = {"string": T.StringType, "number": T.NumericType, "integer": T.IntegralType, "boolean": T.BooleanType}


@dataclass(frozen=True)
class Reference:
    """What a column refers to: a key of another table, one or (as an array) many."""

    table: str
    key: str = HASH


@dataclass(frozen=True)
class Column:
    key: str
    type: str = "string"
    ref: Reference | None = None
    title: str | None = None


@dataclass(frozen=True)
class TableConfig:
    key: str
    type: str = "components"
    columns: tuple[Column, ...] = ()
    id: str = HASH

    def check(self) -> None:
        if not re.fullmatch(r"[a-z][a-zA-Z0-9]*", self.key):
            raise ValueError(f"table name {self.key!r} is not lower camel case")
        if self.type in ENDINGS:
            if not self.key.endswith(ENDINGS[self.type]):
                raise ValueError(f"a table of {self.type} must end in {ENDINGS[self.type]}: {self.key!r}")
        elif self.type not in PLAIN:
            raise ValueError(f"unknown content type {self.type!r}")

    @property
    def references(self) -> dict[str, Reference]:
        return {c.key: c.ref for c in self.columns if c.ref}

    @property
    def hash(self) -> str:
        return hash_of({"key": self.key, "type": self.type, "columns": [{"key": c.key, "type": c.type} for c in self.columns]})

    def model(self) -> dict:
        return asdict(self)

    @classmethod
    def from_model(cls, model: dict) -> TableConfig:
        columns = tuple(Column(c["key"], c["type"], Reference(**c["ref"]) if c["ref"] else None, c["title"]) for c in model["columns"])
        return cls(model["key"], model["type"], columns, model["id"])

    def extended(self, other: TableConfig) -> TableConfig:
        """Columns are only ever added."""
        have = {c.key for c in self.columns}
        return replace(self, columns=(*self.columns, *(c for c in other.columns if c.key not in have)))


@dataclass
class Store:
    """A namespace of tables. With a path every table is a Parquet folder that only grows; else they are DataFrames.

    Opening a path finds the tables and configurations that earlier stores left there.
    """

    spark: SparkSession
    path: str | None = None
    configs: dict[str, TableConfig] = field(default_factory=dict)
    frames: dict[str, DataFrame] = field(default_factory=dict)
    on_conflict: dict[str, list[Callable[[dict], None]]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.path is None:
            return
        # configurations are kept as lines of JSON, one for each time that a table was created or extended
        for line in self._read(lambda r: r.text(f"{self.path}/{CONFIGS}"), ["value"]):
            config = TableConfig.from_model(json.loads(line.value))
            old = self.configs.get(config.key)
            self.configs[config.key] = old.extended(config) if old else config
        for key in self.configs:
            if key not in self.frames and self._read(lambda r, key=key: r.parquet(f"{self.path}/{key}").limit(0), []) is not None:
                self.frames[key] = self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/{key}")

    def _read(self, read, order: list[str]) -> list | None:
        """Rows of a small file; none where it does not exist."""
        try:
            rows = read(self.spark.read)
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return [] if order else None
        return rows.orderBy(*order).collect() if order else rows.collect()

    def create_table(self, config: TableConfig, rows: DataFrame | None = None) -> None:
        """Create, or extend by columns that are new."""
        config.check()
        old = self.configs.get(config.key)
        new = old.extended(config) if old else config
        self.configs[config.key] = new
        if self.path is not None and new != old:
            line = json.dumps(new.model(), sort_keys=True)
            self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/{CONFIGS}")
        if rows is not None:
            self.frames[config.key] = rows

    def create_table_with_history(self, config: TableConfig) -> None:
        self.create_table(config)
        self.create_history(config)

    def create_history(self, config: TableConfig) -> None:
        names = ("timeId", f"{config.key}Ref", "route", "origin", "previous")
        self.create_table(TableConfig(f"{config.key}InsertHistory", "insertHistory", tuple(Column(n) for n in names)))

    def has_table(self, key: str) -> bool:
        return key in self.configs

    def config(self, key: str) -> TableConfig:
        if key not in self.configs:
            raise KeyError(f"table {key!r} does not exist")
        return self.configs[key]

    def content_type(self, key: str) -> str:
        return self.config(key).type

    def tables(self) -> dict[str, DataFrame]:
        """All tables that hold rows."""
        return {k: self.table(k) for k in self.configs if k in self.frames}

    def table(self, key: str) -> DataFrame:
        self.config(key)
        if key not in self.frames:
            columns = self.configs[key].columns
            schema = T.StructType([T.StructField(HASH, T.StringType()), *(T.StructField(c.key, T.ArrayType(T.StringType()) if c.key == "previous" else COLUMN_TYPES.get(c.type, T.StringType())) for c in columns)])
            return self.spark.createDataFrame([], schema)
        return self.frames[key]

    def read_row(self, key: str, id_: object, also: Mapping[str, object] | None = None) -> DataFrame:
        """The row of an id, if it has the other values too; none if there is none."""
        found = self.table(key).where(F.col(self.config(key).id) == F.lit(id_))
        return found.where(all_equal(also)) if also else found

    def read_rows(self, key: str, where: Mapping[str, object], also: Mapping[str, object] | None = None) -> DataFrame:
        """Rows that equal all values given, those of `also` in place of equal names; they reach the scan as filters."""
        merged = {**where, **(also or {})}
        return self.table(key).where(all_equal(merged)) if merged else self.table(key)

    def import_tables(self, tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        """Validate rows of several tables together, then append what is new; returns the new rows of each.

        Columns and their types must be those of the configuration, a `_hash` that is given must be the row's,
        and every reference must lead to a row that is held or comes along. Nothing is written if one fails.
        """
        hashed = {}
        for key, rows in tables.items():
            self._check_columns(key, rows)
            if HASH in rows.columns:
                wrong = rows.where(F.col(HASH).isNotNull() & (F.col(HASH) != row_hash(rows.schema))).select(HASH).first()
                if wrong:
                    raise ValueError(f"{wrong[0]!r} of table {key!r} is not the hash of its row")
            hashed[key] = stored(with_hash(rows).dropDuplicates([HASH]), key)
        for key, rows in hashed.items():
            for column, ref in self.config(key).references.items():
                if column in rows.columns:
                    self._check_reference(key, rows, column, ref, hashed)
        return {key: self.append_hashed(key, rows) for key, rows in hashed.items()}

    def _check_columns(self, key: str, rows: DataFrame) -> None:
        config = self.config(key)
        unknown = set(rows.columns) - {c.key for c in config.columns} - {HASH}
        if config.columns and unknown:
            raise ValueError(f"columns not in table {key!r}: {sorted(unknown)}")
        for column in config.columns:
            kind = rows.schema[column.key].dataType if column.key in rows.columns else None
            if kind is not None and column.type in CHECKED and not column.ref and not isinstance(kind, CHECKED[column.type]):
                raise ValueError(f"column {column.key!r} of table {key!r} must be {column.type}, not {kind.simpleString()}")

    def _check_reference(self, key: str, rows: DataFrame, column: str, ref: Reference, coming: Mapping[str, DataFrame]) -> None:
        """Raise if some ref leads nowhere. One is looked for, not all."""
        kind = rows.schema[column].dataType
        own = F.explode(column) if isinstance(kind, T.ArrayType) else F.col(column)
        refs = rows.select(own.alias("ref"))
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            refs = refs.select("ref.ref")
        known = [t.select(F.col(ref.key).alias("ref")) for t in ([self.table(ref.table)] if self.has_table(ref.table) else []) + ([coming[ref.table]] if ref.table in coming else []) if ref.key in t.columns]
        lost = refs.where("ref is not null")
        for held in known:
            lost = lost.join(held, "ref", "left_anti")
        gone = lost.first()
        if gone:
            raise ValueError(f"{gone.ref!r} in {column!r} of table {key!r} is no row of {ref.table!r}")

    def upsert(self, key: str, rows: DataFrame) -> DataFrame:
        """Hash, validate and append rows that are new; returns the new rows. Running it again adds nothing."""
        config = self.config(key)
        unknown = set(rows.columns) - {c.key for c in config.columns} - {HASH}
        if config.columns and unknown:
            raise ValueError(f"columns not in table {key!r}: {sorted(unknown)}")
        return self.append_hashed(key, with_hash(rows).dropDuplicates([HASH]))

    def append_hashed(self, key: str, hashed: DataFrame) -> DataFrame:
        """Append rows whose `_hash` is given, each once, unless the table has them; returns the new rows."""
        old = self.frames.get(key)
        new = hashed if old is None else hashed.join(old.select(HASH), HASH, "left_anti")
        if self.path is None:
            # new rows are written before they count as held, so that insert after insert adds no joins to the plan
            new = stored(new, key)
            self.frames[key] = new if old is None else old.unionByName(new, allowMissingColumns=True)
            return new
        where = f"{self.path}/{key}"
        new.write.mode("append").parquet(where)
        self.frames[key] = self.spark.read.option("mergeSchema", "true").parquet(where)
        return new

    def dump(self, path: str) -> None:
        """Every table as JSON lines below path, written by the executors."""
        for key, rows in self.tables().items():
            rows.write.json(f"{path}/{key}")

    def copy_to(self, spark: SparkSession) -> Store:
        return Store(spark, self.path, dict(self.configs), dict(self.frames))


def all_equal(where: Mapping[str, object]):
    """AND of null-safe equalities; a list means any of its values."""
    tests = [F.col(c).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(c).eqNullSafe(F.lit(v)) for c, v in where.items()]
    return reduce(lambda a, b: a & b, tests)


def cascade(stores: list[DataFrame], key: str = HASH) -> DataFrame:
    """Rows of several stores by priority: the first store that holds a key wins."""
    ranked = [s.withColumn("priority", F.lit(n)) for n, s in enumerate(stores)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    first = Window.partitionBy(key).orderBy("priority")
    return rows.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")


@dataclass(frozen=True)
class Member:
    """A store of a cascade and what it is used for."""

    store: Store
    read: bool = True
    write: bool = True
    dump: bool = True


@dataclass(frozen=True)
class Cascade:
    """Stores by priority, the first one first."""

    members: tuple[Member, ...]

    def _readers(self, key: str) -> list[Store]:
        return [m.store for m in self.members if m.read and m.store.has_table(key)]

    def table(self, key: str) -> DataFrame:
        """All rows of the stores that are read; of equal ids the first store's."""
        stores = self._readers(key)
        if not stores:
            raise KeyError(f"no store that is read has table {key!r}")
        return cascade([s.table(key) for s in stores], stores[0].config(key).id).drop("priority")

    def read_rows(self, key: str, where: Mapping[str, object]) -> DataFrame:
        """The rows of the first store that has any such row; none if no store has."""
        found = [s.read_rows(key, where).withColumn("lamina_store", F.lit(n)) for n, s in enumerate(self._readers(key))]
        if not found:
            raise KeyError(f"no store that is read has table {key!r}")
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
        # one row: the number of the first store that has some
        first = rows.agg(F.min("lamina_store").alias("lamina_store"))
        return rows.join(F.broadcast(first), "lamina_store", "left_semi").drop("lamina_store")

    def upsert(self, key: str, rows: DataFrame) -> list[DataFrame]:
        """Append to every store that is written; returns the new rows of each."""
        return [m.store.upsert(key, rows) for m in self.members if m.write]

    def dump(self, path: str) -> None:
        """Tables of the stores that are dumped, each once, as JSON lines below path."""
        members = tuple(replace(m, read=True) for m in self.members if m.dump)
        for key in {k: None for m in members for k in m.store.tables()}:
            Cascade(members).table(key).write.json(f"{path}/{key}")


@dataclass(frozen=True)
class Chart:
    """How wide rows fall into components: for each group its new columns and where they come from.

    A column comes from a path (`props.k`), a (path, type) that it is cast to, or is a group of its own, which
    becomes another table of components that the column refers to. Groups in `bare` get no layer.
    """

    slice_key: str
    groups: Mapping[str, Mapping[str, object]]
    bare: frozenset[str] = frozenset()


def from_chart(rows: DataFrame, chart: Chart) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(components, layers) of a chart: distinct hashed records of every group, and (slice, ref) of each row."""
    components: dict[str, DataFrame] = {}

    def columns(fields: Mapping[str, object]) -> list[SparkColumn]:
        out = []
        for name, origin in fields.items():
            if isinstance(origin, Mapping):
                inner = columns(origin)
                own = rows.select(*inner)
                components[name] = with_hash(own).dropDuplicates([HASH])
                value = text_hash(object_text(F.struct(*inner), own.schema))
            else:
                path, kind = origin if isinstance(origin, tuple) else (origin, None)
                value = F.col(path).cast(COLUMN_TYPES[kind]) if kind else F.col(path)
            out.append(value.alias(name))
        return out

    layers = {}
    for group, fields in chart.groups.items():
        own = rows.select(F.col(chart.slice_key).alias("lamina_slice"), *columns(fields))
        hashed = own.withColumn(HASH, row_hash(own.schema, list(fields)))
        components[group] = hashed.select(HASH, *fields).dropDuplicates([HASH])
        if group not in chart.bare:
            layers[group] = hashed.select(F.col("lamina_slice").alias("slice"), F.col(HASH).alias("ref"))
    return components, layers


def decompose(rows: DataFrame, slice_key: str, groups: Mapping[str, list[str]]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Wide rows -> (components, layers) per group of columns: distinct hashed records, and (slice, ref) of each row."""
    components, layers = {}, {}
    for name, columns in groups.items():
        hashed = rows.select(F.col(slice_key).alias("slice"), row_hash(rows.schema, columns).alias(HASH), *columns)
        components[name] = hashed.drop("slice").dropDuplicates([HASH])
        layers[name] = hashed.select("slice", F.col(HASH).alias("ref"))
    return components, layers


def layer_maps(layer: DataFrame, per: str) -> DataFrame:
    """(per, slice, ref) -> one `add` map for each value of per, in slice order."""
    pairs = layer.groupBy(per).agg(F.array_sort(F.collect_list(F.struct(F.col("slice").cast("string").alias("k"), F.col("ref").cast("string").alias("v")))).alias("pairs"))
    return pairs.select(per, F.map_from_entries("pairs").alias("add"))
