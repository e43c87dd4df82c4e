"""Base chains: layers and slice sets that inherit from a base, resolved for any number of roots at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.ranking import numbered

#: Levels of a chain that one query follows.
MAX_DEPTH = 1000


def check_bases(rows: DataFrame, key: str = "_hash", base: str = "base") -> None:
    """Raise if some base is not among the rows. One missing row is looked for, not all."""
    missing = rows.where(F.col(base).isNotNull()).select(F.col(base).alias("missing")).join(rows.select(F.col(key).alias("missing")), "missing", "left_anti").first()
    if missing:
        raise ValueError(f"base {missing.missing} does not exist")


def chains(rows: DataFrame, key: str = "_hash", base: str = "base", roots: DataFrame | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(root, member, depth): every root (all rows by default) and what it inherits from, nearest first."""
    links = rows.select(F.col(key).alias("member"), F.col(base).alias("base"))
    start = links if roots is None else links.join(roots.select(F.col(roots.columns[0]).alias("member")), "member", "left_semi")
    return rows.sparkSession.sql(
        f"""WITH RECURSIVE chain(root, member, base, depth) MAX RECURSION LEVEL {int(max_depth)} AS (
              SELECT member, member, base, 0 FROM {{start}}
              UNION ALL
              SELECT c.root, l.member, l.base, c.depth + 1 FROM chain c JOIN {{links}} l ON c.base = l.member)
            SELECT root, member, depth FROM chain LIMIT ALL""",
        start=start,
        links=links,
    )


def entries(layers: DataFrame, key: str = "_hash") -> DataFrame:
    """Layers with `add` and `remove` maps -> (member, slice, ref, op); keys that start with _ are internal."""
    parts = []
    for op in ("add", "remove"):
        if op in layers.columns:
            parts.append(layers.select(F.col(key).alias("member"), F.explode(op).alias("slice", "ref")).withColumn("op", F.lit(op)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where(~F.col("slice").cast("string").startswith("_"))


def resolve_layers(layers: DataFrame, own: DataFrame, key: str = "_hash", base: str = "base", roots: DataFrame | None = None, slices: DataFrame | None = None) -> DataFrame:
    """(root, slice, ref): the nearest entry of each slice counts; in one layer a removal beats an addition.

    own: (member, slice, ref, op). slices restricts the entries before the chain is followed.
    """
    if slices is not None:
        own = own.join(slices.select(F.col(slices.columns[0]).alias("slice")).distinct(), "slice", "left_semi")
    reached = chains(layers, key, base, roots).join(own, "member")
    nearest = Window.partitionBy("root", "slice").orderBy("depth", F.when(F.col("op") == "remove", 0).otherwise(1), "ref")
    return reached.withColumn("rn", F.row_number().over(nearest)).where("rn = 1 and op = 'add'").select("root", "slice", "ref")


def resolve_slices(sets: DataFrame, key: str = "_hash", base: str = "base", roots: DataFrame | None = None, ordered: bool = True) -> DataFrame:
    """Slice sets with `add`, `remove` arrays -> (root, slice, ord), in insertion order, base first; unordered without `ord`."""
    own = sets.select(F.col(key).alias("member"), F.posexplode("add").alias("pos", "slice")).withColumn("op", F.lit("add"))
    if "remove" in sets.columns:
        gone = sets.select(F.col(key).alias("member"), F.posexplode("remove").alias("pos", "slice")).withColumn("op", F.lit("remove"))
        own = own.unionByName(gone)
    reached = chains(sets, key, base, roots).join(own, "member")
    per_slice = Window.partitionBy("root", "slice")
    # what counts is the nearest level that names the slice; it stands where it was first added since its last removal
    marked = reached.withColumn("last_gone", F.min(F.when(F.col("op") == "remove", F.col("depth"))).over(per_slice))
    since = marked.where((F.col("op") == "add") & (F.col("last_gone").isNull() | (F.col("depth") < F.col("last_gone"))))
    placed = since.groupBy("root", "slice").agg(F.min(F.struct((-F.col("depth")).alias("level"), "pos")).alias("at"))
    if not ordered:
        return placed.select("root", "slice")
    return numbered(placed, ["root"], [F.col("at.level"), F.col("at.pos"), F.col("slice")], "ord").select("root", "slice", "ord")


def overlay(base: Column, own: Column, removed: Column | None = None) -> Column:
    """Map base with own laid over it, then without removed keys; null maps are empty."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    under = F.map_filter(F.coalesce(base, empty), lambda k, _: ~F.coalesce(F.map_contains_key(own, k), F.lit(False)))
    both = F.map_concat(under, F.coalesce(own, empty))
    return both if removed is None else F.map_filter(both, lambda k, _: ~F.coalesce(F.array_contains(removed, k), F.lit(False)))
