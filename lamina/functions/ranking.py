"""Ranks, numbers and running maxima without bringing all rows, or those of one group, to one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.sources.scratch import stored

#: Bits of monotonically_increasing_id that number rows within a partition.
ROW_BITS = 33


def _cut(df: DataFrame, keys: list[Column]) -> DataFrame:
    """df in the order of keys, written, with `lamina_id` in that order and `lamina_part`, the partition that holds a row."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("lamina_id", F.monotonically_increasing_id())
    return stored(spread, "ranked").withColumn("lamina_part", F.shiftright("lamina_id", ROW_BITS))


def ranked(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """df with a 1-based rank by keys over all rows.

    Rows are range-partitioned by the keys, once and into a fixed number of partitions, sorted, numbered
    there and written to the shared folder: their places and the partitions' sizes, one row each, must
    come from the same cut of the keys, which Spark samples anew each time that it runs an exchange.
    """
    spread = _cut(df, keys)
    sizes = spread.groupBy("lamina_part").agg(F.count("*").alias("lamina_n"))
    before = F.coalesce(F.sum("lamina_n").over(Window.orderBy("lamina_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row per partition, so its size is bounded by the number of partitions
    offsets = sizes.select("lamina_part", before.alias("lamina_before"))
    row = F.col("lamina_id").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    out = spread.join(F.broadcast(offsets), "lamina_part").withColumn(name, (row + F.col("lamina_before") + 1).cast("long"))
    return out.drop("lamina_id", "lamina_part", "lamina_before")


def numbered(df: DataFrame, per: list[str], keys: list[Column], name: str) -> DataFrame:
    """df with a 1-based number by keys within each group: its rank over all rows, less that of the group's first."""
    placed = ranked(df, [*map(F.col, per), *keys], "lamina_place")
    first = placed.groupBy(*(F.col(c).alias(f"lamina_per_{k}") for k, c in enumerate(per))).agg(F.min("lamina_place").alias("lamina_first"))
    out = placed.join(first, _same(per)).withColumn(name, F.col("lamina_place") - F.col("lamina_first") + 1)
    return out.drop("lamina_place", "lamina_first", *(f"lamina_per_{k}" for k in range(len(per))))


def greatest_before(df: DataFrame, per: list[str], keys: list[Column], value: str, name: str) -> DataFrame:
    """df with the greatest value of the rows before, by keys within each group; null for a group's first row.

    A window runs within a group's share of one partition; what earlier partitions hold comes as one row for each of them.
    """
    spread = _cut(df, [*map(F.col, per), *keys])
    inside = Window.partitionBy("lamina_part", *per).orderBy("lamina_id").rowsBetween(Window.unboundedPreceding, -1)
    shares = spread.groupBy(*per, "lamina_part").agg(F.max(value).alias("lamina_max"))
    earlier = F.max("lamina_max").over(Window.partitionBy(*per).orderBy("lamina_part").rowsBetween(Window.unboundedPreceding, -1))
    carried = shares.select(*(F.col(c).alias(f"lamina_per_{k}") for k, c in enumerate(per)), F.col("lamina_part").alias("lamina_at"), earlier.alias("lamina_before")).where("lamina_before is not null")
    out = spread.withColumn(name, F.max(value).over(inside)).join(carried, _same(per) & (F.col("lamina_part") == F.col("lamina_at")), "left")
    out = out.withColumn(name, F.greatest(name, "lamina_before"))
    return out.drop("lamina_id", "lamina_part", "lamina_at", "lamina_before", *(f"lamina_per_{k}" for k in range(len(per))))


def _same(per: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"lamina_per_{k}")) for k, c in enumerate(per)))
