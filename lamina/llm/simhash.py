"""Operator 6: SimHash near-duplicates through pivot distance tables.

Every fingerprint is cut into blocks, and each block's Hamming distances to PIVOTS reference
fingerprints are precomputed and packed into one number. Two fingerprints within max_distance = 2
bits of each other differ in at most two of four blocks, so in some pair of blocks all their pivot
distances agree: pairs of blocks' distance rows are the join keys. A candidate whose distances to
any pivot differ by more than the limit cannot be within it (triangle inequality) and is dropped;
the rest are verified on the fingerprints.

A key with many fingerprints is not paired out: its members are tied through the fingerprints one bit
away from them, since two fingerprints are within two bits exactly if they share such a neighbour.
That takes 33 rows a member however many there are, and loses no link.

Nulls and empty texts have fingerprint zero and are linked like any other; repeated rows are kept, a
component without a doc_id has a null component_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.components import components
from lamina.llm.scratch import stored

BLOCKS, WIDTH, PIVOTS, FIELD = 4, 16, 12, 5
MAX_DISTANCE = 2
#: Members of a key up to which pairs are formed.
PAIRED = 24


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), dtype="<u8", count=max(1, len(words) - shingle + 1))
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[lo:lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(x.as_py()) for x in batch.column(2)], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints)], ["doc_id", "doc_key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, doc_key (content hash), fp (64 bits as a long)."""
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("doc_key"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id long, doc_key long, fp long")


def pivots() -> list[list[int]]:
    """Reference fingerprints of each block, from a hash of their place."""
    return [[xxhash.xxh64_intdigest(f"pivot {g} {k}".encode()) & ((1 << WIDTH) - 1) for k in range(PIVOTS)] for g in range(BLOCKS)]


def distance_row(fp: Column, block: int) -> Column:
    """Distances of one block to its pivots, FIELD bits each."""
    own = F.shiftrightunsigned(fp, WIDTH * block).bitwiseAND(F.lit((1 << WIDTH) - 1))
    return sum((F.bit_count(own.bitwiseXOR(F.lit(p))).cast("long") * F.lit(1 << FIELD * k) for k, p in enumerate(pivots()[block])), F.lit(0).cast("long"))


def _apart(a: Column, b: Column, limit: int) -> Column:
    """Whether some pivot's distances in two packed rows differ by more than limit."""
    field = lambda c, k: F.shiftright(c, FIELD * k).bitwiseAND(F.lit((1 << FIELD) - 1))
    out = F.lit(False)
    for k in range(PIVOTS):
        out = out | (F.abs(field(a, k) - field(b, k)) > limit)
    return out


def links(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (a, b) that connect exactly what chains of links connect."""
    rows = [f"d{g}" for g in range(BLOCKS)]
    table = prints.select("fp", *(distance_row(F.col("fp"), g).alias(f"d{g}") for g in range(BLOCKS)))
    keys = [F.struct(F.lit(n).alias("pair"), F.col(f"d{g}").alias("x"), F.col(f"d{h}").alias("y")) for n, (g, h) in enumerate(combinations(range(BLOCKS), 2))]
    keyed = table.select("fp", *rows, F.explode(F.array(*keys)).alias("key")).select("fp", *rows, "key.pair", "key.x", "key.y")
    sizes = keyed.groupBy("pair", "x", "y").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(keyed.join(sizes, ["pair", "x", "y"]), "pivots")
    few = shared.where(F.col("n") <= PAIRED).drop("n")
    other = few.select("pair", "x", "y", F.col("fp").alias("fp2"), *(F.col(r).alias(f"{r}_2") for r in rows))
    apart = F.lit(False)
    for r in rows:
        apart = apart | _apart(F.col(r), F.col(f"{r}_2"), MAX_DISTANCE)
    paired = few.join(other, ["pair", "x", "y"]).where(F.col("fp") < F.col("fp2")).where(~apart).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= MAX_DISTANCE)
    many = shared.where(F.col("n") > PAIRED).select("fp", "pair").distinct()
    near = []
    for n, (g, h) in enumerate(combinations(range(BLOCKS), 2)):
        # the pair's own blocks agree among its members, so only the other bits can differ
        bits = [b for b in range(64) if b // WIDTH not in (g, h)]
        masks = F.array(*(F.lit((1 << b) - (1 << 64) * (b == 63)).cast("long") for b in bits), F.lit(0).cast("long"))
        near.append(many.where(F.col("pair") == n).select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("via")))
    hubs = near[0]
    for part in near[1:]:
        hubs = hubs.unionByName(part)
    least = hubs.groupBy("via").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high").select("via", "low")
    tied = hubs.join(least, "via").where("fp <> low")
    return paired.select(F.col("fp").alias("a"), F.col("fp2").alias("b")).unionByName(tied.select(F.col("fp").alias("a"), F.col("low").alias("b")))


def rooted(nodes: DataFrame) -> DataFrame:
    """nodes (fp, ...), one row for each fingerprint, with `root`: the least fingerprint that links reach."""
    roots = components(links(nodes.select("fp")))
    return nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(*nodes.columns, F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, fp, component_id (least doc_id that links reach)."""
    rows = stored(fingerprints(docs).select("doc_id", "fp"), "fingerprints")
    nodes = rooted(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    ids = nodes.groupBy("root").agg(F.min("low").alias("component_id"))
    named = stored(nodes.join(ids, "root").select("fp", "component_id"), "components")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs, with columns of any names, with one row of each component: the one of the least doc_id (null first) and, among its texts, the least content hash."""
    at = {name: f"c{k}" for k, name in enumerate(docs.columns)}
    plain = docs.toDF(*at.values())
    prints = stored(fingerprints(plain.select(F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text"))), "fingerprints")
    nodes = rooted(prints.groupBy("fp").agg(F.min(F.struct("doc_id", "doc_key")).alias("low")))
    kept = stored(nodes.groupBy("root").agg(F.min("low").alias("low")).select("low.*"), "kept")
    # two columns for an id that may be null, so that the join and what follows it share their keys
    keys = lambda id_, doc_key: {"no_id": F.col(id_).isNull(), "id": F.coalesce(F.col(id_).cast("long"), F.lit(0)), "key": doc_key}
    rows, kept = plain.withColumns(keys(at["doc_id"], F.xxhash64(at["text"]))), kept.withColumns(keys("doc_id", F.col("doc_key")))
    on = ["no_id", "id", "key"]
    return rows.join(kept.select(*on), on, "left_semi").dropDuplicates(on).select(*at.values()).toDF(*docs.columns)
