"""Operator 1: token ids in canonical length-limited Huffman files.

Layout of a written folder:
  codebook/  (symbol int, length int): canonical code lengths from the global id counts
  segments/  one row per run of documents, in ascending doc_id order: part, local_start, doc_ids,
             doc_tokens, bits (each document starts on a byte), checkpoints (uint64 bit offset of
             every block of BLOCK ids; blocks decode independently)
Files hold whole documents; a document's ids are its text's ids and then the end id.

Nulls: a null text is an empty text; a null doc_id sorts first. Repeated rows are all kept, ties in
doc_id stand in the order of their content hash. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.llm.pieces import piece_ids, runs
from lamina.llm.scratch import stored
from lamina.llm.words import spread

#: Ids per independently decodable block.
BLOCK = 256
#: Ids after which a segment row is closed, and ids handled at once in memory.
SEGMENT, CHUNK = 1 << 18, 1 << 20
MAX_BITS = 16
#: Rows a part that are sampled to find where parts begin.
SAMPLED = 100


# ---------------------------------------------------------------- code construction

def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most max_bits by package-merge; 0 for symbols that do not occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols do not fit codes of {max_bits} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.int64)
    row, is_leaf = leaves, []
    for _ in range(max_bits - 1):
        packages = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, packages])
        order = np.argsort(both, kind="stable")
        is_leaf.append(order < n)
        row = both[order]
    take, depth = 2 * n - 2, np.zeros(n, dtype=np.int64)
    for flags in reversed(is_leaf):
        k = int(flags[:take].sum())
        depth[:k] += 1
        take = 2 * (take - k)
    depth[:take] += 1
    lengths[used] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol), as the decoder rebuilds them from lengths alone."""
    codes = np.zeros(len(lengths), dtype=np.uint32)
    code = last = 0
    for symbol in np.lexsort((np.arange(len(lengths)), lengths)):
        size = int(lengths[symbol])
        if size:
            code <<= size - last
            codes[symbol], last = code, size
            code += 1
    return codes


def decode_tables(lengths: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For every max_bits-bit window: the symbol whose code it starts with, and that code's length."""
    symbols = np.zeros(1 << max_bits, dtype=np.uint32)
    sizes = np.ones(1 << max_bits, dtype=np.uint8)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    span = 1 << (max_bits - lengths[order].astype(np.int64))
    total = int(span.sum())
    symbols[:total] = np.repeat(order, span)
    sizes[:total] = np.repeat(lengths[order], span)
    return symbols, sizes


# ---------------------------------------------------------------- bit packing

def pack(ids: np.ndarray, counts: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids of some documents -> bytes, bytes per document, and every id's bit offset in its document."""
    size = lengths[ids].astype(np.int64)
    after = np.cumsum(size)
    before = after - size
    first = np.cumsum(counts) - counts
    bits = after[first + counts - 1] - before[first]
    n_bytes = (bits + 7) // 8
    base = (np.cumsum(n_bytes) - n_bytes) * 8
    own = before - np.repeat(before[first], counts)
    at = own + np.repeat(base, counts)
    value = codes[ids].astype(np.int64) << (24 - size - (at & 7))
    byte, total = at >> 3, int(n_bytes.sum()) + 3
    out = sum(np.bincount(byte + k, weights=(value >> (16 - 8 * k)) & 255, minlength=total)[:total] for k in range(3))
    return out.astype(np.uint8), n_bytes, own


def unpack(bits: bytes, starts: np.ndarray, sizes: np.ndarray, symbols: np.ndarray, widths: np.ndarray, max_bits: int) -> np.ndarray:
    """Decode blocks side by side: step k reads the k-th id of every block that has one."""
    data = np.frombuffer(bits + b"\0" * 8, dtype=np.uint8).astype(np.uint32)
    window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    out = np.zeros((len(starts), int(sizes.max(initial=0))), dtype="<u4")
    order = np.argsort(-sizes, kind="stable")
    at, alive = starts[order].astype(np.int64), np.searchsorted(-sizes[order], -np.arange(out.shape[1]), side="left")
    mask = (1 << max_bits) - 1
    for k in range(out.shape[1]):
        at = at[: alive[k]]
        look = (window[at >> 3] >> (32 - max_bits - (at & 7)).astype(np.uint32)) & mask
        out[order[: alive[k]], k] = symbols[look]
        at = at + widths[look]
    return out[np.arange(out.shape[1]) < sizes[:, None]]


# ---------------------------------------------------------------- tasks

def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids of some texts, each followed by the end id, and how many each then has."""
    out = np.full(len(ids) + len(counts), end_id, dtype="<u4")
    out[spread(np.cumsum(counts) - counts + np.arange(len(counts)), counts)] = ids
    return out, counts + 1


def binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column whose values lie one after another in data."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]) * data.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype("<i8")), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def _tokenize(batches: Iterator[pa.RecordBatch], path: str, end_id: int, width: str) -> Iterator[pa.RecordBatch]:
    memo = piece_ids(path)
    for batch in batches:
        texts = [x or "" for x in batch.column(1).to_pylist()]
        for lo, hi in runs(texts):
            ids, counts = with_end(*memo.encode(texts[lo:hi]), end_id)
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(counts, pa.int64()), binaries(ids.astype(width), counts)], ["doc_id", "n_tokens", "ids"])


def _count_ids(batches: Iterator[pa.RecordBatch], width: str, vocab: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(vocab, dtype=np.int64)
    for batch in batches:
        for part in batch.column(0):
            total += np.bincount(np.frombuffer(part.as_py(), dtype=width), minlength=vocab)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["symbol", "n"])


def place(doc_id: int | None, tie: int) -> tuple:
    return doc_id is not None, doc_id or 0, tie


def _encode(batches: Iterator[pa.RecordBatch], width: str, lengths: np.ndarray, bounds: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Bits of documents (doc_id, n_tokens, ids, tie), with the part that they fall to between the bounds."""
    codes = canonical_codes(lengths)
    for batch in batches:
        counts = np.array(batch.column(1), dtype=np.int64)
        edges = np.flatnonzero(np.diff(np.cumsum(counts) // CHUNK)) + 1
        for lo, hi in zip([0, *edges], [*edges, len(counts)], strict=True):
            if lo == hi:
                continue
            ids = np.concatenate([np.frombuffer(x.as_py(), dtype=width) for x in batch.column(2)[lo:hi]])
            out, n_bytes, own = pack(ids, counts[lo:hi], codes, lengths)
            ends, first = np.cumsum(n_bytes), np.cumsum(counts[lo:hi]) - counts[lo:hi]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0)[lo:hi],
                    batch.column(1)[lo:hi],
                    pa.array([out[e - n:e].tobytes() for e, n in zip(ends, n_bytes, strict=True)], pa.binary()),
                    pa.array([own[f:f + c:BLOCK].astype("<u8").tobytes() for f, c in zip(first, counts[lo:hi], strict=True)], pa.binary()),
                    batch.column(3)[lo:hi],
                    pa.array([bisect_right(bounds, place(d, t)) for d, t in zip(batch.column(0)[lo:hi].to_pylist(), batch.column(3)[lo:hi].to_pylist(), strict=True)], pa.int32()),
                ],
                ["doc_id", "n_tokens", "bits", "checkpoints", "tie", "part"],
            )


SEGMENT_SCHEMA = "part int, local_start long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, bits binary, checkpoints binary"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, start = TaskContext.get().partitionId(), 0
    ids, tokens, bits, marks, filled, n_bytes = [], [], [], [], 0, 0

    def row() -> pa.RecordBatch:
        values = [part, start, filled, ids, tokens, b"".join(bits), b"".join(marks)]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        names = [x.split()[0] for x in SEGMENT_SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

    for batch in batches:
        for doc, n, body, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids.append(doc)
            tokens.append(n)
            bits.append(body)
            marks.append((np.frombuffer(at, dtype="<u8") + n_bytes * 8).astype("<u8").tobytes())
            filled, n_bytes = filled + n, n_bytes + len(body)
            if filled >= SEGMENT:
                yield row()
                start += filled
                ids, tokens, bits, marks, filled, n_bytes = [], [], [], [], 0, 0
    if ids:
        yield row()


def segment_ids(bits: bytes, checkpoints: bytes, doc_tokens: list[int], tables: tuple[np.ndarray, np.ndarray], max_bits: int) -> np.ndarray:
    """All ids of a segment, from its blocks."""
    tokens = np.array(doc_tokens, dtype=np.int64)
    blocks = -(-tokens // BLOCK)
    sizes = np.full(int(blocks.sum()), BLOCK, dtype=np.int64)
    sizes[np.cumsum(blocks) - 1] = tokens - (blocks - 1) * BLOCK
    return unpack(bits, np.frombuffer(checkpoints, dtype="<u8"), sizes, *tables, max_bits)


def _digest(batches: Iterator[pa.RecordBatch], lengths: np.ndarray, max_bits: int) -> Iterator[pa.RecordBatch]:
    tables = decode_tables(lengths, max_bits)
    for batch in batches:
        for start, doc_ids, tokens, bits, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids = memoryview(segment_ids(bits, marks, tokens, tables, max_bits)).cast("B")
            ends = np.cumsum(tokens)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_ids, pa.int64()),
                    pa.array(start + ends - tokens, pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([zlib.crc32(ids[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), tokens, strict=True)], pa.int64()),
                ],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def _documents(batches: Iterator[pa.RecordBatch], lengths: np.ndarray, max_bits: int) -> Iterator[pa.RecordBatch]:
    tables = decode_tables(lengths, max_bits)
    for batch in batches:
        for doc_ids, tokens, bits, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids = segment_ids(bits, marks, tokens, tables, max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(np.split(ids.astype(np.int32), np.cumsum(tokens)[:-1]), pa.list_(pa.int32()))], ["doc_id", "ids"])


# ---------------------------------------------------------------- operator

def part_edges(ids: DataFrame, parts: int) -> list[tuple]:
    """Places that cut the documents (doc_id, tie) into parts of about equal number, from about SAMPLED rows a part."""
    if parts == 1:
        return []
    own = sorted(place(*r) for r in ids.select("doc_id", "tie").sample(min(1.0, SAMPLED * parts / max(1, ids.count())), seed=1).collect())
    return [own[k * len(own) // parts] for k in range(1, parts)] if own else []


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, tokens_per_part: int = 8_000_000, max_bits: int = MAX_BITS) -> None:
    """Write the ids of all texts (doc_id, text) below path, in ascending doc_id order."""
    spark = docs.sparkSession
    vocab = max(piece_ids(tokenizer).tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
    width = "<u2" if vocab <= 1 << 16 else "<u4"
    ids = stored(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(partial(_tokenize, path=tokenizer, end_id=end_id, width=width), "doc_id long, n_tokens long, ids binary").withColumn("tie", F.xxhash64("ids")),
        "ids",
    )
    counts = np.zeros(vocab, dtype=np.int64)
    # at most one row per vocabulary entry reaches the driver
    for symbol, n in ids.select("ids").mapInArrow(partial(_count_ids, width=width, vocab=vocab), "symbol int, n long").groupBy("symbol").agg(F.sum("n")).collect():
        counts[symbol] = n
    lengths = code_lengths(counts, max_bits)
    spark.createDataFrame([(int(s), int(lengths[s])) for s in np.flatnonzero(lengths)], "symbol int, length int").coalesce(1).write.parquet(f"{path}/codebook")
    parts = max(1, -(-int(counts.sum()) // tokens_per_part))
    (
        # the parts are found from names alone: Spark's own sampling would encode all documents once more
        ids.mapInArrow(partial(_encode, width=width, lengths=lengths, bounds=part_edges(ids, parts)), "doc_id long, n_tokens long, bits binary, checkpoints binary, tie long, part int")
        .repartitionById(parts, "part")
        .sortWithinPartitions("doc_id", "tie")
        .drop("tie", "part")
        .mapInArrow(_segments, SEGMENT_SCHEMA)
        .write.parquet(f"{path}/segments")
    )


def _opened(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray]:
    book = spark.read.schema("symbol int, length int").parquet(f"{path}/codebook").collect()
    lengths = np.zeros(max((r.symbol for r in book), default=0) + 1, dtype=np.uint8)
    for symbol, size in book:
        lengths[symbol] = size
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(f"{path}/segments")
    # one row per written part
    offsets = segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
    return segments.join(F.broadcast(offsets), "part"), lengths


def read_ids(spark: SparkSession, path: str, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents of a written folder: doc_id, ids array<int>."""
    segments, lengths = _opened(spark, path)
    return segments.select("doc_ids", "doc_tokens", "bits", "checkpoints").mapInArrow(partial(_documents, lengths=lengths, max_bits=max_bits), "doc_id long, ids array<int>")


def read_digests(spark: SparkSession, path: str, max_bits: int = MAX_BITS) -> DataFrame:
    """Per document of a written folder: doc_id, start, n_tokens, ids_crc32, from its decoded ids."""
    segments, lengths = _opened(spark, path)
    rows = segments.select((F.col("local_start") + F.col("offset")).alias("start"), "doc_ids", "doc_tokens", "bits", "checkpoints")
    return rows.mapInArrow(partial(_digest, lengths=lengths, max_bits=max_bits), "doc_id long, start long, n_tokens long, ids_crc32 long")
