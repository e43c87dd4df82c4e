"""Operator 8: best-fit packing of documents into sequences, by best-two-fit.

Each task packs one bounded share of the pieces: it fills a sequence greedily with the largest
piece that fits, then exchanges the sequence's smallest piece for two unpacked ones that fill the
widened gap more tightly. Only lengths decide, so the state of a task is a count per length.
Pieces of full length fill a sequence alone and are never shared out.

Nulls: a null text is an empty text (its end id alone); null ids and repeated rows are packed like
any other. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.pieces import piece_ids, runs
from lamina.llm.token_output import binaries, with_end
from lamina.llm.words import spread

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids binary"


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: the first takes the rest, so that all others are full."""
    first = n % size or size
    return [(0, min(n, first)), *((s, size) for s in range(first, n, size))]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, size: int, digest: bool) -> Iterator[pa.RecordBatch]:
    memo = piece_ids(path)
    for batch in batches:
        texts = [x or "" for x in batch.column(1).to_pylist()]
        for lo, hi in runs(texts):
            ids, n = with_end(*memo.encode(texts[lo:hi]), end_id)
            # as `cut`, for all texts at once: the first piece takes the rest
            parts = -(-n // size)
            own, piece = np.repeat(np.arange(len(n)), parts), spread(np.zeros(len(n), dtype=np.int64), parts)
            rest = (n - (parts - 1) * size)[own]
            start, length = np.where(piece == 0, 0, rest + (piece - 1) * size), np.where(piece == 0, rest, size)
            ends = np.cumsum(length) * 4
            raw = memoryview(ids).cast("B")
            value = pa.array([zlib.crc32(raw[e - 4 * k:e]) for e, k in zip(ends.tolist(), length.tolist(), strict=True)], pa.int64()) if digest else binaries(ids, length)
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi].take(pa.array(own)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), value], ["doc_id", "piece", "start", "length", "ids_crc32" if digest else "ids"])


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = 2048, digest: bool = False) -> DataFrame:
    """docs (doc_id, text) -> one row per piece with its ids (little-endian uint32), or with their crc32 only."""
    schema = PIECE_SCHEMA.replace("ids binary", "ids_crc32 long") if digest else PIECE_SCHEMA
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(partial(_pieces, path=tokenizer, end_id=end_id, size=size, digest=digest), schema)


class Shelf:
    """How many unpacked pieces there are of each length up to size."""

    def __init__(self, lengths: np.ndarray, size: int):
        self.counts = np.bincount(lengths, minlength=size + 1)
        self.mask = sum(1 << int(n) for n in np.flatnonzero(self.counts))

    def largest(self, room: int) -> int:
        """The largest unpacked length of at most room; 0: none."""
        return (self.mask & ((2 << room) - 1)).bit_length() - 1 if room > 0 and self.mask & ((2 << room) - 1) else 0

    def take(self, n: int) -> None:
        self.counts[n] -= 1
        if not self.counts[n]:
            self.mask &= ~(1 << n)

    def put(self, n: int) -> None:
        self.counts[n] += 1
        self.mask |= 1 << n

    def best_two(self, room: int, more_than: int) -> tuple[int, int] | None:
        """Two unpacked lengths whose sum is the largest of at most room, and above more_than."""
        n = np.flatnonzero(self.counts[:room])
        n = n[n > 0]
        if not len(n):
            return None
        at = np.searchsorted(n, room - n, side="right") - 1
        fits = at >= 0
        a, at = n[fits], at[fits]
        b = n[at]
        again = (a == b) & (self.counts[a] < 2)  # the only piece of its length cannot be used twice
        at = np.where(again, at - 1, at)
        a, b = a[at >= 0], n[at[at >= 0]]
        if not len(a):
            return None
        k = int(np.argmax(a + b))
        return (int(a[k]), int(b[k])) if a[k] + b[k] > more_than else None


def best_two_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Sequences as lists of piece lengths."""
    shelf, out = Shelf(lengths, size), []
    while first := shelf.largest(size):
        shelf.take(first)
        bin_, gap = [first], size - first
        while gap and (n := shelf.largest(gap)):
            shelf.take(n)
            bin_.append(n)
            gap -= n
        if gap and len(bin_) > 1:
            small = bin_[-1]
            if two := shelf.best_two(gap + small, small):
                bin_[-1:] = two
                shelf.put(small)
                shelf.take(two[0])
                shelf.take(two[1])
        out.append(bin_)
    return out


def _pack(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if table is None or not table.num_rows:
        return
    lengths = np.asarray(table.column("length"), dtype=np.int64)
    waiting = defaultdict(list)
    for row, n in enumerate(lengths.tolist()):
        waiting[n].append(row)
    sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    for k, bin_ in enumerate(best_two_fit(lengths, size)):
        at = 0
        for n in bin_:
            row = waiting[n].pop()
            sequence[row], offset[row], at = k, at, at + n
    sequence += TaskContext.get().partitionId() << 40
    yield from table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).to_batches(max_chunksize=10_000)


def pack_pieces(pieces: DataFrame, size: int = 2048, shares: int = 1) -> DataFrame:
    """Give every piece (a `length` column of at most size, any others) a sequence_id and an offset in it."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in pieces.schema)}, sequence_id long, offset long"
    # dealt out evenly by row, not by any key: repeated ids or lengths cannot pile up in one share
    return pieces.repartition(shares).mapInArrow(partial(_pack, size=size), schema)


def shares_for(docs: DataFrame, bytes_per_share: int) -> int:
    """Shares of about bytes_per_share of text, at least one."""
    n = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-n // bytes_per_share))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = 2048, digest: bool = False, bytes_per_share: int = 1 << 28) -> DataFrame:
    """All pieces of docs with their ids (or crc32), sequence and offset.

    A share of 256 MB of text holds some hundred thousand pieces: tens of MB in a task as digests, and
    enough of them that a share's last sequences do not show in the number of sequences. With ids a
    share should be smaller; 32 MB of text give as many MB of ids.
    """
    return pack_pieces(token_pieces(docs, tokenizer, end_id, size, digest), size, shares_for(docs, bytes_per_share if digest else min(bytes_per_share, 1 << 25)))


def sequences(packed: DataFrame) -> DataFrame:
    """Packed pieces with ids -> sequence_id, ids binary (all ids in order), docs array<struct<offset, doc_id, length>>."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("rows"))
    return rows.select(
        "sequence_id",
        F.aggregate("rows", F.lit(b""), lambda all_, r: F.concat(all_, r["ids"])).alias("ids"),
        F.transform("rows", lambda r: F.struct(r["offset"].alias("offset"), r["doc_id"].alias("doc_id"), r["length"].alias("length"))).alias("docs"),
    )
