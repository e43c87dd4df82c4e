"""Operator 10: line dedup by an exact set-similarity join.

A line is removed if an earlier line (by doc_id, then line number) has the same set of words, or one
of Jaccard similarity 0.8 or more. Words are lower-cased and split at white space; lines of fewer
than min_words different words always stay. Lines of fewer than KEYED words are similar to equal sets
alone, which are found without keys.

Words are put in order of rarity by counts over all lines. Similar lines share one of their first
n - ceil(0.8 n) + 1 words (the prefix). Words of at most RARE lines are keys of their own; lines that
share no such word must share several of their next words, so these are joined on combinations of
two or three, and keys stay short lists however frequent single words are. Under a key, two lines are
compared by length, by position (the first word that they share must leave room for the overlap that
their two lengths demand) and by a parity sketch of their words, whose bits differ in no more places
than the words do. Each line keeps its CANDIDATES closest earlier lines; these are verified on the
words, the closest first, the others only if that one was not similar. A line without a close one
keeps up to CANDIDATES_FAR.

Hot keys: a key with many lines in one chunk is dealt over salted groups, and a group is worked in
pieces of PIECE lines, so that groups of near copies cost no pairs. What was not compared with all of
its key, or had more candidates than it kept, and was not found similar, is compared again: a few lines
with all others (`_compared`), many under all of their keys (`looked_up`); so nothing is lost to bounds.

Nulls: a null text has no lines; a null doc_id comes first. Rows with equal doc_id and equal text are
one document and keep the same lines; with other texts they are told apart. Empty lines stay. An
empty table loses nothing. Columns of docs may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import InitVar, dataclass
from functools import cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.scratch import stored
from lamina.llm.words import M1, M2, M3, PADDING, mixed, word_hashes

#: Least Jaccard similarity, as a fraction.
NUM, DEN = 4, 5
#: Words from which on a line can be similar to one of other words: there a line of one word more can hold them all.
KEYED = NUM // (DEN - NUM)
#: Counts are kept in a power of two of cells between these bounds (8 to 64 MB), one for BYTES_A_CELL of text, CELLS_A_ROW of them in a row on their way to be summed.
LEAST_CELLS, MOST_CELLS, BYTES_A_CELL, CELLS_A_ROW = 1 << 21, 1 << 24, 1024, 1 << 11
#: Words in at most so many lines are keys alone.
RARE = 2048
#: Candidates that a line keeps under a key if one of them is close, and if none is; lines of a key that are compared at once, and lines of a chunk from which on a key is dealt over salted groups.
CANDIDATES, CANDIDATES_FAR, PIECE, SALTED = 8, 64, 8192, 256
#: Ids up to which a set of lines is sent to the tasks (16 MB); a larger one is joined.
SENT_IDS = 2_000_000
#: Bytes of words up to which lines are sent to the tasks to be compared with all others.
SENT_BYTES = 8_000_000
#: Documents and removed lines up to which the lists of removed lines are broadcast (about 50 MB).
BROADCAST_DOCS, BROADCAST_LINES = 300_000, 5_000_000
#: Bytes of text worked at once, rows of keys worked at once, lines that a task remembers as sent.
CHUNK, BAG, SEEN_LIMIT = 1 << 21, 200_000, 1_000_000
#: Rows of keys that a task deals out at once, bytes of text whose keys go to one task (some 400,000 rows), and rows that it sorts at once.
DEALT, BYTES_A_PART, HELD = 500_000, 1 << 24, 2_000_000
#: Bits (as a power of two, 16 MB) that mark lines which are too many to be sent.
MARK_BITS = 27

ORD = ["doc_id", "doc_key", "line_no"]
#: A line's identity: two sums of 64 bits over its words.
LINE = ["lid", "lid2"]
#: Low bits of a key: the part flag, the place of the key's first word and the number of words, the last two up to a bound.
PLACE_BITS, SIZE_BITS = 8, 10
MOST_PLACE, MOST_SIZE, KEY_SHIFT = (1 << PLACE_BITS) - 1, (1 << SIZE_BITS) - 1, 1 + PLACE_BITS + SIZE_BITS
#: Bits of keys and of LINE's first sum as they are dealt out; other lines of equal bits are told apart by their words.
DEALT_BITS, SHORT_BITS = 48, 40
#: Bits of the parity sketch. Lines of SPLIT words or more have another one for half of their words. The rest of both longs says how early the line is.
SKETCH_BITS, EARLY_BITS, SPLIT = 56, 8, 64

#: A table for bytes.translate: white space of one byte (1), first bytes of white space of more bytes (2); and that of more bytes.
_SPACE = bytes(1 if b in (*range(9, 14), *range(28, 33)) else 2 * (b in (0xC2, 0xE1, 0xE2, 0xE3)) for b in range(256))
_TWO_BYTES, _THREE_BYTES = (np.sort([int.from_bytes(x.encode()) for x in chars]) for chars in ("\x85\xa0", ["\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000"]))

# ---------------------------------------------------------------- words of lines

@dataclass
class Lines:
    """Lines with words, of some texts: which text and line of it, and their different words (all lines' in one array); and the number of all lines of each text."""

    text: np.ndarray
    number: np.ndarray
    sizes: np.ndarray
    words: np.ndarray
    n_lines: np.ndarray

    @property
    def first(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    def lids(self) -> np.ndarray:
        return self._sums(self.words)

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        return self.lids(), self._sums(mixed(self.words, M3))

    def _sums(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.sizes):
            return np.zeros(0, dtype=np.int64)
        return mixed(np.add.reduceat(hashes, self.first), self.sizes.astype(np.uint64)).view(np.int64)

    def take(self, at: np.ndarray) -> Lines:
        sizes = self.sizes[at]
        inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return Lines(self.text[at], self.number[at], sizes, self.words[np.repeat(self.first[at], sizes) + inner], self.n_lines)


def lines_of(texts: pa.Array | list[str], counts: np.ndarray | None = None, least: int = 1, ranks: np.ndarray | None = None, some: np.ndarray | None = None) -> Lines:
    """Lines of at least `least` different words; their words by rarity under counts, else in the order of their hashes.

    ranks: `rarity` of the counts, in their place. some: a table by the upper 20 bits of hashes; lines without a word in it are left out.
    """
    parts = lowered(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
    data = b"\n".join([*parts, b"\0" * PADDING])
    if not parts:
        data = b"\n" + data
    buf = np.frombuffer(data, dtype=np.uint8)
    space = spaces(data, buf)[:-PADDING]
    turns = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        turns = np.concatenate([[0], turns])
    starts, ends = turns[::2], turns[1::2]
    words = word_hashes(buf, starts, ends - starts)
    newlines = np.flatnonzero(buf[:-PADDING] == 10)
    breaks = np.searchsorted(starts, newlines)
    line = np.repeat(np.arange(len(breaks)), np.diff(breaks, prepend=0))
    if some is not None:
        wanted = np.zeros(len(breaks), dtype=bool)
        wanted[line[some[(words >> np.uint64(44)).astype(np.int64)]]] = True
        words, line = words[wanted[line]], line[wanted[line]]
    rank = np.zeros(len(words), dtype=np.uint64)
    if counts is not None:
        ranks = rarity(counts)
    if ranks is not None:
        rank = ranks[(words & np.uint64(len(ranks) - 1)).astype(np.int64)].astype(np.uint64)
    words, line = in_rank_order(words, line, rank)
    new = np.ones(len(words), dtype=bool)
    new[1:] = (words[1:] != words[:-1]) | (line[1:] != line[:-1])
    words, line = words[new], line[new]
    sizes = np.bincount(line)
    own = np.flatnonzero(sizes)
    sizes = sizes[own]
    n_lines = np.diff(np.searchsorted(newlines, np.cumsum([len(x) + 1 for x in parts]) - 1, side="right"), prepend=0) if parts else np.zeros(0, dtype=np.int64)
    text = np.repeat(np.arange(len(texts)), n_lines)
    number = np.arange(len(text)) - np.repeat(np.cumsum(n_lines) - n_lines, n_lines)
    found = Lines(text[own], number[own], sizes, words, n_lines)
    return found.take(np.flatnonzero(sizes >= least)) if least > 1 else found


@cache
def _lower_pairs() -> np.ndarray:
    """By the first two bytes of a character in UTF-8: those of its lower case where it has two, -1 where its whole text has to be asked."""
    out = np.arange(1 << 16, dtype=np.int32)
    for c in range(0x80, 0x800):
        low = chr(c).lower().encode()
        out[int.from_bytes(chr(c).encode())] = int.from_bytes(low) if len(low) == 2 and c != 0x3A3 else -1  # Sigma's depends on what follows
    for c in (*range(0x800, 0xD800), *range(0xE000, 0x20000)):
        if chr(c).lower() != chr(c):
            out[int.from_bytes(chr(c).encode()[:2])] = -1
    out[0xF0A0:] = -1
    return out


def lowered(texts: pa.Array) -> list[memoryview | bytes]:
    """Texts as str.lower gives them, in UTF-8; null is empty."""
    texts = texts.fill_null("")
    _, at, data = texts.buffers()
    if not len(texts) or data is None:
        return [b""] * len(texts)
    at = np.frombuffer(at, dtype="<i8" if pa.types.is_large_string(texts.type) else "<i4")[texts.offset:texts.offset + len(texts) + 1]
    at = at.astype(np.int64)
    low = np.frombuffer(data.slice(int(at[0]), int(at[-1] - at[0])).to_pybytes().lower(), dtype=np.uint8).copy()
    at -= at[0]
    lead = np.flatnonzero(low >= 0xC3)  # no character before has another lower case
    pairs = low[lead].astype(np.int64) << 8 | low[lead + 1]
    to = _lower_pairs()[pairs]
    new = np.flatnonzero((to != pairs) & (to >= 0))
    low[lead[new]], low[lead[new] + 1] = to[new] >> 8, to[new] & 0xFF
    whole = memoryview(low)
    out: list[memoryview | bytes] = [whole[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    for k in np.unique(np.searchsorted(at, lead[to < 0], side="right") - 1).tolist():
        out[k] = texts[k].as_py().lower().encode()
    return out


def spaces(data: bytes, buf: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 are of white space, as str.split knows it."""
    kind = np.frombuffer(data.translate(_SPACE), dtype=np.uint8)
    space, at = kind == 1, np.flatnonzero(kind == 2)
    if len(at):
        two = buf[at].astype(np.int64) << 8 | buf[at + 1]
        two, three = at[np.isin(two, _TWO_BYTES)], at[np.isin(two << 8 | buf[at + 2], _THREE_BYTES)]
        space[np.concatenate([two, two + 1, three, three + 1, three + 2])] = True
    return space


def rarity(counts: np.ndarray) -> np.ndarray:
    """Counts as 12 bits in the same order: as they are up to RARE, in small steps of their logarithm beyond."""
    out = np.minimum(counts, RARE).astype(np.uint16)
    at = np.flatnonzero(counts > RARE)
    out[at] = RARE + np.minimum(4095 - RARE, 1 + (128 * np.log2(counts[at] / max(RARE, 1))).astype(np.int64))
    return out


def in_rank_order(words: np.ndarray, line: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words by line, rank and hash."""
    if not len(words) or line[-1] >= 1 << 13 or len(words) >= 1 << 19:
        order = np.lexsort((words, rank, line))
        return words[order], line[order]
    # line, rank, some of the hash and the place in one number: plain numbers sort the fastest
    packed = np.sort(line.astype(np.uint64) << np.uint64(51) | rank << np.uint64(39) | words >> np.uint64(44) << np.uint64(19) | np.arange(len(words), dtype=np.uint64))
    packed, words = packed >> np.uint64(19), words[(packed & np.uint64((1 << 19) - 1)).astype(np.int64)]
    tied = np.flatnonzero((packed[1:] == packed[:-1]) & (words[1:] != words[:-1]))
    if len(tied):  # other words of equal rank: their whole hashes decide, the same way in all lines
        at = np.flatnonzero(np.isin(line, line[tied]))
        words[at] = words[at][np.lexsort((words[at], packed[at]))]
    return words, line


def chunks(batch: pa.RecordBatch, text_at: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Runs of rows with about CHUNK bytes of text."""
    if not batch.num_rows:
        return
    held = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text_at)), 0)).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        hi = min(batch.num_rows, int(np.searchsorted(held, (held[lo - 1] if lo else 0) + CHUNK)) + 1)
        part = batch.slice(lo, hi - lo)
        yield part, part.column(text_at)
        lo = hi


LINES_SCHEMA = "doc_id long, doc_key long, line_no int, lid long, lid2 long, n_lines long, part int, cells binary"


def _lines(batches: Iterator[pa.RecordBatch], least: int, n_cells: int) -> Iterator[pa.RecordBatch]:
    """A row for each line, one for each document with its number of lines, and at the end how many lines hold the words of each cell."""
    cells = np.zeros(n_cells, dtype="<u4")
    names = [x.split()[0] for x in LINES_SCHEMA.split(", ")]
    waiting: list[np.ndarray] = []
    for batch in batches:
        for part, texts in chunks(batch, 2):
            own = lines_of(texts, least=least)
            waiting.append((own.words[np.repeat(own.sizes >= KEYED, own.sizes)] & np.uint64(n_cells - 1)).astype(np.int32))
            if sum(map(len, waiting)) > n_cells:
                cells, waiting = cells + np.bincount(np.concatenate(waiting), minlength=n_cells).astype("<u4"), []
            at, n = pa.array(own.text), len(own.text)
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(own.number, pa.int32()), *map(pa.array, own.ids()), *(pa.nulls(n, k) for k in (pa.int64(), pa.int32(), pa.binary()))], names)
            n = len(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.nulls(n, k) for k in (pa.int32(), pa.int64(), pa.int64())), pa.array(own.n_lines, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
    if waiting:
        cells = cells + np.bincount(np.concatenate(waiting), minlength=n_cells).astype("<u4")
    rows = cells.reshape(-1, CELLS_A_ROW)
    used = np.flatnonzero(rows.any(axis=1))
    for lo in range(0, len(used), 256):
        own = used[lo:lo + 256]
        empty = [pa.nulls(len(own), k) for k in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())]
        yield pa.RecordBatch.from_arrays([*empty, pa.array(own, pa.int32()), pa.array([narrow(rows[k]) for k in own], pa.binary())], names)


def narrow(cells: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest of them needs."""
    most = int(cells.max())
    return cells.astype("u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, cells in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            held = cells.as_buffer()
            own = np.frombuffer(held, dtype=f"<u{len(held) // CELLS_A_ROW}").astype("<u4")
            total[part] = np.minimum(total[part].astype(np.int64) + own, 0xFFFFFFFF).astype("<u4") if part in total else own
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["part", "cells"])


def word_counts(lines: DataFrame, n_cells: int) -> np.ndarray:
    """How many lines hold the words of each cell, over all lines; n_cells is bounded."""
    shares = max(1, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    summed = lines.where("part is not null").select("part", "cells").repartition(shares, "part").mapInArrow(_sum, "part int, cells binary")
    out = np.zeros((n_cells // CELLS_A_ROW, CELLS_A_ROW), dtype="<u4")
    for part, cells in summed.collect():
        out[part] = np.frombuffer(cells, dtype="<u4")
    return out.reshape(-1)


# ---------------------------------------------------------------- keys

def together(n: int) -> int:
    """How many frequent words a key holds, by the length of a line."""
    return 3 if n <= 24 else 2 if n <= 100 else 1


def _mix(tokens: np.ndarray, salt: int) -> np.ndarray:
    """Hash rows of tokens (in their common order) to 64 bits."""
    out = np.full(tokens.shape[:-1], 0x9E3779B97F4A7C15 + salt, dtype=np.uint64)
    for k in range(tokens.shape[-1]):
        out = (out ^ tokens[..., k]) * M1
        out ^= out >> np.uint64(32)
    return out


def line_keys(own: Lines, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of lines whose words stand by rarity (`rarity` of their counts): line number, key, and place.

    The place is that of a key's last word, less the words before it in the key: two lines whose first
    shared words are these have it within n - overlap, for the overlap that both lengths demand.
    """
    words, sizes, first = own.words, own.sizes, own.first
    prefix = sizes - -(-NUM * sizes // DEN) + 1
    line = np.repeat(np.arange(len(sizes)), prefix)
    starts = np.cumsum(prefix) - prefix
    place = np.arange(len(line)) - starts[line]
    head = words[first[line] + place]
    rank = ranks[(head & np.uint64(len(ranks) - 1)).astype(np.int64)]
    rare = rank <= RARE
    alone = rare & (rank > 1)
    out = [(line[alone], _mix(head[alone][:, None], 1), place[alone])]
    n_rare = np.add.reduceat(rare, starts, dtype=np.int64)  # of the prefix
    left = prefix - n_rare  # places in the prefix that frequent words take
    # lines of different length may join words in different numbers: a line uses the numbers of all lengths that can be similar
    lengths, at = np.unique(sizes, return_inverse=True)
    ways = np.array([[k in {together(-(-NUM * n // DEN)), together(n), together(DEN * n // NUM)} for k in (1, 2, 3)] for n in lengths.tolist()])[at]
    for k in (1, 2, 3):
        for r in np.unique(left[(left > 0) & ways[:, k - 1]]).tolist():
            mine = np.flatnonzero((left == r) & ways[:, k - 1])
            width = r + k - 1
            picks = np.array(list(combinations(range(width), k)), dtype=np.int64)
            step = max(1, 500_000 // (len(picks) * k))
            for part in (mine[lo:lo + step] for lo in range(0, len(mine), step)):
                tokens = words[(first[part] + n_rare[part])[:, None] + np.arange(width)][:, picks]
                out.append((np.repeat(part, len(picks)), _mix(tokens, 1 + k).reshape(-1), (n_rare[part][:, None] + picks[:, -1] - (k - 1)).reshape(-1)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def sketches(own: Lines, early: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity of the words that fall on each bit, and that of half of the words of longer lines; above them how early the line's document is."""
    if not len(own.sizes):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    flips = np.uint64(1) << ((own.words >> np.uint64(24)) % np.uint64(SKETCH_BITS))
    half = np.bitwise_xor.reduceat(np.where(own.words & np.uint64(1 << 23), flips, np.uint64(0)), own.first)
    high, low = (x.astype(np.uint64) << np.uint64(SKETCH_BITS) for x in (early >> EARLY_BITS, early & ((1 << EARLY_BITS) - 1)))
    return (np.bitwise_xor.reduceat(flips, own.first) | high).view(np.int64), (np.where(own.sizes >= SPLIT, half, np.uint64(0)) | low).view(np.int64)


def earliness(ids: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Twice EARLY_BITS that never fall as ids grow: the part of the corpus, and where in it."""
    part = np.searchsorted(edges, ids, side="right")
    if not len(edges):
        return part
    low, high = edges[np.maximum(part - 1, 0)].astype(np.float64), edges[np.minimum(part, len(edges) - 1)].astype(np.float64)
    inside = np.where((part > 0) & (part < len(edges)), (ids.astype(np.float64) - low) / np.maximum(high - low, 1), 0.0)
    return part << EARLY_BITS | np.clip(inside * (1 << EARLY_BITS), 0, (1 << EARLY_BITS) - 1).astype(np.int64)


def within(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    """Places of values in a sorted array; -1 where it lacks them."""
    if not len(sorted_):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return np.where(sorted_[at] == values, at, -1)


def salted(key: np.ndarray, lid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Deal keys with more than SALTED lines of a chunk over groups of their own. Some lines stay, so that all others of the key learn of it by the flag."""
    _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
    part = n[inverse] > SALTED
    if not part.any():
        return key, part
    order = np.argsort(inverse, kind="stable")
    rank = np.empty(len(key), dtype=np.int64)
    rank[order] = np.arange(len(key)) - np.repeat(np.cumsum(n) - n, n)
    moved = part & (rank >= SALTED // 4)
    salt = (lid.view(np.uint64)[moved] % (n[inverse][moved] // (SALTED // 4)).astype(np.uint64)) + np.uint64(1)
    key = key.copy()
    key[moved] = mixed(key[moved], salt)
    return key, part


#: Where a line may have more candidates than were kept.
SAME, ALL = 1, 2
KEYS_SCHEMA = "key long, lid long, sketch long, half long"


def short(lid: Column | str) -> Column:
    return (F.col(lid) if isinstance(lid, str) else lid).bitwiseAND(F.lit((1 << SHORT_BITS) - 1))


DEALT_SCHEMA = "part int, data binary"


def by_part(part: np.ndarray, parts: int) -> np.ndarray:
    return np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")  # numbers of 16 bits are sorted in one go


def dealt(rows: tuple[np.ndarray, ...], parts: int) -> pa.RecordBatch:
    """Columns of KEYS_SCHEMA -> the rows of each part as bytes: the lines, the keys, and the half sketches of the lines that have one."""
    key, lid, sketch, half = (x.view(np.uint64) for x in rows)
    part = (mixed(key >> np.uint64(KEY_SHIFT), M2) % np.uint64(parts)).astype(np.int32)
    order = by_part(part, parts)
    part, key, lid, sketch, half = part[order], key[order], lid[order], sketch[order], half[order]
    eight = lambda x: np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)
    lines = np.concatenate([eight(lid)[:, :SHORT_BITS // 8], eight(sketch), eight(half)[:, 7:]], axis=1)
    keys, halves = eight(key)[:, :DEALT_BITS // 8], eight(half)[:, :7]
    split = (key & np.uint64(MOST_SIZE)) >= SPLIT
    own, starts = np.unique(part, return_index=True)
    data = [lines[a:b].tobytes() + keys[a:b].tobytes() + halves[a:b][split[a:b]].tobytes() for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(part)], strict=True)]
    # the number of rows goes first, since those with a half sketch are longer
    sizes = np.diff(np.append(starts, len(part)))
    return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([n.to_bytes(4, "little") + x for n, x in zip(sizes.tolist(), data, strict=True)], pa.binary())], ["part", "data"])


def undealt(data: bytes | pa.Buffer) -> tuple[np.ndarray, ...]:
    """Rows of `dealt`, as columns of KEYS_SCHEMA in unsigned numbers; of keys and lids the bits that were sent."""
    buf = np.frombuffer(data, dtype=np.uint8)
    n, a, b = int(buf[:4].view("<u4")[0]), SHORT_BITS // 8, DEALT_BITS // 8
    lines, keys = buf[4:4 + n * (a + 9)].reshape(n, a + 9), buf[4 + n * (a + 9):4 + n * (a + 9 + b)].reshape(n, b)
    out = [np.zeros((n, 8), dtype=np.uint8) for _ in range(4)]
    out[0][:, :b], out[1][:, :a], out[2][:], out[3][:, 7] = keys, lines[:, :a], lines[:, a:a + 8], lines[:, a + 8]
    key, lid, sketch = (x.view("<u8").reshape(-1) for x in out[:3])
    out[3][(key & np.uint64(MOST_SIZE)) >= SPLIT, :7] = buf[4 + n * (a + 9 + b):].reshape(-1, 7)
    return key, lid, sketch, out[3].view("<u8").reshape(-1)


def _deal(batches: Iterator[pa.RecordBatch], parts: int, **how: object) -> Iterator[pa.RecordBatch]:
    """The rows of `_keys`, dealt out."""
    held: list[tuple[np.ndarray, ...]] = []
    n_held = 0
    for batch in _keys(batches, **how):
        held.append(tuple(np.asarray(c) for c in batch.columns))
        n_held += batch.num_rows
        if n_held >= DEALT:
            yield dealt(tuple(map(np.concatenate, zip(*held, strict=True))), parts)
            held, n_held = [], 0
    if n_held:
        yield dealt(tuple(map(np.concatenate, zip(*held, strict=True))), parts)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows that were dealt to one part, by key; where they are more than HELD, some at a time, their keys flagged as not whole."""
    def by_key(rows: list[tuple[np.ndarray, ...]], flag: bool) -> Iterator[pa.RecordBatch]:
        columns = tuple(map(np.concatenate, zip(*rows, strict=True)))
        order = np.argsort(columns[0])
        key, *others = (c[order] for c in columns)
        if flag:
            key = key | np.uint64(1 << (PLACE_BITS + SIZE_BITS))
        for lo in range(0, len(key), BAG):
            yield pa.RecordBatch.from_arrays([pa.array(c[lo:lo + BAG].view(np.int64)) for c in (key, *others)], ["key", "lid", "sketch", "half"])

    held: list[tuple[np.ndarray, ...]] = []
    n_held, over = 0, False
    for batch in batches:
        for data in batch.column(1):
            if n_held >= HELD:
                over = True
                yield from by_key(held, over)
                held, n_held = [], 0
            held.append(undealt(data.as_buffer()))
            n_held += len(held[-1][0])
    if n_held:
        yield from by_key(held, over)


def _keys(batches: Iterator[pa.RecordBatch], ranks: np.ndarray, least: int, edges: np.ndarray, salt: bool, lids: np.ndarray | None = None, groups: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    """key, lid and sketches of every line of KEYED words or more; a line goes once from a task as far as it remembers.

    Only of lines named in lids, where given; only under the groups given, for lines that are as early as asked for there.
    """
    # the line last sent from each of SEEN_LIMIT slots, and how early it was
    seen, seen_early = np.zeros(SEEN_LIMIT, dtype=np.int64), np.full(SEEN_LIMIT, np.iinfo(np.int64).max)
    for batch in batches:
        for part, texts in chunks(batch, 1):
            own = lines_of(texts, least=max(least, KEYED), ranks=ranks)
            if not len(own.sizes):
                continue
            ids = part.column(0).fill_null(np.iinfo(np.int64).min)
            early = earliness(np.asarray(ids), edges)[own.text]
            lid = own.lids()
            at = np.lexsort((early, lid))
            at = at[np.concatenate([[True], lid[at][1:] != lid[at][:-1]])]  # the earliest of equal lines
            slot = lid[at] % SEEN_LIMIT
            new = (seen[slot] != lid[at]) | (early[at] < seen_early[slot])
            at, slot = at[new], slot[new]
            slot, last = np.unique(slot, return_index=True)
            seen[slot], seen_early[slot] = lid[at[last]], early[at[last]]
            if lids is not None:
                at = at[within(lid[at], lids) >= 0]
            if not len(at):
                continue
            own, lid, early = own.take(at), lid[at], early[at]
            line, key, place = line_keys(own, ranks)
            key, flag = salted(key, lid[line]) if salt else (key, np.zeros(len(key), dtype=bool))
            low = flag.astype(np.uint64) << np.uint64(PLACE_BITS + SIZE_BITS) | np.minimum(place, MOST_PLACE).astype(np.uint64) << np.uint64(SIZE_BITS) | np.minimum(own.sizes[line], MOST_SIZE).astype(np.uint64)
            packed = (key & ~np.uint64((1 << KEY_SHIFT) - 1)) | low
            if groups is not None:
                at = within((packed >> np.uint64(KEY_SHIFT)).view(np.int64), groups[0])
                hit = np.flatnonzero((at >= 0) & (early[line] <= groups[1][at]))
                packed, line = packed[hit], line[hit]
            sketch, half = sketches(own, early)
            for lo in range(0, len(packed), 100_000):
                some = slice(lo, lo + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(packed[some].view(np.int64)), *(pa.array(c[line[some]]) for c in (lid, sketch, half))], ["key", "lid", "sketch", "half"])


# ---------------------------------------------------------------- candidates

def fitting(n: np.ndarray, m: np.ndarray, p: np.ndarray, q: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Whether lines of n and m words with a common key at places p and q, and sketches so far apart, may be similar."""
    overlap = -(-NUM * (n + m) // (NUM + DEN))
    known = (n < MOST_SIZE) & (m < MOST_SIZE)
    return ~known | ((p <= n - overlap) & (q <= m - overlap) & (apart <= (n + m) * (DEN - NUM) // (NUM + DEN)))


def runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, dtype=np.int64)


def group_candidates(group: np.ndarray, low: np.ndarray, lid: np.ndarray, sketch: np.ndarray, half: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, ...]:
    """later lid, earlier lid, distance, more of lines in groups; `cut` marks the lines of groups that are not whole.

    more says where else a line has candidates: nowhere (0), in documents just as early (SAME), anywhere (ALL).
    """
    bits, mask = np.uint64(SKETCH_BITS), np.uint64((1 << SKETCH_BITS) - 1)
    # lines are known by lid, place and parity: of the lid some bits may be left, and other keys may fall into the group
    place = low >> np.uint64(SIZE_BITS) & np.uint64(MOST_PLACE)
    own = group.astype(np.uint64) << np.uint64(44) | mixed(mixed(lid.view(np.uint64), M2) ^ (sketch & mask), place) >> np.uint64(20)
    order = np.argsort(own)
    at = runs(own[order])
    early = ((sketch >> bits) << np.uint64(EARLY_BITS) | half >> bits).astype(np.int64)
    early = np.minimum.reduceat(early[order], at) if len(at) else early  # the earliest copy of each line
    group, low, lid, sketch, half, cut, place = (x[order[at]] for x in (group, low, lid, sketch, half, cut, place))
    starts = runs(group)
    sizes = np.diff(np.append(starts, len(group)))
    # groups beyond PIECE are worked in pieces
    inside = np.arange(len(group)) - np.repeat(starts, sizes)
    cut = cut | np.repeat(sizes > PIECE, sizes)
    both = np.cumsum(inside % PIECE == 0) << 16 | (low & np.uint64(MOST_SIZE)).astype(np.int64)
    order = np.argsort(both)
    both, place, lid, parity, half, cut, early = both[order], place[order].astype(np.int64), lid[order], (sketch & mask)[order], (half & mask)[order], cut[order], early[order]
    n, piece = both & MOST_SIZE, both >> 16
    upto = np.searchsorted(both, piece << 16 | np.minimum(n * DEN // NUM, MOST_SIZE), side="right")
    width = upto - np.arange(len(n)) - 1
    found: list[tuple[np.ndarray, ...]] = []
    ends = np.cumsum(width)
    lo = 0
    while lo < len(width):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 2_000_000, side="right")))
        w = width[lo:hi]
        i = np.repeat(np.arange(lo, hi), w)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(w) - w, w)
        # where both have it, each half is compared by itself
        other = np.where((n[i] >= SPLIT) & (n[j] >= SPLIT), half[i] ^ half[j], np.uint64(0))
        apart = np.bitwise_count(parity[i] ^ parity[j] ^ other).astype(np.int64) + np.bitwise_count(other)
        fits = fitting(n[i], n[j], place[i], place[j], apart) & ((lid[i] != lid[j]) | (parity[i] != parity[j]))
        i, j, apart = i[fits], j[fits], apart[fits]
        # equally early: either may come first, the words' check knows which
        for later, earlier in ((j, i), (i, j)):
            may = early[earlier] <= early[later]
            found.append((later[may], earlier[may], apart[may]))
        lo = hi
    later, earlier, apart = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 3
    same = (early[later] == early[earlier]).astype(np.int64)
    # by the later line, then the earlier ones as they are kept: of lids the bits that are left
    order = np.argsort(later << 44 | same << 43 | apart << 35 | early[earlier] << 19 | lid[earlier] & ((1 << 19) - 1))
    later, earlier, apart, same = later[order], earlier[order], apart[order], same[order]
    at = runs(later)
    own = later[at]
    # the closest says how many are kept: what differs in few places is all but sure to be similar
    best = np.minimum.reduceat(apart, at) if len(at) else apart
    most = np.where(4 * best * (NUM + DEN) <= n[own] * 4 * (DEN - NUM), CANDIDATES, CANDIDATES_FAR)
    part = later * 2 + same
    at = runs(part)
    part, count = part[at], np.diff(np.append(at, len(part)))
    limit = most[np.searchsorted(own, part >> 1)]
    keep = np.arange(len(later)) - np.repeat(at, count) < np.repeat(limit, count)
    more = np.where(cut, ALL, 0)
    np.maximum.at(more, part[count > limit] >> 1, np.where(part[count > limit] & 1, SAME, ALL))
    none = np.setdiff1d(np.flatnonzero(cut), own)  # nothing found yet in a group that is not whole
    ids = np.concatenate([later[keep], none])
    return lid[ids], np.concatenate([lid[earlier[keep]], np.zeros(len(none), dtype=np.int64)]), np.concatenate([apart[keep], np.full(len(none), -1)]), more[ids]


CANDIDATE_SCHEMA = "later long, earlier long, apart int, more int"


def _dealt_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _candidates(_in_order(batches))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of KEYS_SCHEMA, those of a key one after another -> candidates; memory is bounded whatever a key holds."""
    held: list[tuple[np.ndarray, ...]] = []
    n_held, broken = 0, None

    def work(rows: tuple[np.ndarray, ...], open_end: bool) -> tuple[pa.RecordBatch, tuple[np.ndarray, ...], int | None]:
        key, lid, sketch, half = rows
        group = key >> np.uint64(KEY_SHIFT)
        last = int(group[-1])
        end = len(group)
        if open_end:
            others = np.flatnonzero(group != group[-1])
            end = int(others[-1]) + 1 if len(others) else 0
        cut_key = None
        if end == 0:  # one key fills the bag: work it as far as it came
            end, cut_key = len(group), last
        g = group[:end]
        flag = (key[:end] >> np.uint64(PLACE_BITS + SIZE_BITS) & np.uint64(1)).astype(bool)
        at = runs(g)
        sizes = np.diff(np.append(at, end))
        cut = np.isin(g[at], [x for x in (broken, cut_key) if x is not None]) | np.logical_or.reduceat(flag, at)
        # a line alone under a key that is whole has no candidates there
        some = np.flatnonzero(np.repeat((sizes > 1) | cut, sizes))
        found = group_candidates(np.repeat(np.arange(len(at)), sizes)[some], key[some], lid[some], sketch[some], half[some], np.repeat(cut, sizes)[some])
        out = pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1]), pa.array(found[2], pa.int32()), pa.array(found[3], pa.int32())], ["later", "earlier", "apart", "more"])
        return out, (key[end:], lid[end:], sketch[end:], half[end:]), cut_key

    for batch in batches:
        held.append((np.asarray(batch.column(0)).view(np.uint64), np.asarray(batch.column(1)), np.asarray(batch.column(2)).view(np.uint64), np.asarray(batch.column(3)).view(np.uint64)))
        n_held += batch.num_rows
        if n_held >= BAG:
            out, rest, broken = work(tuple(np.concatenate(c) for c in zip(*held, strict=True)), True)
            held, n_held = [rest], len(rest[0])
            yield out
    if n_held:
        yield work(tuple(np.concatenate(c) for c in zip(*held, strict=True)), False)[0]


# ---------------------------------------------------------------- verification

def similar(a: bytes, b: bytes) -> bool:
    x, y = np.frombuffer(a, dtype="<u8"), np.frombuffer(b, dtype="<u8")
    return len(np.intersect1d(x, y, assume_unique=True)) * (NUM + DEN) >= NUM * (len(x) + len(y))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with both lines' words: LINE of the later line of each similar pair."""
    for batch in batches:
        keep = [k for k, (a, b) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)) if similar(a, b)]
        yield pa.RecordBatch.from_arrays([batch.column(n).take(pa.array(keep, pa.int64())) for n in range(2)], LINE)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (later, later2, earlier, earlier2), texts (LINE, words) -> LINE of the later line of every similar pair."""
    one, two = (texts.select(F.col("lid").alias(a), F.col("lid2").alias(f"{a}2"), F.col("words").alias(f"{a}_words")) for a in ("later", "earlier"))
    both = pairs.join(one, ["later", "later2"]).join(two, ["earlier", "earlier2"])
    return both.select("later", "later2", "later_words", "earlier_words").mapInArrow(_verify, "lid long, lid2 long").distinct()


def texts_of(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """texts without the lines that no pair names, where few are named: their words need not move."""
    lids = pairs.select(F.explode(F.array("later", "earlier")).alias("lid")).distinct()
    return texts.join(F.broadcast(lids), "lid", "left_semi").select(texts.columns) if lids.count() <= SENT_IDS else texts


def _texts(batches: Iterator[pa.RecordBatch], least: int, places: tuple[np.ndarray, ...] | None, marks: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """LINE, ORD and words of lines; of those at the places (document, number, lid; sorted) alone, where these are few enough to be sent along, else of those with marks."""
    for batch in batches:
        for part, texts in chunks(batch, 2):
            number = None
            if places is not None:
                docs = place_hashes(np.asarray(part.column(0).fill_null(0)), np.asarray(part.column(1)), np.asarray(part.column(0).is_null()))
                low, high = (np.searchsorted(places[0], docs, side=x) for x in ("left", "right"))
                number = np.concatenate([places[1][a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]) if len(docs) else places[1][:0]
                # these lines alone, as a text of its own for each document; numbers beyond a text's end are of another document of equal hash
                texts = [pick(texts[k].as_py() or "", places[1][a:b].tolist()) if a < b else "" for k, (a, b) in enumerate(zip(low.tolist(), high.tolist(), strict=True))]
            own = lines_of(texts, least=max(least, KEYED))
            lid, lid2 = own.ids()
            if number is None:
                hit = np.flatnonzero(marked(lid, marks))
            else:
                hit = np.flatnonzero(places[2][np.minimum(low[own.text] + own.number, len(places[2]) - 1)] == lid) if len(lid) else np.zeros(0, dtype=np.int64)
                first = np.concatenate([[0], np.cumsum(high - low)[:-1]])
                own.number = number[np.minimum(first[own.text] + own.number, len(number) - 1)] if len(own.number) else own.number
            own, lid, lid2 = own.take(hit), lid[hit], lid2[hit]
            data, ends = own.words.tobytes(), np.cumsum(own.sizes) * 8
            rows = pa.array(own.text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(lid), pa.array(lid2), part.column(0).take(rows), part.column(1).take(rows), pa.array(own.number, pa.int32()), pa.array([data[e - 8 * n:e] for e, n in zip(ends.tolist(), own.sizes.tolist(), strict=True)], pa.binary())], [*LINE, *ORD, "words"]
            )


def pick(text: str, numbers: list[int]) -> str:
    if not numbers:
        return ""
    lines = text.split("\n")
    return "\n".join(lines[n] if n < len(lines) else "" for n in numbers)


def place_hashes(ids: np.ndarray, keys: np.ndarray, null: np.ndarray) -> np.ndarray:
    return mixed(mixed(ids.astype(np.int64).view(np.uint64), M2) ^ keys.astype(np.int64).view(np.uint64), M3 + null.astype(np.uint64))


def slots(lid: np.ndarray) -> tuple[np.ndarray, ...]:
    """Two bits of 1 << MARK_BITS that mark a line."""
    own = lid.view(np.uint64) & np.uint64((1 << SHORT_BITS) - 1)
    return tuple((mixed(own, salt) & np.uint64((1 << MARK_BITS) - 1)).astype(np.int64) for salt in (M2, M3))


def marked(lid: np.ndarray, marks: np.ndarray) -> np.ndarray:
    one, two = slots(lid)
    return ((marks[one >> 3] >> (one & 7)) & (marks[two >> 3] >> (two & 7)) & 1).astype(bool)


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The marks of some lines, in rows of CELLS_A_ROW bytes."""
    marks = np.zeros(1 << MARK_BITS >> 3, dtype=np.uint8)
    for batch in batches:
        for own in slots(np.asarray(batch.column(0))):
            for bit in range(8):
                marks[own[own & 7 == bit] >> 3] |= np.uint8(1 << bit)
    rows = marks.reshape(-1, CELLS_A_ROW)
    used = np.flatnonzero(rows.any(axis=1))
    for lo in range(0, len(used), 256):
        yield pa.RecordBatch.from_arrays([pa.array(used[lo:lo + 256], pa.int32()), pa.array([rows[k].tobytes() for k in used[lo:lo + 256]], pa.binary())], ["part", "cells"])


def _either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, cells in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = np.frombuffer(cells.as_buffer(), dtype=np.uint8)
            total[part] = total[part] | own if part in total else own
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["part", "cells"])


def marks_of(lids: DataFrame) -> np.ndarray:
    """Marks of all lines named in lids (lid): of other lines few have both bits, while lids are fewer than a tenth of the bits."""
    shares = max(1, int(lids.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = np.zeros(((1 << MARK_BITS) // 8 // CELLS_A_ROW, CELLS_A_ROW), dtype=np.uint8)
    # at most 1 << MARK_BITS bits reach the driver
    for part, cells in lids.select("lid").mapInArrow(_mark, "part int, cells binary").repartition(shares, "part").mapInArrow(_either, "part int, cells binary").collect():
        out[part] = np.frombuffer(cells, dtype=np.uint8)
    return out.reshape(-1)


def line_texts(rows: DataFrame, lines: DataFrame, lids: DataFrame, least: int) -> DataFrame:
    """LINE, first (the ORD of the first such line) and words (sorted hashes) of the lines named in lids (lid, short)."""
    n = lids.count()
    asked = lids.select(F.col("lid").alias("short"))
    first = stored(lines.withColumn("short", short("lid")).join(F.broadcast(asked) if n <= SENT_IDS else asked, "short", "left_semi").groupBy(*LINE).agg(F.min(F.struct(*ORD)).alias("first")), "firsts")
    few = marks = None
    if n > SENT_IDS:
        marks = marks_of(lids)
    else:
        table = first.select("first.*", "lid").toArrow()
        doc = place_hashes(np.asarray(table.column(0).fill_null(0)), np.asarray(table.column(1)), np.asarray(table.column(0).is_null()))
        number = np.asarray(table.column(2), dtype=np.int64)
        order = np.lexsort((number, doc))
        few = doc[order], number[order], np.asarray(table.column(3), dtype=np.int64)[order]
    texts = rows.mapInArrow(partial(_texts, least=least, places=few, marks=marks), "lid long, lid2 long, doc_id long, doc_key long, line_no int, words binary")
    own = texts.select(*LINE, F.struct(*ORD).alias("first"), "words")
    if few is None:
        own = own.join(first.withColumnRenamed("first", "least"), LINE).where(F.col("first").eqNullSafe(F.col("least")))
    # one row for each line, however often its document is repeated
    words = own.dropDuplicates(LINE)
    return stored(words.select(*LINE, "first", "words"), "line-words")


def directed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (later, earlier, apart) of short lids -> later, later2, earlier, earlier2, apart (LINE) of those that stand so in the order of lines."""
    one, two = (texts.select(short("lid").alias(a), F.col("lid").alias(f"{a}_lid"), F.col("lid2").alias(f"{a}2"), F.col("first").alias(f"{a}_first")) for a in ("later", "earlier"))
    both = pairs.join(one, "later").join(two, "earlier").where(F.col("earlier_first") < F.col("later_first"))
    return both.select(F.col("later_lid").alias("later"), "later2", F.col("earlier_lid").alias("earlier"), "earlier2", "apart")


# ---------------------------------------------------------------- operator

def early_edges(rows: DataFrame) -> np.ndarray:
    """Document ids that cut the corpus into at most 255 parts of about equal size."""
    edges = rows.where("doc_id is not null").agg(F.percentile_approx("doc_id", F.array(*(F.lit(k / (1 << EARLY_BITS)) for k in range(1, (1 << EARLY_BITS) - 1))), F.lit(2000))).first()[0]
    return np.unique(np.array(edges or [], dtype=np.int64))


def key_rows(rows: DataFrame, ranks: np.ndarray, least: int, edges: np.ndarray, salt: bool, lids: np.ndarray | None = None, groups: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    return rows.select("doc_id", "text").mapInArrow(partial(_keys, ranks=ranks, least=least, edges=edges, salt=salt, lids=lids, groups=groups), KEYS_SCHEMA)


@dataclass
class Asked:
    """Lines to be compared with all others: identities, places in the order of lines, words; and by which words they are found."""

    ids: list[tuple[int, int]]
    first: list[tuple]
    words: list[np.ndarray]
    counts: InitVar[np.ndarray]

    def __post_init__(self, counts: np.ndarray) -> None:
        # whatever is similar to n words has at least ceil(0.8 n) of them, and so one of the n - ceil(0.8 n) + 1 rarest
        rarest = (w[np.argsort(counts[(w & np.uint64(len(counts) - 1)).astype(np.int64)], kind="stable")] for w in self.words)
        prefix = [w[: len(w) - -(-NUM * len(w) // DEN) + 1] for w in rarest]
        self.flat = np.concatenate([np.zeros(0, dtype=np.uint64), *prefix])
        self.of = np.repeat(np.arange(len(prefix)), [len(p) for p in prefix])
        order = np.argsort(self.flat, kind="stable")
        self.flat, self.of = self.flat[order], self.of[order]
        self.some = np.zeros(1 << 20, dtype=bool)
        self.some[(self.flat >> np.uint64(44)).astype(np.int64)] = True


def in_order(first: tuple) -> tuple:
    return first[0] is not None, first[0] or 0, first[1], first[2]


def _compared(batches: Iterator[pa.RecordBatch], least: int, asked: Asked, edges: np.ndarray, early: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """LINE of the lines asked for that some earlier line of these rows is similar to; of documents as early as given alone, where that is enough."""
    found: set[int] = set()
    for batch in batches:
        if early is not None:
            batch = batch.filter(pa.array(np.isin(earliness(np.asarray(batch.column(0).fill_null(np.iinfo(np.int64).min)), edges), early)))
        for part, texts in chunks(batch, 2):
            own = lines_of(texts, least=max(least, KEYED), some=asked.some)
            hit = np.flatnonzero(asked.some[(own.words >> np.uint64(44)).astype(np.int64)])
            low, high = (np.searchsorted(asked.flat, own.words[hit], side=x) for x in ("left", "right"))
            line = np.repeat(np.arange(len(own.sizes)), own.sizes)[hit]
            n = high - low
            at = np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            pairs = np.unique(np.repeat(line, n) * len(asked.ids) + asked.of[at])
            starts, docs, keys = own.first, part.column(0), part.column(1)
            for i, a in zip((pairs // len(asked.ids)).tolist(), (pairs % len(asked.ids)).tolist(), strict=True):
                mine, size = asked.words[a], int(own.sizes[i])
                if a in found or size * DEN < len(mine) * NUM or len(mine) * DEN < size * NUM:
                    continue
                k = int(own.text[i])
                if in_order((docs[k].as_py(), keys[k].as_py(), int(own.number[i]))) < in_order(asked.first[a]):
                    both = len(np.intersect1d(own.words[starts[i]:starts[i] + size], mine, assume_unique=True))
                    if both * (NUM + DEN) >= NUM * (size + len(mine)):
                        found.add(a)
    lines = [asked.ids[a] for a in sorted(found)]
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in lines], pa.int64()) for k in range(2)], LINE)


def _field(c: Column, shift: int, most: int) -> Column:
    return F.shiftrightunsigned(c, shift).bitwiseAND(F.lit(most))


def looked_up(rows: DataFrame, left: DataFrame, ranks: np.ndarray, least: int, edges: np.ndarray) -> DataFrame:
    """All candidates (later, earlier, apart; short lids) of the lines in left (lid), under all of their keys."""
    grouped = lambda keys: keys.withColumns({"group": F.shiftrightunsigned("key", KEY_SHIFT), "early": F.shiftrightunsigned("sketch", SKETCH_BITS) * F.lit(1 << EARLY_BITS) + F.shiftrightunsigned("half", SKETCH_BITS)})
    lids = np.sort(np.asarray(left.toArrow().column(0), dtype=np.int64)) if left.count() <= SENT_IDS else None
    own = key_rows(rows, ranks, least, edges, salt=False, lids=lids)
    own = stored(grouped(own if lids is not None else own.join(left, "lid", "left_semi")).distinct(), "keys-again")
    asked = own.groupBy("group").agg(F.max("early").alias("upto")).orderBy("group")
    if asked.count() <= SENT_IDS:
        # the lines in question are few: with their keys sent along, hardly a row of the others has to move
        table = asked.toArrow()
        groups = tuple(np.asarray(table.column(k), dtype=np.int64) for k in range(2))
        others = grouped(key_rows(rows, ranks, least, edges, salt=False, groups=groups))
    else:
        others = grouped(key_rows(rows, ranks, least, edges, salt=False)).join(asked, "group").where("early <= upto").drop("upto")
    a, b = (x.select("group", *(F.col(c).alias(f"{c}_{y}") for c in ("key", "lid", "sketch", "half", "early"))) for x, y in ((own, "a"), (others.distinct(), "b")))
    (n, p, s, h), (m, q, t, g) = ((_field(F.col(f"key_{x}"), 0, MOST_SIZE), _field(F.col(f"key_{x}"), SIZE_BITS, MOST_PLACE), F.col(f"sketch_{x}"), F.col(f"half_{x}")) for x in "ab")
    mask = F.lit((1 << SKETCH_BITS) - 1)
    other = F.when((n >= SPLIT) & (m >= SPLIT), h.bitwiseXOR(g).bitwiseAND(mask)).otherwise(F.lit(0).cast("long"))
    apart = F.bit_count(s.bitwiseXOR(t).bitwiseAND(mask).bitwiseXOR(other)) + F.bit_count(other)
    overlap = F.ceil(NUM * (n + m) / (NUM + DEN))
    fits = (n == MOST_SIZE) | (m == MOST_SIZE) | ((p <= n - overlap) & (q <= m - overlap) & (apart * (NUM + DEN) <= (n + m) * (DEN - NUM)))
    lengths = ((n * DEN >= m * NUM) | (m == MOST_SIZE)) & ((m * DEN >= n * NUM) | (n == MOST_SIZE))
    both = a.join(b, "group").where((F.col("lid_a") != F.col("lid_b")) & lengths & fits & (F.col("early_b") <= F.col("early_a")))
    return both.groupBy(short("lid_a").alias("later"), short("lid_b").alias("earlier")).agg(F.min(apart).alias("apart"))


def similar_later(rows: DataFrame, lines: DataFrame, counts: np.ndarray, least: int, n_bytes: int) -> DataFrame:
    """LINE of every set of words that is similar to another one that comes first."""
    edges, ranks = early_edges(rows), rarity(counts)
    shares = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = max(shares, -(-n_bytes // BYTES_A_PART))
    keyed = rows.select("doc_id", "text").mapInArrow(partial(_deal, parts=parts, ranks=ranks, least=least, edges=edges, salt=True), DEALT_SCHEMA).repartitionById(parts, "part")
    found = stored(keyed.mapInArrow(_dealt_candidates, CANDIDATE_SCHEMA), "candidates")
    pairs = found.where("apart >= 0").groupBy("later", "earlier").agg(F.min("apart").alias("apart"))
    lids = found.select(F.explode(F.when(F.col("apart") >= 0, F.array("later", "earlier")).otherwise(F.array("later"))).alias("lid")).distinct()
    texts = line_texts(rows, lines, stored(lids, "suspects"), least)
    pairs = stored(directed(pairs, texts), "pairs")
    closest = pairs.groupBy("later", "later2").agg(F.min(F.struct("apart", "earlier", "earlier2")).alias("x")).select("later", "later2", "x.earlier", "x.earlier2")
    sure = stored(verified(closest, texts), "later-lines")
    known = sure.select(F.col("lid").alias("later"), F.col("lid2").alias("later2"))
    rest = stored(pairs.join(known, ["later", "later2"], "left_anti").join(closest, ["later", "later2", "earlier", "earlier2"], "left_anti"), "rest")
    sure = stored(sure.unionByName(verified(rest, texts_of(rest, texts))), "later-lines")
    open_ = found.where("more > 0").groupBy(F.col("later").alias("short")).agg(F.max("more").alias("more"))
    # names alone move to find the lines that are left
    names = stored(texts.select(*LINE, short("lid").alias("short")).join(open_, "short").join(sure, LINE, "left_anti").drop("short"), "left-names")
    left = stored(texts.join(F.broadcast(names) if names.count() <= SENT_IDS else names, LINE), "left")
    n, n_bytes, widest = left.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("words")), F.lit(0)), F.max("more")).first()
    if not n:
        return sure
    if n_bytes <= SENT_BYTES:
        few = left.toArrow()
        asked = Asked(list(zip(few.column("lid").to_pylist(), few.column("lid2").to_pylist(), strict=True)), [tuple(x.values()) for x in few.column("first").to_pylist()], [np.frombuffer(w, dtype="<u8") for w in few.column("words").to_pylist()], counts)
        early = None if widest == ALL else np.unique(earliness(np.array([np.iinfo(np.int64).min if f[0] is None else f[0] for f in asked.first], dtype=np.int64), edges))
        compared = rows.mapInArrow(partial(_compared, least=least, asked=asked, edges=edges, early=early), "lid long, lid2 long")
        return stored(sure.unionByName(compared).distinct(), "later-lines")
    again = stored(looked_up(rows, left.select("lid"), ranks, least, edges), "candidates-again")
    texts = line_texts(rows, lines, stored(again.select(F.explode(F.array("later", "earlier")).alias("lid")).distinct(), "suspects"), least)
    return stored(sure.unionByName(verified(directed(again, texts), texts)).distinct(), "later-lines")


#: A line as it is dealt out: GONE (copy of an earlier one), NAMED in line_no (all lines of these words go).
LINE_ROW = np.dtype([("lid", "<i8"), ("lid2", "<i8"), ("no_id", "?"), ("gone", "?"), ("doc_id", "<i8"), ("doc_key", "<i8"), ("line_no", "<i4")])
NAMED = -1


def copies(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are lines that go, as far as these rows tell: those of words that are named, and all but the first of equal words; and which say nothing more of others."""
    gone, spare = np.zeros(len(rows), dtype=bool), np.zeros(len(rows), dtype=bool)
    order = np.argsort(rows["lid"])
    at = runs(rows["lid"][order])
    sizes = np.diff(np.append(at, len(rows)))
    some = order[np.repeat(sizes > 1, sizes)]
    # null ids come first, and what names words before all lines
    own = rows[some]
    some = some[np.lexsort((own["line_no"], own["doc_key"], own["doc_id"], ~own["no_id"], own["line_no"] != NAMED, own["lid2"], own["lid"]))]
    own = rows[some]
    new = (own["lid"][1:] != own["lid"][:-1]) | (own["lid2"][1:] != own["lid2"][:-1])
    at = np.flatnonzero(np.concatenate([[True], new])) if len(own) else np.zeros(0, dtype=np.int64)
    first = own[np.repeat(at, np.diff(np.append(at, len(own))))]
    other = np.logical_or.reduce([own[c] != first[c] for c in ("no_id", "doc_id", "doc_key", "line_no")]) if len(own) else np.zeros(0, dtype=bool)
    gone[some] = other
    spare[some] = ~other
    spare[some[at]] = False  # the same row again
    return gone, spare


def _deal_lines(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """LINE and ORD of lines (NAMED: of words whose lines all go) -> rows of LINE_ROW, dealt out by their words; what is gone already, by its document.

    So a task sends a line that is repeated once to where its words are worked, for all lines that it deals at once.
    """
    def deal(rows: np.ndarray) -> pa.RecordBatch:
        gone, spare = copies(rows)
        rows["gone"] = gone
        rows, gone = rows[~spare], gone[~spare]
        where = np.where(gone, place_hashes(rows["doc_id"], rows["doc_key"], rows["no_id"]), rows["lid"].astype(np.uint64))
        part = (mixed(where, M2) % np.uint64(parts)).astype(np.int32)
        order = by_part(part, parts)
        part, rows = part[order], rows[order]
        at = runs(part)
        data = [rows[a:b].tobytes() for a, b in zip(at.tolist(), [*at[1:].tolist(), len(rows)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(part[at], pa.int32()), pa.array(data, pa.binary())], ["part", "data"])

    held: list[np.ndarray] = []
    for batch in batches:
        doc_id, doc_key, line_no, lid, lid2 = batch.columns
        rows = np.zeros(batch.num_rows, dtype=LINE_ROW)
        rows["no_id"], rows["doc_id"] = np.asarray(doc_id.is_null()), np.asarray(doc_id.fill_null(0))
        rows["doc_key"], rows["line_no"], rows["lid"], rows["lid2"] = (np.asarray(c) for c in (doc_key, line_no, lid, lid2))
        held.append(rows)
        if sum(map(len, held)) >= DEALT:
            yield deal(np.concatenate(held))
            held = []
    if held:
        yield deal(np.concatenate(held))


def _gone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines that go, of all rows dealt to one part."""
    data = [x.as_buffer() for batch in batches for x in batch.column(1)]
    rows = np.concatenate([np.zeros(0, dtype=LINE_ROW), *(np.frombuffer(x, dtype=LINE_ROW) for x in data)])
    open_ = rows[~rows["gone"]]
    for own in (rows[rows["gone"]], open_[copies(open_)[0]]):
        for lo in range(0, len(own), 100_000):
            some = own[lo:lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(some[c])) for c in ("no_id", "doc_id", "doc_key", "line_no")], ["no_id", "id", "doc_key", "line_no"])


def removed_lines(docs: DataFrame, min_words: int = 1) -> DataFrame:
    """docs (doc_id, text) -> doc_id, doc_key (content hash), removed: sorted numbers of the lines that go; only rows that lose some."""
    return _judge(docs, min_words)[1]


def line_report(docs: DataFrame, min_words: int = 1) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_lines, removed (null: none) of every row; the texts are not read again for it."""
    own, gone = _judge(docs, min_words)
    both = own.alias("d").join(gone.alias("g"), F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.doc_key") == F.col("g.doc_key")), "left")
    return both.select("d.doc_id", "n_lines", "removed")


def _judge(docs: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, doc_key, n_lines of every row, and what `removed_lines` gives."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("doc_key"), F.col("text").cast("string").alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << int(n_bytes // BYTES_A_CELL).bit_length()))
    lines = stored(rows.mapInArrow(partial(_lines, least=min_words, n_cells=n_cells), LINES_SCHEMA), "lines")
    held = lines.where("lid is not null").select(*ORD, *LINE)
    later = similar_later(rows, held, word_counts(lines, n_cells), min_words, n_bytes)
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // BYTES_A_PART))
    named = later.select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("doc_key"), F.lit(NAMED).alias("line_no"), *LINE)
    rows_of_lines = held.unionByName(named).mapInArrow(partial(_deal_lines, parts=parts), DEALT_SCHEMA).repartitionById(parts, "part")
    gone = rows_of_lines.mapInArrow(_gone, "no_id boolean, id long, doc_key long, line_no int")
    removed = gone.groupBy("no_id", "id", "doc_key").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))
    own = lines.where("n_lines is not null").select("doc_id", "doc_key", "n_lines")
    return own, removed.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "doc_key", "removed")


def judged(docs: DataFrame, min_words: int = 1) -> tuple[DataFrame, Column]:
    """Every row and column of docs, by position and with names of its own (c0, c1, ...), and the column of removed line numbers (null: none)."""
    at = {name: f"c{k}" for k, name in enumerate(docs.columns)}
    plain = docs.toDF(*at.values())
    own = plain.select(F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text"))
    gone = stored(removed_lines(own, min_words), "removed").select(F.col("doc_id").alias("gone_id"), F.col("doc_key").alias("gone_key"), "removed")
    # short lists go to where the texts lie; longer ones meet them in a shuffle
    n_docs, n_lines = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("removed")), F.lit(0))).first()
    if n_docs <= BROADCAST_DOCS and n_lines <= BROADCAST_LINES:
        gone = F.broadcast(gone)
    on = F.col(at["doc_id"]).cast("long").eqNullSafe(F.col("gone_id")) & (F.xxhash64(at["text"]) == F.col("gone_key"))
    return plain.join(gone, on, "left"), F.col("removed")


def dedup_lines(docs: DataFrame, min_words: int = 1) -> DataFrame:
    """docs without repeated lines: the columns of docs, with `text` rebuilt from the lines that stay."""
    rows, removed = judged(docs, min_words)
    text = F.col(f"c{docs.columns.index('text')}")
    kept = F.filter(F.split(text, "\n", -1), lambda x, k: ~F.array_contains(removed, k))
    rebuilt = F.when(removed.isNotNull(), F.concat_ws("\n", kept)).otherwise(text)
    return rows.select(*(rebuilt.alias(name) if name == "text" else F.col(f"c{k}").alias(name) for k, name in enumerate(docs.columns)))
