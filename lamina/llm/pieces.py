"""Whole-text tokenisation with a per-worker memo of pieces, looked up for all words of many texts at once.

Texts are cut where their pre-tokeniser always cuts: at white space, and before a few ASCII symbols
that end a word after a plain or Latin-1 letter. Equal pieces then have equal ids wherever they stand, so each
worker asks the tokenizers library once per distinct piece, known by 128 bits of hash. Texts in which
a cut could change the result go to the library whole. The memo is bounded and holds only public
vocabulary ids, never documents.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from lamina.llm.words import M2, M3, PADDING, spread, word_hashes

#: Pieces after which a worker's memo starts again (about 100 MB).
MEMO_LIMIT = 1_000_000
#: Characters of text that are worked at once.
CHUNK = 1 << 20

_ODD_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_END, _SPACE = 0xFF, 0x20  # the end byte is no part of any UTF-8 text


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: 0x100 + n for n, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()


def byte_letters(word: str) -> str:
    if word.isascii() and word.isalpha():
        return word
    return word.encode().decode("latin-1").translate(_BYTE_LETTERS)


def whole_only(text: str, word_ends: bool) -> bool:
    """Whether only the whole text gives the right ids: it may hold special strings, or white space of other kinds."""
    return "<|" in text or (not word_ends and not text.isascii() and _ODD_SPACE.search(text) is not None)


def _table(members: list[int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[members] = True
    return out


_SPACES = {True: _table([10, _SPACE]), False: _table([*range(9, 14), _SPACE])}
_LETTERS = _table([*range(65, 91), *range(97, 123)])
#: All symbols of one byte but the apostrophe, which may begin a contraction; second bytes of letters whose first is 0xC3; symbols up to which the end of a word is cut off.
_SYMBOLS = _table([x for x in range(33, 127) if not chr(x).isalnum() and x != 0x27])
_LATIN, MOST_SYMBOLS = _table([x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]), 8


def cut(buf: np.ndarray, word_ends: bool, with_space: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the pieces of texts that each end with an end byte, in order; with_space: all white space goes with the word after it."""
    space = _SPACES[word_ends][buf]
    word = ~space & (buf != _END)
    starts = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
    ends = np.flatnonzero(~word & np.concatenate([[False], word[:-1]]))
    tail = np.zeros(len(ends), dtype=np.int64)
    live = np.arange(len(ends))
    for k in range(MOST_SYMBOLS):
        live = live[(ends[live] - k > starts[live]) & _SYMBOLS[buf[ends[live] - 1 - k]]]
        tail[live] += 1
    before = ends - tail - 1
    letter = _LETTERS[buf[before]] | ((before > starts) & (buf[before - 1] == 0xC3) & _LATIN[buf[before]])
    tail = np.where((before >= starts) & letter, tail, 0)
    ends = ends - tail
    parts = [(ends[tail > 0], tail[tail > 0])]
    if word_ends:
        parts.append((starts, ends - starts))
    elif with_space:
        first = np.flatnonzero(space & ~np.concatenate([[False], space[:-1]]))
        after = np.flatnonzero(~space & np.concatenate([[False], space[:-1]]))
        before_word = word[after]
        begin = starts.copy()
        begin[np.searchsorted(starts, after[before_word])] = first[before_word]
        parts.append((begin, ends - begin))
        parts.append((first[~before_word], (after - first)[~before_word]))
    else:
        # one space goes with the word after it; the last character of other white space before a word stands alone
        lead = (starts > 0) & (buf[starts - 1] == _SPACE)
        parts.append((starts - lead, ends - starts + lead))
        first = np.flatnonzero(space & ~np.concatenate([[False], space[:-1]]))
        after = np.flatnonzero(~space & np.concatenate([[False], space[:-1]]))
        before_word = word[after]
        alone = before_word & (buf[after - 1] != _SPACE)
        parts.append((after[alone] - 1, np.ones(int(alone.sum()), dtype=np.int64)))
        rest = after - before_word - first
        parts.append((first[rest > 0], rest[rest > 0]))
    starts, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(starts, kind="stable")
    return starts[order], sizes[order]


class TooMany(Exception):
    """A run of texts has more different pieces than the memo holds."""


class PieceTable:
    """hash -> numbers of a piece, in a table of open addresses that is read for many pieces at once."""

    def __init__(self, limit: int = MEMO_LIMIT):
        self.limit, self.slots = limit, 1 << (4 * limit - 1).bit_length()
        self.clear()

    def clear(self) -> None:
        self.at = np.full(self.slots, -1, dtype=np.int32)
        self.hashes = np.zeros((self.limit, 2), dtype=np.uint64)
        self.first, self.size = np.zeros(self.limit, dtype=np.int64), np.zeros(self.limit, dtype=np.int32)
        self.pool, self.used, self.held = np.zeros(1 << 20, dtype="<u4"), 0, 0
        self.again = np.zeros(self.limit, dtype=bool)

    def make_room(self, n: int) -> None:
        """Keep the pieces that were found again, if that leaves room for n others."""
        keep = np.flatnonzero(self.again[:self.held])
        hashes, sizes = self.hashes[keep], self.size[keep].astype(np.int64)
        flat = self.pool[spread(self.first[keep], sizes)]
        self.clear()
        if len(keep) <= min(self.limit - n, self.limit // 2):
            self._put(hashes, flat, sizes)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Entries of (n, 2) hashes; -1: none."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        left, slot = np.arange(len(hashes)), (hashes[:, 0] & np.uint64(self.slots - 1)).astype(np.int64)
        while len(left):
            entry = self.at[slot]
            there = entry >= 0
            left, slot, entry = left[there], slot[there], entry[there]
            equal = (self.hashes[entry, 0] == hashes[left, 0]) & (self.hashes[entry, 1] == hashes[left, 1])
            out[left[equal]] = entry[equal]
            left, slot = left[~equal], (slot[~equal] + 1) & (self.slots - 1)
        return out

    def add(self, hashes: np.ndarray, numbers: list[np.ndarray]) -> None:
        """Add pieces that are not there yet, each once."""
        sizes = np.array([len(x) for x in numbers], dtype=np.int64)
        self._put(hashes, np.concatenate(numbers) if numbers else np.zeros(0, dtype="<u4"), sizes)

    def _put(self, hashes: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used:self.used + len(flat)] = flat
        entries = np.arange(self.held, self.held + len(sizes))
        self.hashes[entries], self.size[entries] = hashes, sizes
        self.first[entries] = self.used + np.cumsum(sizes) - sizes
        self.used, self.held = self.used + len(flat), self.held + len(sizes)
        slot = (hashes[:, 0] & np.uint64(self.slots - 1)).astype(np.int64)
        while len(entries):
            free = self.at[slot] < 0
            self.at[slot[free]] = entries[free]
            put = self.at[slot] == entries
            entries, slot = entries[~put], (slot[~put] + 1) & (self.slots - 1)


class Pieces:
    """Numbers (ids, say) of whole texts, put together from those of their pieces; running: each piece's count on from the last ones before it."""

    def __init__(self, word_ends: bool, of_piece: Callable[[str], np.ndarray], of_text: Callable[[str], np.ndarray], with_space: bool = False, running: bool = False):
        self.word_ends, self.of_piece, self.of_text, self.with_space, self.running, self.table = word_ends, of_piece, of_text, with_space, running, PieceTable()

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Entries of all pieces of some texts, and how many of them each text has."""
        data = b"".join(x.encode() + b"\xff" for x in texts)
        buf = np.frombuffer(data + b"\0" * PADDING, dtype=np.uint8)
        if self.word_ends:  # the vocabulary drops case, so pieces may as well
            upper = (buf >= 65) & (buf <= 90)
            buf = buf + (upper * 32).astype(np.uint8)
        body = buf[:len(data)]
        starts, sizes = cut(body, self.word_ends, self.with_space)
        hashes = np.column_stack([word_hashes(buf, starts, sizes, salt) for salt in (M2, M3)])
        entries = self.table.find(hashes)
        self.table.again[entries[entries >= 0]] = True
        missing = np.flatnonzero(entries < 0)
        if len(missing):
            _, at = np.unique(hashes[missing], axis=0, return_index=True) if len(missing) < 64 else np.unique(hashes[missing, 0] ^ hashes[missing, 1], return_index=True)
            new = missing[at]
            if self.table.held + len(new) > self.table.limit:
                if len(new) > self.table.limit:
                    raise TooMany
                self.table.make_room(len(new))
                return self.pieces(texts)
            raw = buf.tobytes()
            self.table.add(hashes[new], [self.of_piece(raw[s:s + n].decode()) for s, n in zip(starts[new].tolist(), sizes[new].tolist(), strict=True)])
            entries = self.table.find(hashes)
        ends = np.searchsorted(starts, np.flatnonzero(body == _END))
        return entries, np.diff(ends, prepend=0)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All numbers of some texts, and how many each has."""
        try:
            return self._encode(texts)
        except TooMany:  # one run holds more different pieces than the memo: take texts by themselves, and a single one whole
            parts = [self.of_text(x) if len(texts) == 1 else self.encode([x])[0] for x in texts]
            return np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole = [whole_only(x, self.word_ends) for x in texts]
        entries, n = self.pieces([("" if w else x) for x, w in zip(texts, whole, strict=True)])
        sizes = self.table.size[entries].astype(np.int64)
        flat = self.table.pool[spread(self.table.first[entries], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(n)]
        if self.running and len(entries):
            last = self.table.pool[self.table.first[entries] + sizes - 1].astype(np.int64)
            upto = np.concatenate([[0], np.cumsum(last)])
            flat = flat + np.repeat(upto[:-1] - np.repeat(upto[np.cumsum(n) - n], n), sizes)
        counts = np.diff(ends, prepend=0)
        if any(whole):
            parts = [self.of_text(x) if w else flat[e - c:e] for x, w, e, c in zip(texts, whole, ends.tolist(), counts.tolist(), strict=True)]
            flat, counts = np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64)
        return flat, counts


def runs(texts: list[str]) -> list[tuple[int, int]]:
    """(from, to) of runs of texts of about CHUNK characters."""
    out, lo, held = [], 0, 0
    for k, x in enumerate(texts):
        held += len(x)
        if held >= CHUNK or k + 1 == len(texts):
            out.append((lo, k + 1))
            lo, held = k + 1, 0
    return out


class PieceIds(Pieces):
    """Ids of whole texts as unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        # a vocabulary with a word-end mark drops white space and case; the byte-level one keeps both
        super().__init__(bool(self.model.end_of_word_suffix), self.piece, self.library)

    def library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def piece(self, piece: str) -> np.ndarray:
        body = piece[1:] if piece[0] == " " else piece
        # a word of letters alone is one pre-token, which the model itself takes; not where lower-casing could add marks, as it does for no Latin-1 letter
        if not body.isalpha() or not (body.isascii() or max(body) < ("Ā" if self.word_ends else "ɐ")):
            return self.library(piece)
        return np.array([t.id for t in self.model.tokenize(byte_letters(piece.lower() if self.word_ends else piece))], dtype="<u4")


@lru_cache(maxsize=4)
def piece_ids(path: str) -> PieceIds:
    """One memo per worker process and vocabulary file."""
    return PieceIds(path)
