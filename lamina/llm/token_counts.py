"""Operator 4: exact token counts at every prefix, by dynamic programming over prefixes.

For a piece of pre-tokenised text, last[i] is the last token of the encoding of its first i bytes
and count[i] = count[i - len(last[i])] + 1. A vocabulary token t that ends at i is that last token
exactly if the merge rules leave the pair (last[i - len(t)], t) as it is; the pair test depends on
two ids only and is memoised. What is stored for a piece is its count at every character prefix. Sums
of the pieces' last counts give the count of a whole text; the counts inside a piece that crosses a
budget give the longest prefix within it, so that neither question needs a second encoding.

Nulls: a null text counts as empty; ids and repeated rows pass through unchanged. Special strings in
a text are one token each, as the library has it by default; a prefix that ends inside one counts
what it has of it as plain text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lamina.llm.pieces import MEMO_LIMIT, Pieces, byte_letters, runs


class PrefixCounter:
    """Counts of one byte-level BPE vocabulary file. Words are written with one letter per byte."""

    def __init__(self, path: str):
        import public_tokenizers

        with open(path, encoding="utf-8") as f:
            self.vocab: dict[str, int] = json.load(f)["model"]["vocab"]
        self.tokenizer = Tokenizer.from_file(path)
        self.marks = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        for mark in self.marks:
            self.vocab.pop(mark, None)
        self.tokens = {v: k for k, v in self.vocab.items()}
        self.longest = max(map(len, self.vocab))
        self.pairs: dict[int, bool] = {}
        self.words = regex.compile(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.spaces = regex.compile(r"\p{White_Space}+")
        self.memo = Pieces(False, self.stored_counts, lambda text: np.array(self.text_prefixes(text)[1:], dtype="<u4"), with_space=True, running=True)

    def stays(self, a: int, b: int) -> bool:
        """Whether the merge rules leave the tokens a, b as they are, side by side."""
        key = a << 20 | b
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) > 2 * MEMO_LIMIT:
                self.pairs.clear()
            known = self.pairs[key] = [t.id for t in self.tokenizer.model.tokenize(self.tokens[a] + self.tokens[b])] == [a, b]
        return known

    def prefix_counts(self, word: str) -> list[int]:
        """count[i] for the first i bytes of one pre-token; count[0] is 0."""
        token_of, stays, pairs, longest = self.vocab.get, self.stays, self.pairs.get, self.longest
        last, count = [-1], [0]
        for i in range(1, len(word) + 1):
            for j in range(i - longest if i > longest else 0, i):
                token = token_of(word[j:i])
                if token is not None and (not j or ((known := pairs(last[j] << 20 | token)) is None and stays(last[j], token)) or known):
                    last.append(token)
                    count.append(count[j] + 1)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return count

    def text_total(self, text: str) -> int:
        return sum(self.prefix_counts(byte_letters(w))[-1] for w in self.words.findall(text))

    def stored_counts(self, piece: str) -> np.ndarray:
        return np.array(self.piece_prefixes(piece)[1:], dtype="<u4")

    def counts(self, texts: list[str], budget: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of every text, and the characters of its longest prefix of at most budget tokens."""
        flat, n_chars = self.memo.encode(texts)
        ends = np.cumsum(n_chars)
        total = np.where(n_chars > 0, np.append(flat, 0)[np.maximum(ends - 1, 0)], 0).astype(np.int64)
        fit = n_chars.copy()
        for k in np.flatnonzero(total > budget):
            within = np.flatnonzero(flat[ends[k] - n_chars[k]:ends[k]] <= budget)
            fit[k] = within[-1] + 1 if len(within) else 0
        return total, fit

    def piece_prefixes(self, piece: str) -> list[int]:
        """Count of every character prefix of a piece; index 0 is the empty prefix. One pass over the piece's bytes."""
        out = [0] * (len(piece) + 1)
        for found in self.words.finditer(piece):
            start, end = found.span()
            if found[0][0] == "'" and found[0][1:].isalpha():
                # a cut contraction is two words
                inside = [self.text_total(found[0][:k]) for k in range(1, end - start + 1)]
            else:
                inside = self._char_counts(found[0])
            out[start + 1:end + 1] = [out[start] + n for n in inside]
        for found in self.spaces.finditer(piece):
            # white space at the end of a prefix is one word, whatever follows in the piece
            start, end = found.span()
            out[start + 1:end + 1] = [out[start] + n for n in self._char_counts(found[0])]
        return out

    def _char_counts(self, word: str) -> list[int]:
        """Counts at the ends of a word's characters."""
        counts = self.prefix_counts(byte_letters(word))
        return [counts[n] for n in accumulate(len(c.encode()) for c in word)]

    def text_prefixes(self, text: str) -> list[int]:
        """Count of every character prefix of a text, special strings included; index 0 is the empty prefix."""
        parts = regex.split("(" + "|".join(map(regex.escape, self.marks)) + ")", text) if self.marks else [text]
        out, plain, done = [0], "", 0
        for part in parts:
            if part in self.marks:
                # cut short, the mark goes on as plain text from what stands before it
                out += [done + self.text_total(plain + part[:k]) for k in range(1, len(part))]
                done = out[-len(part)] + 1
                out.append(done)
                plain = ""
            else:
                out += [done + n for n in self.piece_prefixes(part)[1:]]
                plain = part
        return out

    def all_prefixes(self, texts: list[str]) -> list[list[int]]:
        """Exact token count of every character prefix of each text; element 0 is the empty prefix."""
        flat, n_chars = self.memo.encode(texts)
        return [[0, *own.tolist()] for own in np.split(flat, np.cumsum(n_chars)[:-1])]


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def _count(batches: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    own = counter(path)
    for batch in batches:
        texts = [x or "" for x in batch.column(1).to_pylist()]
        for lo, hi in runs(texts):
            part = texts[lo:hi]
            total, fit = own.counts(part, limit)
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array([len(x.encode()) for x in part], pa.int64()), pa.array(total), pa.array(total > limit), pa.array(fit, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """Per row of docs (doc_id, text): bytes, tokens, whether over the limit, and the characters of a prefix within it."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        partial(_count, path=tokenizer, limit=limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long"
    )


def _prefix_rows(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = counter(path)
    for batch in batches:
        texts = [x or "" for x in batch.column(1).to_pylist()]
        for lo, hi in runs(texts):
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(own.all_prefixes(texts[lo:hi]), pa.list_(pa.int32()))], ["doc_id", "prefix_tokens"])


def prefix_table(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, prefix_tokens: element i is the token count of the text's first i characters."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(partial(_prefix_rows, path=tokenizer), "doc_id long, prefix_tokens array<int>")
