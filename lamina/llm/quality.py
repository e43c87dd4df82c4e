"""Operator 7: quality rules, judged together by an isolation forest on their statistics.

Random splits isolate rows with unusual rule statistics after few steps. The forest is fitted on a
bounded sample of labelled rows (mostly good ones), every document is scored by its mean path
length, and the threshold comes from the scores of all labelled rows. Plain base rules stay in force.

Nulls and empty texts have no words and fail the base rules. Repeated rows are kept. Without any
labelled rows of quality 1, only the base rules decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.scratch import stored

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rule statistics that the forest splits on. Repeats have a base rule of their own; digits and
#: punctuation mark clean documents with addresses or code as unusual, so they are left out.
STATISTICS = ("log_words", "word_length", "symbols", "upper", "line_words", "distinct", "short_words")
#: Bounds of the fit: labelled rows that reach the driver, rows of other quality among them, trees and rows a tree.
SAMPLE, OTHERS, TREES, TREE_ROWS = 20_000, 0.05, 150, 256
#: Part of the labelled good rows that the threshold may reject.
GOOD_LOST = 0.01
BINS = 4000

_SPACE, _SYMBOLS, _UPPER = b" \t\n\r\x0b\x0c", b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    once: set = set()
    twice = {w for w in windows if w in once or once.add(w)}
    upto = total = 0
    for k, w in enumerate(windows):
        if w in twice:
            total += k + 3 - max(k, upto)
            upto = k + 3
    return total


def rule_statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts of a text, and what the forest sees of it."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    without = lambda drop: len(raw) - len(raw.translate(None, drop))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, spaces = len(words), without(_SPACE)
    chars, symbols, dup, repeats = len(text) - spaces, without(_SYMBOLS), len(lines) - len(set(lines)), repeated_words(words)
    per = lambda x, of: x / of if of else 0.0
    seen = [np.log1p(n), per(chars, n), per(symbols, n), per(without(_UPPER), chars), np.log1p(per(n, len(lines))), per(len(set(words)), n) + 0.08 * np.log1p(n), per(sum(len(w) < 4 for w in words), n)]
    return [n, chars, symbols, dup, repeats], seen


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = [rule_statistics(x.as_py()) for x in batch.column(1)]
        counts = np.array([c for c, _ in both], dtype=np.int64).reshape(-1, len(COUNTS))
        seen = np.array([s for _, s in both], dtype=np.float64).reshape(-1, len(STATISTICS))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in counts.T), *(pa.array(c) for c in seen.T)], ["doc_id", *COUNTS, *STATISTICS])


def statistics(docs: DataFrame) -> DataFrame:
    schema = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), *(f"{c} double" for c in STATISTICS)])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_statistics, schema)


# ---------------------------------------------------------------- forest

def usual_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of a failed search among n rows."""
    n = np.asarray(n, dtype=np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(rows: np.ndarray, rng: np.random.Generator, depth: int) -> list[tuple[int, float, int, int, float]]:
    """One tree as (column, split, left, right, path length at a leaf), column -1 at leaves."""
    nodes: list = []

    def add(part: np.ndarray, at: int) -> int:
        own = len(nodes)
        nodes.append((-1, 0.0, own, own, at + float(usual_path(len(part)))))
        low, high = (part.min(axis=0), part.max(axis=0)) if len(part) else (np.zeros(1), np.zeros(1))
        open_ = np.flatnonzero(high > low)
        if at < depth and len(part) > 1 and len(open_):
            column = int(rng.choice(open_))
            split = float(rng.uniform(low[column], high[column]))
            right = part[:, column] > split
            nodes[own] = (column, split, add(part[~right], at + 1), add(part[right], at + 1), 0.0)
        return own

    add(rows, 0)
    return nodes


def fit_forest(rows: np.ndarray, trees: int = TREES, size: int = TREE_ROWS, seed: int = 7) -> list[tuple[np.ndarray, ...]]:
    rng = np.random.default_rng(seed)
    size = min(size, len(rows))
    depth = int(np.ceil(np.log2(max(size, 2)))) + 2
    return [tuple(map(np.array, zip(*grow(rows[rng.choice(len(rows), size, replace=False)], rng, depth), strict=True))) for _ in range(trees)]


def anomaly(rows: np.ndarray, forest: list[tuple[np.ndarray, ...]], size: int) -> np.ndarray:
    """2 ** -(mean path / usual path): near 1 for rows that few splits isolate."""
    total = np.zeros(len(rows))
    all_ = np.arange(len(rows))
    for column, split, left, right, path in forest:
        at = np.zeros(len(rows), dtype=np.int64)
        while (inner := column[at] >= 0).any():
            at = np.where(inner, np.where(rows[all_, np.maximum(column[at], 0)] > split[at], right[at], left[at]), at)
        total += path[at]
    return 2.0 ** -(total / len(forest) / max(float(usual_path(size)), 1e-9))


def _score(batches: Iterator[pa.RecordBatch], forest: list, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.column_stack([np.asarray(batch.column(name)) for name in STATISTICS]) if batch.num_rows else np.zeros((0, len(STATISTICS)))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *COUNTS)), pa.array(anomaly(rows, forest, size))], ["doc_id", *COUNTS, "anomaly"])


def threshold(good: np.ndarray, other: np.ndarray, lost: float = GOOD_LOST) -> float:
    """Upper edge, in bins of the score, above which the most other rows lie while at most a `lost` part of the good ones does.

    Where rejecting fewer good rows costs few others, it prefers to keep: each good row weighs five others.
    """
    above = lambda counts: np.cumsum(counts[::-1])[::-1]
    g, o = above(good) / max(good.sum(), 1), above(other) / max(other.sum(), 1)
    gain = np.where(g <= lost, o - 5 * g, -1.0)
    return (int(np.argmax(gain)) if gain.max() > 0 else len(good)) / len(good)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text), with labels (doc_id, quality): doc_id, base counts, anomaly, base_failed, kept."""
    stats = stored(statistics(docs), "statistics")
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = stats.where(~base_failed).join(known, "doc_id")
    # at most SAMPLE rows of a fixed number of columns reach the driver, for the fit alone
    few = labelled.orderBy(F.xxhash64("doc_id", "n_words")).limit(SAMPLE).select("quality", *STATISTICS).toArrow()
    rows, quality = np.column_stack([np.asarray(few.column(c)) for c in STATISTICS]), np.asarray(few.column("quality"))
    good, other = rows[quality == 1], rows[quality != 1]
    if not len(good):
        return stats.select("doc_id", *COUNTS, F.lit(0.0).alias("anomaly"), base_failed.alias("base_failed"), (~base_failed).alias("kept"))
    rows = np.concatenate([good, other[: int(OTHERS * len(good))]])
    forest, size = fit_forest(rows), min(TREE_ROWS, len(rows))
    scored = stats.mapInArrow(partial(_score, forest=forest, size=size), ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), "anomaly double"]))
    # all labelled rows, as counts per bin
    counts = scored.where(~base_failed).join(known, "doc_id").groupBy(F.least(F.lit(BINS - 1), F.floor(F.col("anomaly") * BINS)).cast("int").alias("bin"), (F.col("quality") == 1).alias("good")).count().collect()
    bins = np.zeros((2, BINS), dtype=np.int64)
    for bin_, is_good, n in counts:
        bins[int(is_good), bin_] += n
    cut = threshold(bins[1], bins[0])
    return scored.select("doc_id", *COUNTS, "anomaly", base_failed.alias("base_failed"), (~base_failed & (F.floor(F.col("anomaly") * BINS) < F.lit(round(cut * BINS)))).alias("kept"))
