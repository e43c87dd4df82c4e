"""Operator 3: toxicity by maximum-scoring segments.

Words and their beginnings get log-odds of toxic against other labelled documents, smoothed by a
Dirichlet prior in the proportions of both together and shrunk by how likely it is that chance alone
parts the word so: a likelihood ratio against as many words as were looked at, without a bound below
which words are thrown out. A linear-time scan finds all maximal segments
of a text's word scores. Scores of segments are calibrated as extreme values: with lambda and K of
the background, -ln(E) = lambda * S - ln(K * n) for a text of n words. A logistic curve over that and
the number of significant passages gives the score.

Nulls and empty texts have no segments and get the score of a text without toxic words. Repeated rows
are kept; a row without doc_id is scored like any other and never learnt from; it is in neither fold (held_out is null). Without labels of both
kinds every score is 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.scratch import stored

#: Bound of the fit: labelled rows. Beginnings of words that count as tokens.
MAX_ROWS, BEGINNINGS = 20_000, (4, 6)
#: Prior weight in documents, and what every word costs a segment.
PRIOR, DRIFT = 25.0, 0.25
#: Decimals of a score; what rounds to nothing scores nothing.
DECIMALS = 2
#: A passage is significant below this E-value.
SIGNIFICANT = 0.05
MEMO_LIMIT = 150_000

_WORD = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)]


class Scores(dict):
    """word -> score, from the word's feature with the strongest evidence."""

    def __init__(self, model: dict[str, tuple[float, float]]):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) > MEMO_LIMIT:
            self.clear()
        known = [self.model[f] for f in features(word) if f in self.model]
        value = self[word] = (max(known, key=lambda x: abs(x[1]))[0] if known else 0.0) - DRIFT
        return value


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in one pass over the scores."""
    # each open segment: start, end, total before it, total at its end
    found: list[tuple[int, int, float, float]] = []
    total = 0.0
    for k, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, left = k, before
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j -= 1
            if j < 0 or found[j][3] >= total:
                found.append((start, k + 1, left, total))
                break
            start, left = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, r - l) for a, b, l, r in found]


def segments_of(text: str | None, scores: Scores) -> tuple[int, list[tuple[int, int, float]]]:
    own = list(map(scores.__getitem__, tokens(text)))
    return len(own), maximal_segments(own) if own and max(own) > 0 else []


# ---------------------------------------------------------------- fit

def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            counts[toxic].update({f for w in set(tokens(text.as_py())) for f in features(w)})
    names = list(counts[0].keys() | counts[1].keys())
    for lo in range(0, len(names), 50_000):
        part = names[lo:lo + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array([c[f] for f in part], pa.int64()) for c in counts)], ["feature", "n0", "n1"])


MEASURED = "toxic int, n long, best double, values array<double>, counts array<long>"


def _measure(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    """Per text its words and best segment; from each task one row more, with how often each score occurs in clean texts."""
    scores, held = Scores(model), Counter()
    kinds = [pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int64())]
    names = [x.split()[0] for x in MEASURED.split(", ")]
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names)
    for batch in batches:
        rows = []
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            n, found = segments_of(text.as_py(), scores)
            if not toxic:
                held.update(map(scores.__getitem__, tokens(text.as_py())))
            rows.append((toxic, n, max((s for _, _, s in found), default=0.0), None, None))
        yield table(rows)
    # scores are rounded, so that there are few of them whatever the texts' lengths
    yield table([(None, None, None, list(held.keys()), list(held.values()))])


def _inputs(batches: Iterator[pa.RecordBatch], model: dict, lam: float, log_k: float) -> Iterator[pa.RecordBatch]:
    scores = Scores(model)
    for batch in batches:
        rows = []
        for text in batch.column(0):
            n, found = segments_of(text.as_py(), scores)
            rows.append(inputs(n, [s for _, _, s in found], lam, log_k))
        x = np.array(rows, dtype=np.float64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(x[:, k]) for k in range(3))], ["toxic", "x0", "x1", "x2"])


def solve_lambda(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum p * exp(lambda * s) = 1 for background scores of negative mean."""
    p = weights / weights.sum()
    value = lambda x: float((p * np.exp(np.minimum(x * values, 500))).sum()) - 1
    low, high = 1e-6, 1.0
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def evidence(n: int, best: float, lam: float, log_k: float) -> float:
    """-ln of the E-value of a best segment in n words."""
    return lam * best - log_k - float(np.log(max(n, 1)))


def inputs(n: int, segments: list[float], lam: float, log_k: float) -> list[float]:
    limit = -float(np.log(SIGNIFICANT))
    own = [evidence(n, s, lam, log_k) for s in segments]
    return [1.0, min(40.0, max([0.0, *own])), float(np.log1p(sum(e > limit for e in own)))]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame) -> dict | None:
    """Learn from at most MAX_ROWS labelled rows outside the held-out fold, taken in the order of a hash of their id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)").where(F.coalesce(~held_out(F.col("doc_id")), F.lit(False)))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id")).limit(MAX_ROWS)
    # bounded by MAX_ROWS, so texts of the fit are picked out where they lie
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id").select("text", "toxic")
    rows = stored(rows, "labelled")
    n = dict(rows.groupBy("toxic").count().collect())
    if not (n.get(0) and n.get(1)):
        return None
    counted = stored(rows.mapInArrow(_count_features, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where("n0 + n1 >= 3"), "features")
    share = (F.col("n0") + F.col("n1") + 1) / (n[0] + n[1] + 2)
    a, b = PRIOR * share, PRIOR * (1 - share)
    odds = lambda y, total: F.log((F.col(y) + a) / (total - F.col(y) + b))
    delta = odds("n1", n[1]) - odds("n0", n[0])
    # the root of the likelihood ratio, which holds for words that one side never has; Wald's z is small for just these
    both = (F.col("n0") + F.col("n1")) / (n[0] + n[1])
    part = lambda y, total, p: F.when(y > 0, y * F.log(y / (total * p))).otherwise(0.0)
    ratio = sum((part(F.col(y), n[k], both) + part(n[k] - F.col(y), n[k], 1 - both) for k, y in enumerate(("n0", "n1"))), F.lit(0.0))
    z = F.signum(delta) * F.sqrt(F.greatest(2 * ratio, F.lit(0.0)))
    score = F.round(delta / (1 + counted.count() * F.exp(-z * z / 2)), DECIMALS)
    # what chance explains is rounded away: as many words stay as the labelled texts give evidence for
    top = counted.select("feature", score.alias("score"), z.alias("z")).where("score <> 0").collect()
    model = {r.feature: (float(r.score), float(r.z)) for r in top}
    few = rows.mapInArrow(partial(_measure, model=model), MEASURED).toArrow().to_pylist()
    held = Counter()
    for r in few:
        held.update(dict(zip(r["values"] or (), r["counts"] or (), strict=True)))
    values, weights = np.array([*held.keys()] or [-DRIFT]), np.array([*held.values()] or [1.0], dtype=float)
    if not (values > 0).any():
        values, weights = np.append(values, 1.0), np.append(weights, 1.0)
    if (values * weights).sum() >= 0:  # the background's mean is negative, if only by the words that no feature scores
        values, weights = np.append(values, -DRIFT), np.append(weights, 1 + (values * weights).sum() / DRIFT)
    lam = solve_lambda(values, weights)
    clean = [r for r in few if r["toxic"] == 0]
    best, n_words = np.array([r["best"] for r in clean]), np.array([r["n"] for r in clean], dtype=float)
    # the mean of a Gumbel variable of this kind is (ln K + ln n + 0.5772) / lambda; texts without a segment count as best 0
    log_k = float(np.mean(lam * best - np.log(np.maximum(n_words, 1)))) - 0.5772 if (best > 0).any() else -float(np.log(max(float(n_words.mean()), 1.0)))
    x = rows.mapInArrow(partial(_inputs, model=model, lam=lam, log_k=log_k), "toxic int, x0 double, x1 double, x2 double").toArrow()
    y = np.asarray(x.column(0), dtype=float)
    return {"features": model, "lambda": lam, "log_k": log_k, "weights": logistic(np.column_stack([np.asarray(x.column(k)) for k in (1, 2, 3)]), y)}


# ---------------------------------------------------------------- scoring

PASSAGES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def _score(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    scores, lam, log_k, weights = Scores(model["features"]), model["lambda"], model["log_k"], model["weights"]
    limit = -float(np.log(SIGNIFICANT))
    for batch in batches:
        values, passages = [], []
        for text in batch.column(1):
            n, found = segments_of(text.as_py(), scores)
            values.append(1 / (1 + np.exp(-float(np.dot(inputs(n, [s for _, _, s in found], lam, log_k), weights)))))
            passages.append([{"start": a, "end": b, "score": s} for a, b, s in found if evidence(n, s, lam, log_k) > limit])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64()), pa.array(passages, PASSAGES)], ["doc_id", "score", "passages"])


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text), learnt from labels (doc_id, toxic): doc_id, score, passages (word spans)."""
    model = fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.array().cast("array<struct<start:int,end:int,score:double>>").alias("passages"))
    return rows.mapInArrow(partial(_score, model=model), "doc_id long, score double, passages array<struct<start:int,end:int,score:double>>")


def _score_rows(batches: Iterator[pa.RecordBatch], model: dict, at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pair = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(at)], ["doc_id", "text"])
        for scored in _score(iter([pair]), model):
            yield pa.RecordBatch.from_arrays([*batch.columns, scored.column(1)], [*batch.schema.names, "score"])


def without_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The rows of docs, all columns as they are, whose score is below limit. Nothing is shuffled."""
    model = fit(docs, labels)
    if model is None:
        return docs
    # positions, not names: columns of docs may have any name
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema) + ", score double"
    kept = plain.mapInArrow(partial(_score_rows, model=model, at=docs.columns.index("text")), schema).where(F.col("score") < limit)
    return kept.drop("score").toDF(*docs.columns)
