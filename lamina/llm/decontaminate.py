"""Operator 2: benchmark decontamination [native], a prefix-filtered set join with exact windows.

Each item yields windows of `size` consecutive words. The words of a window are put in order of
rarity over the whole corpus; a document can only hold the window if it holds the window's rarest
word (the prefix that containment needs), so only occurrences of such words are joined. A candidate
must leave room for the window before and after it (position and length bounds) and is then
compared word by word. The document side is never shuffled before that: words are looked up in
broadcast blocks of at most BLOCK windows, as many rounds as the benchmark needs.

Nulls: a null text has no words; rows with equal doc_id but other texts get results of their own;
repeated rows stay repeated; a null item_id can hit words but is not named. Without windows every
document is clean; an empty table of documents gives none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.scratch import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Windows broadcast at once: about 200 bytes each.
BLOCK = 50_000


def words(text: Column) -> Column:
    """A-Z lower-cased; words are runs of digits, letters a-z and characters beyond ASCII."""
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """items (item_id, text) -> window array<string>, item_id string; once per pair."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1))
    return w.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s, size))).alias("window")).distinct()


def rarest_first(docs_words: DataFrame, windows: DataFrame, vocabulary_bound: int) -> DataFrame:
    """windows (window_id, window) with `token`, the rarest word by its occurrences in all documents, and its place in the window.

    Windows with a word that no document holds are dropped.
    """
    tokens = windows.select("window_id", "window", F.posexplode("window").alias("place", "token"))
    vocabulary = tokens.select("token").distinct()
    if vocabulary.count() <= vocabulary_bound:
        vocabulary = F.broadcast(vocabulary)
    counts = docs_words.select(F.explode("w").alias("token")).join(vocabulary, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    ordered = tokens.join(counts, "token").groupBy("window_id", "window").agg(F.count("*").alias("found"), F.min(F.struct("n", "token", "place")).alias("first"))
    return ordered.where(F.col("found") == F.size("window")).select("window_id", "window", "first.token", "first.place")


def window_hits(docs: DataFrame, prefix: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, key, w): a row with n_words for the document itself and one for each hit (start, length, window_id)."""
    # a null word at the end stands for the document, so that one shuffle brings all its rows together
    spread = docs.select("doc_id", "key", "w", F.posexplode(F.concat("w", F.array(F.lit(None).cast("string")))).alias("pos", "token"))
    found = spread.join(F.broadcast(prefix), "token", "left")
    start = F.col("pos") - F.col("place")
    length = F.size("window")
    fits = (start >= 0) & (start + length <= F.size("w"))
    exact = F.slice("w", start + 1, length) == F.col("window")
    hit = F.col("window_id").isNotNull() & F.when(fits, exact).otherwise(False)
    return found.where(F.col("token").isNull() | hit).select(
        "doc_id", "key", F.when(F.col("token").isNull(), F.col("pos")).alias("n_words"), F.when(hit, F.struct(start.alias("start"), (start + length).alias("end"))).alias("span"), F.when(hit, F.col("window_id")).alias("window_id")
    )


def covered(spans: Column) -> Column:
    """Words covered by a set of (start, end)."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["upto"]))).alias("n"), F.greatest(a["upto"], s["end"]).alias("upto"))
    return F.aggregate(F.array_sort(spans), zero, step)["n"].cast("long")


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, block: int = BLOCK) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, key (content hash), n_words, n_hit, items array<string>, spans."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), words(F.col("text")).alias("w"))
    pairs = item_windows(items, size)
    windows = pairs.select("window").distinct().select(F.sha2(F.concat_ws(" ", "window"), 256).alias("window_id"), "window")
    prefix = rarest_first(rows, windows, block)
    n = windows.count()
    rounds = max(1, -(-n // block))
    if rounds == 1:
        hits = window_hits(rows, prefix)
    else:
        parts = [prefix.where(F.pmod(F.xxhash64("window_id"), F.lit(rounds)) == k) for k in range(rounds)]
        hits = reduce(DataFrame.unionByName, (window_hits(rows, p) for p in parts))
    per_doc = hits.groupBy("doc_id", "key").agg(
        F.max("n_words").alias("n_words"), (F.count("n_words") / rounds).cast("int").alias("copies"), F.collect_set("span").alias("spans"), F.collect_set("window_id").alias("window_ids")
    )
    per_doc = stored(per_doc, "hits")  # both kinds of documents come from it
    named = pairs.select(F.sha2(F.concat_ws(" ", "window"), 256).alias("window_id"), "item_id")
    clean = per_doc.where(F.size("spans") == 0).select("doc_id", "key", "n_words", "copies", "spans", F.array().cast("array<string>").alias("items"))
    hit = per_doc.where(F.size("spans") > 0)
    hit = hit.select("*", F.explode("window_ids").alias("window_id")).join(F.broadcast(named) if n <= block else named, "window_id")
    hit = hit.groupBy("doc_id", "key").agg(F.first("n_words").alias("n_words"), F.first("copies").alias("copies"), F.first("spans").alias("spans"), F.sort_array(F.collect_set("item_id")).alias("items"))
    both = clean.unionByName(hit)
    return both.select("doc_id", "key", F.col("n_words").cast("long").alias("n_words"), covered(F.col("spans")).alias("n_hit"), "items", F.array_sort("spans").alias("spans"), F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("_")).drop("_")


def without_contaminated(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """The rows of docs, all columns as they are and of any names, that hold no window of an item."""
    at = {name: f"c{k}" for k, name in enumerate(docs.columns)}
    rows = docs.toDF(*at.values())
    found = contamination(rows.select(F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text")), items, size)
    hit = stored(found.where("n_hit > 0").select(F.col("doc_id").alias("hit_doc_id"), F.col("key").alias("hit_key")).distinct(), "contaminated")
    return rows.join(hit, F.col(at["doc_id"]).eqNullSafe(F.col("hit_doc_id")) & (F.xxhash64(at["text"]) == F.col("hit_key")), "left_anti").toDF(*docs.columns)
