"""Operator 9: secret scans [native] with corpus-wide ownership frequency.

The base rules find assignments, access keys and hex strings. Further candidates (provider tokens,
bearer values, private-key headers, upper-case hex) are hashed, and each hash's distinct
repositories and owners are counted over the whole corpus: a value held by many owners is a widely
copied example, and so is one of few owners that fills more of their repositories than nearly all other
values of few owners do (`UNUSUAL` of them, over all rows). The rest looks live and its span is added.
Base spans always stay.

Offsets are in code points, ends exclusive. Nulls: a null text is empty; a null owner or repository
counts as one of its own. Repeated rows are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.scratch import stored

# The base rules and, after them, formats of published credential kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
PROVIDER = r"gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9]{20,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
BEARER = r"(?:Bearer|bearer|BEARER)\x20+[A-Za-z0-9._~+/=-]{20,}"
HEADER = r"-----BEGIN[A-Z\x20]*PRIVATE\x20KEY-----"
UPPER_HEX = r"(?<![0-9A-Za-z])[0-9A-F]{32,}(?![0-9A-Za-z])"
BASE = ("assign", "access", "hex")
EXTRA = {"provider": PROVIDER, "bearer": BEARER, "header": HEADER, "upperhex": UPPER_HEX}

#: Part of the values of few owners that are in no more repositories than the limit, and the least limit.
UNUSUAL, LEAST_LIMIT = 0.99, 5
#: Values of so many repositories that are no live ones are put aside before anything is joined by value.
HOT = 10_000

SPANS = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"


def spans_of(text: Column, kind: str, rank: int, pattern: str, value: int = 0) -> Column:
    """All leftmost non-overlapping matches: what lies between them gives their places."""
    lengths = lambda parts: F.transform(parts, F.char_length)
    rows = F.arrays_zip(
        lengths(F.split(text, pattern, -1)).alias("gap"), lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("size"), F.regexp_extract_all(text, F.lit(pattern), F.lit(value)).alias("value")
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(a: Column, r: Column) -> Column:
        start = a["at"] + r["gap"]
        end = start + F.coalesce(r["size"], F.lit(0))
        one = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), r["value"].alias("value"))
        # the text after the last match has no match of its own
        return F.struct(end.alias("at"), F.when(r["size"].isNotNull(), F.concat(a["out"], F.array(one))).otherwise(a["out"]).alias("out"))

    return F.aggregate(rows, zero, step)["out"]


def _where(test: Column, spans: Column) -> Column:
    return F.when(test, spans).otherwise(F.array().cast(SPANS))


def found_spans(docs: DataFrame, owner: str, repository: str) -> DataFrame:
    """doc_id, owner, repository, base spans and further candidates of every row."""
    text = F.col("text")
    rows = docs.select("doc_id", F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    long_enough = lambda n: lambda s: F.char_length(s["value"]) >= n
    assign = _where(text.rlike(ASSIGN), F.filter(spans_of(text, "assign", 0, ASSIGN, 2), long_enough(8)))
    access = _where(F.contains(text, F.lit("AKIA")), F.filter(spans_of(text, "access", 1, ACCESS), long_enough(16)))
    hexes = _where(text.rlike(HEX), spans_of(text, "hex", 2, HEX))
    base = rows.select("doc_id", "owner", "repository", "text", F.concat(assign, access, hexes).alias("base"))
    hint = {"provider": text.rlike(r"gh[pousr]_|xox[abprs]-|sk-|eyJ"), "bearer": text.rlike("(?:Bearer|bearer|BEARER)\\x20"), "header": F.contains(text, F.lit("-----BEGIN")), "upperhex": text.rlike(UPPER_HEX)}
    extra = F.concat(*(_where(hint[kind], spans_of(text, kind, 3 + n, pattern)) for n, (kind, pattern) in enumerate(EXTRA.items())))
    return base.select("doc_id", "owner", "repository", F.array_sort("base").alias("base"), F.array_sort(extra).alias("extra"), F.xxhash64("text").alias("key"))


def ownership(candidates: DataFrame) -> DataFrame:
    """candidates (hash, owner, repository) -> hash, n_owners, n_repositories, counted in steps that combine before each shuffle."""
    repos = candidates.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
    owners = repos.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return owners.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))


def scan_secrets(docs: DataFrame, owner: str = "source", repository: str = "doc_id", max_owners: int = 2) -> DataFrame:
    """Per row of docs (doc_id, text, owner, repository): doc_id, base and added spans, how many look live.

    Columns: doc_id, base array<struct>, added array<struct>, n_live, n_copied (of all candidates).
    """
    found = stored(found_spans(docs, owner, repository), "spans")
    empty = F.size("base") + F.size("extra") == 0
    none = found.where(empty).select("doc_id", "base", F.col("extra").alias("added"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_copied"))
    held = found.where(~empty)
    spread = held.select("doc_id", "owner", "repository", "key", F.explode(F.concat("base", "extra")).alias("span")).withColumn("hash", F.sha2(F.col("span.value"), 256))
    owned = stored(ownership(spread.select("hash", "owner", "repository")), "ownership")
    few = F.col("n_owners") <= max_owners
    usual = owned.where(few).agg(F.percentile_approx("n_repositories", UNUSUAL)).first()[0] or 0
    is_live = few & (F.col("n_repositories") <= max(usual, LEAST_LIMIT))
    live, hot = owned.where(is_live).select("hash"), owned.where(~is_live & (F.col("n_repositories") > HOT)).select("hash")
    # what is live is in few repositories, so that no value's rows pile up in the join that is left
    spread = spread.join(hot, "hash", "left_anti").join(live, "hash", "left_semi")
    judged = spread.groupBy("doc_id", "owner", "repository", "key").agg(
        F.collect_set(F.when(F.col("span.rank") >= len(BASE), F.col("span"))).alias("kept"), F.collect_set(F.struct("span.start", "span.rank")).alias("live")
    )
    keys = ["doc_id", "owner", "repository", "key"]
    left, right = held.alias("l"), judged.alias("r")
    both = left.join(right, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys], "left")
    # an added span that a base span already covers says nothing new
    kept = F.coalesce("r.kept", F.array().cast(SPANS))
    new = F.filter(F.array_sort(kept), lambda s: ~F.exists("l.base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    n_live = F.coalesce(F.size("r.live"), F.lit(0))
    n_live = F.greatest(n_live, F.lit(0)).cast("long")
    return none.unionByName(both.select("l.doc_id", "l.base", new.alias("added"), n_live.alias("n_live"), (F.size("l.base") + F.size("l.extra") - n_live).cast("long").alias("n_copied")))


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
