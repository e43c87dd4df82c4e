"""Operator 5: URL filter [native]. Longest rule wins; a blocked Bloom filter and an exact join serve the list.

Listed canonical URLs set bits in 256-bit blocks (four words of 64 bits). A page whose canonical URL
finds all its bits set passes on to the exact hash join with the list, which removes the false
positives; all other pages skip that join's shuffle.

Nulls and URLs without '://' have an empty host and path, no rule, and are allowed. Repeated rows
keep their own results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 4
#: Bits set per URL, and blocks per listed URL: about 12 bits a URL.
BITS, BLOCKS_PER_URL = 6, 12 / 256
#: Largest filter that is broadcast, in blocks (about 40 MB); a larger one is joined by block.
BROADCAST_BLOCKS = 1 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.concat(url, F.lit("")), "://", 1))
    after = F.when(rest.isNotNull(), url.substr(F.char_length(rest) + 4, F.char_length(url)))
    host = F.coalesce(F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))
    path = F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def canonical(host: Column, path: Column) -> Column:
    """One spelling for a page's usual variants: no www. or m., no .html, index or closing slash, no query."""
    return F.concat(F.regexp_replace(host, r"^(?:www|m)\.", ""), F.lit("/"), F.regexp_replace(F.regexp_replace(path, r"(?:/index)?(?:\.html?)?/*$", ""), r"^/+", ""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of a few rules (verdict, host, path) that fits; null: none."""
    rule = verdict = None
    for what, on, under in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(under)
        put = lambda c, v: F.when(fits, F.lit(v)) if c is None else c.when(fits, F.lit(v))  # noqa: B023, E731
        rule, verdict = put(rule, on + under), put(verdict, what)
    empty = F.lit(None).cast("string")
    return (empty, empty) if rule is None else (rule, verdict)


def _hashed(url: Column, blocks: int) -> tuple[Column, list[Column]]:
    """A URL's block and its bits in each word of it."""
    first, second = F.xxhash64(url, F.lit(1)), F.xxhash64(url, F.lit(2))
    words = [F.lit(0).cast("long")] * WORDS
    for k in range(BITS):
        # eight bits of the second hash choose each bit of the block
        place = F.shiftrightunsigned(second, 8 * k).bitwiseAND(F.lit(255))
        for w in range(WORDS):
            mine = F.shiftright(place, 6) == w
            words[w] = words[w].bitwiseOR(F.when(mine, F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))).otherwise(F.lit(0).cast("long")))
    return F.pmod(first, F.lit(blocks)).alias("block"), [w.alias(f"need{n}") for n, w in enumerate(words)]


def bloom(listed: DataFrame, url: str, blocks: int) -> DataFrame:
    """Blocks of the filter: block, bits0..bits3."""
    block, words = _hashed(F.col(url), blocks)
    return listed.select(block, *words).groupBy("block").agg(*(F.bit_or(f"need{n}").alias(f"bits{n}") for n in range(WORDS)))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """pages (page_id, url) against rules and listed (canon): page_id, host, path, rule, verdict, canon, possible."""
    listed = listed.select(F.col("canon")).where(F.col("canon").isNotNull()).distinct()
    blocks = max(1, int(listed.count() * BLOCKS_PER_URL) + 1)
    filter_ = bloom(listed, "canon", blocks)
    if blocks <= BROADCAST_BLOCKS:
        filter_ = F.broadcast(filter_)
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"), canonical(F.col("host"), F.col("path")).alias("canon"))
    block, words = _hashed(F.col("canon"), blocks)
    tested = rows.select("*", block, *words).join(filter_, "block", "left")
    passes = F.lit(True)
    for n in range(WORDS):
        passes = passes & (F.coalesce(F.col(f"bits{n}"), F.lit(0)).bitwiseAND(F.col(f"need{n}")) == F.col(f"need{n}"))
    tested = tested.withColumn("possible", passes).select("page_id", "host", "path", "rule", "ruled", "canon", "possible")
    exact = listed.select(F.col("canon").alias("possible_canon"), F.lit(True).alias("is_listed"))
    # a page that the filter rules out has a null key and matches nothing
    hits = tested.withColumn("possible_canon", F.when(F.col("possible"), F.col("canon")))
    ruled_out = hits.where(F.col("possible_canon").isNull()).withColumn("is_listed", F.lit(None).cast("boolean"))
    checked = hits.where(F.col("possible_canon").isNotNull()).join(exact, "possible_canon", "left").select(*ruled_out.columns)
    both = ruled_out.unionByName(checked)
    return both.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("is_listed"), F.lit("block")), F.lit("allow")).alias("verdict"), "canon", "possible")
