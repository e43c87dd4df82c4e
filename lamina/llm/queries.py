"""Registered queries of the numbered operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import decontaminate, line_dedup, packing, quality, secret_scan, simhash, token_counts, token_output, toxicity, url_filter
from lamina.llm.scratch import new_path

BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")

#: (verdict, host, path) of the contract.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: A list of canonical URLs as published lists have them, made by rule and independent of the pages: these hosts under three domains, in four languages, with the first pages of each.
LISTED_HOSTS, LISTED_DOMAINS, LISTED_LANGS, LISTED_PAGES = ("spam-farm", "casino", "pills", "loans"), ("com", "net", "org"), ("en", "fr", "de", "es"), 800


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "huffman")
    token_output.write_ids(table(spark, sf_dir, "documents"), path, WORD_BPE, end_id=2)
    return token_output.read_digests(spark, path)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), BYTE_BPE, limit=1024)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = lambda xs: F.explode(F.array(*map(F.lit, xs)))
    listed = spark.range(LISTED_PAGES).select("id", values(LISTED_HOSTS).alias("h")).select("id", "h", values(LISTED_DOMAINS).alias("d")).select("id", "h", "d", values(LISTED_LANGS).alias("l"))
    listed = listed.select(F.concat("h", F.lit(".example."), "d", F.lit("/"), "l", F.lit("/"), F.col("id").cast("string")).alias("canon"))
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), BYTE_BPE, end_id=0, size=2048, digest=True)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    kinds = [secret_scan.count_kind(F.col("base"), kind).alias(f"n_{kind}") for kind in secret_scan.BASE]
    return found.select("doc_id", *kinds, F.sha2(secret_scan.listed(F.col("base")), 256).alias("base_sha256"), secret_scan.listed(F.concat("base", "added")).alias("spans"), "n_live", "n_copied")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    removed = F.col("removed")
    return line_dedup.line_report(docs).select("doc_id", "n_lines", F.size(F.coalesce(removed, F.array().cast("array<int>"))).cast("long").alias("n_removed"), F.coalesce(F.concat_ws(",", removed.cast("array<string>")), F.lit("")).alias("removed"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_output, op2_decontamination, op3_toxicity, op4_token_counts, op5_url_filter, op6_simhash, op7_quality, op8_packing, op9_secret_scan, op10_line_dedup)}

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
_LIST = ", ".join(f"(SELECT unnest([{', '.join(map(repr, xs))}]) AS {name})" for xs, name in ((LISTED_HOSTS, "h"), (LISTED_DOMAINS, "d"), (LISTED_LANGS, "l")))
_FITS = [(on + under, what, f"(host = '{on}' OR host LIKE '%.{on}') AND starts_with(path, '{under}')") for what, on, under in sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))]

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
        i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, w[k:k + 9] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
        n AS (SELECT DISTINCT len(win) AS n FROM win),
        g AS (SELECT rid, k, n, w[k:k + n - 1] AS win FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, n WHERE len(w) >= n)),
        hit AS (SELECT rid, k, n, item_id FROM g JOIN win USING (win)),
        c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS p FROM hit) GROUP BY rid),
        s AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT rid, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN c USING (rid) LEFT JOIN s USING (rid)""",
    "op5_url_filter": f"""
        WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        r AS (SELECT *, CASE {" ".join(f"WHEN {fits} THEN '{rule}'" for rule, _, fits in _FITS)} END AS rule, CASE {" ".join(f"WHEN {fits} THEN '{what}'" for _, what, fits in _FITS)} END AS ruled,
          regexp_replace(host, '^(www|m)\\.', '') || '/' || regexp_replace(regexp_replace(path, '(/index)?(\\.html?)?/*$', ''), '^/+', '') AS canon FROM p),
        listed AS (SELECT DISTINCT h || '.example.' || d || '/' || l || '/' || n AS canon FROM {_LIST}, (SELECT unnest(range({LISTED_PAGES})) AS n))
        SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN listed.canon IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict FROM r LEFT JOIN listed USING (canon)""",
}
