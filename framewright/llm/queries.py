"""The queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language, licenses, mixing, quality, simhash, substrings, token_counts, token_files, urls


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_files.token_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_summary(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = spark.createDataFrame(urls.RULES + urls.LISTED, urls.ENTRIES)
    return urls.judge(table(spark, sf_dir, "pages"), entries).select("page_id", "host", "path", "rule", "verdict")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "_fw_cut.*")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.quality(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def queries() -> dict:
    return {f.__name__: f for f in (op1_mixing, op2_token_files, op3_license_scan, op4_url_filter, op5_token_counts, op6_substring_dedup, op7_language_id, op8_simhash_dedup, op9_quality_rules, op10_decontamination)}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _urls_sql() -> str:
    rows = ", ".join(f"('{h}', '{p}', '{v}', '{k}')" for h, p, v, k in urls.RULES + urls.LISTED)
    return f"""
WITH entries(h, p, v, k) AS (VALUES {rows}),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
          regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fit AS (SELECT s.page_id, s.host, s.path, e.h || e.p AS rule, e.v, e.k, length(e.h || e.p) AS n
        FROM split s LEFT JOIN entries e ON (s.host = e.h OR s.host LIKE '%.' || e.h) AND starts_with(s.path, e.p))
SELECT page_id, host, path, max_by(rule, n) FILTER (WHERE k = 'rule') AS rule,
       coalesce(max_by(v, n) FILTER (WHERE k = 'rule'), CASE WHEN bool_or(coalesce(k = 'listed', false)) THEN 'block' ELSE 'allow' END) AS verdict
FROM fit GROUP BY page_id, host, path"""


def _words_sql(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _decontamination_sql() -> str:
    return f"""
WITH d AS (SELECT doc_id, {_words_sql("text")} AS w FROM documents),
b AS (SELECT item_id, {_words_sql("text")} AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS t
         FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM wins),
grams AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t
          FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS i FROM d, lens)),
found AS (SELECT g.doc_id, g.i, g.n, wins.item_id FROM grams g JOIN wins ON g.n = wins.n AND g.t = wins.t),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filter": _urls_sql(), "op10_decontamination": _decontamination_sql()}
