"""The ten queries with their production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import exact_dedup, langid, line_dedup, ngram_jaccard, packing, pieces, ppm, token_counts, topk, url_filter
from marginalia.llm.common import documents


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_ids(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(documents(spark, sf_dir), min_chars=16)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.identify(docs, langid.train(docs))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.lm_scores(documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_tokens(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.tiktoken"), tokenizer_pattern(), rule="first")


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return topk.search(docs, docs.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text"), k=10)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(documents(spark, sf_dir), width=4, percent=85)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.tiktoken"), tokenizer_pattern(), capacity=1024, end_id=2)


HOST_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
PATTERN_RULES = (
    url_filter.PatternRule("adult host", r"://([^/?#]*\.)?adult-[^/?#]*", ("adult",)),
    url_filter.PatternRule("cheap pills", r"\bcheap-pills\b", ("cheap", "pills")),
    url_filter.PatternRule("spam farm", r"\bspam-farm\b", ("spam", "farm")),
    url_filter.PatternRule("casino", r"\bcasino\b", ("casino",)),
    url_filter.PatternRule("feed copies", r"[?&]utm_source=feed\b.*[?&]utm_medium=copy\b", ("utm", "copy")),
)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(documents(spark, sf_dir, "pages"), HOST_RULES, PATTERN_RULES)


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP10_SQL = f"""
WITH u AS (
  SELECT page_id, coalesce({_LOWER.format("url")}, '') AS low,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
p AS (
  SELECT page_id, low, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
         regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM u),
r AS (
  SELECT page_id, host, path, low,
         CASE WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN regexp_matches(low, '://([^/?#]*\\.)?adult-[^/?#]*') OR regexp_matches(low, '\\bcheap-pills\\b')
              OR regexp_matches(low, '\\bspam-farm\\b') OR regexp_matches(low, '\\bcasino\\b')
              OR regexp_matches(low, '[?&]utm_source=feed\\b.*[?&]utm_medium=copy\\b') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_line_dedup": op2_line_dedup,
    "op3_language_id": op3_language_id,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_token_counts": op5_token_counts,
    "op6_topk_search": op6_topk_search,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_url_filters": op10_url_filters,
}
ORACLE_SQL: dict[str, str] = {"op7_exact_dedup": OP7_SQL, "op10_url_filters": OP10_SQL}
