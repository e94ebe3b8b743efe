"""From raw documents to packed sequences: language ID, exact dedup, n-gram Jaccard join, best-fit packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import exact_dedup, langid, ngram_jaccard, packing
from marginalia.llm.common import documents, stored
from marginalia.llm.queries import tokenizer_file, tokenizer_pattern
from marginalia.session import importable


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts among them), or in no language that the model tells, go; every
    other row stays, with its columns. Rows that repeat an id are judged each by its text. An empty table gives no
    rows."""
    importable(spark)
    return langid.identified(docs, langid.train(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, null ids lowest; of rows that repeat id and text one. Rows
    that share an id only are other documents. Columns of any name are carried along; an empty table gives no rows."""
    importable(spark)
    return exact_dedup.without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the row of the smallest doc_id stays, null ids last. The stage is operator
    8, with that query's definition of a link: four words and 85 %. Rows without words stay, as do rows that share an id
    with a row that goes but aren't linked with it. Columns of any name are carried along; an empty table gives no
    rows."""
    importable(spark)
    return ngram_jaccard.without_near_copies(docs, width=4, percent=85)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of all that stayed; rows that repeat an id are packed each for itself, a null text as its end
    alone. An empty table gives no rows."""
    importable(spark)
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.tiktoken"), tokenizer_pattern(), capacity=1024, end_id=2)


STAGES = [("language_id", language_id), ("exact_dedup", exact_copies), ("ngram_jaccard", near_copies), ("best_fit_packing", best_fit)]
#: SQL can express neither the trained model nor the tokenizer; tests/llm compares every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`; what one returns is written and read again as the next one's input."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
    return docs
