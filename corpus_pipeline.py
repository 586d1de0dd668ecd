"""From raw documents to token files: five stages, each over all that its predecessor kept.

Every stage is written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontam, mixing, near_dup, quality, token_files
from tidemark.llm.queries import table, tokenizer_file
from tidemark.llm.store import drop, keep, new_path, small_batches


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or score below the threshold go.

    A null or empty text has no words, so it fails. Repeated rows are judged alike, each by its own text; rows without a
    doc_id too, but they are never trusted ones. Without documents or labels: no rows, or scores of 0. Other columns stay as they are.
    """
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    ratios = quality.log_ratios(*quality.ngram_counts(docs, trusted))
    return docs.where(quality.keeps(docs["text"], ratios))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (80 % of five-word shingles) stays."""
    small_batches(spark)
    return near_dup.one_of_each(docs, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none, null and empty items are in none; repeated rows go or stay together. An empty benchmark takes nothing.
    """
    return docs.where(~decontam.contaminated(docs["text"], table(spark, sf_dir, "benchmark")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    A null or empty text has size 0 and its place among those of its size; a null source is one of its own. Rows of one
    source, size and doc_id are interchangeable; repeated rows count one by one. No documents give no rows.
    """
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The index of the token files; copies of a document follow each other.

    A null text is an empty one: its end id alone. Rows without a doc_id come first. No documents give no rows.
    """
    small_batches(spark)
    path = new_path(spark, "tokens")
    token_files.write_tokens(docs, path, tokenizer_file(), end_id=1)
    return token_files.token_index(spark, path)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("tokens", tokens),
]

#: The likelihood ratio over hashed n-grams and the tokenizer are not SQL; see tests/llm.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, last = keep(stage(spark, docs, sf_dir), name), docs
        if last is not before:
            drop(last)
    return STAGES[-1][1](spark, docs, sf_dir)
