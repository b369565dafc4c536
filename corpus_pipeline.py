"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents; the last returns each document's tokens.

Stages work on whole texts and handle nulls, empty tables and repeated rows as their operators state. Documents with
null text go in the first stage, which keeps what has a language, unless no row has a label to learn from: then all
stay. The stages set their session's Arrow batches to a few hundred rows, so that workers need little memory beside
executors whose heap is full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import decontaminate, jaccard, language, pii, sentencepieces
from ledgerloom.llm.common import stage_written, table, use_small_batches


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in no language, as far as their text tells, go; a null lang is filled in."""
    use_small_batches(spark)
    return language.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest doc_id stays."""
    use_small_batches(spark)
    return jaccard.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    use_small_batches(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the text becomes [KIND]; every document stays."""
    use_small_batches(spark)
    return pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, tokens, round_trip and the decoded text of every document."""
    use_small_batches(spark)
    return sentencepieces.encode_documents(docs, with_text=True)


STAGES = [
    ("language ID", language_id),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("tokens", tokens),
]

#: The language model, the field's weights and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage_written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
