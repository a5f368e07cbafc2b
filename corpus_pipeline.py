"""The corpus pipeline: quality rules, language, near duplicates, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import language_id, packing, personal_data, quality_rules, shingle_join
from millrace.llm.shared import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression bands reject go; the lower limits are fitted to all documents.

    Null and empty texts go, as the base rule wants 50 words; equal texts share a verdict, whatever their ids; long texts
    are judged whole; an empty table stays empty; columns pass through as they are.
    """
    return quality_rules.keep_documents(docs, **quality_rules.fit_limits(docs))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language isn't clear go.

    Null and empty texts go; rows with the same text and source share a verdict, whatever their ids; if no row names a
    language, nothing can be judged and all stay; an empty table stays empty; columns pass through.
    """
    return language_id.keep_documents(spark, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document with the smallest id stays.

    Rows without an id, or without words (null and empty texts), stay, as they are like nothing; of rows that repeat the
    kept id all stay; an empty table stays empty; columns pass through.
    """
    return shingle_join.one_of_each(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts gives way to its kind; n_chars follows the text.

    Null texts stay null, empty ones empty; equal texts are changed alike; every row stays; other columns pass through.
    """
    clean = personal_data.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents that are left, as token pieces placed in sequences.

    Null and empty texts are their end id alone; repeated rows are packed each for itself; an empty table gives no pieces.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", private),
    ("packing", packed),
]

#: Compression ratios, trained likelihoods and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to ``documents``; each result is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
