"""A training corpus from raw documents: quality rules, exact and near dedup, personal data, packing.

Every stage takes any table with the columns of documents: nulls in any column, empty and very long texts, repeated rows,
an empty table (which gives an empty one), and further columns, whatever their names, which stay until packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ratewell.llm import exact_dedup, near_dedup, packing, pii, quality_rules
from ratewell.llm.texts import stored


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; a null or empty text has no words and goes. Limits of compression are
    those of this stage's own input. Repeated rows are judged alike."""
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z folded) one row stays: the one with the largest id, and of rows that repeat it the one with the
    largest hash of all columns. A null id stays only where no row of the group has an id."""
    return exact_dedup.drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (shingles of five words, similarity 0.8 or more, which includes 0.8) the document
    with the smallest id stays. Texts without words, and rows with a null id, are linked with nothing and stay."""
    return near_dedup.drop_near(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars is counted anew. A null text stays null."""
    return pii.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its token ids, its sequence and its place there, so that the rows are the
    training corpus; a null or empty text is one piece, its end id."""
    return packing.pack_documents(docs, with_ids=True)


STAGES = [("quality rules", good), ("exact dedup", exact), ("near dedup", near), ("personal data", private), ("packing", packed)]

#: SQL can't express the stages; tests/llm/test_pipeline.py holds them against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in ``sf_dir``; each stage's rows are written once and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
