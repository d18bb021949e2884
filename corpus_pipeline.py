"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlake.llm import decontam, jaccard_join, packing, pii, quality
from ledgerlake.llm.common import settled, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the robust outlier rules keep.

    Null and empty texts go, as they fail the base rule; null languages and sources are groups of their own. Repeated
    rows and documents with equal statistics are judged alike. No documents give none; extra columns stay as they are.
    """
    return quality.keep_clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest ``doc_id`` of each group linked by five-word shingles at 0.8.

    Documents without words and those without a ``doc_id`` are linked with nothing and stay. Repeated rows of the
    smallest ``doc_id`` all stay, as none of them is smaller. No documents give none; extra columns stay.
    """
    return jaccard_join.keep_one(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified passage of the benchmark.

    Null and empty texts hold no passage and stay; items without words are in no document. Repeated rows go or stay
    alike; a score that just reaches its threshold counts as found. No documents or no items take nothing away.
    """
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts masked.

    Null texts stay null and empty ones empty; of overlapping spans the text is masked once. Every row stays, also
    repeated ones; all columns but the text are untouched. No documents give none.
    """
    return pii.mask(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 ids at most.

    A null or empty text is its end id. Repeated rows are packed one by one, next to each other; a null ``doc_id`` comes
    first. Of cuts that cost the same the latest start wins. No documents give no pieces; extra columns are not read.
    """
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", mask_personal_data),
    ("packing", pack_sequences),
]

#: Tokens, spans and components are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settled(docs, f"pipeline-{k}")
    return docs
