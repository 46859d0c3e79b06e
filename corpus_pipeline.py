"""From raw documents to packed training sequences.

Every stage takes ``(spark, docs, sf_dir)``, works on all that the stage before
kept, and returns the columns of ``documents``; the last returns the pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import neardup, packing, quality, substrings
from auditlake.llm.scratch import discard, materialize, scratch_scope
from auditlake.sources.spread import spread


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.7 or more; the others go.

    Null and empty texts are scored like others.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = quality.score_column(spark, quality.fit_quality(docs, labels), F.col("text"))
    return docs.filter(score >= 0.7)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id.

    Each row is a document: rows that share an id, or have none, are told apart
    by their texts, and go only if they are near-duplicates.  Rows without words stay.
    """
    return neardup.keep_one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages of 50 words that occur more than once.

    A document that loses all of its words stays, with an empty text; null texts stay null.
    """
    return substrings.remove_repeats(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens, a row per piece; null texts are the end id alone."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("best-fit packing", best_fit_packing),
]

#: A trained classifier can't be put in SQL; tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, make in STAGES:
        done = docs
        with scratch_scope():
            made = make(spark, done, sf_dir)
            docs = materialize(made, name.replace(" ", "-"), kept=True)
        discard(done)
    return docs
