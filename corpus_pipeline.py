"""A training-data pipeline over ``documents``: filter, deduplicate, mask secrets, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and reread
as the next stage's documents. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tipscope.llm.common import table
from tipscope.llm.retrieval_packing import packed_pieces
from tipscope.llm.secret_scan import without_secrets
from tipscope.llm.set_join import keep_first
from tipscope.llm.subword_classifier import keep_quality
from tipscope.llm.weak_rules import keep_good
from tipscope.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules take for good."""
    return keep_good(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good. It learns from the labels of all documents:
    of those that the rules keep, hardly any is labelled bad."""
    return keep_quality(docs, table(spark, sf_dir, "labels"),
                        taught_by=table(spark, sf_dir, "documents"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group: shingles of five words, similarity 0.8 or more."""
    return keep_first(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked."""
    return without_secrets(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"),
                           public_tokenizers.PATTERN)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    return packed_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near duplicates", near_duplicates),
    ("secret scans", secret_scans),
    ("packing", packing),
]

#: A learned classifier and a tokenizer's packing are not SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
